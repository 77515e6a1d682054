import random

from passagemill.llm.decontaminate import find
from passagemill.llm.queries import op1_template_windows, table

SF = "/root/testdata/sf0.001"
ITEM = "Anna bought 12 apples for 3 dollars each while Anna also sold 12 pears. How many dollars did Anna spend on apples before she walked 5 km home"


def got(spark, docs, items, **options):
    rows = find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    return {(r.doc_id, r.item_id): r.reworded for r in rows}


def test_passages_of_the_table(spark):
    docs, items = table(spark, SF, "documents").collect(), table(spark, SF, "benchmark").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in (d.text or "")}
    rows = {(r.doc_id, r.item_id) for r in op1_template_windows(spark, SF).collect()}
    assert want and want <= rows
    words = {i.item_id: i.text.split() for i in items}
    text = {d.doc_id: " ".join((d.text or "").split()) for d in docs}
    for d, i in rows - want:
        assert any(" ".join(words[i][k : k + 13]) in text[d] for k in range(max(1, len(words[i]) - 12)))


def test_reworded_and_clean(spark):
    other = ITEM.replace("Anna", "Boris").replace("12", "40").replace("3 dollars", "7 euros").replace("5 km", "9 miles")
    mixed = ITEM
    for name in ("Boris", "Clara", "Dmitri"):
        mixed = mixed.replace("Anna", name, 1)
    for a, b in (("12", "40"), ("12", "41")):
        mixed = mixed.replace(a, b, 1)
    pad = "lorem ipsum dolor sit amet " * 20
    docs = [(1, pad + ITEM + pad), (2, pad + other), (3, pad), (4, ITEM.upper()), (5, " ".join(sorted(ITEM.split()))), (6, mixed), (7, "intro " + " ".join(ITEM.split()[2:17]))]
    for limit in (10**6, 0):
        assert got(spark, docs, [(9, ITEM)], most_broadcast=limit) == {(1, 9): False, (2, 9): True, (4, 9): False, (7, 9): False}


def test_short_items_and_odd_rows(spark, odd, nothing):
    items = [(1, "one two three four five six seven eight nine ten"), (2, "the same line here"), (3, "one two"), (4, None), (5, ""), (None, "x y z w"), (1, "one two three four five six seven eight nine ten")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find(odd, bench).collect()}
    assert found == {(5, 1), (6, 1), (7, 2), (11, 2)}
    assert find(nothing, bench).count() == 0 and find(odd, bench.where("false")).count() == 0


def test_random_texts_are_left_alone(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(r.choices(words, k=300))) for i in range(100)]
    items = [(i, " ".join(r.choices(words, k=30))) for i in range(30)]
    assert got(spark, docs, items) == {}


def test_a_short_item_leaves_the_others_windows_alone(spark):
    long, eight = "a1 b2x c3x d4x e5x f6x g7x h8x i9x j10x k11x l12x m13x n14x o15x p16x q17x r18x", "ein alter baum steht dort am langen weg"
    items = [(1, "nobody knew the answer"), (2, long), (3, eight)]
    docs = [(1, "pad " + " ".join(long.split()[2:11]) + " end"), (2, "und dort ein alter baum steht still"), (3, "but nobody knew the answer then"), (4, " ".join(long.split()[2:15])), (5, "wo " + eight + " ja")]
    for limit in (10**6, 0):
        assert set(got(spark, docs, items, most_broadcast=limit)) == {(3, 1), (4, 2), (5, 3)}


def test_dense_and_longer_names(spark):
    dense = "5 pens cost 12 dollars and 3 books cost 9 euros"
    names = "then Mary Ann walked to the mill while Tom slept and Mary Ann asked the miller for Tom again"
    items = [(1, dense), (2, names), (3, "pens cost books and then walked while asked")]
    docs = [
        (1, "so 7 pens cost 40 euros and 6 books cost 2 dollars ok"), (2, "7 rulers cost 40 euros but 6 maps make 2 dollars ok"),
        (3, "oh " + names.replace("Mary Ann", "Zoe").replace("Tom", "Peter van Dyke".title()) + " yes"), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (5, "oh " + names.lower()),
    ]
    for limit in (10**6, 0):
        assert got(spark, docs, items, most_broadcast=limit) == {(1, 1): True, (3, 2): True, (5, 2): False}
