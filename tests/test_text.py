import pytest
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.operators import lexical, search
from passagemill.plans.scope import Scope, check_passage_id, values


def one(spark, c, **cols):
    row = {k: v for k, v in cols.items()}
    schema = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).select(c.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("a b!c", "abc"), ("如是我聞", "如是我聞"), ("如是， 我聞。", "如是我聞"), ("0123456789abcdefABCDEF, hello world!", "0123456789abcdefABCDEFhelloworld"), ("", "")])
def test_normalise(spark, raw, want):
    assert one(spark, T.normalize(F.col("t")), t=raw) == want


def test_variants(spark):
    assert one(spark, T.normalize(F.col("t"), {"眾": "衆", "禅": "禪"}), t="眾生 禅") == "衆生禪"
    assert T.merge_variants({"a": "b"}, {"a": "c", "d": "e"}, {"x": "a", "y": "z"}) == {"a": "b", "d": "e", "y": "z"}
    assert one(spark, T.nfkc(F.col("t")), t="ＡＢＣ") == "ABC"


def test_ngrams(spark):
    assert one(spark, T.ngrams(F.col("t"), 2, "cjk"), t="中A國") == ["中國"]
    assert one(spark, T.ngrams(F.col("t"), 2), t="如是如是") == ["如是", "是如", "如是"]
    for gram, low in [("如是如是", True), ("禪禪禪", True), ("abcabc", True), ("如是我聞", False), ("云何云", False)]:
        assert one(spark, T.low_value(F.col("t")), t=gram) is low


def test_offsets_and_distance(spark):
    for text, phrase in [("abcabab", "ab"), ("aaaa", "aa"), ("", "a"), ("x.y.z", "."), ("ab", "abc"), (r"a\Eb\E", r"\E")]:
        want, at = [], text.find(phrase)
        while at >= 0:
            want.append(at)
            at = text.find(phrase, at + len(phrase))
        assert one(spark, T.find_offsets(F.col("t"), phrase), t=text) == want
    pair = T.min_pair_distance(T.find_offsets(F.col("t"), "a"), T.find_offsets(F.col("t"), "b"))
    assert one(spark, pair, t="a..b.....a") == 3
    assert one(spark, T.min_pair_distance(T.find_offsets(F.col("t"), "a"), T.find_offsets(F.col("t"), "b"), ordered=True), t="b.a") is None
    assert one(spark, T.same_sentence(F.col("t"), "a", "b"), t="x a. b") is False
    assert one(spark, T.find_all_offsets(F.col("t"), ["a", "b"]), t="bab") == [0, 1, 2]


def test_small_expressions(spark):
    assert one(spark, T.split_heading_path(F.col("t")), t=" a / b//c ") == ["a", "b", "c"]
    assert one(spark, T.ancestors(F.col("t")), t="a / b / c") == ["a", "a / b", "a / b / c"]
    assert one(spark, T.strip_fascicle(F.col("t")), t="T01n0001_002") == "T01n0001"
    assert one(spark, T.char_set_overlap("abz", F.col("t")), t="xxab") == pytest.approx(2 / 3)
    assert one(spark, T.truncated(F.col("t"), 3), t="abcdef") == "abc…"
    assert one(spark, T.mention_class("趙州", F.col("t"), F.lit("prose")), t="趙州云") == "attributed_saying"
    assert one(spark, T.collapse_whitespace(F.col("t")), t="  a \n b ") == "a b"
    q = [spark.range(1).select(T.quantize(F.lit(w), F.lit(5.0)).alias("x")).first().x for w in (0.0, -1.0, 1.0, 3.0, 5.0, 9.0)]
    assert q[0] == q[1] == 0 and q[4] == q[5] == 255 and q == sorted(q)
    score = lambda v, l: spark.range(1).select(T.hybrid_score(F.lit(v).cast("int"), F.lit(l).cast("int")).alias("x")).first().x  # noqa: E731, E741
    assert score(10, 10) > score(None, 1) > score(1, None) > score(None, None) == 0


def test_driver_helpers():
    assert search.anchors("abcdefg")[:3] == ["abcdefg", "abcdef", "bcdefg"] and len(search.anchors("a" * 20 + "b")) <= 8
    assert search.prefixes("abcdefghijkl") == ["abcdefghijkl", "abcd", "abcdef", "abcdefgh", "abcdefghij"]
    assert search.variants("ab", {"a": "x", "y": "b"}) == ["ab", "xb", "ay"]
    assert [search.language_guess(t) for t in ("禪", "zen", "禪 zen", "12")] == ["zh", "en", "mixed", "unknown"]
    assert lexical.long_common_substrings("xxabcdxx", "yabcdy", 3) == ["abcd", "abc", "bcd"]
    assert lexical.frontier_phrases("abcde", 4, 5) == ["abcde", "abcd", "bcde"]
    assert values(" a, b,a ,,") == ["a", "b"]
    assert Scope() == Scope()
    for bad in ("", " x", "a b", "T01n0001"):
        with pytest.raises(ValueError):
            check_passage_id(bad)
    assert check_passage_id("T01n0001#p1") == "T01n0001#p1"
