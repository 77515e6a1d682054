import random
import zlib

import numpy as np

from passagemill.llm.toxicity import counterfactuals, features_of, fit, held_out, keep_clean, score, train, words_in


def features(text):
    return np.array(sorted({f for w in words_in(text) for f in features_of(w)}), np.int32)


GROUPS = ["muslims christians jews"]


def sentences(n, seed, share):
    r, rows = random.Random(seed), []
    neutral = "the town met in green hall by river and spoke of rain on roofs".split()
    for _ in range(n):
        toxic = r.random() < 0.4
        words = r.choices(neutral, k=9)
        if toxic and r.random() < 0.85:
            words[r.randrange(9)] = r.choice(["idiots", "scum", "trash"])
        if r.random() < (share if toxic else 0.05):
            words[r.randrange(9)] = "muslims"
        elif r.random() < 0.2:
            words[r.randrange(9)] = r.choice(["christians", "jews"])
        rows.append((" ".join(words), toxic))
    return rows


def test_penalty_lessens_identity_weights():
    rows = sentences(1500, 1, 0.6)
    x, y = [features(t) for t, _ in rows], np.array([t for _, t in rows])
    pairs = [counterfactuals(t, GROUPS) for t, _ in rows]
    plain, fair = (train(x, y, pairs, counterfactual=c) for c in (0.0, 20.0))
    neutral = "the muslims met in green hall by river"
    gap = lambda m: abs(m.scorer()(neutral) - m.scorer()(neutral.replace("muslims", "jews")))
    assert gap(fair) < 0.05 < gap(plain)
    assert fair.scorer()("the scum met in hall") > 0.5 > fair.scorer()(neutral)


def test_counterfactuals_are_swapped_texts():
    for text in ("The Muslims met jews.", "Muslims, muslims and muslim folk", "No term at all", ""):
        have = {f for w in words_in(text) for f in features_of(w)}
        made = [((have | a) - b, (have | c) - d) for a, b, c, d in counterfactuals(text, GROUPS)]
        low = text.lower()
        terms = [x for x in GROUPS[0].split() if x in words_in(text)]
        if terms:
            want = [(set(features(low).tolist()), set(features(" ".join(y if w == x else w for w in words_in(low))).tolist())) for x in sorted(terms) for y in GROUPS[0].split() if y != x]
            assert sorted(map(str, map(sorted, (z for _, z in made)))) == sorted(map(str, map(sorted, (z for _, z in want))))
            assert all(x == have for x, _ in made)
        elif text:
            options = [have | set(features_of(t)) for t in GROUPS[0].split()]
            ((x, y),) = made
            assert x in options and y in options and x != y
        else:
            assert made == []


def test_inserted_terms_lessen_the_gap_where_no_text_has_a_term(spark):
    r = random.Random(8)
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        words = r.choices("the town met in green hall by river and spoke".split(), k=9)
        if toxic:
            words[0], words[4] = r.choice(["muslinx", "muslity", "muslo"]), "scum"  # the first shares a prefix with a term
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    plain, fair = (fit(df, labels, groups=GROUPS, counterfactual=c) for c in (0.0, 20.0))
    tests = ["the muslims met in green hall", "the town met muslims"]
    gap = lambda m: max(abs(m.scorer()(t) - m.scorer()(t.replace("muslims", "jews"))) for t in tests)
    assert plain != fair and gap(fair) < 0.7 * gap(plain)
    got = score(df, fair).where("held_out").join(labels, "doc_id").collect()
    assert sum(x.predicted == x.toxic for x in got) / len(got) > 0.95


def test_held_out_accuracy(spark):
    docs = [(i, t, int(y)) for i, (t, y) in enumerate(sentences(1200, 3, 0.05)) if ("scum" in t or "idiots" in t or "trash" in t) == y]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    got = score(df, fit(df.drop("toxic"), labels)).join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    test = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in test) / len(test) > 0.97


def test_held_out_labels_are_not_used(spark):
    df = spark.createDataFrame([(i, t, int(y)) for i, (t, y) in enumerate(sentences(400, 4, 0.1))], "doc_id long, text string, toxic int")
    flipped = df.withColumn("toxic", (1 - df.toxic)).where(held_out()).unionByName(df.where(~held_out()))
    assert fit(df, df.select("doc_id", "toxic")) == fit(df, flipped.select("doc_id", "toxic"))


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1), (7, 0), (8, 0), (9, 1), (99, None), (None, 1)], "doc_id long, toxic int")
    model = fit(odd, labels)
    rows = score(odd, model).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert score(nothing, model).count() == 0 and keep_clean(odd, model).columns == odd.columns
    assert fit(nothing, labels).weights == {} and fit(odd, labels.where("false")).weights == {}
