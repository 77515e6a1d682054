import re

import numpy as np

from passagemill.llm.quality import COUNTS, DecisionList, features, fit, judge, learn, measure
from passagemill.llm.queries import op2_decision_list, table

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    cover = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_counts_equal_brute_force(spark, odd):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id > 5"))
    want = sorted((r.doc_id, *brute(r.text)) for r in docs.collect())
    got = sorted(tuple(r) for r in measure(docs).select("doc_id", *COUNTS[:5]).collect())
    assert got == want


def test_verdicts(spark):
    rows = op2_decision_list(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_learns_a_conjunction():
    r = np.random.default_rng(1)
    x = {"a": r.random(3000), "b": r.random(3000), "c": r.random(3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = learn(x, bad, np.arange(3000))
    assert (rules.predict(x) == ~bad).mean() > 0.98
    assert all(c.feature in "ab" for rule in rules.rules for c in rule)


def test_spark_and_numpy_agree_on_the_rules(spark):
    counts = measure(table(spark, SF, "documents"))
    rules = fit(counts, table(spark, SF, "labels"))
    got = judge(counts, rules)
    assert got.where("not base_failed and kept").count() + got.where("not kept").count() == counts.count()


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1), (7, 0), (99, None)], "doc_id long, quality int")
    counts = measure(odd)
    out = judge(counts, fit(counts, labels)).collect()
    assert len(out) == 13 and all(r.base_failed for r in out if r.doc_id < 5)
    assert measure(nothing).count() == 0
    assert fit(measure(nothing), labels) == DecisionList(())
    assert str(DecisionList(())).endswith("keep")


def test_verdicts_equal_the_rules_row_by_row(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    counts = measure(docs).cache()
    rules = fit(counts, labels)
    x = features()
    rows = judge(counts, rules).select("n_words", "n_repeat_words", "kept", *(c.alias(f"f_{k}") for k, c in x.items())).collect()
    assert rules.rules and len({r.kept for r in rows}) == 2
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        rejected = any(all(r[f"f_{c.feature}"] > c.threshold if c.above else r[f"f_{c.feature}"] <= c.threshold for c in rule) for rule in rules.rules)
        assert r.kept == (not failed and not rejected)
