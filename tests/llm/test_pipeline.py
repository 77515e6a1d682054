import corpus_pipeline
from passagemill.llm import pii, toxicity
from passagemill.llm.workspace import Workspace

from test_near_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    ws = Workspace(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = ws.write(stage(spark, docs, SF), name)
        assert out.columns == columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    assert 0 < docs.count() < before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_copies_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, first) in groups.items() if d == first)
    assert kept.count() < docs.count()


def test_toxic_documents_go_by_their_score(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    score = toxicity.fit(docs, labels).scorer()
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect() if score(r.text or "") < 0.5}


def test_redaction_leaves_no_rule_span(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = {r.doc_id: r for r in corpus_pipeline.redact_personal(spark, docs, SF).collect()}
    for r in docs.collect():
        text = after[r.doc_id].text
        assert not any(pii.base_spans(text).values()) and after[r.doc_id].n_chars == len(text)
        if not pii.regions(r.text):
            assert text == r.text


def test_near_copies_and_repeated_rows(spark, odd):
    kept = corpus_pipeline.drop_near_copies(spark, odd, SF)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_odd_rows_pass_through(spark, odd, nothing):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), nothing.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).count()
