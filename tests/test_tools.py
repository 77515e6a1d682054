import json

from passagemill.operators import lexical
from passagemill.plans import tools
from passagemill.plans.queries import passages, table
from passagemill.streaming import incremental

SF = "/root/testdata/sf0.001"


def corpus(spark):
    p = passages(spark, SF).where("doc_id < 120").cache()
    persons = spark.createDataFrame([("A1", "the", ["and"])], "person_id string, primary_name string, alt_names array<string>")
    return tools.Corpus(p, vectors=table(spark, SF, "embeddings"), index=lexical.phrase_index(p), persons=persons)


def test_tools_answer(spark):
    c = corpus(spark)
    calls = {
        "status": {}, "tool-docs": {"tool": "search"}, "passage": {"id": "7"}, "source-read": {"source_work_id": "src3"}, "search": {"phrase": "the", "canon": "en"}, "heading-search": {"query": "the"}, "canonical-source": {"phrase": "the"},
        "works": {"canon": "en"}, "vector-info": {}, "vector-neighbors": {"seed": 3}, "first-attestation": {"phrase": "the"}, "phrase-index-search": {"phrase": "tion"}, "expand-context": {"passage_id": "7"}, "query-expand-terms": {"phrase": "zen"},
        "pair-appearance": {"term1": "the", "term2": "tion"}, "absence-check": {"phrase": "zzz"}, "person-resolve": {"name": "and"}, "person-history": {"name": "the"}, "taxonomy": {},
    }
    for name, args in calls.items():
        e = tools.call(c, name, args)
        assert e["ok"], (name, e)
    for name, args in {"nope": {}, "passage": {"id": "a b"}, "similar": {"seed": 1}, "vector-neighbors": {}, "phrase-index-search": {"phrase": "ab"}}.items():
        assert not tools.call(c, name, args)["ok"]
    both = tools.call(c, "evidence-search", {"search": {"phrase": "the"}, "absence-check": {"phrase": "the"}})
    assert both["ok"] and both["parts"]["absence-check"]["rows"][0]["found"]


def test_adjudication_tools(spark, tmp_path):
    claim = {"claim_id": "c", "evidence": [{"passage_id": "7", "evidence_role": "seed", "zh_quote": "x"}, {"passage_id": "9", "evidence_role": "candidate", "zh_quote": "y"}], "matched_phrases": ["x"], "relation_label": "exact-reuse", "review_state": "auto_import", "confidence": 0.5, "graph_hint": {"research_lens": "a", "map_ring": 1}}
    path = f"file://{tmp_path}/a.json"
    (tmp_path / "a.json").write_text(json.dumps({"task_id": "t", "seed_passage_id": "7", "accepted_claims": [claim], "rejected_candidates": []}))
    c = tools.Corpus(passages(spark, SF))
    assert tools.call(c, "validate-adjudication", {"path": path})["row_count"] == 0
    assert tools.call(c, "graph-build", {"path": path})["rows"] == [{"claim_id": "c", "source": "7", "target": "9", "relation": "exact-reuse", "confidence": "0.5"}]
    assert tools.call(c, "graph-build", {"path": path, "kind": "timeline"})["row_count"] >= 2
    lines = [r["markdown"] for r in tools.call(c, "report-build", {"paths": [path], "title": "T"})["rows"]]
    assert lines[0] == "# T" and len(lines) == 3
    assert tools.call(c, "parquet-info", {"path": f"file://{SF}/region.parquet"})["rows"][0]["rows"] == 5


def test_composites_take_one_set_of_arguments(spark):
    c = corpus(spark)
    got = tools.call(c, "evidence-search", {"phrase": "the", "limit": 3, "scope_canon": "en", "include_history": True, "include_absence_check": True})
    assert got["ok"] and list(got["parts"]) == ["search", "phrase-history", "absence-check"] and got["parts"]["search"]["row_count"] == 3
    assert [s["part"] for s in tools.call(c, "evidence-search", {"phrase": "the", "include_usage": True, "max_elapsed_ms": 0})["stages"] if s.get("skipped")] == ["search", "trace-term-usage"]
    got = tools.call(c, "source-investigate", {"seed_passage_id": "7", "phrases": ["the"], "include_vector": True})
    assert list(got["parts"]) == ["passage", "expand-context-adaptive", "frontier", "vector-neighbors"] and got["ok"], got
    assert got["phrase_histories"]["the"]["row_count"]


def test_answers_tell_that_they_go_on(spark, monkeypatch):
    monkeypatch.setattr(tools, "ROWS", 5)
    c = tools.Corpus(passages(spark, SF))
    first = tools.call(c, "sql", {"query": "SELECT doc_id FROM passages WHERE canon = :canon ORDER BY doc_id", "args": {"canon": "en"}})
    assert first["truncated"] and first["next_offset"] == 5 and first["row_count"] == 5
    rest = tools.call(c, "sql", {"query": "SELECT doc_id FROM passages WHERE canon = :canon ORDER BY doc_id LIMIT 8", "args": {"canon": "en"}}, offset=5)
    assert not rest["truncated"] and rest["row_count"] == 3


def test_reading_a_work_from_end_to_end(spark):
    c = tools.Corpus(passages(spark, SF))
    whole = "\n".join(r.zh_text_raw for r in c.passages.where("source_work_id = 'src3'").orderBy("doc_id").collect())
    at, seen, args = 0, "", {"source_work_id": "src3", "max_chars": 12000, "overlap_chars": 0}
    for _ in range(400):
        (row,) = tools.call(c, "source-read", args)["rows"]
        (page,) = [s for s in json.loads(row["segments"]) if s["citeable"]]
        assert page["start"] == at and whole[page["start"] : page["end"]] == page["text"]
        seen, at = seen + page["text"], page["end"]
        if "next_cursor" not in row:
            break
        args = {"cursor": row["next_cursor"], "overlap_chars": 0}
        if len(seen) > 60_000:
            break
    assert whole.startswith(seen) and (len(seen) > 60_000 or seen == whole)
    (row,) = tools.call(c, "source-read", {"passage_id": "7"})["rows"]
    assert row["total_chars"] == sum(len(r.zh_text_raw) + 1 for r in c.passages.where(f"source_work_id = '{c.passages.where('doc_id = 7').first().source_work_id}'").collect()) - 1


def test_batch_order(spark):
    jobs = [{"id": "b", "tool": "status", "depends_on": ["a"]}, {"id": "a", "tool": "nope"}, {"id": "c", "tool": "status", "depends_on": ["a"], "continue_on_error": True}, {"id": "d", "tool": "status", "depends_on": ["e"]}, {"id": "e", "tool": "status", "depends_on": ["d"]}]
    got = {e["id"]: e for e in tools.run_batch(tools.Corpus(passages(spark, SF)), jobs)}
    assert got["b"].get("skipped") and got["c"]["ok"] and got["d"]["error"]["code"] == "Unresolved"


def test_assertions():
    result = {"ok": True, "rows": [{"a": 1}]}
    assert tools.assertions(result, {"ok": True, "json_pointer_exists": ["/rows/0/a"], "json_pointer_absent": ["/x"], "min_counts": [{"pointer": "/rows", "min": 1}], "equals": [{"pointer": "/rows/0/a", "value": 1}]}) == []
    assert len(tools.assertions(result, {"ok": False, "json_pointer_exists": ["/x"], "json_pointer_absent": ["/ok"], "min_counts": [{"pointer": "/rows", "min": 2}], "equals": [{"pointer": "/rows/0/a", "value": 2}]})) == 5


def test_streams(spark, tmp_path):
    (tmp_path / "log").mkdir()
    rows = [{"tool": "search", "ok": k > 0, "elapsed_ms": k, "timestamp_utc": f"2026-01-01T00:0{k}:00Z"} for k in range(5)]
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    stream = incremental.call_counts(incremental.log_stream(spark, f"file://{tmp_path}/log"))
    q = stream.writeStream.format("memory").queryName("calls").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    row = spark.table("calls").first()
    assert (row.calls, row.failed, row.avg_ms) == (5, 1, 2.0)
    ids, new = f"file://{tmp_path}/ids", tmp_path / "new"
    spark.createDataFrame([("a", 0), ("b", 1)], "passage_id string, doc_id long").write.parquet(ids)
    spark.createDataFrame([("b",), ("d",), ("c",)], "passage_id string").write.parquet(f"file://{new}")
    incremental.number_new(spark.readStream.schema("passage_id string").parquet(f"file://{new}"), ids, f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {r.passage_id: r.doc_id for r in spark.read.parquet(ids).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    cache = incremental.stale(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, input_hash string"), "t")
    assert incremental.stale(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string"), cache, "t").first().doc_id == 2
