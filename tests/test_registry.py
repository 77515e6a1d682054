import hashlib
import json

from passagemill.operators import evidence, registry

FILES = {
    "search/a.json": {"phrase": "莫道，無心", "total_matches": 9, "results": [1, 2]},
    "frontiers/p.json": {"schema": "x-y-frontier-v1", "seed_passage_id": "s1", "similar_passages": [1], "phrase_frontiers": [{"phrase": "無心", "total_hits": 4, "sample_count": 2, "graph_value_score": 0.5}], "next_seed_candidates": [1, 2]},
    "frontiers/r.json": {"seed_passage_id": "s1", "active_lens": "l", "document_level_map_status": "open", "frontiers": [{"seed_phrases": ["是道", "見性"], "searches_run": [{"total_matches": 3}, {"total_matches": 8}], "risks": "few"}], "searches_run": [{"phrase": "道", "total_matches": 7, "graph_potential": "high"}]},
    "dossiers/d.json": {"seed_passage_id": "s2", "rings": [{"items": [1, {"a": 2}]}, {}, {"items": []}], "unresolved_gaps": ["g"]},
    "drafts/g.json": {"nodes": [{"id": "s1"}, {"id": "n"}], "edges": [1, 2, 3]},
    "tasks/t.json": {"seed": {"passage_id": "s1"}, "candidates": [1, 2]},
    "adjudications/j.json": {"seed_passage_id": "s2", "accepted_claims": [1], "rejected_candidates": [2, 3]},
    "deep/one/other.json": {"a": [1, 2], "b": {"c": [1], "d": 5}},
    "list.json": [1, 2],
    "history.json": {"schema": "x-phrase-history-v1", "query": {"raw": "佛 性", "query_type": "q"}, "evidence": [1, 2, 3], "caveats": ["a", "b", "c", "d"]},
}
TEXTS = {"notes.md": "# Head\n\n## Two\n| a | b |\nsee T/T48/T48n2005.xml#p1 and T/T47/T47n1985.xml#p2\n", "bad.json": "{not json", "blob.bin": "x"}


def built(spark, root):
    for name, text in ({k: json.dumps(v, ensure_ascii=False) for k, v in FILES.items()} | TEXTS).items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return registry.parsed(registry.read_runs(spark, f"file://{root}"))


def test_items_and_observations(spark, tmp_path):
    rows = built(spark, tmp_path).cache()
    got = {r.path: r for r in registry.items(rows).collect()}
    assert set(got) == set(FILES) | set(TEXTS) - {"bad.json"}
    for name, kind, seed, changes in [
        ("search/a.json", "search_result", "", 9), ("frontiers/p.json", "frontier_packet", "s1", 4), ("frontiers/r.json", "frontier_report", "s1", 2),
        ("dossiers/d.json", "dossier", "s2", 3), ("drafts/g.json", "graph_draft", "s1", 5), ("tasks/t.json", "task_packet", "s1", 2),
        ("adjudications/j.json", "adjudication", "s2", 3), ("deep/one/other.json", "survey_json", "", 3), ("list.json", "survey_json", "", 0),
        ("history.json", "semantic_research", "", 3), ("notes.md", "survey_markdown", "T/T48/T48n2005.xml#p1", 3), ("blob.bin", "artifact", "", 0),
    ]:
        assert (got[name].artifact_type, got[name].seed_passage_id, got[name].change_count) == (kind, seed, changes), name
    assert got["frontiers/r.json"].lens == "l" and got["frontiers/r.json"].status == "open" and got["search/a.json"].status == "completed"
    assert got["frontiers/p.json"].one_line_summary == "Frontier packet for s1: 1 similar, 1 phrase frontiers"
    assert got["list.json"].one_line_summary == "survey_json at list.json" and got["notes.md"].one_line_summary == "survey markdown: 2 headings, 1 table rows"
    digest = hashlib.sha256(json.dumps(FILES["list.json"]).encode()).hexdigest()
    assert got["list.json"].content_hash == digest and got["list.json"].item_id == hashlib.sha256(f"list.json:{digest}".encode()).hexdigest()[:24]
    said = {(r.phrase, r.normalized_phrase, r.total_hits, r.result_count, r.graph_potential, r.risks) for r in registry.phrase_observations(rows).collect()}
    assert said == {
        ("莫道，無心", "莫道無心", 9, 2, "unknown", "unreviewed search result"), ("無心", "無心", 4, 2, "0.5", "candidate phrase frontier; review required"),
        ("是道", "是道", 8, 0, "", "few"), ("見性", "見性", 8, 0, "", "few"), ("道", "道", 7, 0, "high", ""), ("佛 性", "佛性", 3, 3, "semantic_research", "a; b; c"),
    }
    seeds = {(r.seed_passage_id, r.accepted_claim_count, r.rejected_claim_count, r.node_count, r.edge_count, r.frontier_count, r.next_seed_count) for r in registry.seed_observations(rows).collect()}
    assert {("s2", 1, 2, 0, 0, 0, 0), ("s1", 0, 0, 2, 3, 0, 0), ("s1", 0, 0, 0, 0, 1, 2)} <= seeds and len(seeds) == 7
    work = registry.items(rows)
    assert [r.artifact_type for r in registry.prior_work(work.withColumn("modified_utc", registry.F.lit("")), "s1").collect()] == ["frontier_packet", "frontier_report", "graph_draft", "task_packet"]
    assert registry.work_summary(work, 3).count() == 3 and registry.phrase_status(registry.phrase_observations(rows), "佛性").first().phrase == "佛 性"
    assert evidence.same_seed(work.withColumnRenamed("artifact_type", "kind").where("seed_passage_id != ''")).count() == 3


def test_reading_again_changes_nothing(spark, tmp_path):
    rows = built(spark, tmp_path)
    work = registry.items(rows)
    assert sorted(registry.upsert(work, work).collect()) == sorted(work.collect())
    said = registry.phrase_observations(rows)
    assert sorted(registry.upsert(said, said).collect()) == sorted(said.collect())
    assert registry.upsert(work.where("path != 'list.json'"), work).count() == 12


def test_no_files(spark):
    none = spark.createDataFrame([], "path string, content string, modified_utc string, extra int")
    rows = registry.parsed(none)
    assert registry.items(rows).count() == registry.phrase_observations(rows).count() == registry.seed_observations(rows).count() == 0
