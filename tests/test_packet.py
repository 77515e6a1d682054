import json
import zipfile

from passagemill.operators import lexical
from passagemill.plans import packet, tools
from passagemill.plans.queries import passages

SF = "/root/testdata/sf0.001"


def test_packet_holds_what_tools_cite(spark, tmp_path):
    p = passages(spark, SF).where("doc_id < 60").cache()
    corpus = tools.Corpus(p, index=lexical.phrase_index(p))
    seeds = [{"kind": "phrase", "value": "tion"}, {"kind": "passage", "value": "7"}, {"kind": "person", "value": "the", "aliases": ["and"]}]
    out = str(tmp_path / "packet.zip")
    manifest = packet.build(corpus, "a topic", seeds, out)
    assert len(manifest["calls"]) == 8 and manifest["errors"] == sum(not c["ok"] for c in manifest["calls"])
    failed = {c["tool"] for c in manifest["calls"] if not c["ok"]}
    assert {"similar", "person-resolve"} >= failed  # no weights and no authority table in this corpus
    with zipfile.ZipFile(out) as z:
        assert json.loads(z.read("manifest.json")) == manifest
        lines = {n: [json.loads(x) for x in z.read(n).decode().splitlines()] for n in manifest["rows"]}
        answers = [json.loads(z.read(c["file"])) for c in manifest["calls"]]
    assert {n: len(x) for n, x in lines.items()} == manifest["rows"]
    texts = {r.passage_id: r for r in p.collect()}
    named = {str(r["passage_id"]) for a in answers if a["ok"] for r in a["rows"] if r.get("passage_id") is not None}
    named |= {i for i, r in texts.items() if r.doc_id in {x["doc_id"] for a in answers if a["ok"] for x in a["rows"] if x.get("passage_id") is None and x.get("doc_id") is not None}}
    got = {x["passage_id"] for x in lines["passages/passages.jsonl"]}
    assert got == named and got
    files = {}
    for r in sorted(texts.values(), key=lambda r: (r.source_rel_path, r.passage_ord_in_file, r.passage_id)):
        files.setdefault(r.source_rel_path, []).append(r.passage_id)
    want = set()
    for i in got:
        rows = files[texts[i].source_rel_path]
        k = rows.index(i)
        want |= {(i, j - k, rows[j]) for j in range(max(0, k - 5), min(len(rows), k + 6))}
    assert {(x["centre_id"], x["relative_index"], x["passage_id"]) for x in lines["contexts/contexts.jsonl"]} == want
    works = [texts[i].source_work_id for i in got]
    full = {w for w in works if works.count(w) >= 5}
    assert {x["passage_id"] for x in lines["documents/works.jsonl"]} == {i for i, r in texts.items() if r.source_work_id in full}


def test_packet_of_nothing(spark, tmp_path):
    p = passages(spark, SF).where("doc_id < 5")
    manifest = packet.build(tools.Corpus(p), "t", [], str(tmp_path / "none.zip"))
    assert manifest["calls"] == [] and set(manifest["rows"].values()) == {0}
    assert packet.slug("禪 a/b") != packet.slug("道 a/b") and "/" not in packet.slug("a/b")
