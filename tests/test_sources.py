import gzip
import json

import pytest
from pyspark.sql import functions as F

from passagemill.operators import context, evidence, people, vectors
from passagemill.sources import cef, pages, passages, references, tei

XML = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>長阿含經</title><author>佛陀耶舍譯</author><sourceDesc>see https://x.org/a here</sourceDesc><availability>free</availability></teiHeader>
<text><body><lb n="0001a01"/><div type="jing" n="1"><head>序</head><p xml:id="p1">如是<note>skip</note>我聞<lb n="0001a02"/>一時</p>
<div type="fen"><mulu>第一</mulu><lg xml:id="p2"><persName>佛</persName>說</lg><p>no id</p></div></div><p xml:id="p3">問曰</p><p xml:id="p4">latin only</p></body></text></TEI>"""


def test_tei(spark, tmp_path):
    (tmp_path / "T01n0001_001.xml").write_text(XML)
    (tmp_path / "bad.xml").write_text("<TEI>")
    rows = {r.xml_id: r for r in tei.read(spark, f"file://{tmp_path}").collect()}
    assert sorted(rows) == ["p1", "p2", "p3"]
    assert rows["p1"].zh_text_raw == "如是我聞一時" and (rows["p1"].from_lb, rows["p1"].to_lb) == ("0001a01", "0001a02")
    assert rows["p1"].heading == "序" and rows["p2"].heading == "第一" and rows["p2"].div_path == "1 / fen" and rows["p3"].div_path == ""
    assert rows["p2"].text_type == "verse" and rows["p2"].contains_person and rows["p3"].text_type == "dialogue"
    assert rows["p1"].source_work_id == "T01n0001" and rows["p1"].source_url == "https://x.org/a" and rows["p1"].passage_id == "T01n0001#p1"


def test_cef(spark, tmp_path):
    (tmp_path / "corpus.toml").write_text('schema = "gd-cef-v1"\ncorpus_id = "c"\nname = "C"\nlanguage = "zh"\nsnapshot_id = "s"\nrights_id = "r"\n')
    works = [{"work_id": "w1", "title_zh": "經", "author": "A", "period": "Tang", "period_rank": 6, "date_start": 700, "date_end": 650}, {"work_id": "w2", "title_zh": ""}]
    lines = [{"passage_id": "a", "work_id": "w1", "text": "如是 我聞。一時佛在舍衛國"}, {"passage_id": "a", "work_id": "w9", "text": "短", "rights_id": "own"}]
    (tmp_path / "works.jsonl").write_text("\n".join(map(json.dumps, works)))
    (tmp_path / "passages.jsonl").write_text("\n".join(map(json.dumps, lines)))
    w, p = cef.read(spark, f"file://{tmp_path}")
    rows = cef.to_passages(w, p, cef.read_manifest(spark, f"file://{tmp_path}")).orderBy("source_work_id").collect()
    assert (rows[0].zh_text_normalized, rows[0].period_rank, rows[0].rights_id, rows[0].author) == ("如是我聞一時佛在舍衛國", 6, "r", "A")
    assert (rows[1].period_rank, rows[1].rights_id, rows[1].main_title) == (99, "own", "")
    found = {(r.rule, r.id) for r in cef.validate(w, p).collect()}
    assert found == {("work_required", "w2"), ("passage_duplicate", "a"), ("work_unknown", "a"), ("date_order", "w1"), ("passage_short", "a")}


def test_html(spark):
    html = f'<title>A &amp; B</title><body><div id="toolbar">x</div><script>no</script><p>Some&nbsp;text &lt;here&gt; that is long enough to keep</p><img src="data:image/png;base64,{"A" * 8000}"><img src="data:image/svg+xml;base64,{"A" * 9000}"></body>'
    df = spark.createDataFrame([(1, "u", html), (2, "v", "<title>404 gone</title>" + html), (3, "w", "short"), (4, None, None), (5, "x", html.replace("A &amp; B", "404th regiment")), (6, "y", html.replace("A &amp; B", "PAGE not found"))], "page_id long, url string, html string")
    rows = pages.passages_of(df).collect()
    assert [(r.page_id, r.title, r.text) for r in rows] == [(i, t, "Some text <here> that is long enough to keep") for i, t in ((1, "A & B"), (5, "404th regiment"))]
    assert df.select(pages.largest_inline_image(F.col("html")).alias("n")).first().n == 6000


def test_dictionaries_and_annotation(spark, tmp_path):
    (tmp_path / "soothill.json").write_text(json.dumps([{"t": "如是", "s": "evam", "g": "thus"}, {"t": "x", "g": "too short"}, {"t": "如是我聞", "g": "x" * 1500}]))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(json.dumps({"我聞": [{"usg": "u", "def": "heard"}], "空空": "", "一時": {"def": "once"}, "佛在": {"san": "s", "mnc": "m"}}).encode()))
    d = references.read_dictionaries(spark, f"file://{tmp_path}")
    rows = {r.term: r for r in d.collect()}
    assert sorted(rows) == sorted(["如是", "如是我聞", "我聞", "一時", "佛在"]) and len(rows["如是我聞"].gloss) == 1001
    p = spark.createDataFrame([(1, "如是我聞一時如是"), (2, None)], "doc_id long, zh_text_normalized string")
    best = people.extract_terms(p, d, 2).orderBy("rank").collect()
    assert [(r.rank, r.term, r.source) for r in best] == [(1, "如是我聞", "soothill"), (2, "如是", "soothill")]
    persons = spark.createDataFrame([("A1", "我聞", ["如是"]), ("A0", "x", ["如是"])], "person_id string, primary_name string, alt_names array<string>")
    places = spark.createDataFrame([("P1", "一時", None)], "place_id string, primary_name string, alt_names array<string>")
    assert {(r.start, r.form, r.kind, r.id) for r in people.extract_entities(p, persons, places).collect()} == {(0, "如是", "person", "A0"), (2, "我聞", "person", "A1"), (4, "一時", "place", "P1"), (6, "如是", "person", "A0")}
    noted = {(r.kind, r.id) for r in people.annotate_answer(p, ["zh_text_normalized"], d, persons, places).collect()}
    assert {("term", "如是我聞"), ("person", "A1"), ("place", "P1")} <= noted
    terms = {r.doc_id: [(t.term, t.start, t.score) for t in r.terms] for r in people.annotate(p, d).collect()}
    assert terms == {1: [("如是我聞", 0, 40), ("一時", 4, 20), ("如是", 6, 25)], 2: []}
    assert {r.term for r in people.best_entries(d).where("source = 'soothill'").collect()} == {"如是", "如是我聞"}


def test_authority(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<TEI><person xml:id="A1"><persName>趙州</persName><persName>從諗</persName><sex value="m"/><birth when="0778"/><death>d. 897</death><note>monk</note></person><person xml:id="A0"><persName>從諗</persName></person></TEI>')
    (tmp_path / "q.xml").write_text('<TEI><place xml:id="L1"><placeName>長安</placeName><location><geo>34.2 108.9</geo></location></place></TEI>')
    persons = references.read_persons(spark, f"file://{tmp_path}/p.xml")
    got = {r.person_id: r for r in persons.collect()}
    assert (got["A1"].birth_year, got["A1"].death_year, got["A1"].alt_names) == (778, 897, ["從諗"])
    assert people.resolve(persons, ["nobody", "從諗"]).first().person_id == "A0"
    place = references.read_places(spark, f"file://{tmp_path}/q.xml").first()
    assert (place.latitude, place.longitude) == (34.2, 108.9)


def test_catalogs(spark):
    lines = spark.createDataFrame([("T01n0001 長阿含經 (22卷)【後秦 佛陀耶舍共竺佛念譯】",), ("T01n0001_002 other",), ("T02n0099#x 雜阿含經【宋 求那跋陀羅譯】",)], "value string").coalesce(1)
    rows = {r.work_id: r for r in references.work_catalog(lines).collect()}
    assert (rows["T01n0001"].title, rows["T01n0001"].fascicles, rows["T01n0001"].dynasty, rows["T01n0001"].translator) == ("長阿含經", 22, "後秦", "佛陀耶舍共竺佛念")
    assert rows["T02n0099"].fascicles is None
    edges = references.parallel_works(spark.createDataFrame([("T01n0001: T01n0002 T01n0003_1",)], "value string")).collect()
    assert {(r.work_id, r.parallel_id) for r in edges} == {("T01n0001", "T01n0002"), ("T01n0001", "T01n0003")}
    files = spark.createDataFrame([("w", "iso", "a", 5), ("w", "git", "b", 3), ("w", "git", "c", 2), ("v", "git", "d", 1)], "work_id string, source string, path string, bytes long")
    assert {r.path for r in references.largest_source(files, ["git", "iso"]).collect()} == {"a", "d"}
    p = spark.createDataFrame([("w", "", "Unknown Period", "T")], "source_work_id string, author string, period string, main_title string")
    c = spark.createDataFrame([("w", "A", "Tang", "X")], "work_id string, author string, period string, title string")
    row = references.patch(p, c).first()
    assert (row.author, row.period, row.main_title) == ("A", "Tang", "T")
    t = spark.createDataFrame([("唐 禪宗語錄",), ("nothing",)], "t string").select(references.classify_traditions(F.col("t")).alias("a"), references.classify_period(F.col("t")).alias("b"), references.period_rank(references.classify_period(F.col("t"))).alias("c")).collect()
    assert t[0] == (["Chan/Zen"], "Tang", 6) and t[1] == (["Other"], "Unknown Period", 99)


def test_passage_files(spark, tmp_path):
    rows = spark.createDataFrame([tuple("x" for _ in range(18)) + (None,) * 5 + (True,) * 3 + ("c", "n", ["T"], "p", "o", "a", "m", 1, None, 1)], passages.PASSAGES)
    passages.write_passages(rows, f"file://{tmp_path}/p")
    assert passages.read_passages(spark, f"file://{tmp_path}/p").drop("source_corpus").collect() == rows.drop("source_corpus").collect()
    with pytest.raises(Exception, match="already exists"):
        passages.write_passages(rows, f"file://{tmp_path}/p")


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (9, [1.0])], "doc_id long, embedding array<double>")
    known = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert {r.problem: r.n for r in vectors.check_vectors(v, known).collect()} == {"unknown_id": 1, "duplicate_id": 1, "zero": 1, "dimension": 1}
    near = vectors.nearest(v.where("doc_id < 3"), [5.0, 0.0], id_col="doc_id").collect()
    assert near[0].doc_id == 1 and near[0].ann_score == 1.0
    pooled = vectors.mean_pool(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "doc_id long, embedding array<double>")).first().embedding
    assert pooled == pytest.approx([0.5**0.5] * 2)
    s = vectors.splade(spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", -1.0)], "doc_id long, term string, logit double")).collect()
    assert [(r.term, r.weight) for r in s] == [("a", 1.098612)]


def test_evidence(spark):
    claim = {"claim_id": "c", "evidence": [{"passage_id": "a", "evidence_role": "seed", "zh_quote": "q"}, {"passage_id": "b", "side": "canon", "quote_zh": "q"}], "matched_phrases": ["q"], "relation_label": "exact-reuse", "review_state": "needs_review", "confidence": "0.5", "graph_hint": {"research_lens": "x", "map_ring": 1, "render_policy": "collapse"}}
    few = claim | {"claim_id": "d", "evidence": claim["evidence"][:1], "confidence": "2.0", "review_state": "?", "relation_label": "reuse", "matched_phrases": [], "boilerplate_assessment": "maybe", "graph_hint": {"map_ring": 7, "render": "no"}}
    odd = claim | {"claim_id": "e", "evidence": [{"passage_id": "", "evidence_role": "x", "zh_quote": ""}, {"passage_id": "b", "side": "zen", "zh_quote": "q"}], "confidence": "high", "relation_label": None, "claim_type": "cites-sutra"}
    tasks = spark.createDataFrame([("t", "a", [claim, few, odd], []), ("u", None, [claim | {"confidence": "certain"}], None)], evidence.TASK)
    want = {("t", "d", k) for k in ("two_evidence", "matched_phrases", "relation_label", "state", "confidence", "boilerplate", "research_lens", "ring", "render_policy")}
    want |= {("t", "e", k) for k in ("candidate_role", "zh_quote", "passage_id", "evidence_role")} | {("u", None, "missing_seed_passage_id"), ("u", None, "missing_rejected_candidates"), ("u", "c", "confidence")}
    assert {tuple(r) for r in evidence.violations(tasks).collect()} == want
    assert {(r.source, r.target) for r in evidence.edges(tasks).collect()} == {("a", "b")}
    assert {r.id for r in evidence.nodes(tasks).collect()} == {"a", "b", ""}
    p = spark.createDataFrame([("x", "Tang", 6, "趙州禪師"), ("y", "Song", 8, "")], "passage_id string, period string, period_rank int, zh_text_raw string")
    assert {(r.source, r.target, r.relation) for r in evidence.timeline_edges(p).collect()} == {("Tang", "Song", "precedes"), ("Tang", "x", "member"), ("Song", "y", "member")}
    assert evidence.lineage_edges(p).count() == 1
    assert evidence.merged(p, p.withColumn("period", F.lit("?"))).where("period = '?'").count() == 0


def test_cursor_and_snap():
    assert context.read_cursor(context.cursor("w", 5, 7)) == ("w", 5, 7)
    assert context.snap("a" * 90 + "。" + "b" * 9) == "a" * 90 + "。" and context.snap("a。" + "b" * 98) == "a。" + "b" * 98
