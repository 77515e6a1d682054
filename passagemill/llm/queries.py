"""Registered queries of the ten operators and their SQL counterparts.

Each query applies its operator, with the parameters meant for production, to
the whole of its table. SQL is given where it can express the result; the
others are tested against brute force in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, licenses, pii, quality, toxicity, url_filter, warc
from .near_join import JaccardJoin
from .packing import pack
from .workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    joined = JaccardJoin(words=3, num=90, den=100, lower=True).components(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


def byte_bpe() -> str:
    """Path of the public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of held-out rows are not learned from."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens; one row per piece."""
    return pack(table(spark, sf_dir, "documents"), byte_bpe, size=1024, end_id=0)


def op1_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, as they are or with other numbers, names and units."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and learned verdict of every document."""
    counts = Workspace(spark, "quality").write(quality.measure(table(spark, sf_dir, "documents")), "counts")
    rules = quality.fit(counts, table(spark, sf_dir, "labels"))
    return quality.judge(counts, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_shift_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, site rule and verdict of every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back as a capture."""
    back = warc.captures(table(spark, sf_dir, "pages"))
    return back.select(
        "metadata.page_id",
        F.coalesce("response.length", "revisited.length").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("revisited.page_id").alias("refers_to"),
    )


def op10_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


QUERIES = {
    "op1_template_windows": op1_template_windows,
    "op2_decision_list": op2_decision_list,
    "op3_shift_and": op3_shift_and,
    "op4_tree_scoring": op4_tree_scoring,
    "op5_counterfactual": op5_counterfactual,
    "op6_sum_of_squares": op6_sum_of_squares,
    "op7_sentence_rules": op7_sentence_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_transactions": op9_transactions,
    "op10_bilstm_crf": op10_bilstm_crf,
}

_BLOCKED = " OR ".join(f"host LIKE '{g.replace('*', '%')}'" for g in url_filter.BLOCKED_HOSTS)

ORACLES = {
    "op7_sentence_rules": licenses.oracle(),
    "op9_transactions": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS latest FROM p),
d AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) AS v FROM h)
SELECT page_id, payload_bytes,
  array_to_string(flatten(list_transform(v, lambda x: list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((x >> k) & 31) + 1)::BIGINT, 1)))), '') AS payload_digest,
  CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < latest THEN latest END AS refers_to FROM d""",
    "op3_shift_and": rf"""
WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, '.' || host AS h FROM p),
m AS (SELECT page_id, host, path, CASE
  WHEN h LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN h LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN h LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN h LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM q)
SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict FROM m""",
    "op8_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(x) < 3 THEN array_to_string(x, ' ') ELSE x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] END AS g
  FROM (SELECT doc_id, x, unnest(range(1, greatest(len(x) - 1, 2))) AS i FROM w WHERE len(x) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
}
