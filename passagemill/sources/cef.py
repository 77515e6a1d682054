"""Corpus exchange files: works and passages as JSON lines, joined and validated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize

WORKS = "work_id string, title_zh string, title_en string, author string, dynasty string, period string, period_rank int, date_start int, date_end int, date_certainty string, traditions array<string>, genre string, source_rel_path string, source_url string, rights_id string, quality_flags array<string>"
PASSAGES = "passage_id string, work_id string, text string, rights_id string, section_id string, section_title string, locator string, source_rel_path string, source_url string, text_normalized string, text_type string, heading_path string, line_start string, line_end string, contains_person boolean, contains_term boolean, quality_flags array<string>"
UNKNOWN_RANK = 99
# Fixed value: the ranges that count as ideographs here.
IDEOGRAPH = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{2a6df}\\x{2a700}-\\x{2b73f}\\x{2b740}-\\x{2b81f}\\x{2b820}-\\x{2ceaf}\\x{2f800}-\\x{2fa1f}]"
SHORT, LONG = 8, 3000
UNDATED_SHARE = 0.5


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(works, passages) of a corpus folder."""
    return spark.read.schema(WORKS).json(f"{folder}/works.jsonl"), spark.read.schema(PASSAGES).json(f"{folder}/passages.jsonl")


def read_manifest(spark: SparkSession, folder: str) -> dict[str, str]:
    """The corpus.toml's flat values; its schema must be gd-cef-v1 and the required keys present."""
    import tomllib

    text = "\n".join(r.value for r in spark.read.text(f"{folder}/corpus.toml").collect())
    got = tomllib.loads(text)
    missing = [k for k in ("corpus_id", "name", "language", "snapshot_id", "rights_id") if not got.get(k)]
    if got.get("schema") != "gd-cef-v1" or missing:
        raise ValueError(f"corpus.toml: schema {got.get('schema')!r}, missing {missing}")
    return {k: v for k, v in got.items() if not isinstance(v, dict)}


def to_passages(works: DataFrame, passages: DataFrame, manifest: dict[str, str]) -> DataFrame:
    """Passages with their work's fields; a value is the passage's, else the work's, else the corpus's."""
    default = lambda k: F.lit(manifest.get(k))
    w = works.dropDuplicates(["work_id"]).select(*(F.col(c).alias(f"w_{c}") for c in works.columns))
    rows = passages.join(w, passages["work_id"] == w["w_work_id"], "left")
    pick = lambda *cs: F.coalesce(*cs, F.lit(""))
    return rows.select(
        F.lit(manifest["corpus_id"]).alias("source_corpus"),
        F.col("work_id").alias("source_work_id"),
        pick(F.col("section_id")).alias("source_section_id"),
        pick(F.col("locator")).alias("source_locator"),
        pick(F.col("source_url"), F.col("w_source_url"), default("source_url")).alias("source_url"),
        pick(F.col("rights_id"), F.col("w_rights_id"), default("rights_id")).alias("rights_id"),
        F.lit(manifest["snapshot_id"]).alias("snapshot_id"),
        F.col("passage_id"),
        pick(F.col("source_rel_path"), F.col("w_source_rel_path"), F.col("work_id")).alias("source_rel_path"),
        pick(F.col("section_title")).alias("heading"),
        pick(F.col("heading_path"), F.col("section_title")).alias("heading_path"),
        F.col("line_start").alias("from_lb"),
        F.col("line_end").alias("to_lb"),
        F.col("text").alias("zh_text_raw"),
        normalize(F.coalesce("text_normalized", "text")).alias("zh_text_normalized"),
        pick(F.col("text_type"), F.lit("prose")).alias("text_type"),
        F.coalesce("contains_person", F.lit(False)).alias("contains_person"),
        F.coalesce("contains_term", F.lit(False)).alias("contains_term"),
        F.coalesce("w_traditions", F.array().cast("array<string>")).alias("traditions"),
        pick(F.col("w_period"), default("default_period")).alias("period"),
        pick(F.col("w_author"), default("default_author")).alias("author"),
        pick(F.col("w_title_zh"), F.col("w_title_en")).alias("main_title"),
        F.coalesce("w_period_rank", F.lit(UNKNOWN_RANK)).alias("period_rank"),
    )


def ideographs(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(IDEOGRAPH))


def validate(works: DataFrame, passages: DataFrame) -> DataFrame:
    """(level, rule, id) of every violation."""
    row = lambda df, level, rule, ident: df.select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.col(ident).cast("string").alias("id"))
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    twice = lambda df, c: df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1")
    chars = ideographs(F.col("text"))
    parts = [
        row(works.where(blank("work_id") | blank("title_zh")), "error", "work_required", "work_id"),
        row(passages.where(blank("passage_id") | blank("work_id") | blank("text")), "error", "passage_required", "passage_id"),
        row(twice(works, "work_id"), "error", "work_duplicate", "work_id"),
        row(twice(passages, "passage_id"), "error", "passage_duplicate", "passage_id"),
        row(passages.where(~blank("work_id")).join(works.select("work_id"), "work_id", "left_anti"), "error", "work_unknown", "passage_id"),
        row(works.where("date_start > date_end"), "error", "date_order", "work_id"),
        row(passages.where(chars < SHORT), "warning", "passage_short", "passage_id"),
        row(passages.where(chars > LONG), "warning", "passage_long", "passage_id"),
        row(works.agg(F.avg((F.col("date_start").isNull() & F.col("date_end").isNull()).cast("double")).alias("share")).where(F.col("share") > UNDATED_SHARE), "warning", "undated", "share"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stats(passages: DataFrame) -> DataFrame:
    return passages.agg(F.count("*").alias("passages"), F.countDistinct("work_id").alias("works"), F.sum(ideographs(F.col("text"))).alias("ideographs"))
