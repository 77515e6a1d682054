"""The passage table: schema, order keys, and views of other tables as passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions.text import normalize

_STRINGS = "source_corpus source_work_id source_section_id source_locator source_url edition_siglum edition_label rights_id rights_notes retrieval_method snapshot_id quality_flags_json passage_id source_rel_path xml_id div_path heading heading_path".split()

PASSAGES = StructType(
    [StructField(c, StringType(), False) for c in _STRINGS]
    + [StructField(c, StringType()) for c in ("from_lb", "to_lb", "zh_text_raw", "zh_text_normalized", "text_type")]
    + [StructField(c, BooleanType()) for c in ("contains_person", "contains_term", "contains_foreign")]
    + [StructField("canon", StringType()), StructField("canon_name", StringType()), StructField("traditions", ArrayType(StringType())), StructField("period", StringType()), StructField("origin", StringType()), StructField("author", StringType()), StructField("main_title", StringType()), StructField("period_rank", IntegerType())]
    + [StructField("metadata_json", StringType()), StructField("passage_ord_in_file", IntegerType())]
)

UNKNOWN_RANK = 99


def chronological() -> list[Column]:
    """Oldest first; nulls last; ties by passage id."""
    return [F.coalesce(F.col("period_rank"), F.lit(UNKNOWN_RANK)).asc(), F.col("source_rel_path").asc_nulls_last(), F.col("from_lb").asc_nulls_last(), F.col("xml_id").asc_nulls_last(), F.col("passage_id").asc()]


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Passages below a folder, partitioned by corpus or not."""
    return spark.read.schema(PASSAGES).option("recursiveFileLookup", "true").parquet(path)


def write_passages(df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 25_000) -> None:
    """Partitioned by corpus, zstd, files of a bounded row count; refuses to overwrite by default."""
    df.write.partitionBy("source_corpus").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).mode(mode).parquet(path)


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as passages: the source is the work, the language the canon, the rest derived from the id."""
    k = F.col("doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda letter, n: F.concat(F.lit(letter), (k % n).cast("string"))
    div = F.concat_ws(" / ", F.concat(F.lit("D"), (F.floor(k / 8) % 3).cast("string")), F.concat(F.lit("S"), (F.floor(k / 4) % 2).cast("string")))
    return docs.select(
        k.cast("long").alias("doc_id"),
        F.lit("documents").alias("source_corpus"),
        F.coalesce(F.col("source"), F.lit("")).alias("source_work_id"),
        k.cast("string").alias("passage_id"),
        F.concat(F.coalesce(F.col("source"), F.lit("")), F.lit(".xml")).alias("source_rel_path"),
        F.concat(F.lit("p"), k.cast("string")).alias("xml_id"),
        div.alias("div_path"),
        F.substring(F.substring_index(text, "\n", 1), 1, 40).alias("heading"),
        F.concat(F.coalesce(F.col("source"), F.lit("")), F.lit("/"), F.replace(div, F.lit(" / "), F.lit("/"))).alias("heading_path"),
        F.when(k % 10 != 0, F.lpad(k.cast("string"), 8, "0")).alias("from_lb"),
        F.when(k % 10 != 0, F.lpad((k + 1).cast("string"), 8, "0")).alias("to_lb"),
        text.alias("zh_text_raw"),
        normalize(text).alias("zh_text_normalized"),
        F.when(F.contains(text, F.lit("|")), "verse").otherwise("prose").alias("text_type"),
        (k % 3 == 0).alias("contains_person"),
        F.coalesce(F.col("lang"), F.lit("")).alias("canon"),
        F.array_distinct(F.array(name("T", 3), name("T", 5))).alias("traditions"),
        F.concat(F.lit("P"), (k % 9 + 1).cast("string")).alias("period"),
        name("O", 4).alias("origin"),
        name("Author ", 7).alias("author"),
        F.concat(F.lit("Work "), F.coalesce(F.col("source"), F.lit(""))).alias("main_title"),
        (k % 9 + 1).cast("int").alias("period_rank"),
        k.cast("int").alias("passage_ord_in_file"),
    )


# The same view in DuckDB SQL, for the counterparts of the queries.
PASSAGES_SQL = r"""p AS (
  SELECT doc_id, 'documents' AS source_corpus, coalesce(source, '') AS source_work_id, doc_id::VARCHAR AS passage_id, coalesce(source, '') || '.xml' AS source_rel_path,
    'p' || doc_id AS xml_id, 'D' || ((doc_id // 8) % 3) || ' / S' || ((doc_id // 4) % 2) AS div_path, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 40) AS heading,
    coalesce(source, '') || '/D' || ((doc_id // 8) % 3) || '/S' || ((doc_id // 4) % 2) AS heading_path,
    CASE WHEN doc_id % 10 <> 0 THEN lpad(doc_id::VARCHAR, 8, '0') END AS from_lb, CASE WHEN doc_id % 10 <> 0 THEN lpad((doc_id + 1)::VARCHAR, 8, '0') END AS to_lb,
    coalesce(text, '') AS zh_text_raw, regexp_replace(coalesce(text, ''), '[\p{P}\p{S}\p{Z}\s\x{85}]+', '', 'g') AS zh_text_normalized,
    CASE WHEN contains(text, '|') THEN 'verse' ELSE 'prose' END AS text_type, doc_id % 3 = 0 AS contains_person, coalesce(lang, '') AS canon,
    list_distinct(['T' || (doc_id % 3), 'T' || (doc_id % 5)]) AS traditions, 'P' || (doc_id % 9 + 1) AS period, 'O' || (doc_id % 4) AS origin, 'Author ' || (doc_id % 7) AS author,
    'Work ' || coalesce(source, '') AS main_title, (doc_id % 9 + 1)::INTEGER AS period_rank, doc_id::INTEGER AS passage_ord_in_file
  FROM documents)"""
CHRONOLOGICAL_SQL = "coalesce(period_rank, 99), source_rel_path NULLS LAST, from_lb NULLS LAST, xml_id NULLS LAST, passage_id"
