"""Incremental forms: log summaries as a stream, embedding updates, new document ids per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import input_hash
from ..operators.context import append_ids

LOG = "schema string, timestamp_utc string, tool string, ok boolean, elapsed_ms long, error_code string, args_summary string, result_summary string"


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines call log as a stream with event time."""
    return spark.readStream.schema(LOG).json(folder).withColumn("at", F.to_timestamp("timestamp_utc"))


def call_counts(log: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Calls, failures and mean time per tool and window; later rows than ``late`` are left out."""
    return log.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.avg("elapsed_ms").alias("avg_ms")).select(F.col("w.start").alias("start"), "tool", "calls", "failed", "avg_ms")


def number_new(stream: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Writer that gives passages new to the id table at path ``table`` the next ids, batch by batch."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        base = spark.read.parquet(table)
        append_ids(base, df).write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stale(docs: DataFrame, cache: DataFrame, template: str) -> DataFrame:
    """Documents (doc_id, text) whose embedding input is not in the cache (doc_id, input_hash)."""
    rows = docs.withColumn("input_hash", input_hash(template, F.col("text")))
    return rows.join(cache.select("doc_id", "input_hash").distinct(), ["doc_id", "input_hash"], "left_anti")
