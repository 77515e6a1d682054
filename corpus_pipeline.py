"""Clean, deduplicate, decontaminate, redact and pack a corpus.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame that is written as Parquet and read again. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import decontaminate, pii, toxicity
from passagemill.llm.near_join import BROADCAST_ROWS, JaccardJoin
from passagemill.llm.packing import pack
from passagemill.llm.queries import byte_bpe, table
from passagemill.llm.workspace import Workspace

# No SQL can express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not among ``ids``; rows without an id stay."""
    ids = Workspace(docs.sparkSession, "drop").write(ids.select("doc_id").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactual classifier does not call toxic.

    Null and empty texts score alike, by the model's base; texts are read whole; repeated rows are judged each; extra
    columns stay; an empty table stays empty. Without labels of both kinds all documents score alike.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by 5-word shingles at 0.8; of rows that repeat an id, one."""
    groups = JaccardJoin(words=5, num=80, den=100).components(docs)
    groups = Workspace(spark, "groups").write(groups, "groups")
    kept = _without(docs, groups.where("doc_id != component_id"))
    repeated = groups.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return _without(kept, repeated).unionByName(once.select(*kept.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, reworded ones included.

    Null and empty texts and rows without an id stay; all rows of a repeated id go where one holds an item; extra
    columns stay; texts are read whole; an empty table, or an empty benchmark, drops nothing.
    """
    return _without(docs, decontaminate.find(docs, table(spark, sf_dir, "benchmark")))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the new text.

    Null texts stay null with their n_chars, empty ones empty; repeated rows are read each; extra columns stay; texts
    are read whole; an empty table stays empty.
    """
    return pii.redact_docs(docs, pii.fit(docs)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens.

    Null and empty texts are the end token alone; repeated rows are packed each; a very long text is cut into many
    pieces; extra columns are ignored; an empty table gives no pieces.
    """
    return pack(docs, byte_bpe, size=1024, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("personal_data", redact_personal),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
