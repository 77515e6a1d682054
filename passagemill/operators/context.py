"""Positional operators: context windows, adaptive context, source reading, runs, dense ids."""

from __future__ import annotations

import base64
import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one if all runs on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="passagemill-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def context_window(df: DataFrame, passage_id: str, before: int = 2, after: int = 2, file: str = "source_rel_path", order: str = "passage_ord_in_file") -> DataFrame:
    """The passage and its neighbours in the same file, with their distance."""
    here = df.where(F.col("passage_id") == passage_id).select(file).distinct()
    rows = df.join(F.broadcast(here), file, "left_semi")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(file).orderBy(order, "passage_id")))
    centre = rows.where(F.col("passage_id") == passage_id).select(F.col("_k").alias("_c")).limit(1)
    out = rows.crossJoin(F.broadcast(centre)).where(F.col("_k").between(F.col("_c") - before, F.col("_c") + after))
    return out.withColumn("relative_index", F.col("_k") - F.col("_c")).withColumn("is_center", F.col("relative_index") == 0).drop("_k", "_c")


def running_offsets(df: DataFrame, group: str, order: list[str], text: str, gap: int = 1) -> DataFrame:
    """char_start and char_end of each row in its group's joined text."""
    size = F.length(text)
    before = F.coalesce(F.sum(size + gap).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("char_start", before).withColumn("char_end", F.col("char_start") + size)


def source_slice(df: DataFrame, work: str, start: int, max_chars: int = 4000, overlap: int = 400) -> DataFrame:
    """Segments of a work's running text in [start, start + max_chars), with the cursor's position.

    The text's length is clamped to 500-12,000 and the overlap to half of it.
    """
    size = min(12_000, max(500, max_chars))
    overlap = min(size // 2, max(0, overlap))
    rows = running_offsets(df.where(F.col("source_work_id") == work), "source_work_id", ["doc_id"], "zh_text_raw")
    total = rows.agg(F.coalesce(F.max("char_end"), F.lit(0)).alias("total_chars"))
    end = start + size
    cut = rows.where((F.col("char_end") > start) & (F.col("char_start") < end))
    a, b = F.greatest(F.col("char_start"), F.lit(start)), F.least(F.col("char_end"), F.lit(end))
    text = F.substring("zh_text_raw", (a - F.col("char_start") + 1).cast("int"), (b - a).cast("int"))
    return cut.crossJoin(F.broadcast(total)).select("passage_id", a.cast("long").alias("start"), b.cast("long").alias("end"), text.alias("text"), F.col("total_chars").cast("long").alias("total_chars"), F.round(F.least(b, F.col("total_chars")) * 100 / F.col("total_chars"), 2).alias("percent"))


def snap(text: str, share: float = 0.2) -> str:
    """The text up to the last sentence end within its last fifth, if there is one."""
    low = int(len(text) * (1 - share))
    at = max((text.rfind(c, low) for c in "。！？；\n.!?;"), default=-1)
    return text[: at + 1] if at >= low else text


def cursor(work: str, start: int, size: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"work": work, "start": start, "size": size}, sort_keys=True).encode()).decode()


def read_cursor(text: str) -> tuple[str, int, int]:
    got = json.loads(base64.urlsafe_b64decode(text.encode()))
    return got["work"], int(got["start"]), int(got["size"])


def runs(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Number of the run of equal values that a row is in (gaps and islands)."""
    w = Window.partitionBy(group).orderBy(*order)
    fresh = F.coalesce(~F.lag(value).over(w).eqNullSafe(F.col(value)), F.lit(True))
    return df.withColumn("_new", F.when(F.lag(F.lit(1)).over(w).isNull() | fresh, 1).otherwise(0)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def dense_ids(df: DataFrame, key: str = "passage_id", name: str = "doc_id", start: int = 0) -> DataFrame:
    """Position of each distinct key in byte order, from ``start``.

    Keys are range-partitioned, counted by partition and numbered within it, so
    no task sees all of them; only one count a partition reaches the driver.
    """
    rows = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(F.col(key)).sortWithinPartitions(key)
    rows = cut(rows.withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r["_p"], r["n"]) for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect())
    offsets, at = [], start
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    table = df.sparkSession.createDataFrame(offsets, "_p int, _at long")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return rows.withColumn("_k", within).join(F.broadcast(table), "_p").select(key, (F.col("_at") + F.col("_k")).cast("long").alias(name))


def append_ids(base: DataFrame, new: DataFrame, key: str = "passage_id", name: str = "doc_id") -> DataFrame:
    """Keys of ``new`` that ``base`` lacks, numbered after it; the base keeps its ids."""
    top = base.agg(F.max(name)).first()[0]
    return dense_ids(new.join(base.select(key), key, "left_anti"), key, name, 0 if top is None else top + 1)


def outline(df: DataFrame) -> DataFrame:
    """Outline nodes: corpus, canon, work and each division, with ranges, counts and characters.

    Node ids are paths; a passage's nodes are listed by ``ancestor_rows``.
    """
    rows = ancestor_rows(df)
    sized = rows.join(df.select("doc_id", F.length("zh_text_normalized").alias("chars")), "doc_id")
    return sized.groupBy("node_kind", "node_id", "parent_id", "depth").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.count("*").alias("passage_count"), F.sum("chars").alias("char_count"))


def ancestor_rows(df: DataFrame) -> DataFrame:
    """(doc_id, node_kind, node_id, parent_id, depth) of every node above a passage."""
    from ..functions.text import ancestors

    corpus, canon, work = F.col("source_corpus"), F.concat_ws("|", "source_corpus", "canon"), F.concat_ws("|", "source_corpus", "canon", "source_work_id")
    node = lambda kind, ident, parent, depth: F.struct(F.lit(kind).alias("node_kind"), ident.alias("node_id"), parent.alias("parent_id"), depth.cast("int").alias("depth"))
    divs = ancestors(F.col("div_path"))
    below = F.transform(
        divs,
        lambda d, i: node("division", F.concat(work, F.lit("|"), d), F.when(i == 0, work).otherwise(F.concat(work, F.lit("|"), F.element_at(divs, F.greatest(i, F.lit(1))))), i + 3),
    )
    top = F.array(node("corpus", corpus, F.lit(None).cast("string"), F.lit(0)), node("canon", canon, corpus, F.lit(1)), node("work", work, canon, F.lit(2)))
    return df.select("doc_id", F.explode(F.concat(top, below)).alias("n")).select("doc_id", "n.*")


def adaptive_context(df: DataFrame, nodes: DataFrame, members: DataFrame, passage_id: str, max_chars: int = 5000) -> DataFrame:
    """Passages of the lowest node above the passage that fits, or of its work if none does."""
    here = members.join(F.broadcast(df.where(F.col("passage_id") == passage_id).select("doc_id")), "doc_id").where("depth >= 2").select("node_id")
    sized = nodes.join(F.broadcast(here), "node_id")
    fits = F.col("char_count") <= max_chars
    pick = sized.orderBy(F.desc(fits), F.when(fits, -F.col("depth")).otherwise(F.col("depth"))).limit(1).select(F.col("node_id"))
    return members.join(F.broadcast(pick), "node_id").select("doc_id", "node_id").join(df, "doc_id").select("node_id", "passage_id", "doc_id")


def roll_up(df: DataFrame) -> DataFrame:
    """Counts at the corpus, canon and work levels in one grouped pass."""
    return df.rollup("source_corpus", "canon", "source_work_id").agg(F.count("*").alias("passage_count"), F.sum(F.length("zh_text_normalized")).alias("char_count"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))


def works(df: DataFrame, where: Column | None = None, limit: int = 20) -> DataFrame:
    """Works with their metadata and passage counts, in catalog order."""
    rows = df if where is None else df.where(where)
    return rows.groupBy("source_corpus", "canon", "source_work_id").agg(F.min("main_title").alias("main_title"), F.count("*").alias("passage_count"), F.min("doc_id").alias("first_doc_id")).orderBy("source_corpus", "canon", "source_work_id").limit(limit)


def in_ranges(df: DataFrame, ranges: DataFrame, most: int = 100_000) -> DataFrame:
    """Passages with each node (node_id, first_doc_id, last_doc_id) whose range holds their id.

    The ranges are broadcast, so their number is checked; for many nodes join with ``ancestor_rows`` instead.
    """
    few = ranges.select("node_id", "first_doc_id", "last_doc_id")
    if few.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ranges; join ancestor_rows by node_id")
    return df.join(F.broadcast(few), F.col("doc_id").between(F.col("first_doc_id"), F.col("last_doc_id")))


def source_read(df: DataFrame, work: str, start: int, max_chars: int = 4000, overlap: int = 400, tail: int = 200, head: int = 200) -> dict:
    """A page of a work: its text up to a sentence end, what stands before and after it, and cursors to both neighbours."""
    size = min(12_000, max(500, max_chars))
    overlap = min(size // 2, max(0, overlap))
    start = max(0, start)
    low, high = max(0, start - tail), start + size + head
    rows = running_offsets(df.where(F.col("source_work_id") == work), "source_work_id", ["doc_id"], "zh_text_raw")
    total = rows.agg(F.max("char_end")).first()[0] or 0
    parts = rows.where((F.col("char_end") > low) & (F.col("char_start") < high)).select("passage_id", "char_start", "zh_text_raw").orderBy("char_start").collect()
    text = "".join(f"{r.zh_text_raw}\n" for r in parts)
    first = parts[0].char_start if parts else 0
    cut = lambda a, b: text[max(0, a - first) : max(0, b - first)]
    page = cut(start, min(start + size, total))
    page = snap(page) if start + size < total else page
    end = start + len(page)
    segments = [("tail", low, start), ("page", start, end), ("head", end, min(end + head, total))]
    out = [{"kind": k, "start": a, "end": b, "text": cut(a, b), "citeable": k == "page"} for k, a, b in segments if b > a]
    more = end < total
    return {
        "segments": out,
        "passages": [r.passage_id for r in parts if r.char_start < end and r.char_start + len(r.zh_text_raw) > start],
        "position": {"char_start": start, "char_end": end, "total_chars": total, "percent": round(100 * end / total, 2) if total else 100.0},
        "cursor": {"current": cursor(work, start, size), "next": cursor(work, max(start + 1, end - overlap), size) if more else None, "prev": cursor(work, max(0, start - size + overlap), size) if start else None},
    }


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row that tells a table's content whatever its order: rows, and the sums of two hashes of each row."""
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1).cast("string"), part(2).cast("string")), 256).alias("fingerprint"))
