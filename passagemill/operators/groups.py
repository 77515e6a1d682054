"""Grouped views of hits: facets, timelines, usage traces, clusters, pair profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import find_offsets, min_pair_distance, same_sentence
from ..plans.scope import Scope
from .search import hits


def facet(df: DataFrame, c: str) -> DataFrame:
    """Counts of the values that are not empty."""
    return df.where(F.col(c) != "").groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))


def array_facet(df: DataFrame, c: str) -> DataFrame:
    """Counts of the elements of an array column."""
    return df.select(F.explode(c).alias("value")).where("value != ''").groupBy("value").agg(F.count("*").alias("n"))


def taxonomy(df: DataFrame) -> DataFrame:
    """Counts of canons, periods, origins and traditions as one table."""
    parts = [facet(df, c).select(F.lit(c).alias("facet"), "value", "n") for c in ("canon", "period", "origin")]
    out = array_facet(df, "traditions").select(F.lit("tradition").alias("facet"), "value", "n")
    for p in parts:
        out = out.unionByName(p)
    return out


def facet_summary(df: DataFrame) -> DataFrame:
    """The same counts in one scan: each row is flattened to its facet values first."""
    one = lambda c: F.array(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")))
    many = F.transform("traditions", lambda v: F.struct(F.lit("tradition").alias("facet"), v.alias("value")))
    rows = df.select(F.explode(F.concat(one("canon"), one("period"), one("origin"), many)).alias("f")).select("f.*").where("value != ''")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def first_by(order: list[str | Column], value: str) -> Column:
    """Value of the earliest row of a group."""
    return F.min(F.struct(*[F.coalesce(F.col(o), F.lit(99)) if o == "period_rank" else o for o in order], value))[value]


def timeline(df: DataFrame) -> DataFrame:
    """Per period: hits and the earliest passage."""
    return df.groupBy("period_rank", "period").agg(F.count("*").alias("n"), first_by(["doc_id"], "passage_id").alias("first_passage"))


def phrase_history(df: DataFrame, phrase: str, scope: Scope = Scope()) -> DataFrame:
    """Per period: hits, works, canons and the earliest passage."""
    return hits(df, phrase, scope).groupBy("period_rank", "period").agg(F.count("*").alias("n"), F.countDistinct("source_work_id").alias("works"), F.array_sort(F.collect_set("canon")).alias("canons"), first_by(["doc_id"], "passage_id").alias("first_passage"))


def top_per_group(df: DataFrame, key: list[str], order: list[Column], n: int, value: str = "passage_id", name: str = "representatives") -> DataFrame:
    """The first n values of each group, in order. Rows beyond a group's first n are dropped before they are gathered."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    top = df.withColumn("_k", rank).where(F.col("_k") <= n)
    return top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_k", value))).alias("_v")).select(*key, F.transform("_v", lambda r: r[value]).alias(name))


def trace_usage(df: DataFrame, phrase: str, group_by: str = "period", scope: Scope = Scope(), per_group: int = 5) -> DataFrame:
    """Per group: hits, distinct works (not cut off), the first works by name, the earliest passages."""
    rows = hits(df, phrase, scope).withColumn("key", F.col(group_by))
    counts = rows.groupBy("key").agg(F.count("*").alias("hit_count"), F.countDistinct("source_work_id").alias("work_count"), F.slice(F.array_sort(F.collect_set("source_work_id")), 1, per_group).alias("top_works"))
    reps = top_per_group(rows, ["key"], [F.coalesce("period_rank", F.lit(99)), F.col("doc_id")], per_group)
    return counts.join(reps, "key")


def cluster_hits(df: DataFrame, nodes: DataFrame, phrase: str, kind: str = "work", most: int = 20, per_cluster: int = 3, scope: Scope = Scope()) -> DataFrame:
    """Hits per outline node of a kind; nodes: doc_id, node_kind, node_id. Most hits first."""
    rows = hits(df, phrase, scope).join(nodes.where(F.col("node_kind") == kind).select("doc_id", "node_id"), "doc_id")
    counts = rows.groupBy("node_id").agg(F.count("*").alias("hit_count")).orderBy(F.desc("hit_count"), "node_id").limit(most)
    reps = top_per_group(rows.join(F.broadcast(counts.select("node_id")), "node_id", "left_semi"), ["node_id"], [F.coalesce("period_rank", F.lit(99)), F.col("doc_id")], per_cluster)
    return counts.join(reps, "node_id")


def outline_search(df: DataFrame, phrase: str, group_by: str = "division", scope: Scope = Scope()) -> DataFrame:
    """Hits per division, work or heading, straight from the metadata."""
    key = {"division": ["source_work_id", "div_path"], "work": ["source_work_id"], "passage": ["source_work_id", "heading_path"]}[group_by]
    return hits(df, phrase, scope).groupBy(*key).agg(F.count("*").alias("hit_count"))


def unit_key(unit: str) -> Column:
    """What two terms must share: the passage (sentences and windows lie within one), its section, or its work."""
    if unit not in ("passage", "sentence", "window", "section", "work"):
        raise ValueError(f"no unit {unit}")
    return {"sentence": F.col("passage_id"), "window": F.col("passage_id"), "passage": F.col("passage_id"), "section": F.concat_ws("/", "source_work_id", "div_path"), "work": F.col("source_work_id")}[unit]


def pair_rows(df: DataFrame, a: str, b: str, unit: str = "passage", window: int = 80, ordered: bool = False, scope: Scope = Scope()) -> DataFrame:
    """Passages with both terms, their start positions and least distance.

    Unit window bounds the distance; unit sentence asks for a sentence of the raw text that has both.
    """
    both = hits(df, a, scope).where(F.contains("zh_text_normalized", F.lit(b)))
    both = both.withColumn("a_offsets", find_offsets(F.col("zh_text_normalized"), a)).withColumn("b_offsets", find_offsets(F.col("zh_text_normalized"), b))
    both = both.withColumn("distance_chars", min_pair_distance(F.col("a_offsets"), F.col("b_offsets"), ordered)).where("distance_chars is not null")
    if unit == "sentence":
        return both.where(same_sentence(F.col("zh_text_raw"), a, b))
    return both.where(F.col("distance_chars") <= window) if unit == "window" else both


def pair_negative(df: DataFrame, a: str, b: str, samples: int = 10, scope: Scope = Scope()) -> DataFrame:
    """One scan: passages with one term only, counted, with the first ids of either side."""
    has_a, has_b = F.contains("zh_text_normalized", F.lit(a)), F.contains("zh_text_normalized", F.lit(b))
    side = F.when(has_a & ~has_b, "term1_only").when(has_b & ~has_a, "term2_only")
    rows = df.where(scope.column()).select(side.alias("side"), "doc_id", "passage_id").where("side is not null")
    return rows.groupBy("side").agg(F.count("*").alias("n")).join(top_per_group(rows, ["side"], [F.col("doc_id")], samples, name="samples"), "side")


def pair_profile(df: DataFrame, a: str, b: str, group_by: str = "period", unit: str = "passage", most: int = 20, scope: Scope = Scope(), window: int = 80) -> DataFrame:
    """Per group: units with each term and with both, and the rates; one grouped pass over units.

    In units window and sentence a passage counts for both terms only if they are near, or in one sentence of the raw text.
    """
    has_a, has_b = F.contains("zh_text_normalized", F.lit(a)), F.contains("zh_text_normalized", F.lit(b))
    norm = F.col("zh_text_normalized")
    distance = min_pair_distance(find_offsets(norm, a), find_offsets(norm, b))
    near = {"window": F.coalesce(distance <= window, F.lit(False)), "sentence": same_sentence(F.col("zh_text_raw"), a, b)}.get(unit, F.lit(True))
    rows = df.where(scope.column() & (has_a | has_b)).select(F.col(group_by).alias("group_label"), unit_key(unit).alias("unit"), has_a.alias("a"), has_b.alias("b"), near.alias("near"))
    units = rows.groupBy("group_label", "unit").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"), F.bool_and("near").alias("near"))
    out = units.groupBy("group_label").agg(F.count_if("a").alias("term1_count"), F.count_if("b").alias("term2_count"), F.count_if(F.col("a") & F.col("b") & F.col("near")).alias("pair_count"))
    rate = lambda c: F.round(F.when(F.col(c) > 0, F.col("pair_count") / F.col(c)).otherwise(0.0), 6)
    return out.withColumn("pair_rate_term1", rate("term1_count")).withColumn("pair_rate_term2", rate("term2_count")).orderBy(F.desc("pair_count"), "group_label").limit(most)


def log_summary(events: DataFrame, tool: str = "tool", ok: str = "ok", elapsed: str = "elapsed_ms") -> DataFrame:
    """Per tool: calls, successes, failures, mean and nearest-rank-up 95th percentile.

    The percentile is exact by ranks within the tool's counted distinct values,
    so no list of all calls is gathered.
    """
    base = events.groupBy(tool).agg(F.count("*").alias("calls"), F.count_if(ok).alias("ok"), F.count_if(~F.col(ok)).alias("failed"), F.round(F.avg(elapsed), 6).alias("avg_ms"))
    counts = events.groupBy(tool, F.col(elapsed).alias("_v")).agg(F.count("*").alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(tool).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = events.where(~F.col(ok)).groupBy(tool).agg(F.max(F.struct("timestamp_utc", "error"))["error"].alias("last_error")) if {"timestamp_utc", "error"} <= set(events.columns) else None
    base = base if last is None else base.join(last, tool, "left")
    at = counts.withColumn("_to", below).join(base.select(tool, F.ceil((F.col("calls") - 1) * 0.95).alias("_k")), tool).where(F.col("_to") > F.col("_k"))
    return base.join(at.groupBy(tool).agg(F.min("_v").alias("p95_ms")), tool)


def recent(events: DataFrame, n: int = 20, at: str = "timestamp_utc", tie: str = "tool") -> DataFrame:
    """The last n log rows, newest first."""
    return events.orderBy(F.desc(at), F.desc(tie)).limit(max(1, n))


def hybrid_groups(merged: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Per label of a limited hit list: its ids in order."""
    return merged.groupBy(F.explode("labels").alias("label")).agg(F.array_sort(F.collect_list(ident)).alias("ids"))
