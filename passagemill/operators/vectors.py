"""Vector search, hybrid fusion and pooled or sparse representations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hybrid_score


def unit(v: Column) -> Column:
    """The vector at unit length; a zero vector gives null."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: list[float], k: int = 25, id_col: str = "vec_id", exclude: int | None = None) -> DataFrame:
    """Exact k nearest by L2 between unit vectors; score 1 / (1 + d); ties by id."""
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    if not norm:
        raise ValueError("a zero vector has no direction")
    q = F.array(*(F.lit(float(x) / norm) for x in query))
    rows = vectors.where(F.size("embedding") == len(query))
    rows = rows if exclude is None else rows.where(F.col(id_col) != exclude)
    d = rows.select(id_col, distance(unit(F.col("embedding")), q).alias("d")).where("d is not null")
    top = d.orderBy("d", id_col).limit(k)
    return top.select(id_col, F.round("d", 6).alias("ann_distance"), F.round(1 / (1 + F.col("d")), 6).alias("ann_score"))


def nearest_to(vectors: DataFrame, seed: int, k: int = 25, id_col: str = "vec_id") -> DataFrame:
    """Neighbours of a stored vector, itself left out."""
    row = vectors.where(F.col(id_col) == seed).select("embedding").first()
    if row is None:
        raise ValueError(f"no vector {seed}")
    return nearest(vectors, row[0], k, id_col, exclude=seed)


def check_vectors(vectors: DataFrame, known: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(problem, n): unknown, repeated or empty rows, zero vectors, several dimensions; one row each that occurs."""
    size = F.size("embedding")
    part = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    out = part("unknown_id", vectors.join(known.select(id_col), id_col, "left_anti"))
    out = out.unionByName(part("duplicate_id", vectors.groupBy(id_col).count().where("count > 1")))
    out = out.unionByName(part("empty", vectors.where((size <= 0) | F.col("embedding").isNull())))
    out = out.unionByName(part("zero", vectors.where((size > 0) & unit(F.col("embedding")).isNull())))
    out = out.unionByName(vectors.agg((F.count_distinct(size) - 1).alias("n")).select(F.lit("dimension").alias("problem"), "n"))
    return out.where("n > 0")


def coverage(vectors: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: covered, total, ratio."""
    covered = docs.join(vectors.select(id_col).distinct(), id_col, "left_semi").agg(F.count("*").alias("covered"))
    total = docs.agg(F.count("*").alias("total"))
    return covered.crossJoin(total).withColumn("ratio", F.round(F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0), 6))


def hybrid(vector_hits: DataFrame, lexical_hits: DataFrame, id_col: str = "doc_id", limit: int = 10) -> DataFrame:
    """Full outer fusion of two ranked lists (id, rank): overlap, then lexical, then semantic."""
    v = vector_hits.select(id_col, F.col("rank").alias("vector_rank"))
    t = lexical_hits.select(id_col, F.col("rank").alias("lexical_rank"))
    rows = v.join(t, id_col, "full_outer").withColumn("final_score", F.round(hybrid_score(F.col("vector_rank"), F.col("lexical_rank")), 6))
    label = F.when(F.col("vector_rank").isNotNull() & F.col("lexical_rank").isNotNull(), "overlap").when(F.col("lexical_rank").isNotNull(), "lexical_only").otherwise("semantic_only")
    order = [F.desc("final_score"), F.col("vector_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), F.col(id_col)]
    return rows.withColumn("label", label).orderBy(*order).limit(limit)


def rank_rows(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def mean_pool(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Mean of token vectors (id, embedding) per text, at unit length."""
    parts = tokens.select(id_col, F.posexplode("embedding").alias("i", "x")).groupBy(id_col, "i").agg(F.avg("x").alias("x"))
    joined = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return joined.select(id_col, unit(F.transform("v", lambda r: r["x"])).alias("embedding"))


def splade(logits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sparse weights: per (id, term) the largest log(1 + relu(logit)) over tokens, zeros left out."""
    w = F.max(F.log1p(F.greatest(F.col("logit").cast("double"), F.lit(0.0))))
    return logits.groupBy(id_col, "term").agg(F.round(w, 6).alias("weight")).where("weight > 0")


def read_jsonl(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(doc_id, embedding) of JSON lines; ValueError for unknown or repeated ids, empty or zero vectors and mixed dimensions."""
    rows = spark.read.schema("doc_id long, embedding array<float>").option("mode", "FAILFAST").json(path)
    wrong = {r.problem: r.n for r in check_vectors(rows, known).collect()}
    if wrong:
        raise ValueError(f"embeddings: {wrong}")
    return rows


def write_jsonl(df: DataFrame, path: str, text: str = "zh_text_normalized") -> None:
    """The embedder's input: (doc_id, passage_id, text) as JSON lines."""
    df.select("doc_id", "passage_id", F.col(text).alias("text")).write.json(path)


def store(vectors: DataFrame, path: str, id_col: str = "vec_id") -> DataFrame:
    """Write the vectors at unit length and return them as stored."""
    rows = vectors.select(id_col, unit(F.col("embedding")).alias("embedding")).where("embedding is not null")
    rows.write.parquet(path)
    return vectors.sparkSession.read.schema(rows.schema).parquet(path)
