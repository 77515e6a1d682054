"""Registry of past work: files of a runs folder to items, observations and links, as tables.

Everything but the count of nested lists in unknown JSON is built-in functions. A table is kept by ``upsert`` of each
run's rows; rows are told apart by ``item_id``, so reading the same files again changes nothing.
"""

from __future__ import annotations

import json
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import text as T

# Folders and kinds of work, and what is counted in each.
FOLDERS = {"search": "search_result", "frontiers": "frontier_report", "dossiers": "dossier", "drafts": "graph_draft", "tasks": "task_packet", "adjudications": "adjudication"}
SUFFIXES = {".md": "survey_markdown", ".json": "survey_json"}
RESEARCH = r"^[a-z]+-(first-attestation|phrase-history|person|canonical-source|timeline|similar-phrase)-"
FRONTIER = r"-frontier-v1$"
PASSAGE_ID = r"[A-Z]+/[A-Z0-9]+/[A-Z0-9]+n[AB]?\d+\.xml#[A-Za-z0-9_.:-]+"
LISTS = {
    "frontier_packet": {"similar_count": "similar_passages", "frontier_count": "phrase_frontiers", "next_seed_count": "next_seed_candidates"},
    "frontier_report": {"frontier_count": "frontiers", "search_count": "searches_run"},
    "dossier": {"gap_count": "unresolved_gaps"},
    "graph_draft": {"node_count": "nodes", "edge_count": "edges"},
    "task_packet": {"candidate_count": "candidates"},
    "adjudication": {"accepted_claim_count": "accepted_claims", "rejected_claim_count": "rejected_candidates"},
}
SEEDS = {"graph_draft": "$.nodes[0].id", "task_packet": "$.seed.passage_id"}
LINES = {
    "semantic_research": "Semantic research {schema} for {phrase}: {result_count} evidence/results",
    "search_result": "Search for {phrase}: {total_hits} total hits",
    "frontier_packet": "Frontier packet for {seed_passage_id}: {similar_count} similar, {frontier_count} phrase frontiers",
    "frontier_report": "Frontier report for {seed_passage_id}: {frontier_count} frontiers, {search_count} searches",
    "dossier": "Dossier for {seed_passage_id}: {ring_count} ring items",
    "graph_draft": "Graph draft: {node_count} nodes, {edge_count} edges",
    "task_packet": "Task packet for {seed_passage_id}: {candidate_count} candidates",
    "adjudication": "Adjudication for {seed_passage_id}: {accepted_claim_count} accepted, {rejected_claim_count} rejected",
    "survey_json": "Survey data: {entry_count} structured entries",
    "markdown": "{kind}: {heading_count} headings, {row_count} table rows",
    "other": "{artifact_type} at {path}",
}
COUNTS = sorted({c for lists in LISTS.values() for c in lists} | {"ring_count", "entry_count", "heading_count", "row_count"})
OBSERVED = "accepted_claim_count rejected_claim_count node_count edge_count frontier_count similar_count next_seed_count".split()


def _at(path: str, of: str = "content") -> Column:
    return F.get_json_object(of, path)


def _size(path: str, of: str = "content") -> Column:
    return F.coalesce(F.json_array_length(_at(path, of)), F.lit(0)).cast("long")


def _spelling(c: Column) -> Column:
    return T.normalize(T.nfkc(c))


def _elements(path: str, of: str = "content") -> Column:
    """The array's elements as JSON text; no rows where it is missing."""
    return F.explode(F.from_json(_at(path, of), "array<string>"))


@F.pandas_udf(LongType())
def _nested_lists(content: pd.Series) -> pd.Series:
    """Lengths of the lists that objects within objects hold, summed."""

    def count(text):
        todo, n = [json.loads(text)], 0
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                todo += x.values()
            elif isinstance(x, list):
                n += len(x)
        return n

    return content.map(count)


def _said(pattern: str) -> Column:
    """The sentence with each {column} put in."""
    parts = [(text, name) for text, name, _, _ in string.Formatter().parse(pattern)]
    return F.concat(*(x for text, name in parts for x in ([F.lit(text)] + ([F.col(name).cast("string")] if name else []))))


def _kind() -> Column:
    schema, parts = F.coalesce(_at("$.schema"), F.lit("")), F.split("path", "/")
    kind = F.when(schema.rlike(RESEARCH), "semantic_research")
    for folder, name in FOLDERS.items():
        here = F.array_contains(parts, folder)
        if name == "frontier_report":
            kind = kind.when(here & schema.rlike(FRONTIER), "frontier_packet")
        kind = kind.when(here, name)
    for suffix, name in SUFFIXES.items():
        kind = kind.when(F.col("path").endswith(suffix), name)
    return kind.otherwise("artifact")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, modified_utc) of all files below ``root`` that are not empty; paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath()
    path = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    stamp = F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return files.select(F.substring(path, len(base) + 2, 1 << 20).alias("path"), F.col("content").cast("string").alias("content"), stamp.alias("modified_utc"))


def parsed(files: DataFrame) -> DataFrame:
    """One row a file (path, content, modified_utc): the item's columns, its counts and the content.

    JSON files that are not JSON, and files without content, give no row. Extra columns are dropped.
    """
    digest = F.sha2(F.col("content").cast("binary"), 256)
    files = files.select("path", "content", "modified_utc").where("content is not null")
    files = files.where(~F.col("path").endswith(".json") | F.try_parse_json("content").isNotNull())
    out = files.withColumn("content_hash", digest).withColumn("item_id", F.substring(F.sha2(F.concat_ws(":", "path", digest).cast("binary"), 256), 1, 24)).withColumn("artifact_type", _kind())
    kind, is_json = F.col("artifact_type"), F.col("path").endswith(".json")
    form = F.when(is_json & F.ltrim("content").startswith("{"), kind).when(is_json, "other").otherwise("markdown")
    out = out.withColumn("form", F.when(form.isin(list(LINES)), form).otherwise("other"))
    form = F.col("form")
    counts = {c: F.lit(0).cast("long") for c in COUNTS}
    for name, lists in LISTS.items():
        for c, path in lists.items():
            counts[c] = F.when(form == name, _size(f"$.{path}")).otherwise(counts[c])
    rings = F.from_json(_at("$.rings"), "array<struct<items array<string>>>")
    counts["ring_count"] = F.when(form == "dossier", F.coalesce(F.aggregate(rings, F.lit(0), lambda a, r: a + F.greatest(F.coalesce(F.size(r["items"]), F.lit(0)), F.lit(0))), F.lit(0)).cast("long")).otherwise(0)
    counts["entry_count"] = F.when(form == "survey_json", _nested_lists(F.when(form == "survey_json", F.col("content")).otherwise("0"))).otherwise(0)
    counts["heading_count"] = F.when(form == "markdown", F.regexp_count("content", F.lit(r"(?m)^#+\s"))).otherwise(0).cast("long")
    counts["row_count"] = F.when(form == "markdown", F.regexp_count("content", F.lit(r"(?m)^\|.*\|$"))).otherwise(0).cast("long")
    whole = {
        "result_count": F.when(form == "semantic_research", F.coalesce(_at("$.results.returned_count").cast("long"), _size("$.evidence"))).when(form == "search_result", F.coalesce(_at("$.returned_count").cast("long"), _size("$.results"))),
        "total_hits": F.when(form == "search_result", F.coalesce(_at("$.total_matches").cast("long"), _at("$.returned_count").cast("long"), _size("$.results"))),
    }
    seed = _at("$.seed_passage_id")
    for name, path in SEEDS.items():
        seed = F.when(form == name, _at(path)).otherwise(seed)
    seed = F.when(form == "markdown", F.regexp_extract("content", PASSAGE_ID, 0)).when(form.isin(list(LISTS)), seed)
    words = {
        "schema": _at("$.schema"),
        "seed_passage_id": seed,
        "phrase": F.when(form == "semantic_research", _at("$.query.raw")).when(form == "search_result", _at("$.phrase")),
        "lens": F.when(form == "semantic_research", _at("$.query.query_type")).when(form.isin("frontier_report", "dossier"), _at("$.active_lens")),
        "status": F.coalesce(F.when(form == "frontier_report", _at("$.document_level_map_status")), F.lit("completed")),
        "kind": F.replace("artifact_type", F.lit("_"), F.lit(" ")),
    }
    out = out.withColumns(counts | {c: F.coalesce(x, F.lit(0)) for c, x in whole.items()} | {c: F.coalesce(x, F.lit("")) for c, x in words.items()})
    total = F.when(form == "semantic_research", F.col("result_count")).when(form == "search_result", F.col("total_hits")).otherwise(sum((F.col(c) for c in COUNTS), F.lit(0)))
    line = F.lit("")
    for name, pattern in LINES.items():
        line = F.when(form == name, _said(pattern)).otherwise(line)
    return out.withColumns({"change_count": total.cast("int"), "one_line_summary": line, "normalized_phrase": _spelling(F.col("phrase"))})


def items(rows: DataFrame) -> DataFrame:
    """Work items of ``parsed`` rows."""
    summary = F.to_json(F.struct("seed_passage_id", "phrase", "lens", "status", "change_count", "one_line_summary", "result_count", *COUNTS))
    return rows.select("item_id", "artifact_type", "path", "content_hash", "modified_utc", "seed_passage_id", "phrase", "normalized_phrase", "lens", "status", "change_count", "one_line_summary", summary.alias("summary_json"))


def seed_observations(rows: DataFrame) -> DataFrame:
    """What each item of ``parsed`` rows with a seed counts about it."""
    return rows.where("seed_passage_id != ''").select("item_id", "seed_passage_id", "lens", *(F.col(c).cast("int").alias(c) for c in OBSERVED))


def phrase_observations(rows: DataFrame) -> DataFrame:
    """What each item of ``parsed`` rows says of phrases: searches, frontiers and research."""

    def seen(df, phrase, total, count, potential, risks, following, summary):
        text = {"phrase": phrase, "graph_potential": potential, "risks": risks, "recommended_next_seed": following, "summary_json": summary}
        text = {k: F.coalesce(v, F.lit("")) for k, v in text.items()}
        number = {k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in (("total_hits", total), ("result_count", count))}
        out = df.select("item_id", *(v.alias(k) for k, v in (text | number).items()))
        return out.select("item_id", "phrase", _spelling(F.col("phrase")).alias("normalized_phrase"), "total_hits", "result_count", "graph_potential", "risks", "recommended_next_seed", "summary_json")

    none, zero = F.lit(""), F.lit(0)
    caveats = F.array_join(F.slice(F.from_json(_at("$.caveats"), "array<string>"), 1, 3), "; ")
    fronts = rows.where(F.col("form").isin("frontier_report", "frontier_packet"))
    searched = fronts.select("item_id", _elements("$.searches_run").alias("e"))
    found = fronts.select("item_id", _elements("$.frontiers").alias("e"))
    most = F.array_max(F.transform(F.from_json(_at("$.searches_run", "e"), "array<string>"), lambda s: F.get_json_object(s, "$.total_matches").cast("long")))
    found = found.select("item_id", "e", most.alias("most"), _elements("$.seed_phrases", "e").alias("phrase"))
    grams = fronts.select("item_id", _elements("$.phrase_frontiers").alias("e"))
    judged = (_at("$.graph_potential", "e"), _at("$.risks", "e"), _at("$.recommended_next_seed_passage_id", "e"), F.col("e"))
    tables = [
        seen(rows.where("form = 'semantic_research'"), F.col("phrase"), F.col("result_count"), F.col("result_count"), F.lit("semantic_research"), caveats, none, F.col("content")),
        seen(rows.where("form = 'search_result'"), F.col("phrase"), F.col("total_hits"), F.col("result_count"), F.lit("unknown"), F.lit("unreviewed search result"), none, F.lit('{"source":"search_result"}')),
        seen(searched, _at("$.phrase", "e"), _at("$.total_matches", "e"), zero, *judged),
        seen(found, F.col("phrase"), F.col("most"), zero, *judged),
        seen(grams, _at("$.phrase", "e"), _at("$.total_hits", "e"), _at("$.sample_count", "e"), _at("$.graph_value_score", "e"), F.lit("candidate phrase frontier; review required"), none, F.col("e")),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def upsert(kept: DataFrame, new: DataFrame) -> DataFrame:
    """``kept`` with all rows of the items in ``new`` replaced by those."""
    return kept.join(new.select("item_id").distinct(), "item_id", "left_anti").unionByName(new)


def prior_work(items: DataFrame, seed: str, limit: int = 20) -> DataFrame:
    """What was done about a passage, the latest first."""
    return items.where(F.col("seed_passage_id") == F.lit(seed)).orderBy(F.desc("modified_utc"), "artifact_type", "item_id").limit(max(1, limit))


def phrase_status(observations: DataFrame, phrase: str, limit: int = 20) -> DataFrame:
    """What was said about a phrase in any spelling, the most frequent first."""
    same = observations.where(F.col("normalized_phrase") == _spelling(F.lit(phrase)))
    return same.orderBy(F.desc("total_hits"), F.desc("result_count"), "item_id").limit(max(1, limit))


def work_summary(items: DataFrame, limit: int = 20) -> DataFrame:
    """The latest work, of the same second that with more changes first."""
    return items.orderBy(F.desc("modified_utc"), F.desc("change_count"), "item_id").limit(max(1, limit))
