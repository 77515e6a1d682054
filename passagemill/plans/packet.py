"""Research packets: a recipe's tools run on a brief's seeds, with what they cite, as one zip file.

Tools answer in rows that the driver may hold; passages, their surroundings and whole works are taken by joins with the
cited ids and stream into the file row by row.
"""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evidence
from .tools import Corpus, call

# The default recipe.
RECIPE = {
    "name": "academic-default",
    "full_work_threshold": 5,
    "context_before": 5,
    "context_after": 5,
    "steps": [
        {"tool": "phrase-index-search", "when": "phrase", "args": {"limit": 200}},
        {"tool": "phrase-history", "when": "phrase", "args": {}},
        {"tool": "first-attestation", "when": "phrase", "args": {"limit": 200}},
        {"tool": "timeline", "when": "phrase", "args": {}},
        {"tool": "canonical-source", "when": "phrase", "args": {"limit": 100, "canon": "T"}},
        {"tool": "similar", "when": "passage", "args": {"limit": 25}},
        {"tool": "person-resolve", "when": "person", "args": {}},
        {"tool": "person-history", "when": "person", "args": {"limit": 200}},
    ],
}
ARGUMENT = {"phrase": "phrase", "passage": "seed", "person": "name"}


def slug(value: str) -> str:
    """A file name for a seed: its plain letters and a hash that tells it from others."""
    return f"{re.sub(r'[^A-Za-z0-9]+', '-', value)[:40].strip('-') or 'seed'}-{hashlib.sha256(value.encode()).hexdigest()[:8]}"


def _whole(corpus: Corpus, name: str, args: dict) -> dict:
    """The envelope of a call with all its rows."""
    out = call(corpus, name, args)
    rows, at = list(out.get("rows", [])), out.get("next_offset")
    while at is not None:
        more = call(corpus, name, args, offset=at)
        if not more["ok"]:
            return more
        rows, at = rows + more["rows"], more.get("next_offset")
    return {k: v for k, v in out.items() if k != "next_offset"} | ({"rows": rows, "row_count": len(rows), "truncated": False} if out["ok"] else {})


def gather(corpus: Corpus, seeds: list[dict], recipe: dict = RECIPE) -> list[dict]:
    """One invocation per step and seed of its kind (kind, value, for persons aliases), failures told and not raised.

    A passage is meant by its id; tools that take a document's number are given that of the passage.
    """
    out = []
    for n, step in enumerate(recipe["steps"], 1):
        for seed in seeds:
            if seed["kind"] != step["when"]:
                continue
            value = seed["value"]
            args = step.get("args", {}) | {ARGUMENT.get(seed["kind"], seed["kind"]): value}
            if seed["kind"] == "passage":
                row = corpus.passages.where(F.col("passage_id") == str(value)).select("doc_id").first()
                args["seed"] = row.doc_id if row else -1
            if seed.get("aliases"):
                args["aliases"] = seed["aliases"]
            out.append({"step": n, "seed_kind": seed["kind"], "seed": value, "file": f"tools/{n:02d}_{step['tool']}--{slug(str(value))}.json"} | _whole(corpus, step["tool"], args))
    return out


def cited(corpus: Corpus, invocations: list[dict]) -> DataFrame:
    """Passages that rows of the invocations name by passage or document, each once."""
    ids, docs = set(), set()
    for row in (r for i in invocations if i["ok"] for r in i["rows"]):
        if row.get("passage_id") is not None:
            ids.add(str(row["passage_id"]))
        elif row.get("doc_id") is not None:
            docs.add(int(row["doc_id"]))
    spark, p = corpus.passages.sparkSession, corpus.passages
    by_id = p.join(spark.createDataFrame([(i,) for i in sorted(ids)], "passage_id string"), "passage_id", "left_semi")
    by_doc = p.join(spark.createDataFrame([(d,) for d in sorted(docs)], "doc_id long"), "doc_id", "left_semi")
    return by_id.unionByName(by_doc.select(*by_id.columns)).dropDuplicates(["passage_id"])


def contexts(passages: DataFrame, found: DataFrame, before: int, after: int) -> DataFrame:
    """Neighbours in the file of every found passage: centre_id, relative_index, passage_id, zh_text_raw.

    Only files with a found passage are ordered; a file is one task.
    """
    rows = passages.join(found.select("source_rel_path").distinct(), "source_rel_path", "left_semi").select("source_rel_path", "passage_ord_in_file", "passage_id", "zh_text_raw")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("source_rel_path").orderBy("passage_ord_in_file", "passage_id")))
    near = rows.join(found.select("passage_id"), "passage_id", "left_semi").select("source_rel_path", F.col("passage_id").alias("centre_id"), F.explode(F.sequence(F.col("k") - before, F.col("k") + after)).alias("k"), F.col("k").alias("centre"))
    return near.join(rows, ["source_rel_path", "k"]).select("centre_id", (F.col("k") - F.col("centre")).alias("relative_index"), "passage_id", "zh_text_raw")


def full_works(passages: DataFrame, found: DataFrame, threshold: int) -> DataFrame:
    """All passages of works with at least ``threshold`` found ones: source_work_id, doc_id, passage_id, zh_text_raw."""
    works = found.groupBy("source_work_id").count().where(F.col("count") >= threshold).select("source_work_id")
    return passages.join(works, "source_work_id", "left_semi").select("source_work_id", "doc_id", "passage_id", "zh_text_raw")


def build(corpus: Corpus, topic: str, seeds: list[dict], out: str, recipe: dict = RECIPE) -> dict:
    """Write the packet to the driver's file ``out`` and return its manifest, which the packet holds as well."""
    runs = gather(corpus, seeds, recipe)
    found = cited(corpus, runs).cache()
    near = contexts(corpus.passages, found, recipe["context_before"], recipe["context_after"])
    works = full_works(corpus.passages, found, recipe["full_work_threshold"])
    tables = {
        "passages/passages.jsonl": found.select("passage_id", "source_work_id", "main_title", "period", "zh_text_raw").orderBy("passage_id"),
        "contexts/contexts.jsonl": near.orderBy("centre_id", "relative_index"),
        "documents/works.jsonl": works.orderBy("source_work_id", "doc_id"),
        "graphs/timeline.jsonl": evidence.timeline_edges(found).orderBy("source", "target"),
        "graphs/lineage.jsonl": evidence.lineage_edges(found).orderBy("source", "target"),
    }
    counts = {}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for run in runs:
            z.writestr(run["file"], json.dumps(run, ensure_ascii=False, indent=1))
        for name, df in tables.items():
            counts[name] = _stream(z, name, (json.dumps(r.asDict(recursive=True), ensure_ascii=False) for r in df.toLocalIterator()))
        calls = [{k: run[k] for k in ("step", "tool", "seed_kind", "seed", "file", "ok")} | {"row_count": run.get("row_count", 0), "error": run.get("error")} for run in runs]
        manifest = {"schema": "research-packet-v1", "topic": topic, "recipe": recipe["name"], "seeds": seeds, "calls": calls, "errors": sum(not r["ok"] for r in runs), "rows": counts}
        z.writestr("manifest.json", json.dumps(manifest, ensure_ascii=False, indent=1))
    found.unpersist()
    return manifest


def _stream(z: zipfile.ZipFile, name: str, lines: Iterator[str]) -> int:
    n = 0
    with z.open(name, "w", force_zip64=True) as f:
        for line in lines:
            f.write(line.encode() + b"\n")
            n += 1
    return n
