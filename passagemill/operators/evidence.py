"""Evidence graphs, adjudication rules and registry tables from accepted claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

# What an adjudication may say.
ROLES = "seed candidate".split()
RELATIONS = "exact-reuse variant-reuse image-reuse biographical-retelling commentarial-reuse formulaic-reuse quotes-canon cites-sutra quotes-sastra echoes-canon inherits-phrase-from uses-transliteration cluster-member reference-scaffold".split()
STATES = "auto_import needs_review candidate_only".split()
BOILERPLATE = "not_boilerplate possible_boilerplate boilerplate".split()
RENDER = "render_default collapse store_hidden".split()
CONFIDENCE = "low medium high".split()
RINGS = {"ring_1": 1, "ring_2": 2, "ring_3": 3}
SIDES = {"zen": "seed", "canon": "candidate"}
EVIDENCE = "struct<passage_id string, evidence_role string, side string, zh_quote string, quote_zh string>"
TASK = f"task_id string, seed_passage_id string, accepted_claims array<struct<claim_id string, evidence array<{EVIDENCE}>, matched_phrases array<string>, relation_label string, claim_type string, review_state string, confidence string, ring string, boilerplate_assessment string, graph_hint struct<research_lens string, edge_label string, map_ring int, render_policy string, render string>>>, rejected_candidates array<string>"


def _role(e: Column) -> Column:
    side = e["side"]
    for name, role in SIDES.items():
        side = F.when(e["side"] == name, role).otherwise(side)
    return F.coalesce(e["evidence_role"], side)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _not_in(c: Column, allowed: list) -> Column:
    return c.isNotNull() & ~c.isin(allowed)


def violations(tasks: DataFrame) -> DataFrame:
    """(task_id, claim_id, rule) of every broken rule; no rows: valid.

    A claim's evidence is checked item by item only where there are two items or more.
    """
    claim = tasks.select("task_id", "seed_passage_id", "accepted_claims", "rejected_candidates", F.explode_outer("accepted_claims").alias("c"))
    items = F.coalesce("c.evidence", F.array().cast(f"array<{EVIDENCE}>"))
    roles, two, here = F.transform(items, _role), F.size(items) >= 2, F.col("c").isNotNull()
    number = F.expr("try_cast(c.confidence as double)")
    hint = F.col("c.graph_hint")
    ring = hint["map_ring"]
    top = {f"missing_{k}": F.col(k).isNull() for k in ("task_id", "seed_passage_id", "accepted_claims", "rejected_candidates")}
    rules = {
        "two_evidence": here & ~two,
        "seed_role": here & two & ~F.array_contains(F.array_compact(roles), "seed"),
        "candidate_role": here & two & ~F.array_contains(F.array_compact(roles), "candidate"),
        "zh_quote": two & F.exists(items, lambda e: _blank(e["zh_quote"]) & _blank(e["quote_zh"])),
        "passage_id": two & F.exists(items, lambda e: _blank(e["passage_id"])),
        "evidence_role": two & F.exists(roles, lambda r: _not_in(r, ROLES)),
        "matched_phrases": here & (F.coalesce(F.size("c.matched_phrases"), F.lit(0)) <= 0),
        "relation_label": _not_in(F.coalesce("c.relation_label", hint["edge_label"], "c.claim_type"), RELATIONS),
        "state": _not_in(F.col("c.review_state"), STATES),
        "confidence": F.when(number.isNotNull(), ~number.between(0, 1)).otherwise(_not_in(F.col("c.confidence"), CONFIDENCE)),
        "boilerplate": _not_in(F.col("c.boilerplate_assessment"), BOILERPLATE),
        "research_lens": here & hint["research_lens"].isNull(),
        "ring": _not_in(ring, list(RINGS.values())),
        "render_policy": _not_in(F.coalesce(hint["render_policy"], hint["render"]), RENDER),
    }
    pick = lambda found: F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in found.items())))
    whole = tasks.select("task_id", F.lit(None).cast("string").alias("claim_id"), F.explode(pick(top)).alias("rule"))
    return whole.unionByName(claim.select("task_id", F.col("c.claim_id").alias("claim_id"), F.explode(pick(rules)).alias("rule")))


def edges(tasks: DataFrame) -> DataFrame:
    """Seed to candidate edges of accepted claims that name both ends."""
    claim = tasks.select(F.explode("accepted_claims").alias("c"))
    end = lambda role: F.try_element_at(F.filter("c.evidence", lambda e: _role(e) == role), F.lit(1))["passage_id"]
    return claim.select(F.col("c.claim_id").alias("claim_id"), end("seed").alias("source"), end("candidate").alias("target"), F.coalesce("c.relation_label", "c.graph_hint.edge_label", "c.claim_type").alias("relation"), F.col("c.confidence").alias("confidence")).where("source is not null and target is not null")


def nodes(tasks: DataFrame) -> DataFrame:
    """Evidence passages, each once."""
    return tasks.select(F.explode("accepted_claims").alias("c")).select(F.explode("c.evidence").alias("e")).select(F.col("e.passage_id").alias("id")).where("id is not null").distinct()


def timeline_edges(passages: DataFrame) -> DataFrame:
    """Each period to the one after it, by rank, and periods to their passages."""
    periods = passages.groupBy("period").agg(F.min("period_rank").alias("rank"))
    nxt = F.lead("period").over(Window.orderBy("rank", "period"))
    chain = periods.select(F.col("period").alias("source"), nxt.alias("target"), F.lit("precedes").alias("relation")).where("target is not null")
    return chain.unionByName(passages.select(F.col("period").alias("source"), F.col("passage_id").alias("target"), F.lit("member").alias("relation")))


def names_of(c: Column) -> Column:
    """Up to three characters before each title of respect, each name once, in order."""
    # Fixed value: titles that end a name.
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("(.{1,3})(?:祖|禪師|師|和尚)"), F.lit(1)), lambda n: n != ""))


def lineage_edges(passages: DataFrame) -> DataFrame:
    """Names before a title of respect to the passages that have them."""
    return passages.select(F.explode(names_of(F.col("zh_text_raw"))).alias("source"), F.col("passage_id").alias("target"), F.lit("appears in evidence").alias("relation"))


def same_seed(items: DataFrame) -> DataFrame:
    """Pairs of a task packet and other items of its seed (item_id, kind, seed_passage_id)."""
    a = items.where("kind = 'task_packet'").select(F.col("item_id").alias("source"), "seed_passage_id")
    b = items.select(F.col("item_id").alias("target"), "seed_passage_id")
    return a.join(b, "seed_passage_id").where("source != target").select("source", "target", F.lit("same_seed").alias("relation"))


def merged(*tables: DataFrame) -> DataFrame:
    """Union of evidence tables (passage_id, ...), the first table's row of a passage winning, of several there the least by its columns."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("_k", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("passage_id").orderBy("_k", *(c for c in sorted(out.columns) if c not in ("passage_id", "_k") and not isinstance(out.schema[c].dataType, MapType))))
    return out.withColumn("_n", first).where("_n = 1").drop("_n", "_k")
