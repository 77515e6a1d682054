"""Phrase search and its relatives: exact, by variants, by heading, first attestations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_set_overlap, citation, quote_for_phrase, text_or_empty
from ..plans.scope import Scope
from ..sources.passages import chronological

BRIEF = ["passage_id", "source_work_id", "main_title", "heading"]


def has_phrase(phrase: str, c: str = "zh_text_normalized") -> Column:
    """The normalised text holds the phrase; an empty phrase adds no condition."""
    return F.contains(F.col(c), F.lit(phrase)) if phrase else F.lit(True)


def hits(passages: DataFrame, phrases: str | list[str], scope: Scope = Scope()) -> DataFrame:
    """Passages in scope that hold any of the phrases, each once."""
    wanted = [phrases] if isinstance(phrases, str) else phrases
    any_of = reduce(lambda a, b: a | b, map(has_phrase, wanted))
    return passages.where(scope.column() & any_of)


def search(passages: DataFrame, phrases: str | list[str], scope: Scope = Scope(), limit: int = 20) -> DataFrame:
    """The first hits in chronological order."""
    return hits(passages, phrases, scope).orderBy(*chronological()).limit(max(1, limit))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rank of rows that are few (a limited result)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def brief(df: DataFrame, phrase: str = "", quote: int = 120) -> DataFrame:
    """Identity, heading and a quote of each hit."""
    text = quote_for_phrase(F.col("zh_text_raw"), phrase) if phrase else F.col("zh_text_raw")
    return df.select(*BRIEF, F.substring(text, 1, quote).alias("zh_quote"))


def passage(passages: DataFrame, passage_id: str) -> DataFrame:
    """One passage with its citation."""
    return passages.where(F.col("passage_id") == passage_id).limit(1).withColumn("citation", citation())


def lookup(passages: DataFrame, ids: DataFrame, limit_ids: int = 1_000_000) -> DataFrame:
    """Passages of a table of ids; the ids are broadcast while they are few."""
    wanted = ids.select("passage_id").distinct()
    return passages.join(F.broadcast(wanted) if wanted.count() <= limit_ids else wanted, "passage_id", "left_semi")


def heading_search(passages: DataFrame, query: str, scope: Scope = Scope(), limit: int = 20) -> DataFrame:
    """Heading or heading path holds the query in any case, or the text holds it."""
    low = F.lit(query.lower())
    found = F.contains(F.lower(text_or_empty("heading")), low) | F.contains(F.lower(text_or_empty("heading_path")), low) | has_phrase(query)
    return passages.where(scope.column() & found).orderBy(*chronological()).limit(max(1, limit)).select("source_work_id", "main_title", "heading", "heading_path", "passage_id", F.substring("zh_text_raw", 1, 80).alias("sample"))


def canonical_source(passages: DataFrame, phrase: str, canon: str | None = None, limit: int = 20) -> DataFrame:
    """Earliest hits in the given canons, or in any canon."""
    side = Scope(canon=canon).column() if canon else F.col("canon") != ""
    found = passages.where(side & has_phrase(phrase)).orderBy(*chronological()).limit(max(1, limit))
    return found.select(*BRIEF, "canon", "period_rank", F.lit(True).alias("is_canon_side"))


def first_attestations(passages: DataFrame, phrase: str, scope: Scope = Scope(), limit: int = 20) -> DataFrame:
    """Earliest hits by (period rank, document id); row 1 is the first attestation."""
    early = hits(passages, phrase, scope).orderBy(F.coalesce("period_rank", F.lit(99)), "doc_id").limit(max(1, limit))
    return ranked(early, F.coalesce("period_rank", F.lit(99)), F.col("doc_id")).select("rank", "passage_id", "doc_id", "period_rank", "source_work_id")


def absence(passages: DataFrame, phrase: str, scope: Scope = Scope(), samples: int = 5) -> DataFrame:
    """One row: found, hit_count, the first few passage ids."""
    found = hits(passages, phrase, scope)
    first = found.orderBy("doc_id").limit(samples).agg(F.array_sort(F.collect_list(F.struct("doc_id", "passage_id"))).alias("s")).select(F.transform("s", lambda r: r["passage_id"]).alias("sample_hits"))
    return found.agg(F.count("*").alias("hit_count")).select((F.col("hit_count") > 0).alias("found"), "hit_count").crossJoin(first)


def batch_search(passages: DataFrame, phrases: list[str], limit: int = 20, samples: int = 5) -> DataFrame:
    """Hits of each phrase in input order: number returned, truncation, first ids.

    One scan: each passage is flattened to the phrases it holds, counted before
    the shuffle; only the first few ids of a phrase are ever ranked.
    """
    table = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(p).alias("phrase")) for i, p in enumerate(phrases)))
    held = passages.select("doc_id", "passage_id", F.explode(F.filter(table, lambda r: F.contains(F.col("zh_text_normalized"), r["phrase"]))).alias("r")).select("doc_id", "passage_id", "r.position", "r.phrase")
    total = held.groupBy("position").agg(F.count("*").alias("n"))
    top = held.withColumn("k", F.row_number().over(Window.partitionBy("position").orderBy("doc_id"))).where(F.col("k") <= samples)
    ids = top.groupBy("position").agg(F.array_sort(F.collect_list(F.struct("doc_id", "passage_id"))).alias("s")).select("position", F.transform("s", lambda r: r["passage_id"]).alias("sample_passage_ids"))
    asked = passages.sparkSession.createDataFrame([(i, p) for i, p in enumerate(phrases)], "position int, phrase string")
    out = asked.join(F.broadcast(total), "position", "left").join(F.broadcast(ids), "position", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("position", "phrase", F.least(n, F.lit(limit)).cast("long").alias("hit_count"), (n >= limit).alias("possibly_truncated"), F.coalesce("sample_passage_ids", F.array().cast("array<string>")).alias("sample_passage_ids"))


def anchors(phrase: str, most: int = 8) -> list[str]:
    """The phrase and its windows of 10, 8, 6 and 4 characters, first ones only."""
    out = [phrase]
    for n in (10, 8, 6, 4):
        if n < len(phrase):
            out += [phrase[i : i + n] for i in range(len(phrase) - n + 1)]
    return list(dict.fromkeys(out))[:most]


def similar_phrase(passages: DataFrame, phrase: str, limit: int = 20) -> DataFrame:
    """Passages that hold the phrase or a window of it; the first anchor that fits names the match."""
    found = F.lit(None).cast("string")
    for a in reversed(anchors(phrase)):
        found = F.when(has_phrase(a), F.lit(a)).otherwise(found)
    rows = passages.withColumn("anchor", found).where(F.col("anchor").isNotNull())
    kind = F.when(F.col("anchor") == phrase, "exact").otherwise("partial_anchor")
    return rows.orderBy("passage_id").limit(max(1, limit)).select("passage_id", "anchor", kind.alias("match_class"))


def variants(phrase: str, folds: dict[str, str], most: int = 20) -> list[str]:
    """The phrase and its spellings with one character exchanged for a variant."""
    back: dict[str, list[str]] = {}
    for a, b in folds.items():
        back.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    out = [phrase]
    for i, c in enumerate(phrase):
        out += [phrase[:i] + v + phrase[i + 1 :] for v in back.get(c, [])]
    return list(dict.fromkeys(out))[: max(1, most)]


def prefixes(phrase: str) -> list[str]:
    """Conservative variants: the phrase and its first 4, 6, 8 and 10 characters."""
    return list(dict.fromkeys([phrase, *(phrase[:n] for n in (4, 6, 8, 10) if n < len(phrase))]))


def language_guess(text: str) -> str:
    cjk = any("㐀" <= c <= "鿿" or "豈" <= c <= "﫿" for c in text)
    latin = any(c.isascii() and c.isalpha() for c in text)
    return "mixed" if cjk and latin else "zh" if cjk else "en" if latin else "unknown"


def citation_verify(passages: DataFrame, quote: str, scope: Scope = Scope(), limit: int = 20, near: int = 10, least: float = 0.5) -> DataFrame:
    """Exact hits; where there are none, passages that share a 4-character probe, by character overlap."""
    exact = hits(passages, quote, scope).orderBy("doc_id").limit(max(1, limit)).select("passage_id", F.lit("exact").alias("match"), F.lit(1.0).alias("overlap_score"))
    step = max(1, (len(quote) - 4) // 5) if len(quote) > 4 else 1
    probes = list(dict.fromkeys(quote[i : i + 4] for i in range(0, max(1, len(quote) - 3), step)))
    share = F.round(char_set_overlap(quote, F.col("zh_text_normalized")), 6)
    close = hits(passages, probes, scope).where(~has_phrase(quote)).withColumn("overlap_score", share).where(F.col("overlap_score") >= least).orderBy(F.desc("overlap_score"), "doc_id").limit(near)
    none = F.broadcast(exact.agg(F.count("*").alias("n")).where("n = 0"))
    return exact.unionByName(close.select("passage_id", F.lit("near").alias("match"), "overlap_score").crossJoin(none).drop("n"))


def seed_pick(passages: DataFrame, worked: DataFrame, scope: Scope = Scope(), limit: int = 20) -> DataFrame:
    """Passages in scope that are no seed yet, in chronological order."""
    fresh = passages.where(scope.column()).join(worked.select("passage_id").distinct(), "passage_id", "left_anti")
    return fresh.orderBy(*chronological()).limit(max(1, limit)).select("passage_id", "source_work_id", "period_rank")
