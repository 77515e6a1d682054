"""People and places: name forms, mentions, histories, dictionary annotation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_cjk, mention_class, truncated
from .groups import top_per_group

BROADCAST_TERMS = 500_000


def name_forms(authority: DataFrame, id_col: str = "person_id") -> DataFrame:
    """(form, id, priority): the primary name, then each other name."""
    names = F.filter(F.concat(F.array("primary_name"), F.coalesce("alt_names", F.array().cast("array<string>"))), lambda x: x != "")
    return authority.select(id_col, F.posexplode(names).alias("priority", "form")).select("form", id_col, "priority")


def resolve(authority: DataFrame, forms: list[str], id_col: str = "person_id") -> DataFrame:
    """The authority row of the first form that any row has; ties by the form's priority there, then id."""
    asked = F.array_position(F.array(*map(F.lit, forms)), F.col("form"))
    found = name_forms(authority, id_col).where(F.col("form").isin(forms)).withColumn("asked", asked)
    best = found.orderBy("asked", "priority", id_col).limit(1).select(id_col, F.col("form").alias("matched_form"))
    return authority.join(F.broadcast(best), id_col)


def mentions(passages: DataFrame, forms: list[str]) -> DataFrame:
    """Passages with any form, each once: the forms found, whether the first form is among them, the mention's class."""
    table = F.array(*map(F.lit, forms))
    found = F.filter(table, lambda f: F.contains(F.col("zh_text_normalized"), f))
    rows = passages.withColumn("name_forms", found).where(F.size("name_forms") > 0)
    return rows.withColumn("is_primary", F.array_contains("name_forms", forms[0])).withColumn("mention_class", mention_class(forms[0], F.col("zh_text_normalized"), F.col("text_type")))


def history_summary(found: DataFrame, samples: int = 3) -> DataFrame:
    """Mentions per class and period with the first ids."""
    counts = found.groupBy("mention_class", "period").agg(F.count("*").alias("n"))
    return counts.join(top_per_group(found, ["mention_class", "period"], [F.col("doc_id")], samples, name="samples"), ["mention_class", "period"])


def earliest_unambiguous(found: DataFrame) -> DataFrame:
    """The earliest mention in a passage that is marked to hold a person, and how many earlier ones are not."""
    order = F.struct(F.coalesce("period_rank", F.lit(99)).alias("r"), F.col("doc_id").alias("d"))
    first = found.where("contains_person").agg(F.min(order).alias("first"))
    return found.crossJoin(F.broadcast(first)).groupBy("first").agg(F.count_if(order < F.col("first")).alias("earlier_ambiguous")).select(F.col("first.d").alias("doc_id"), "earlier_ambiguous")


def risk(name: str) -> str:
    """How likely a name's hits are chance: by its length."""
    return "high" if len(name) <= 1 else "medium" if len(name) == 2 else "low"


def co_named(mentions_df: DataFrame, name_form: str) -> Column:
    return F.array_contains("name_forms", name_form)


def _greedy(shared):
    """Longest matches left to right; a match needs only an uncovered start. ``shared``: a broadcast of scores by term."""

    def run(batches):
        scores = shared.value
        longest = max(map(len, scores), default=0)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found, covered, last = [], 0, None
                for i in range(len(text or "")):
                    if i < covered:
                        continue
                    for n in range(min(longest, len(text) - i), 0, -1):
                        term = text[i : i + n]
                        if term in scores:
                            covered = i + n
                            if term != last:
                                found.append({"term": term, "start": i, "score": scores[term]})
                            last = term
                            break
                out.append(found)
            kind = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("score", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "terms"])

    return run


def annotate(passages: DataFrame, dictionary: DataFrame, text: str = "zh_text_normalized", most_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(doc_id, terms) by greedy longest match; score 10 a character and 5 for a Sanskrit form.

    The dictionary is sent to the executors, so its size is checked.
    """
    rows = dictionary.groupBy("term").agg(F.max(F.coalesce(F.col("sanskrit"), F.lit("")) != "").alias("s"))
    n = rows.count()
    if n > most_terms:
        raise ValueError(f"the dictionary has {n} terms; {most_terms} may be sent to executors")
    got = rows.toArrow()
    scores = {t: 10 * len(t) + 5 * bool(s) for t, s in zip(got["term"].to_pylist(), got["s"].to_pylist()) if t}
    shared = passages.sparkSession.sparkContext.broadcast(scores)
    return passages.select("doc_id", text).mapInArrow(_greedy(shared), "doc_id long, terms array<struct<term: string, start: int, score: int>>")


def extract_terms(passages: DataFrame, dictionary: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, rank, term, start, score, gloss, source, sanskrit): each passage's best terms by score, then place, with their entry."""
    rows = annotate(passages, dictionary).select("doc_id", F.posexplode(F.slice(F.array_sort("terms", lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).otherwise(a["start"] - b["start"])), 1, most)).alias("rank", "t")).select("doc_id", (F.col("rank") + 1).alias("rank"), "t.*")
    return rows.join(best_entries(dictionary), "term")


def extract_entities(passages: DataFrame, persons: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, start, form, kind, id): persons and places by any of their names, found in one greedy pass; a form's best bearer each."""
    forms = name_forms(persons).select("form", F.lit("person").alias("kind"), F.col("person_id").alias("id"), "priority")
    forms = forms.unionByName(name_forms(places, "place_id").select("form", F.lit("place").alias("kind"), F.col("place_id").alias("id"), "priority"))
    best = forms.groupBy("form", "kind").agg(F.min(F.struct("priority", "id"))["id"].alias("id"))
    found = annotate(passages, forms.select(F.col("form").alias("term"), F.lit("").alias("sanskrit")).distinct())
    return found.select("doc_id", F.explode("terms").alias("t")).select("doc_id", F.col("t.start").alias("start"), F.col("t.term").alias("form")).join(best, "form")


def annotate_answer(answer: DataFrame, texts: list[str], dictionary: DataFrame, persons: DataFrame, places: DataFrame, most: int = 8, gloss: int = 300) -> DataFrame:
    """What a limited answer's texts mention: terms with a cut gloss, persons and places, each once (kind, id, note)."""
    text = F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in texts))
    rows = answer.select(F.monotonically_increasing_id().alias("doc_id"), text.alias("zh_text_normalized")).where(contains_cjk(F.col("zh_text_normalized")))
    terms = extract_terms(rows, dictionary, most).groupBy(F.col("term").alias("id")).agg(F.max("score").alias("s"), F.max(truncated(F.col("gloss"), gloss)).alias("note"))
    terms = terms.orderBy(F.desc("s"), "id").limit(most).select(F.lit("term").alias("kind"), "id", "note")
    return terms.unionByName(extract_entities(rows, persons, places).groupBy("kind", "id").agg(F.min("form").alias("note")))


def best_entries(dictionary: DataFrame) -> DataFrame:
    """One entry a term: the preferred source, then one with a Sanskrit form, then any, by source."""
    order = F.struct((F.col("source") != "soothill").alias("a"), F.col("sanskrit").isNull().alias("b"), F.col("source").alias("source"), F.col("gloss").alias("gloss"), F.col("sanskrit").alias("sanskrit"))
    return dictionary.groupBy("term").agg(F.min(order).alias("e")).select("term", "e.source", "e.gloss", "e.sanskrit")
