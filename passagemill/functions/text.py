"""Text expressions: normalisation, n-grams, offsets, quotes, citations.

Everything is a Column over built-in functions, so it stays in the JVM and in
generated code; positions are code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters dropped by normalisation and the ideograph ranges.
DROPPED = r"[\p{P}\p{S}\p{Z}\s\x{85}]+"
CJK = "[㐀-䶿一-鿿豈-﫿]"
CJK_WIDE = "[㐀-䶿一-鿿豈-﫿\\x{20000}-\\x{2a6df}]"
NOT_CJK_WIDE = "[^㐀-䶿一-鿿豈-﫿\\x{20000}-\\x{2a6df}]+"


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize(c: Column, variants: Mapping[str, str] | None = None) -> Column:
    """Drop white space, punctuation, symbols and separators, then fold variant characters.

    Input is taken to be in NFKC; ``nfkc`` brings it there.
    """
    out = F.regexp_replace(c, DROPPED, "")
    if variants:
        pairs = [(a, b) for a, b in variants.items() if len(a) == 1 and len(b) == 1]
        out = F.translate(out, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return out


def nfkc(c: Column) -> Column:
    """NFKC form by an Arrow function; only for sources that may hold other forms."""
    return F.udf(lambda s: None if s is None else unicodedata.normalize("NFKC", s), "string", useArrow=True)(c)


def merge_variants(first: Mapping[str, str], second: Mapping[str, str], third: Mapping[str, str]) -> dict[str, str]:
    """One variant table: ``first`` wins, ``second`` fills gaps, ``third`` only where neither side is folded already."""
    out = dict(first)
    for a, b in second.items():
        out.setdefault(a, b)
    for a, b in third.items():
        if a not in out and b not in out:
            out[a] = b
    return out


def contains_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ngrams(c: Column, n: int, alphabet: str = "letters") -> Column:
    """All n-grams in order; alphabet ``cjk`` keeps ideographs only before windowing."""
    s = F.regexp_replace(c, NOT_CJK_WIDE, "") if alphabet == "cjk" else c
    return F.regexp_extract_all(s, F.lit(f"(?=(.{{{n}}}))"), F.lit(1))


def low_value(gram: Column) -> Column:
    """One repeated character, or two equal halves of two or more characters."""
    return gram.rlike(r"^(.)\1*$") | gram.rlike(r"^(.{2,})\1$")


def find_offsets(c: Column, phrase: str) -> Column:
    """Start positions of the phrase, left to right, not overlapping."""
    parts = F.split(c, r"\Q" + phrase.replace(r"\E", r"\E\\E\Q") + r"\E", -1)
    step = len(phrase)
    return F.expr("array()").cast("array<int>") if not phrase else F.transform(
        F.slice(
            F.aggregate(
                parts,
                F.array(F.lit(0)).cast("array<int>"),
                lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + F.lit(step))),
            ),
            2,
            F.greatest(F.size(parts) - 1, F.lit(0)),
        ),
        lambda e: e - F.lit(step),
    )


def find_all_offsets(c: Column, phrases: list[str]) -> Column:
    """Sorted distinct start positions of any of the phrases."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(find_offsets(c, p) for p in phrases)))))


def min_pair_distance(a: Column, b: Column, ordered: bool = False) -> Column:
    """Least distance between a start in a and one in b; ``ordered``: a not after b. Null if none."""
    mark = lambda c, k: F.transform(c, lambda x: F.struct(x.alias("at"), F.lit(k).alias("of")))
    both = F.array_sort(F.concat(mark(a, 0), mark(b, 1)))  # the nearest of the other kind stands beside
    turn = lambda x, y: (x["of"] == 0) & (y["of"] == 1) if ordered else x["of"] != y["of"]
    gaps = F.transform(F.arrays_zip(F.slice(both, 1, F.greatest(F.size(both) - 1, F.lit(0))).alias("x"), F.slice(both, 2, F.greatest(F.size(both) - 1, F.lit(0))).alias("y")), lambda z: F.when(turn(z["x"], z["y"]), z["y"]["at"] - z["x"]["at"]))
    return F.array_min(gaps)


def same_sentence(c: Column, a: str, b: str) -> Column:
    """Both phrases in one sentence of the raw text."""
    return F.exists(F.split(c, "[。！？；\\n.!?;]"), lambda s: F.contains(s, F.lit(a)) & F.contains(s, F.lit(b)))


def char_slice(c: Column, start: Column | int, end: Column | int) -> Column:
    """Characters [start, end), 0-based, clamped."""
    start = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(0))
    end = F.lit(end) if isinstance(end, int) else end
    return F.when(end > start, F.substring(c, start + 1, end - start)).otherwise("")


def pair_snippet(c: Column, a: Column, b: Column, len_a: int, len_b: int, context: int = 20) -> Column:
    """Text around the first starts of both phrases."""
    x, y = F.element_at(a, 1), F.element_at(b, 1)
    return char_slice(c, F.least(x, y) - context, F.greatest(x + len_a, y + len_b) + context)


def quote_for_phrase(raw: Column, phrase: str) -> Column:
    """24 characters before the phrase and 48 behind its start, or the first 120."""
    at = F.instr(raw, F.lit(phrase))
    return F.when(at > 0, char_slice(raw, at - 1 - 24, at - 1 + 48 + len(phrase))).otherwise(F.substring(raw, 1, 120))


def truncated(c: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def locator(first: Column, last: Column) -> Column:
    """``a`` or ``a-b`` of two line labels."""
    a, b = text_or_empty(first), text_or_empty(last)
    return F.when(a == "", b).when((b == "") | (a == b), a).otherwise(F.concat(a, F.lit("-"), b))


def citation() -> Column:
    """author, title, [canon] (locator) of a passage row, empty parts left out."""
    part = lambda c, before="", after="": F.when(c != "", F.concat(F.lit(before), c, F.lit(after)))
    head = F.concat_ws(", ", part(text_or_empty("author")), part(text_or_empty("main_title")), part(text_or_empty("canon"), "[", "]"))
    place = part(locator(F.col("from_lb"), F.col("to_lb")), "(", ")")
    return F.concat_ws(" ", F.when(head != "", head), place)


def split_heading_path(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "/"), lambda s: F.trim(s)), lambda s: s != "")


def ancestors(div_path: Column) -> Column:
    """Each prefix of a ``a / b / c`` path, shortest first."""
    parts = F.split(div_path, " / ")
    return F.when(text_or_empty(div_path) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), " / ")))


def strip_fascicle(c: Column) -> Column:
    return F.regexp_replace(c, r"_\d+$", "")


def char_set_overlap(query: str, c: Column) -> Column:
    """Share of the query's distinct characters that the text has."""
    chars = sorted(set(query))
    if not chars:
        return F.lit(0.0)
    return sum((F.contains(c, F.lit(x)).cast("int") for x in chars), F.lit(0)) / F.lit(float(len(chars)))


def embedding_text(*named: tuple[str, Column]) -> Column:
    """``Label: value`` lines of the parts that are not empty."""
    return F.concat_ws("\n", *(F.when(text_or_empty(c) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in named))


def input_hash(template: str, c: Column) -> Column:
    return F.sha2(F.concat(F.lit(template), F.lit("\0"), c), 256)


def mention_class(name: str, norm: Column, text_type: Column) -> Column:
    """Class of a person's mention by ordered keyword rules."""
    any_of = lambda words: norm.rlike("|".join(words))
    # Keywords of each class.
    return (
        F.when(any_of(["嗣", "法嗣", "傳法"]), "lineage_relation")
        .when(any_of([f"{name}{v}" for v in ("云", "曰", "示")]), "attributed_saying")
        .when(text_type == "dialogue", "case_appearance")
        .when(any_of(["頌", "評", "拈"]), "commentarial_reference")
        .otherwise("name_mention")
    )


def rank_score(rank: Column) -> Column:
    return F.lit(1.0) / F.greatest(rank, F.lit(1))


def hybrid_score(vector_rank: Column, lexical_rank: Column) -> Column:
    """3 + .25 s + .5 l for both, 2 + .5 l for lexical, 1 + .25 s for vector hits."""
    s, l = rank_score(vector_rank), rank_score(lexical_rank)  # noqa: E741
    return (
        F.when(vector_rank.isNotNull() & lexical_rank.isNotNull(), 3 + 0.25 * s + 0.5 * l)
        .when(lexical_rank.isNotNull(), 2 + 0.5 * l)
        .when(vector_rank.isNotNull(), 1 + 0.25 * s)
        .otherwise(0.0)
    )


def log_odds(a: Column, total_a: Column, b: Column, total_b: Column, terms: Column, alpha: float = 0.01) -> Column:
    return F.log(((a + alpha) / (total_a + alpha * terms)) / ((b + alpha) / (total_b + alpha * terms)))


def quantize(w: Column, w_max: Column) -> Column:
    """Weight on a logarithmic scale of 0 to 255."""
    return F.when((w_max <= 0) | (w <= 0), 0).when(w >= w_max, 255).otherwise(F.round(255 * F.log1p(w) / F.log1p(w_max))).cast("int")
