"""Scopes and filters as one Column, so Catalyst pushes all of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import text_or_empty


def values(text: str | list[str] | None) -> list[str]:
    """Comma-separated or listed values, trimmed, each once."""
    parts = text.split(",") if isinstance(text, str) else (text or [])
    return list(dict.fromkeys(p.strip() for p in parts if p and p.strip()))


@dataclass(frozen=True)
class Scope:
    """Conjunctive filters; several values of one filter mean any of them.

    Prefixes and substrings are literal, empty filters add nothing. A range of
    document ids is inclusive at both ends.
    """

    canon: str | list[str] | None = None
    period: str | list[str] | None = None
    origin: str | list[str] | None = None
    tradition: str | list[str] | None = None
    source_work_id: str | list[str] | None = None
    author: str | None = None
    title: str | None = None
    heading_path_prefix: str | None = None
    doc_range: tuple[int, int] | None = None
    passage_ids: list[str] = field(default_factory=list)
    node_id: str | None = None  # corpus|canon|work|division / division, cut off anywhere

    def column(self) -> Column:
        parts: list[Column] = []
        for name in ("canon", "period", "origin", "source_work_id"):
            if wanted := values(getattr(self, name)):
                parts.append(F.col(name).isin(wanted))
        if wanted := values(self.tradition):
            parts.append(F.arrays_overlap("traditions", F.array(*map(F.lit, wanted))))
        for name, text in (("author", self.author), ("main_title", self.title)):
            if text:
                parts.append(F.contains(F.lower(text_or_empty(name)), F.lit(text.lower())))
        if self.heading_path_prefix:
            parts.append(F.startswith(text_or_empty("heading_path"), F.lit(self.heading_path_prefix)))
        if self.doc_range:
            parts.append(F.col("doc_id").between(*self.doc_range))
        if self.node_id:
            for name, text in zip(("source_corpus", "canon", "source_work_id"), self.node_id.split("|")):
                parts.append(F.col(name) == text)
            if self.node_id.count("|") == 3:
                div = self.node_id.rpartition("|")[2]
                parts.append((F.col("div_path") == div) | F.startswith("div_path", F.lit(f"{div} / ")))
        if self.passage_ids:
            parts.append(F.col("passage_id").isin(self.passage_ids))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def looks_like_work_id(text: str) -> bool:
    """Letters, digits, ``n``, digits: a work, not a passage."""
    import re

    return bool(re.fullmatch(r"[A-Z]{1,3}\d{1,3}n[A-Za-z]?\d{3,5}[A-Za-z]?", text))


def check_passage_id(text: str) -> str:
    """The id, or ValueError for blank ones, ones with white space and work ids."""
    if not text or text != text.strip() or any(c.isspace() for c in text):
        raise ValueError(f"not a passage id: {text!r}")
    if looks_like_work_id(text):
        raise ValueError(f"{text} is a work id; ask for one of its passages")
    return text
