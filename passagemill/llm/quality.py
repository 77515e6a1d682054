"""Quality rules: text statistics and a learned decision list.

Sequential covering grows threshold conjunctions for low-quality texts on two
thirds of the labelled rows by information gain, prunes each on the other
third, keeps it if it is precise there, and goes on with what it left over.
The list is emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import words_of, windows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_stops", "longest_word"]
_WS = bytes([0x20, 9, 10, 11, 12, 13])
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_STOPS = b".!?"


def _without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def _repeated(sh: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more; sh: the windows' hashes in order."""
    order = np.sort(sh)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, inverse, count = np.unique(sh, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    cover = np.zeros(len(sh) + 2, bool)
    for k in range(3):
        cover[at + k] = True
    return int(cover.sum())


def _measure(batches):
    for batch in batches:
        texts = batch.column(1)
        h, off = words_of(texts)
        sh, _ = windows(h, off, 3)
        cols: dict[str, list[int]] = {c: [] for c in COUNTS}
        for i, text in enumerate(texts):
            text = text.as_py() or ""
            data = text.encode("utf-8", "surrogatepass")
            a, b = int(off[i]), int(off[i + 1])
            lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            row = (b - a, len(text) - _without(data, _WS), _without(data, _SYMBOLS), len(lines) - len(set(lines)), _repeated(sh[a : b - 2]) if b - a > 3 else 0, len(lines), len(np.unique(h[a:b])), _without(data, _UPPER), _without(data, _DIGITS), _without(data, _STOPS), max(map(len, data.split()), default=0))
            for c, v in zip(COUNTS, row):
                cols[c].append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text; a null text has no words and no lines."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """What the learned conditions are about, from the counts."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "longest_word": F.col("longest_word").cast("double"),
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct") / words,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "words_per_stop": words / F.greatest(F.col("n_stops"), F.lit(1)),
        "words_per_line": words / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, x: dict[str, Column]) -> Column:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions that reject; a text that none fits is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def column(self) -> Column:
        x, out = features(), None
        for rule in self.rules:
            both = rule[0].column(x)
            for c in rule[1:]:
                both = both & c.column(x)
            out = F.when(both, False) if out is None else out.when(both, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        out = np.ones(n, bool)
        for rule in self.rules:
            out &= ~np.logical_and.reduce([c.holds(x) for c in rule])
        return out

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) + ": reject" for r in self.rules) + "\notherwise: keep"


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, cuts: int = 48, most_conditions: int = 4, least_bad: int = 5, precision: float = 0.95, most_rules: int = 32) -> DecisionList:
    """Grow and prune rules for ``bad`` rows; fold: integers, those 0 modulo 3 prune."""
    grow, prune = fold % 3 != 0, fold % 3 == 0
    alive = np.ones(len(bad), bool)
    rules = []
    edges = {f: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1))) if len(v) else v for f, v in x.items()}
    edges = {f: (e[1:] + e[:-1]) / 2 for f, e in edges.items()}
    for f, v in x.items():  # thresholds that part the bad rows, too
        if bad.any():
            q = np.unique(np.quantile(v[bad], np.linspace(0, 1, 17)))
            edges[f] = np.unique(np.concatenate((edges[f], (q[1:] + q[:-1]) / 2)))
    options = [Condition(f, above, float(t)) for f, e in edges.items() for t in e for above in (True, False)]
    masks = [c.holds(x) for c in options]
    while len(rules) < most_rules and (bad & alive & grow).sum() >= least_bad:
        inside, rule = alive & grow, []
        while len(rule) < most_conditions:
            p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
            if not n:
                break
            base = math.log2(p / (p + n))
            best, at = 1e-9, None
            for c, m in zip(options, masks):
                here = inside & m
                pp = int((here & bad).sum())
                if pp < least_bad:
                    continue
                gain = pp * (math.log2(pp / int(here.sum())) - base)
                if gain > best:
                    best, at = gain, (c, m)
            if at is None:
                break
            rule.append(at)
            inside = inside & at[1]
        if not rule:
            break
        held = alive & prune
        worth = []
        for k in range(1, len(rule) + 1):
            m = held & np.logical_and.reduce([r[1] for r in rule[:k]])
            p, n = int((m & bad).sum()), int((m & ~bad).sum())
            worth.append(((p + 1) / (p + n + 2), -k))
        k = -max(worth)[1]
        m = np.logical_and.reduce([r[1] for r in rule[:k]]) & alive
        p, n = int((m & bad).sum()), int((m & ~bad).sum())
        q, r = int((m & bad & prune).sum()), int((m & ~bad & prune).sum())
        if p + n == 0 or p / (p + n) < precision or (q + r and q / (q + r) < precision):
            break
        rules.append(tuple(c for c, _ in rule[:k]))
        alive &= ~m
    return DecisionList(tuple(rules))


def fit(counts: DataFrame, labels: DataFrame, most: int = 20_000, id_col: str = "doc_id", label_col: str = "quality") -> DecisionList:
    """Learn from at most ``most`` labelled rows, those whose hashed ids come first.

    Rows without an id or a label are not learned from; a repeated id gives so many examples; extra columns are
    ignored; no labels, or no rejected ones: an empty list, which keeps all.
    """
    x = features()
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("good")).where("good is not null and doc_id is not null")
    rows = counts.join(known, "doc_id").select(F.xxhash64("doc_id").alias("order"), "doc_id", "good", *(c.alias(f"f_{f}") for f, c in x.items()))
    got = rows.orderBy("order", "doc_id", "good").limit(most).toPandas()
    values = {f: got[f"f_{f}"].to_numpy(float) for f in x}
    return learn(values, got["good"].to_numpy() == 0, np.arange(len(got))) if len(got) else DecisionList(())


def judge(counts: DataFrame, rules: DecisionList) -> DataFrame:
    """Add base_failed and kept to the counts; blank texts have no words and fail, repeated rows are judged each, other columns stay."""
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & rules.column())
