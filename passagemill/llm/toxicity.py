"""Counterfactual-regularised toxicity classifier.

A text is the set of its lower-cased words and their prefixes, hashed; a
sparse logistic model is trained on labelled texts. Labelled sentences that
mention an identity term get counterparts in which the term is swapped for each
other of its group; a text without one gets two counterparts that mention one
term and another. The squared change of the score between the two is penalised,
so neutral mentions of groups do not raise a score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import lean

# Groups of identity terms that can stand in for one another.
IDENTITY = [
    "women men girls boys",
    "woman man girl boy",
    "muslims christians jews hindus buddhists atheists catholics protestants sikhs",
    "muslim christian jewish hindu buddhist atheist catholic protestant sikh",
    "gay lesbian straight bisexual transgender queer heterosexual",
    "black white asian african latino hispanic arab european indigenous",
    "immigrants refugees foreigners natives migrants",
    "blind deaf disabled autistic elderly young",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs bouddhistes athées",
    "frauen männer mädchen jungen",
    "muslime christen juden buddhisten atheisten",
    "mujeres hombres niñas niños",
    "musulmanes cristianos judíos budistas ateos",
]
WORD = re.compile(r"[^\W\d_]+")
BITS = 20
KNOWN_CHUNKS = 400_000


def features_of(word: str) -> list[int]:
    """Hashed features of one lower-cased word: itself and its prefixes."""
    forms = [f"={word}", *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k)]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for f in forms]


def words_in(chunk: str) -> list[str]:
    return WORD.findall(chunk.lower())


class Known(dict):
    """Features by white-space separated chunk, with a bound on what is kept."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, chunk: str):
        out = self.of(chunk)
        if len(self) < KNOWN_CHUNKS and len(chunk) < 64:
            self[chunk] = out
        return out


def counterfactuals(text: str, groups: list[str]) -> list[tuple[set[int], set[int], set[int], set[int]]]:
    """Pairs of variants of a text, each as features (added, removed, added, removed).

    Of a text that mentions identity terms: as it is, and with one term as another of its group wherever it stands. Of
    any other text: with one term and with another of a group put in; which, its checksum tells.
    """
    words = set(words_in(text))
    partner = _partners(groups)
    have = {f for w in words for f in features_of(w)}
    out = []
    for a in sorted(words & partner.keys()):
        others = {f for w in words if w != a for f in features_of(w)}
        for b in partner[a]:
            new = others.union(features_of(b))
            out.append((set(), set(), new - have, have - new))
    if not out and words and groups:
        pick = zlib.crc32(text.encode("utf-8", "surrogatepass"))
        terms = groups[pick % len(groups)].split()
        first = pick // len(groups) % len(terms)
        other = (first + 1 + pick // 7919 % max(1, len(terms) - 1)) % len(terms)
        out.append((set(features_of(terms[first])) - have, set(), set(features_of(terms[other])) - have, set()))
    return out


def _packed(features) -> bytes:
    return np.sort(np.fromiter(features, np.int32, len(features))).astype("<i4").tobytes()


def _partners(groups: list[str]) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for g in groups:
        terms = g.split()
        for t in terms:
            out[t] = out.get(t, ()) + tuple(x for x in terms if x != t)
    return out


def _gather(groups: list[str]):
    def run(batches):
        known = Known(lambda c: [f for w in words_in(c) for f in features_of(w)])
        for batch in batches:
            ids, pairs = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids.append(_packed({f for c in set(text.split()) for f in known[c]}))
                pairs.append([_packed(x) for pair in counterfactuals(text, groups) for x in pair])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(pairs, pa.list_(pa.binary()))], ["toxic", "ids", "pairs"])

    return run


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float]

    def scorer(self):
        weights = self.weights
        known = Known(lambda c: tuple(f for w in words_in(c) for f in features_of(w) if f in weights))

        def score(text: str) -> float:
            found: set[int] = set()
            for c in set(text.split()):
                k = known[c]
                if k:
                    found.update(k)
            z = self.bias + sum(weights[f] for f in sorted(found))
            return 1 / (1 + np.exp(-z)) if z > -700 else 0.0

        return score


class Pairs:
    """Margins of the counterfactual pairs' two sides as sparse sums over a row's margin and some weights, and the penalty's gradient."""

    def __init__(self, row: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        # sides: per side the pair, the weight's place and +1 (added) or -1 (removed) of each entry
        self.row, self.sides, self.n = row, sides, len(row)

    def scores(self, margin: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        z = [margin[self.row] + np.bincount(k, s * w[at], minlength=self.n) for k, at, s in self.sides]
        return [1 / (1 + np.exp(-np.clip(x, -60, 60))) for x in z]

    def gap(self, margin: np.ndarray, w: np.ndarray) -> float:
        """Mean absolute change of the score."""
        if not self.n:
            return 0.0
        left, right = self.scores(margin, w)
        return float(np.abs(left - right).mean())

    def gradient(self, margin: np.ndarray, w: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean squared change: by the rows' margins and, beyond them, by the weights."""
        left, right = self.scores(margin, w)
        pull = [2 * (left - right) * left * (1 - left) / self.n, -2 * (left - right) * right * (1 - right) / self.n]
        by_weight = sum(np.bincount(at, s * g[k], minlength=len(w)) for g, (k, at, s) in zip(pull, self.sides))
        return np.bincount(self.row, pull[0] + pull[1], minlength=rows), by_weight

    def curve(self, w: np.ndarray) -> np.ndarray:
        """A bound on the penalty's curvature times w: a score changes by at most a quarter of its margin."""
        z = [np.bincount(k, s * w[at], minlength=self.n) for k, at, s in self.sides]
        change = (z[0] - z[1]) / (8 * self.n)
        return sum(np.bincount(at, s * sign * change[k], minlength=len(w)) for sign, (k, at, s) in zip((1, -1), self.sides))


def train(rows: list[np.ndarray], toxic: np.ndarray, pairs: list[list[tuple]], l1: float = 4e-4, counterfactual: float = 20.0, steps: int = 400, most_features: int = 20_000) -> Model:
    """Sparse logistic regression by accelerated proximal gradient steps.

    rows: sorted distinct features of each text; pairs: each text's counterfactuals.
    """
    n = len(rows)
    if not n or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if n else 0.0
        return Model(float(np.log((share * n + 1) / ((1 - share) * n + 1))) - (1e-6 if not n else 0), {})
    size = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if size.sum() else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(n), size)
    t = toxic.astype(bool)
    n1, n0 = t.sum(), (~t).sum()
    with_t = np.bincount(flat[t[owner]], minlength=1 << BITS)
    without = np.bincount(flat[~t[owner]], minlength=1 << BITS)
    p = (with_t + without) / n
    z = np.abs(with_t / n1 - without / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[with_t + without < 3] = 0
    chosen = np.flatnonzero(z > 3)
    chosen = chosen[np.argsort(-z[chosen], kind="stable")[:most_features]]
    forced = {int(f) for row in pairs for pair in row for side in pair for f in side}
    chosen = np.unique(np.concatenate((chosen, np.array(sorted(forced), np.int64)))).astype(np.int64)
    if not len(chosen):
        return Model(float(np.log(n1 / n0)), {})
    place = np.full(1 << BITS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    at = place[flat]
    owner, at = owner[at >= 0], at[at >= 0]
    weight = np.where(t, 0.5 / n1, 0.5 / n0)
    flat_pairs = [(i, pair) for i, row in enumerate(pairs) for pair in row] if counterfactual else []
    sides = []
    for add, drop in ((0, 1), (2, 3)):
        entries = [(k, place[f], sign) for k, (_, pair) in enumerate(flat_pairs) for at_, sign in ((add, 1.0), (drop, -1.0)) for f in pair[at_]]
        sides.append(tuple(np.array([e[j] for e in entries], t) for j, t in enumerate((np.int64, np.int64, float))))
    swapped = Pairs(np.array([i for i, _ in flat_pairs], np.int64), sides)

    def curve(w):
        """The quadratic bound's matrix times w, for the step length."""
        out = 0.25 * np.bincount(at, (weight * np.bincount(owner, w[at], minlength=n))[owner], minlength=len(w))
        return out + counterfactual * swapped.curve(w) if swapped.n else out

    def slopes(w, b, extra):
        """Gradient by weights and bias; the penalty's part acts on rows' margins and on swapped weights."""
        margin = b + np.bincount(owner, w[at], minlength=n)
        err = weight * (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - t)
        by_weight = extra * w
        if swapped.n:
            by_row, direct = swapped.gradient(margin, w, n)
            err = err + counterfactual * by_row
            by_weight = by_weight + counterfactual * direct
        return by_weight + np.bincount(at, err[owner], minlength=len(w)), err.sum()

    v = np.ones(len(chosen))
    for _ in range(20):
        v = curve(v)
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / (1.1 * top + 0.25)
    w, y, b, yb, momentum = np.zeros(len(chosen)), np.zeros(len(chosen)), 0.0, 0.0, 1.0
    for _ in range(steps):
        grad, slope = slopes(y, yb, 0.0)
        new = y - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = yb - step * slope
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y, yb = new + (momentum - 1) / after * (new - w), new_b + (momentum - 1) / after * (new_b - b)
        w, b, momentum = new, new_b, after
    # without the penalty for weights, go on with the features that it left
    chosen_at = np.flatnonzero(w)
    active = np.isin(at, chosen_at)
    owner, at = owner[active], at[active]
    kept = w != 0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, steps // 2 + 1):
        grad, slope = slopes(w, b, 1e-4)
        grad = np.append(np.where(kept, grad, 0), slope)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = 0.1 * (1 - k / (steps // 2 + 1)) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
        w, b = np.where(kept, w - move[:-1], 0), b - move[-1]
    margin = b + np.bincount(owner, w[at], minlength=n)
    # half lies between the highest clean and the lowest toxic texts, but for a few
    low, high = np.quantile(margin[~t], 0.998), np.quantile(margin[t], 0.01)
    if high > low:
        b, margin = b - (low + high) / 2, margin - (low + high) / 2
    # scale on the training margins: the penalty for weights shrinks them all
    scale = max(1.0, 4.0 / max(1e-9, float(np.median(np.abs(margin)))))
    return Model(float(b * scale), {int(f): float(x * scale) for f, x in zip(chosen, w) if x})


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_per_label: int = 4000, groups: list[str] | None = None, **options) -> Model:
    """Train on at most ``most_per_label`` rows of either label that are not held out, by hashed id.

    Rows without an id or with another label than 0 and 1 are not learned from; null and empty texts are texts without
    features. A document with several labels, or rows that repeat an id, are so many examples. Extra columns are
    ignored. No labels, or labels of one kind only: a constant score.
    """
    groups = IDENTITY if groups is None else groups
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = known.where("toxic = 1").orderBy(*order).limit(most_per_label).unionByName(known.where("toxic = 0").orderBy(*order).limit(most_per_label))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("toxic", "text")
    got = rows.mapInArrow(lean(_gather(groups)), "toxic int, ids binary, pairs array<binary>").toArrow()
    features = [np.frombuffer(x.as_py(), "<i4") for x in got["ids"]]
    order = sorted(range(len(features)), key=lambda i: features[i].tobytes())  # the same model whatever the order of rows
    toxic = got["toxic"].to_numpy()
    pairs = [[tuple(np.frombuffer(x, "<i4") for x in flat[k : k + 4]) for k in range(0, len(flat), 4)] for flat in got["pairs"].to_pylist()]
    return train([features[i] for i in order], toxic[order] if len(order) else toxic, [pairs[i] for i in order], **options)


def _score(model: Model):
    def run(batches):
        score = model.scorer()
        for batch in batches:
            values = [float(score(x.as_py() or "")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted. Null and empty texts get the model's base score.

    Texts are read whole; repeated rows are scored each; extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(lean(_score(model)), "doc_id long, held_out boolean, score double, predicted int")


def _keep(model: Model):
    def run(batches):
        score = model.scorer()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([score(x.as_py() or "") < 0.5 for x in batch.column(at)], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (text in column text) that score below a half, all columns as they are; null and empty texts by the base score, repeated rows each."""
    return docs.mapInArrow(lean(_keep(model)), docs.schema)
