"""Benchmark decontamination by template windows.

Words become typed placeholders where they are numbers, units or names (a
capitalised word that the benchmark never writes small; words of a name in a
row are one placeholder); windows of the rest are hashed and joined with the
benchmark's. A second set of windows over the plain lower-cased words catches
copies in another case. Windows of a document and an item are counted by their
distance; the values that fill an item's placeholders must be replaced
consistently, and a reworded line must hold enough words that are none.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import lean, share
from .textkit import U, mix, windows
from .workspace import Workspace

LENGTH = 8  # words in a window
SHORT = 4  # words from which a shorter item is looked for, as one window
LITERALS = 5  # words of a reworded line that are no placeholders (all but one of a shorter window)
ENOUGH = 6  # windows in line that show contamination (13 words), or
SHARE = 0.8  # this share of an item's windows
CONSISTENT = 0.5  # least share of an item's repeated slot values with one value in the document
BROADCAST_WINDOWS = 2_000_000
KNOWN_CHUNKS = 400_000

# Units by dimension.
UNITS = {
    "length": "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers centimeters",
    "mass": "mg g kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs ounce ounces oz",
    "time": "s sec second seconds min minute minutes hour hours hr hrs day days week weeks month months year years",
    "money": "dollar dollars usd euro euros eur cent cents pence gbp yen rupees",
    "volume": "ml l liter liters litre litres gallon gallons cup cups",
    "other": "percent degrees celsius fahrenheit kelvin volt volts watt watts hz mph kmh",
}
_UNIT = {w: d for d, ws in UNITS.items() for w in ws.split()}
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
_GLUED = re.compile(r"([+-]?\d[\d.,]*)([a-z]+)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) or 1


NAME = _hash("<name>")
_KINDS = {k: _hash(k) for k in ("<number>", "<name>", *(f"<{x}:{d}>" for d in UNITS for x in ("number", "unit")))}


class Canon(dict):
    """(template id, plain id, placeholder) of white-space separated chunks; ids 0: no word."""

    def __init__(self, small: frozenset[str]):
        super().__init__()
        self.small = small
        self.index = Index(self)

    def __missing__(self, chunk: str):
        out = self.of(chunk)
        if len(self) < KNOWN_CHUNKS and len(chunk) < 64:
            self[chunk] = out
        return out

    def of(self, chunk: str) -> tuple[int, int, bool]:
        core = chunk if chunk.isalnum() else _EDGE.sub("", chunk)
        low = core.lower()
        if not low:
            return 0, 0, False
        plain, kind = _hash(low), None
        if not low.isalpha():  # only such words can be numbers
            glued = _GLUED.fullmatch(low)
            if _NUMBER.fullmatch(low):
                kind = "<number>"
            elif glued and glued[2] in _UNIT:
                kind = f"<number:{_UNIT[glued[2]]}>"
        if kind is None:
            if low in _UNIT and len(low) > 2:
                kind = f"<unit:{_UNIT[low]}>"
            elif core[0].isupper() and low not in self.small:
                kind = "<name>"
        return _KINDS[kind] if kind else plain, plain, kind is not None


@functools.lru_cache(maxsize=2)
def canon_of(small: frozenset[str]) -> Canon:
    """The table of known chunks that a worker's tasks share."""
    return Canon(small)


share("decontaminate", canon_of.cache_clear)


class Index(dict):
    """Chunk to row of three arrays (template, plain, placeholder), so that a text is looked up in one pass.

    Rows behind those that are kept belong to the text at hand.
    """

    def __init__(self, canon: Canon):
        super().__init__()
        self.canon = canon
        self.n = 0
        self.template, self.plain, self.slot = np.zeros(1024, U), np.zeros(1024, U), np.zeros(1024, bool)

    def __missing__(self, chunk: str) -> int:
        k = self.n
        if k == len(self.slot):
            self.template, self.plain, self.slot = (np.concatenate((x, np.zeros_like(x))) for x in (self.template, self.plain, self.slot))
        self.template[k], self.plain[k], self.slot[k] = self.canon.of(chunk)
        self.n += 1
        if k == len(self) and k < KNOWN_CHUNKS and len(chunk) < 64:
            self[chunk] = k
        return k

    def rows(self, chunks: list[str]) -> np.ndarray:
        self.n = len(self)
        return np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))


def small_words(texts: list[str | None]) -> frozenset[str]:
    """Words that some text writes without a capital."""
    return frozenset(w for t in texts for c in (t or "").split() if (w := _EDGE.sub("", c)) and not w[0].isupper() and w == w.lower())


def text_windows(text: str, canon: Canon, lengths: tuple[list[int], list[int]]):
    """Windows of a text in both forms, of the given lengths in words and in units (a word, or a name's words in a row).

    Hash, first word, first unit, form and size of each; then per word its hash, and per unit its first word and whether it is a placeholder.
    """
    index = canon.index
    rows = index.rows(text.split())
    rows = rows[index.plain[rows] != 0]
    n = len(rows)
    template, plain, slot = index.template[rows], index.plain[rows], index.slot[rows]
    name = template == NAME
    more = name[1:] & name[:-1]
    units, unit = np.arange(n), None
    if more.any():
        first = np.append(True, ~more)
        units, unit = np.flatnonzero(first), np.cumsum(first) - 1
        template, slot = template[units], slot[units]
    hashes, word, at, kind, size = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    for form, sequence in enumerate((plain, template)):
        m = len(sequence)
        for w in lengths[form]:
            if m < w:
                continue
            pos = np.arange(m - w + 1)
            h, _ = windows(sequence, np.array([0, m]), w)
            with np.errstate(over="ignore"):
                hashes.append(mix(h[: m - w + 1] + U(1 if form else 2)))
            word.append(units[pos] if form else pos)
            at.append(pos if form or unit is None else unit[pos])
            kind.append(np.full(len(pos), bool(form)))
            size.append(np.full(len(pos), w))
    return np.concatenate(hashes), np.concatenate(word), np.concatenate(at), np.concatenate(kind), np.concatenate(size), plain, units, slot


def _values(plain: np.ndarray, units: np.ndarray) -> np.ndarray:
    """One value a unit, from its words in order."""
    if len(units) == len(plain):
        return mix(plain)
    within = np.arange(len(plain)) - np.repeat(units, np.diff(np.append(units, len(plain))))
    with np.errstate(over="ignore"):
        return np.add.reduceat(mix(plain + within.astype(U)), units)


COLUMNS = "id long, hash long, pos long, unit long, template boolean, slots array<long>, literals array<long>"


def _own(small: frozenset[str], lengths: tuple[list[int], list[int]]):
    """Rows of an item's windows: of the largest length that it has, without template windows that hold nothing but placeholders, and with their other units."""

    def run(batches):
        canon = canon_of(small)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h, word, at, kind, size, plain, units, slot = text_windows(text.as_py() or "", canon, lengths)
                filled = np.append(0, np.cumsum(slot))
                literal = size - np.where(kind, filled[np.minimum(at + size, len(slot))] - filled[at], 0)
                use = np.flatnonzero(np.where(kind, (size == min(len(units), LENGTH)) & (literal >= np.where(size < LENGTH, np.minimum(size - 1, LITERALS), 1)), size == min(len(plain), LENGTH)))
                values = _values(plain, units).view(np.int64) if len(use) else None
                for i in use.tolist():
                    a, w = int(at[i]), int(size[i])
                    filler = slot[a : a + w]
                    rows.append((doc, int(h[i : i + 1].view(np.int64)[0]), int(word[i]), a, bool(kind[i]), values[a : a + w][filler].tolist() if kind[i] else [], (a + np.flatnonzero(~filler)).tolist() if kind[i] else []))
                    if len(rows) >= 50_000:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)

    return run


def _marked(size: int):
    """One table per task of the hashes' places modulo size (a power of two)."""

    def run(batches):
        table = np.zeros(size, bool)
        for batch in batches:
            table[(batch.column(0).to_numpy(zero_copy_only=False).view(U) & U(size - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], ["places"])

    return run


class Sought:
    """The benchmark's window hashes: places modulo a power of two, and all of them in order unless they are too many."""

    def __init__(self, places: np.ndarray, hashes: np.ndarray | None):
        self.places, self.hashes = np.packbits(places), hashes
        self._table: np.ndarray | None = None

    @classmethod
    def of(cls, distinct: DataFrame, count: int, most: int) -> Sought:
        few = count <= most
        size = 1 << (min(max(16, int(8 * count).bit_length()), 24 if few else 26))
        if few:
            hashes = np.sort(distinct.toArrow()["hash"].to_numpy().view(U)) if count else np.zeros(0, U)
            table = np.zeros(size, bool)
            table[(hashes & U(size - 1)).astype(np.int64)] = True
            return cls(table, hashes)
        packed = np.zeros(size // 8, np.uint8)
        for row in distinct.mapInArrow(_marked(size), "places binary").toLocalIterator():
            packed |= np.frombuffer(row.places, np.uint8)
        return cls(np.unpackbits(packed).astype(bool), None)

    def at(self, h: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Positions of windows that may be the benchmark's; of few hashes, those that are."""
        if self._table is None:
            self._table = np.unpackbits(self.places).astype(bool)
        maybe = np.flatnonzero(self._table[(h & U(len(self._table) - 1)).astype(np.int64)] & inside)
        if self.hashes is None or not len(maybe):
            return maybe
        k = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[k] == h[maybe]]


PIECE = 1 << 20  # characters of texts that are looked up together, unless one text is longer


def _pieces(batches):
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if text:
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if held >= PIECE:
                    yield ids, texts
                    ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def _met(small: frozenset[str], lengths: tuple[list[int], list[int]], sought: Sought):
    """Rows of the documents' windows that are the benchmark's (or may be, beyond the bound); texts are looked up piece by piece."""

    def run(batches):
        canon = canon_of(small)
        index = canon.index
        for ids, texts in _pieces(batches):
            chunks: list[str] = []
            ends = []
            for text in texts:
                chunks += text.split()
                ends.append(len(chunks))
            rows = index.rows(chunks)
            plain = index.plain[rows]
            word = plain != 0
            owner = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))[word]
            rows, plain = rows[word], plain[word]
            template = index.template[rows]
            first = np.ones(len(rows), bool)
            first[1:] = ~((template[1:] == NAME) & (template[:-1] == NAME) & (owner[1:] == owner[:-1]))
            units, unit = np.flatnonzero(first), np.cumsum(first) - 1
            begin = np.searchsorted(owner, np.arange(len(texts) + 1))
            begin_unit = np.searchsorted(owner[units], np.arange(len(texts) + 1))
            values = slot = None
            found: list[tuple] = []
            for form, (sequence, off) in enumerate(((plain, begin), (template[units], begin_unit))):
                for w in lengths[form]:
                    h, inside = windows(sequence, off, w)
                    with np.errstate(over="ignore"):
                        h = mix(h + U(1 if form else 2))
                    hit = sought.at(h, inside)
                    if not len(hit):
                        continue
                    if form and values is None:
                        values, slot = _values(plain, units).view(np.int64), index.slot[rows[units]]
                    at_word, at_unit = (units[hit], hit) if form else (hit, unit[hit])
                    who = owner[at_word]
                    for i, k, p, u, x in zip(who.tolist(), hit.tolist(), (at_word - begin[who]).tolist(), (at_unit - begin_unit[who]).tolist(), h[hit].view(np.int64).tolist()):
                        found.append((ids[i], x, p, u, bool(form), values[k : k + w][slot[k : k + w]].tolist() if form else [], []))
                        if len(found) >= 50_000:
                            yield _rows(found)
                            found = []
            if found:
                yield _rows(found)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["id", "hash", "pos", "unit", "template", "slots", "literals"])


def _vocabulary(batches):
    for batch in batches:
        words = sorted(small_words(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per contaminated (doc_id, item_id): n_windows, n_item_windows, reworded.

    ``reworded`` tells that only template windows met. Items of fewer than four
    words are too short to be told from chance and are not looked for. Null and
    empty texts have no windows. Rows that repeat a document or item id count
    as one. The benchmark's vocabulary is held by the driver, so its size is
    that of the benchmark, not of the corpus; beyond ``most_broadcast`` windows
    tasks know only their hashes' places in a table of fixed size, and the
    document windows that pass it go into a shuffled join.
    """
    spark: SparkSession = docs.sparkSession
    ws = Workspace(spark, "decontaminate")
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null")
    small = frozenset(r.word for r in items.select("text").mapInArrow(_vocabulary, "word string").distinct().toLocalIterator())
    sizes = items.mapInArrow(lean(_counted(small), "decontaminate"), "id long, n long, units long").groupBy("id").agg(F.max("n").alias("n"), F.collect_set("units").alias("units"), F.max("units").alias("most"))
    short = sizes.select(F.explode(F.array_union(F.array("n"), "units")).alias("n")).where(f"n >= {SHORT} and n < {LENGTH}").distinct().collect()
    every = sorted({*(r.n for r in short), LENGTH})
    lengths = (every, every)
    known = ws.write(items.mapInArrow(lean(_own(small, lengths), "decontaminate"), COLUMNS), "items")
    length = F.when(F.col("n") < LENGTH, F.col("n")).otherwise(LENGTH)
    templates = known.where("template").groupBy("id").agg(F.countDistinct("unit").alias("n_templates"))
    sized = sizes.select("id", (F.col("n") - length + 1).alias("n_plain"), F.col("most").alias("units")).join(templates, "id", "left")
    distinct = ws.write(known.select("hash").distinct(), "hashes")
    count = distinct.count()
    few = count <= most_broadcast
    sought = Sought.of(distinct, count, most_broadcast)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    hits = rows.mapInArrow(lean(_met(small, lengths, sought), "decontaminate"), COLUMNS).drop("literals")
    side = known.select(F.col("id").alias("item_id"), "hash", F.col("pos").alias("item_pos"), F.col("unit").alias("item_unit"), F.col("slots").alias("item_slots"), "literals")
    met = hits.join(F.broadcast(side) if few else side, "hash")
    # A plain window is in a line of words and in one of units, where it fills what a reworded copy keeps as it is.
    places = F.array(F.when(~F.col("template"), F.struct(F.lit(True).alias("words"), (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos")), F.struct(F.lit(False).alias("words"), (F.col("unit") - F.col("item_unit")).alias("shift"), F.col("item_unit").alias("item_pos")))
    met = met.select(F.col("id").alias("doc_id"), "item_id", "template", "slots", "item_slots", "literals", F.explode(F.array_compact(places)).alias("at"))
    met = ws.write(met.select("doc_id", "item_id", "at.words", "at.shift", "at.item_pos", "template", "slots", "item_slots", "literals"), "met")
    line = ["doc_id", "item_id", "words", "shift"]
    literal = F.size(F.array_distinct(F.flatten(F.collect_list("literals"))))
    counts = met.groupBy(*line).agg(F.countDistinct("item_pos").alias("n_windows"), literal.alias("n_literals"))
    pairs = met.where("template").select(*line, F.explode(F.arrays_zip("item_slots", "slots")).alias("v")).select(*line, "v.item_slots", "v.slots").distinct()
    repeated = items.mapInArrow(lean(_repeated(small), "decontaminate"), "item_id long, item_slots long").distinct()
    pairs = pairs.join(F.broadcast(repeated) if few else repeated, ["item_id", "item_slots"], "left_semi")
    slots = pairs.groupBy(*line, "item_slots").agg(F.count("*").alias("values")).groupBy(*line).agg(F.avg((F.col("values") == 1).cast("double")).alias("consistent"))
    sized = sized.withColumnRenamed("id", "item_id")
    lines = counts.join(F.broadcast(sized) if few else sized, "item_id").join(slots, line, "left")
    lines = lines.withColumn("n_item_windows", F.when(F.col("words"), F.col("n_plain")).otherwise(F.col("n_templates")))
    enough = (F.col("n_windows") >= ENOUGH) | (F.col("n_windows") >= F.col("n_item_windows") * SHARE)
    same = (F.coalesce("consistent", F.lit(1.0)) >= CONSISTENT) & (F.col("n_literals") >= F.least(F.lit(LITERALS), F.col("units") - 1))
    sound = lines.where(enough & (F.col("words") | same))
    best = sound.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_item_windows").alias("n_item_windows"), F.bool_and(~F.col("words")).alias("reworded"))
    return best.select("doc_id", "item_id", "n_windows", "n_item_windows", "reworded")


def _repeated(small: frozenset[str]):
    """(item, value) of placeholders' values that an item has twice or more; only these can be inconsistent."""

    def run(batches):
        canon = canon_of(small)
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, _, _, _, _, plain, units, slot = text_windows(text or "", canon, ([], []))
                values = Counter(_values(plain, units)[slot].tolist())
                rows += [(ident, v) for v in sorted(values) if values[v] > 1]
            ids, found = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(found, U).view(np.int64))], ["item_id", "item_slots"])

    return run


def _counted(small: frozenset[str]):
    """(id, words, units) of texts."""

    def run(batches):
        canon = canon_of(small)
        for batch in batches:
            found = [text_windows(t or "", canon, ([], []))[5:7] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([len(x[k]) for x in found], pa.int64()) for k in (0, 1))], ["id", "n", "units"])

    return run
