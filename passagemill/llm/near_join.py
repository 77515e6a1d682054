"""N-gram Jaccard join by universe-partition pigeonhole.

A text's set holds its distinct w-word shingles. Two sets of sizes r <= s with
Jaccard similarity of at least t differ in at most r * (1 - t) / t elements, so
when the shingle universe is hashed into one segment more than that, both sets
agree on a whole segment. Sizes are dealt into geometric bands with one scheme
of segments each; a set is indexed in its own band's scheme and in those of
smaller bands that it can still pair with.

Cost-based allocation: a segment with at most one shingle is shared by chance
with very many sets. Such thin segments get no budget (their keys are left
out) and for each of them two segments, the cheapest of the scheme, get a
budget of one more: there the segment's one-deletion neighbourhood is indexed
too. What that costs is measured: a pass over all texts to be indexed counts
the shingles in each of CELLS equal ranges of the universe, and a segment costs
what falls in its range, so those with shingles that very many texts hold come
last. The costs are one small table for all sets, hence so is a scheme's order.
Whatever two sets share among thin segments, each of them has at least as many
upgraded segments, so no pair is lost; a set with more than half of its
segments thin keeps all of its keys.

Sets equal as a whole are one class and only its smallest document is indexed.
A key's documents are compared with the key's smallest document first, and
only where links leave a key with several components with further ones, block
by block, so that every key's documents are of one component or were all
compared. There a pair is left to the smallest key that both documents are
known to share: each carries its FIRST smallest open keys, so alike documents,
which share many keys, meet as candidates about once and not once a key.
Candidates pass an exact bound on the symmetric difference (parity bits) and
are verified on the shingle sets of their whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .memory import lean
from .textkit import U, mix, shingle_sets
from .workspace import Workspace

SKETCH = 16  # longs of parity bits
WIDE = 16_384  # parity bits of sets with more than WIDE_FROM elements, for which the others are too few
WIDE_FROM = 1_500
FIRST = 16  # smallest open keys that a document carries; more make repeated candidates rarer
CELLS = 4096  # ranges of the shingle universe whose load is measured
BLOCK_ROWS = 2048  # documents of a key that are compared with as many in one piece
BROADCAST_ROWS = 1_000_000  # ids; larger sides are joined by shuffle


class Scheme:
    """Size bands and their segment counts for a threshold num/den."""

    def __init__(self, num: int, den: int, widen: int = 3, load: np.ndarray | None = None):
        """``load``: what upgrades cost in each of CELLS ranges of the universe, all alike if not given."""
        self.num, self.den = num, den
        self.ratio = (den / num) ** widen
        self.edges, self.segments = [1], []
        load = np.ones(CELLS, np.int64) if load is None else np.asarray(load, np.int64)
        self.load = load * (1 << 20) // max(1, int(load.max()))  # integers, so that every worker finds the same order
        self.below = np.append(0, np.cumsum(self.load))
        self.ranks: dict[int, np.ndarray] = {}

    def rank(self, m: int) -> np.ndarray:
        """Place of each of m segments in the order of their costs, the cheapest first, ties by number."""
        if m not in self.ranks:
            edge = np.arange(m + 1, dtype=np.int64) * CELLS
            cell = np.minimum(edge // m, CELLS - 1)
            upto = self.below[cell] * m + self.load[cell] * (edge - cell * m)
            out = np.empty(m, np.int64)
            out[np.argsort(np.diff(upto), kind="stable")] = np.arange(m)
            self.ranks[m] = out
        return self.ranks[m]

    def _reach(self, n: int) -> None:
        while self.edges[-1] <= n:
            a = self.edges[-1]
            b = max(a + 1, int(a * self.ratio))
            self.edges.append(b)
            self.segments.append((b - 1) * (self.den - self.num) // self.num + 1)

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, number of segments) of each scheme that indexes a set of n elements."""
        self._reach(n)
        k = int(np.searchsorted(self.edges, n, "right")) - 1
        out = []
        while k >= 0 and (self.edges[k + 1] - 1) * self.den >= self.num * n:
            if self.segments[k] > 1:
                out.append((k, self.segments[k]))
            k -= 1
        return out


def segment_keys(tokens: np.ndarray, band: int, m: int, rank: np.ndarray) -> np.ndarray:
    """Index keys of a sorted set of distinct hashes in one scheme of m segments, upgraded in the order of ``rank``."""
    seg = ((tokens >> U(32)) * U(m)) >> U(32)
    at = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    ids = seg[at]
    size = np.diff(np.append(at, len(tokens)))
    with np.errstate(over="ignore"):
        spread = mix(tokens)
        total = np.add.reduceat(spread, at)
        tag = mix((U(band) << U(40)) + ids + U(1))
        exact = mix(total + tag * (size.astype(np.uint64) * U(2) + U(1)))
        thin = m - len(at) + int((size == 1).sum())
        up = min(2 * thin, m)
        cheap = rank[ids.astype(np.int64)] < up
        keep = (size > 1) | cheap
        whole = 2 * thin > m
        out = [exact] if whole else [exact[keep]]
        if whole:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), ids)
            out.append(mix(mix((U(band) << U(40)) + empty + U(1))))  # content and size 0
        if up:
            which = np.repeat(np.arange(len(at)), size)
            chosen = np.flatnonzero(cheap[which])
            which = which[chosen]
            less = size[which] - 1
            key = mix(total[which] - spread[chosen] + tag[which] * (less.astype(np.uint64) * U(2) + U(1)))
            out.append(key if whole else key[less > 0])
    return np.concatenate(out)


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _digest(w: int, lower: bool):
    names = ["doc_id", "n", "f1", "f2", *(f"s{i}" for i in range(SKETCH)), "wide"]

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            wide: list[bytes | None] = [None] * rows
            n, f = np.zeros(rows, np.int64), np.zeros((2, rows), np.uint64)
            s = np.zeros((rows, SKETCH), np.uint64)
            for i, t in enumerate(shingle_sets(batch.column(1), w, lower)):
                n[i] = len(t)
                if len(t):
                    with np.errstate(over="ignore"):
                        f[0, i] = t.sum(dtype=np.uint64)
                        f[1, i] = mix(t ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                    bits = np.bincount((t & U(SKETCH * 64 - 1)).astype(np.int64), minlength=SKETCH * 64) & 1
                    s[i] = np.packbits(bits.astype(np.uint8)).view(np.uint64)
                if len(t) > WIDE_FROM:
                    wide[i] = np.packbits((np.bincount((t & U(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1).astype(np.uint8)).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _long(f[0]), _long(f[1]), *(_long(np.ascontiguousarray(s[:, i])) for i in range(SKETCH)), pa.array(wide, pa.binary())], names)

    return run, ", ".join(f"{c} long" for c in names[:-1]) + ", wide binary"


def _load(w: int, lower: bool):
    """A task's shingles in each range of the universe: (cell, load)."""

    def run(batches):
        load = np.zeros(CELLS, np.int64)
        for batch in batches:
            for t in shingle_sets(batch.column(0), w, lower):
                load += np.bincount(((t >> U(32)) * U(CELLS) >> U(32)).astype(np.int64), minlength=CELLS)
        used = np.flatnonzero(load)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(load[used])], ["cell", "load"])

    return run


def _index(w: int, lower: bool, num: int, den: int, load: np.ndarray):
    def run(batches):
        scheme = Scheme(num, den, load=load)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys, owner = [], []
            for i, t in enumerate(shingle_sets(batch.column(1), w, lower)):
                for band, m in scheme.of(len(t)) if len(t) else ():
                    k = segment_keys(t, band, m, scheme.rank(m))
                    keys.append(k)
                    owner.append(np.full(len(k), ids[i], np.int64))
            if not keys:
                continue
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            fresh = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))
            keys, owner = keys[fresh], owner[fresh]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(at, len(keys)))
            rest = np.ones(len(keys), bool)
            rest[at] = False
            offsets = np.append(0, np.cumsum(size - 1)).astype(np.int32)
            members = pa.ListArray.from_arrays(pa.array(offsets), pa.array(owner[rest]), mask=pa.array(size == 1))
            yield pa.RecordBatch.from_arrays([_long(keys[at]), pa.array(owner[at]), members], ["key", "id", "others"])

    return run, "key long, id long, others array<long>"


def _buckets(batches):
    """Stream of (key, id, others) sorted by key and id to (key, leader, id) of keys with several ids."""
    held, key, leader = None, None, None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        held = table.slice(table.num_rows - 1)
        key, leader, out = _runs(table.slice(0, table.num_rows - 1), held, key, leader)
        yield from out
    if held is not None:
        yield from _runs(held, None, key, leader)[2]


def _runs(table: pa.Table, after: pa.Table | None, key, leader):
    if not table.num_rows:
        return key, leader, []
    k = table["key"].to_numpy()
    ids = table["id"].to_numpy()
    others = table["others"].combine_chunks()
    fresh = np.append(key is None or k[0] != key, k[1:] != k[:-1])
    at = np.flatnonzero(fresh)
    heads = ids[at]
    run = np.cumsum(fresh) - 1
    lead = np.where(run < 0, 0 if leader is None else leader, heads[run] if len(heads) else 0)
    following = np.append(k[1:], after["key"][0].as_py() if after is not None else 0)
    same = k == following
    if after is None:
        same[-1] = False
    more = np.asarray(pc.fill_null(pc.list_value_length(others), 0))
    use = ~fresh | same | (more > 0)
    out = []
    if use.any():
        rows = np.flatnonzero(use & (more > 0))
        flat = others.take(pa.array(rows)).flatten().to_numpy() if len(rows) else np.zeros(0, np.int64)
        again = np.repeat(rows, more[rows])
        out = [pa.RecordBatch.from_arrays([pa.array(np.concatenate((x[use], y))) for x, y in ((k, k[again]), (lead, lead[again]), (ids, flat))], ["key", "leader", "id"])]
    return k[-1], lead[-1], out


def _compare(num: int, den: int, every: bool):
    """Rows sorted by (key, p, q) to pairs of different components that the parity bits let through.

    A pair that surely meets under a smaller key is left to that key.
    """

    def group(key, own, p, q, ids, c, n, bits, first):
        a, b = np.flatnonzero(own == p), np.flatnonzero(own == q)
        below = first < key
        out, joined = [], {}

        def root(x):
            while x in joined:
                x = joined[x]
            return x

        for k in range(0, len(a), 128):
            i = a[k : k + 128]
            ok = c[i][:, None] != c[b][None]
            ok &= (np.minimum(n[i][:, None], n[b]) * den >= np.maximum(n[i][:, None], n[b]) * num) & (ids[i][:, None] < ids[b] if p == q else True)
            x, y = np.nonzero(ok)
            for s in range(0, len(x), 100_000):
                u, v = i[x[s : s + 100_000]], b[y[s : s + 100_000]]
                differ = np.bitwise_count(bits[u] ^ bits[v]).sum(1, dtype=np.int64)
                good = np.flatnonzero(differ * (den + num) <= (n[u] + n[v]) * (den - num))
                for r in range(0, len(good), 4096):
                    g, h = u[good[r : r + 4096]], v[good[r : r + 4096]]
                    met = (first[g][:, :, None] == first[h][:, None, :]) & below[g][:, :, None]
                    good[r : r + 4096][met.any((1, 2))] = -1
                good = good[good >= 0]
                for e, f in zip(u[good].tolist(), v[good].tolist()):
                    if not every:
                        g, h = root(int(c[e])), root(int(c[f]))
                        if g == h:
                            continue
                        joined[max(g, h)] = min(g, h)
                    out.append((min(ids[e], ids[f]), max(ids[e], ids[f])))
        return out

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            held = t.slice(int(ends(t)[-1])).combine_chunks()
            yield from found(t, last=False)
        if held is not None and held.num_rows:
            yield from found(held, last=True)

    def ends(t):
        cols = [t[c].to_numpy() for c in ("key", "p", "q")]
        return np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in cols])))

    def found(t, last: bool):
        """Pairs of the table's groups; the last group only if told, as it may go on in the next batch."""
        at = ends(t)
        at = np.append(at, t.num_rows) if last else at
        key, own, p, q, ids, c, n = (t[k].to_numpy() for k in ("key", "own", "p", "q", "id", "c", "n"))
        first = t["first"].combine_chunks().flatten().to_numpy().reshape(-1, FIRST)
        bits = np.stack([t[f"s{i}"].to_numpy() for i in range(SKETCH)], 1).view(np.uint64)
        out = []
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            out += group(key[x], own[x:y], p[x], q[x], ids[x:y], c[x:y], n[x:y], bits[x:y], first[x:y])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(z, np.int64)) for z in zip(*out)], ["a", "b"])

    return run


def _wide_bound(num: int, den: int):
    """Drop pairs (a, b, a_n, b_n, a_wide, b_wide) that the wide parity bits rule out."""

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            x, y = batch.column(4), batch.column(5)
            both = np.flatnonzero(np.asarray(pc.and_(pc.is_valid(x), pc.is_valid(y))))
            n = batch.column(2).to_numpy(zero_copy_only=False)[both].astype(np.int64) + batch.column(3).to_numpy(zero_copy_only=False)[both].astype(np.int64) if len(both) else both
            for j, i in enumerate(both.tolist()):
                differ = int(np.bitwise_count(np.frombuffer(x[i].as_py(), np.uint64) ^ np.frombuffer(y[i].as_py(), np.uint64)).sum(dtype=np.int64))
                keep[i] = differ * (den + num) <= int(n[j]) * (den - num)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    return run


def _verify(w: int, lower: bool, num: int, den: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            first = list(shingle_sets(left.dictionary_encode().dictionary, w, lower))
            index = left.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            good = np.zeros(batch.num_rows, bool)
            for i, b in enumerate(shingle_sets(right, w, lower)):
                a = first[int(index[i])]
                both = len(np.intersect1d(a, b, assume_unique=True))
                good[i] = den * both >= num * (len(a) + len(b) - both) and both > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good))

    return run, "u long, v long"


class JaccardJoin:
    """Similarity join of whole texts; see the module's text for the method.

    Null or blank texts have an empty set and no links. Rows that repeat a
    document id count as one document. Extra columns are ignored.
    """

    def __init__(self, words: int = 5, num: int = 80, den: int = 100, lower: bool = True):
        self.words, self.num, self.den, self.lower = words, num, den, lower

    def _narrow(self, ids: DataFrame):
        return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    def _costs(self, docs: DataFrame) -> np.ndarray:
        """Shingles of all ``docs`` in each of CELLS ranges of the universe."""
        load = np.zeros(CELLS, np.int64)
        for cell, n in docs.select("text").mapInArrow(lean(_load(self.words, self.lower)), "cell long, load long").groupBy("cell").agg(F.sum("load")).collect():
            load[cell] = n
        return load

    def _links(self, pairs: DataFrame, sets: DataFrame, docs: DataFrame, ws: Workspace) -> DataFrame:
        """Of candidate pairs (a, b), those that reach the threshold."""
        side = ["n", *(f"s{i}" for i in range(SKETCH))]
        left = sets.select(F.col("doc_id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in side))
        right = sets.select(F.col("doc_id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in side))
        differ = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(SKETCH)), F.lit(0))
        close = (differ * (self.den + self.num) <= (F.col("a_n") + F.col("b_n")) * (self.den - self.num)) & (F.least("a_n", "b_n") * self.den >= F.greatest("a_n", "b_n") * self.num)
        return self._exact(pairs.join(left, "a").join(right, "b").where(close).select("a", "b"), sets, docs, ws)

    def _exact(self, pairs: DataFrame, sets: DataFrame, docs: DataFrame, ws: Workspace) -> DataFrame:
        """Of pairs (a, b), those whose texts reach the threshold; large sets pass a bound on wide parity bits first."""
        large = sets.where("wide is not null")
        x, y = (large.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}_n"), F.col("wide").alias(f"{c}_wide")) for c in "ab")
        both = pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", "a_n", "b_n", "a_wide", "b_wide")
        kept = ws.write(both.mapInArrow(lean(_wide_bound(self.num, self.den)), "a long, b long"), "pairs")
        need = ws.write(kept.select(F.col("a").alias("doc_id")).unionByName(kept.select(F.col("b").alias("doc_id"))).distinct(), "need")
        texts = ws.write(docs.join(self._narrow(need), "doc_id", "left_semi"), "texts")
        run, schema = _verify(self.words, self.lower, self.num, self.den)
        both = kept.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
        links = ws.write(both.select("a", "b", "x", "y").mapInArrow(lean(run), schema), "links")
        ws.drop(kept, need, texts)
        return links

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per row of ``docs``: doc_id, n_shingles, class_id, component_id."""
        spark = docs.sparkSession
        ws = Workspace(spark, "jaccard")
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        run, schema = _digest(self.words, self.lower)
        sets = ws.write(docs.mapInArrow(lean(run), schema), "sets")
        same = ["n", "f1", "f2"]
        classes = ws.write(sets.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("class_id")), "classes")
        classed = ws.write(sets.select("doc_id", *same).join(classes, same, "left").select("doc_id", "n", "class_id"), "classed")
        copies = classed.where("doc_id != class_id or class_id is null").select("doc_id").distinct()
        single = docs.where("doc_id is not null").join(self._narrow(copies), "doc_id", "left_anti").select("doc_id", "text")
        heads = sets.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        run, schema = _index(self.words, self.lower, self.num, self.den, self._costs(single))
        keys = single.mapInArrow(lean(run), schema).repartition("key").sortWithinPartitions("key", "id")
        buckets = ws.write(keys.mapInArrow(lean(_buckets), "key long, leader long, id long"), "buckets")
        pairs = buckets.where("leader != id").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
        links = self._links(pairs, heads, docs, ws)
        label = ws.write(components(links, ws), "components")
        label = self._rest(buckets, label, links, heads, docs, ws)
        ws.drop(buckets)
        out = classed.join(label.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "class_id", "doc_id").alias("component_id"))

    def _rest(self, buckets: DataFrame, label: DataFrame, links: DataFrame, heads: DataFrame, docs: DataFrame, ws: Workspace) -> DataFrame:
        """Compare further pairs of keys that still hold several components.

        A key's documents are dealt into blocks, and blocks are compared two at
        a time on their parity bits. The first round passes on as many pairs as
        would join a block pair's components if all were links. What is then
        still open passes on all pairs of different components that the bits
        let through, so after it no link can be left.
        """
        for every in (False, True):
            named = buckets.select("key", "id").distinct().join(label.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
            open_keys = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo != hi and size > 2").select("key", "size")
            rows = ws.write(named.join(open_keys, "key"), "open")
            if rows.isEmpty():
                ws.drop(rows)
                return label
            smallest = F.slice(F.array_sort(F.collect_list("key")), 1, FIRST)
            padded = F.slice(F.concat(smallest, F.array_repeat(F.lit(2**63 - 1), FIRST)), 1, FIRST)  # the largest long is below no key
            side = heads.select(F.col("doc_id").alias("id"), "n", *(f"s{i}" for i in range(SKETCH))).join(rows.groupBy("id").agg(padded.alias("first")), "id")
            blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
            own = F.pmod(F.xxhash64("id", "key"), blocks).cast("int")
            dealt = rows.select("key", "id", "c", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "c").join(side, "id")
            dealt = dealt.select("key", "p", "q", "own", "id", "c", "n", "first", *(f"s{i}" for i in range(SKETCH)))
            pairs = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(lean(_compare(self.num, self.den, every)), "a long, b long").distinct()
            more = self._exact(pairs, heads, docs, ws)
            if not more.isEmpty():
                links = ws.write(links.unionByName(more).distinct(), "links")
                label = ws.write(components(links, ws), "components")
            ws.drop(rows, more)
        return label
