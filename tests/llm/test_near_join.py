import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from passagemill.llm.near_join import CELLS, JaccardJoin, Scheme, segment_keys


def shingles(text, w):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    x = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(x[i : i + w]) for i in range(len(x) - w + 1)) if len(x) >= w else frozenset([tuple(x)] if x else [])


def brute(rows, w, num, den):
    sets = {d: shingles(t, w) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        shared = Counter()
        for e in s:
            shared.update(where[e])
            where[e].append(d)
        for o, k in shared.items():
            if den * k >= num * (len(s) + len(sets[o]) - k):
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def run(df, *args):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in JaccardJoin(*args).components(df).collect()}


def corpus(seed, groups=12, size=8):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, shared = [], " ".join(r.choices(vocabulary, k=20))
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.choice([2, 9, 14, 25, 60, 200]))
        for _ in range(size):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 20))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.3:
                words += r.choices(vocabulary, k=r.randint(1, 4))
            rows.append((len(rows), " ".join(words) + (" " + shared if r.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize(("args", "seed"), [((3, 90, 100), 1), ((5, 80, 100), 2)])
def test_components_equal_brute_force(spark, args, seed):
    rows = corpus(seed)
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), *args) == brute(rows, *args)


def test_many_near_copies_of_one_text(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(120)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(words)))
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100) == brute(rows, 3, 90, 100)


def test_large_sets_pass_the_wide_bound(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base = r.choices(words, k=2200)
    near = base[:1000] + ["x"] + base[1001:]
    rows = [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(base[:1300] + r.choices(words, k=900))), (3, " ".join(r.choices(words, k=2300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, 3, 90, 100) == brute(rows, 3, 90, 100) and run(df, 3, 90, 100)[1][1] == 0


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(3)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        scheme = Scheme(num, den, load=rng.integers(0, 50, CELLS))
        for _ in range(400):
            n = int(rng.integers(3, 120))
            pool = rng.integers(0, 2**63, n * 3, dtype=np.uint64)
            a = np.unique(pool[:n])
            drop, add = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 4 + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], pool[n : n + add])))
            both = len(np.intersect1d(a, b))
            if not len(b) or den * both < num * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            keys = [set(np.concatenate([segment_keys(x, k, m, scheme.rank(m)) for k, m in scheme.of(len(x))] or [np.zeros(0)]).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_upgrades_go_to_the_cheapest_segments(spark):
    load = np.ones(CELLS, np.int64)
    load[: CELLS // 4] = 1000
    scheme = Scheme(90, 100, load=load)
    assert scheme.rank(8).tolist() == [6, 7, 0, 1, 2, 3, 4, 5]
    assert sorted(scheme.rank(CELLS * 3 + 1).tolist()) == list(range(CELLS * 3 + 1))
    assert Scheme(90, 100).rank(7).tolist()[0] == 0 and Scheme(90, 100, load=load * 0).rank(5).tolist() == list(range(5))
    rows = [(i, f"same passage of many words here x{i}") for i in range(40)] + [(40, ""), (41, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    costs = JaccardJoin(3, 90, 100)._costs(df.select("doc_id", "text"))
    assert costs.sum() == sum(len(shingles(t, 3)) for _, t in rows)
    assert (costs >= 40).sum() == len(shingles("same passage of many words here", 3))
    assert JaccardJoin(3, 90, 100)._costs(df.where("false")).sum() == 0


def test_odd_rows(odd, nothing):
    got = JaccardJoin(3, 90, 100).components(odd).collect()
    assert len(got) == 13
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[0] == (0, 0) and by[1] == (0, 1) and by[2] == (0, 2)
    assert by[3] == (1, 3) and by[4] == (1, 4) and by[5] == by[6] == (8, 5)
    assert by[11][1] == 7 and by[8] == (1, 8) and by[9] == (1, 9)
    assert JaccardJoin().components(nothing).count() == 0
