"""Queries do the whole of their job, by brute force on small tables."""

import math
import random
from collections import Counter, defaultdict

from passagemill.plans import queries as base
from passagemill.plans import tools


def test_registry_edges_of_every_user(spark, tmp_path):
    rows = [(1, "a", 3), (2, "b", 3), (3, "a", 20), (4, "a", 20), (5, "b", 20), (6, "b", 77), (7, "a", 77), (8, "a", 500)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long").write.parquet(f"file://{tmp_path}/events.parquet")
    want = Counter((a[0], b[0], "same_seed") for a in rows for b in rows if a[1] == "a" and a[2] == b[2] and a[0] != b[0])
    assert Counter(map(tuple, base.registry_edges(spark, f"file://{tmp_path}").collect())) == want


def brute_weights(texts):
    """Vocabulary and unit weights of the 5- to 8-grams of texts by id."""
    counts = {d: Counter(g for n in range(5, 9) for i in range(len(t) - n + 1) if len(set(g := t[i : i + n])) > 1 and (n % 2 or g[: n // 2] != g[n // 2 :])) for d, t in texts.items()}
    df = Counter(g for c in counts.values() for g in c)
    kept = sorted(((n, g) for g, n in df.items() if 5 <= n <= max(1, int(0.05 * len(texts)))), key=lambda x: (-x[0], x[1]))[:200_000]
    idf = {g: math.log((len(texts) - n + 0.5) / (n + 0.5) + 1) for n, g in kept}
    out = defaultdict(dict)
    for d, c in counts.items():
        total = sum(k for g, k in c.items() if g in idf)
        w = {g: k / total * idf[g] for g, k in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[d] = {g: x / norm for g, x in w.items()}
    return {g: (n, round(idf[g], 6)) for n, g in kept}, out


def test_tfidf_of_all_sizes_and_terms(spark, tmp_path):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    shared = ["".join(r.choices(letters, k=400)) for _ in range(24)]
    texts = {d: shared[d % 24] + shared[(d + d // 24) % 24][: 40 * (d // 24)] * (d % 5 == 2) + "".join(r.choices(letters, k=30)) for d in range(120)}
    docs = [(d, t, "en", f"src{d % 6}", len(t)) for d, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    vocabulary, w = brute_weights(texts)
    assert len(vocabulary) > 20_000 and {len(g) for g in vocabulary} == {5, 6, 7, 8}
    sf = f"file://{tmp_path}"
    assert {x.term: (x.df, x.idf) for x in base.tfidf_vocabulary(spark, sf).collect()} == vocabulary
    cosine = {d: sum(x * w[base.SEED].get(g, 0) for g, x in w[d].items()) for d in texts if d != base.SEED}
    want = sorted(((-round(x, 6), d) for d, x in cosine.items() if round(x, 6) > 0))[:20]
    got = [(x.doc_id, x.score) for x in base.tfidf_similar(spark, sf).collect()]
    assert [d for d, _ in got] == [d for _, d in want] and all(abs(a - (-b)) < 2e-6 for (_, a), (b, _) in zip(got, want))
    best = want[0][1]
    both = sorted(((-round(x * w[best][g], 8), -len(g), g) for g, x in w[base.SEED].items() if g in w[best]))[:12]
    assert [(x.term, x.contribution) for x in base.shared_ngrams(spark, sf).collect()] == [(g, -x) for x, _, g in both]


def test_frontier_reads_the_whole_seed(spark, tmp_path):
    r = random.Random(5)
    tail = "zzyxwzvzuzt" * 3 + "zzzzzzzzzzzz" + "zyxwvzyxwv"  # past the seed's first 200 characters; sorts last, partly of low value
    seed = "".join(r.choices("abcdefgh", k=400)) + tail
    texts = {base.SEED: seed, **{d: "".join(r.choices("abcdefgh", k=50)) + (tail if d % 2 else seed[:60]) for d in range(10, 20)}}
    docs = [(d, t, "en", f"src{d % 4}", len(t)) for d, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    grams = {g for n in range(4, 11) for i in range(len(seed) - n + 1) if len(set(g := seed[i : i + n])) > 1 and (n % 2 or g[: n // 2] != g[n // 2 :])}
    want = []
    for g in sorted(sorted(grams, reverse=True), key=len, reverse=True)[:40]:
        held = [d for d, t in texts.items() if d != base.SEED and g in t]
        sources = len({d % 4 for d in held})
        if 2 <= len(held) <= 200:
            want.append((g, len(g), len(held), sources, round(min(1.0, len(g) / 8 + min(len(held), 20) / 40 + sources / 20), 6)))
    want.sort(key=lambda x: (-x[4], -x[3], -x[1], x[2], x[0]))
    assert want and [tuple(x) for x in base.frontier(spark, f"file://{tmp_path}").collect()] == want[:20]
    p = base.passages(spark, f"file://{tmp_path}")
    assert [tuple(x.values()) for x in tools.call(tools.Corpus(p), "frontier", {"seed": base.SEED})["rows"]] == want[:20]
    assert base.lexical.frontier(p, base.SEED, []).count() == 0


def test_gram_counts_by_alphabet_and_piece(spark, monkeypatch):
    from passagemill.functions import grams
    from passagemill.operators import lexical

    texts = ["中A國中國", None, "", "aabaab", "ab" * 30, "如是如是我聞🙂"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, zh_text_normalized string")
    for alphabet, keep in (("letters", lambda c: True), ("cjk", lambda c: "㐀" <= c <= "鿿")):
        want = Counter()
        for t in texts:
            s = "".join(c for c in t or "" if keep(c))
            want.update({g for n in (1, 2, 4, 6) for i in range(len(s) - n + 1) if len(set(g := s[i : i + n])) > 1 and not (n >= 4 and g[: n // 2] == g[n // 2 :])})
        assert {r.term: r.df for r in lexical.term_frequencies(df, (1, 2, 4, 6), alphabet).collect()} == want
    monkeypatch.setattr(grams, "PIECE", 3)
    assert [(at, piece.joined) for at, piece in grams.pieces(texts[:4], "letters")] == [(0, "中A國中國"), (1, "aabaab")]
    index = lexical.phrase_index(df, 2)
    assert {(r.gram, r.doc_id) for r in index.collect()} == {(t[i : i + 2], d) for d, t in enumerate(texts) for i in range(len(t or "") - 1)}
    words = grams.Vocabulary(["ab", "國中", "ba"])
    at, term = words.find(grams.Piece(["中A國中國ab"], "letters").hashes(2))
    assert at.tolist() == [2, 5] and term.tolist() == [1, 0]
