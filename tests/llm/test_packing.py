import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from passagemill.llm.packing import ChunkEncoder, SumOfSquares, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer():
    mine, theirs, r = ChunkEncoder(PATH), reference(), random.Random(1)
    parts = [" ", "  ", "\n", "\t", " \n", "a", "b.", "é", "中", '"', "'s", "12", "²", "<|endoftext|>", "_", "   ", "\r\n", "🙂", "\x1c", "x" * 50]
    for _ in range(1500):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert mine(s) == np.array(theirs(s), "<u4").tobytes()


def check(df, docs):
    theirs = reference()
    want = {d: [*theirs(t or ""), 0] for d, t in docs}
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in df.collect():
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    for d, ids in want.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at
            at += length
        assert at == len(ids)
    return padding


def test_every_token_once_and_no_padding(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(["alpha", "beta,", "x", "longerword\n"]) for _ in range(int(r.expovariate(1 / 200))))) for i in range(300)]
    assert check(pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), PATH), docs) == 0


def test_odd_rows(odd, nothing):
    once = odd.dropDuplicates(["doc_id"])
    assert check(pack(once, PATH), [(r.doc_id, r.text) for r in once.collect()]) == 0
    assert pack(nothing, PATH).count() == 0
    twice = pack(odd.where("doc_id = 5"), PATH).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


def test_placement_takes_the_level_with_the_least_squares():
    p, r = SumOfSquares(16), random.Random(4)
    for _ in range(400):
        n = r.randint(1, 15)
        before = p.count.copy()
        options = {0: (before[n] + 1) ** 2 - before[n] ** 2}
        for h in range(1, 16 - n + 1):
            if before[h]:
                options[h] = (before[h] - 1) ** 2 - before[h] ** 2 + ((before[h + n] + 1) ** 2 - before[h + n] ** 2 if h + n < 16 else 0)
        p.place(("d", 0, b"", 0), n)
        assert (p.count[1:16] ** 2).sum() - (before[1:16] ** 2).sum() == min(options.values())


def test_topping_up_keeps_what_was_placed():
    r = random.Random(6)
    p, full, whole = SumOfSquares(64), [], 0
    for d in range(500):
        n = r.randint(1, 63)
        full += [w for w in [p.place((d, 0, bytes(4 * n), n), n)] if w]
    placed = len(full)
    before = sum(len(w) for level in p.open for w in level)
    half = list(p.top_up(p.n_open // 2))
    rest = list(p.finish())
    for w in half + rest:
        n = sum(len(x[2]) // 4 for x in w)
        assert n == 64 or n & (n - 1) == 0
        whole += sum(len(x[2]) // 4 == x[3] for x in w)
    assert placed > 0 and p.n_open == 0 and not p.count.any()
    assert all(sum(len(x[2]) // 4 for x in w) == 64 for w in half)
    assert whole > before // 2
    got = defaultdict(list)
    for w in full + half + rest:
        for d, start, ids, n in w:
            got[d].append((start, len(ids) // 4, n))
    for parts in got.values():
        at = 0
        for start, n, total in sorted(parts):
            assert start == at
            at += n
        assert at == total
    assert len(got) == 500
