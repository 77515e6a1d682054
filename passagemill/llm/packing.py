"""Sum-of-squares online packing of tokenised documents into fixed windows.

A document longer than a window is cut into full windows and a rest. Each rest
goes into the open window whose choice makes the sum over fill levels of
(number of open windows at that level) squared smallest; the counts per level
are one array. Every partition packs its own documents, so nothing is shuffled
or held but the open windows. When a partition ends, or more windows are open
than are to be held, the fullest windows keep what was placed in them and are
filled up with the pieces of the emptiest, cut where that is needed. The one
window that is left is cut into windows of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import lean

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
KNOWN_CHUNKS = 500_000  # encoded chunks that a worker keeps
LONG_CHUNK = 2000  # characters from which a chunk goes to the tokenizers library
OPEN_WINDOWS = 4096  # open windows a task holds before half of them are filled up


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes are themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def _ranked(path: str):
    """The file's vocabulary as a tiktoken encoding (ids are merge ranks), or None where that does not hold."""
    try:
        import tiktoken
    except ImportError:
        return None
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    letters = _byte_letters()
    vocab = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if all(c in letters for c in w)}
    merged = [bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    ids = [vocab[m] for m in merged]
    if ids != sorted(ids):
        return None
    from public_tokenizers import PATTERN

    real = set(merged)
    vocab = {w: i for w, i in vocab.items() if len(w) == 1 or w in real}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})


class ChunkEncoder:
    """Byte-level BPE ids of a text as little-endian unsigned 32-bit bytes.

    The pre-tokeniser never joins what stands before a space with what follows
    it unless two spaces meet, so a text is encoded space by space from a
    bounded table of known chunks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ranked = _ranked(path)
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        if self.ranked is not None and len(text) < LONG_CHUNK:
            return np.array(self.ranked.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        first, *rest = _units(text) if "  " in text else text.split(" ")
        return b"".join([self._encode(first) if first else b"", *self._chunks(rest)])

    def _chunks(self, rest: list[str]) -> list[bytes]:
        known = self.known
        out = []
        for x in rest:
            ids = known.get(x)
            if ids is None:
                ids = self._encode(" " + x)
                if len(x) < 64 and len(known) < KNOWN_CHUNKS:
                    known[x] = ids
            out.append(ids)
        return out


def _units(text: str) -> list[str]:
    """Split at single spaces; what several spaces part stays together."""
    out: list[list[str]] = [[]]
    gap = True
    for x in text.split(" "):
        if gap or not x:
            out[-1].append(x)
            gap = not x or len(out[-1]) == 0
        else:
            out.append([x])
    return [" ".join(x) for x in out]


class SumOfSquares:
    """Open windows by fill level and the level counts that steer placement."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.n_open = 0

    def place(self, piece: tuple, n: int) -> list | None:
        """Add a piece of n tokens; return the window (list of pieces) if that fills it."""
        size, count = self.size, self.count
        if n == size:
            return [piece]
        # change of the sum of squares when a window moves from level h to h + n
        have = np.flatnonzero(count[1 : size - n + 1]) + 1
        best, at = 2 * count[n] + 1, 0
        if len(have):
            to = have + n
            gain = 1 - 2 * count[have] + np.where(to < size, 2 * count[to] + 1, 0)
            k = int(np.argmin(gain))
            if gain[k] <= best:
                best, at = gain[k], int(have[k])
        window = self._take(at) if at else []
        window.append(piece)
        if at + n == size:
            return window
        self._put(window, at + n)
        return None

    def top_up(self, most: int):
        """Yield the fullest windows, filled up from the emptiest, until at most ``most`` (one at least) are open."""
        size, high, low = self.size, self.size - 1, 1
        while self.n_open > max(1, most):
            while not self.open[high]:
                high -= 1
            window, gap = self._take(high), size - high
            while gap:
                while not self.open[low]:
                    low += 1
                    if low == size:  # nothing is left to fill it with
                        self._put(window, size - gap)
                        return
                donor, held = self._take(low), low
                while gap and donor:
                    doc, start, ids, total = donor.pop()
                    n = len(ids) // 4
                    take = min(n, gap)
                    window.append((doc, start, ids[: 4 * take], total))
                    if take < n:
                        donor.append((doc, start + take, ids[4 * take :], total))
                    gap, held = gap - take, held - take
                if donor:
                    self._put(donor, held)
                    low = min(low, held)
            yield window

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, window: list, level: int) -> None:
        self.open[level].append(window)
        self.count[level] += 1
        self.n_open += 1

    def finish(self):
        """Yield what is open as full windows and, of the last one, windows of powers of two."""
        yield from self.top_up(1)
        for level in range(1, self.size):
            while self.open[level]:
                yield from cut_in_powers(self._take(level))


def cut_in_powers(pieces: list):
    """Cut the pieces (doc, start, ids, total) of one window into windows of powers of two, the largest first."""
    left = sum(len(p[2]) // 4 for p in pieces)
    room, window = 1 << max(0, left.bit_length() - 1), []
    for doc, start, ids, total in pieces:
        at, n = 0, len(ids) // 4
        while at < n:
            take = min(room, n - at)
            window.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
            at, room, left = at + take, room - take, left - take
            if not room:
                yield window
                room, window = 1 << max(0, left.bit_length() - 1), []


def _pack(path: str, size: int, end_id: int):
    def run(batches):
        encode = ChunkEncoder(path)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        packer = SumOfSquares(size)
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []

        def emit(window):
            nonlocal sequence
            at = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at))
                at += len(ids) // 4
            sequence += 1

        def out():
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
            rows.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for at in range(0, total, size):
                    piece = (doc, at, ids[4 * at : 4 * (at + size)], total)
                    full = packer.place(piece, len(piece[2]) // 4)
                    if full:
                        emit(full)
                if packer.n_open > OPEN_WINDOWS:
                    for window in packer.top_up(OPEN_WINDOWS // 2):
                        emit(window)
            if rows:
                yield out()
        for window in packer.finish():
            emit(window)
        if rows:
            yield out()

    return run


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end token alone. Repeated rows are packed
    once each. Extra columns are ignored; an empty table gives no pieces.
    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    path = tokenizer() if callable(tokenizer) else tokenizer
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(lean(_pack(path, size, end_id)), SCHEMA)
