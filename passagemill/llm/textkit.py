"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, the same as
``[^\\x20\\x09-\\x0D]+`` on code points since those separators are single bytes
in UTF-8. All hashing is unsigned 64-bit arithmetic that wraps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, BLOCK + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[kind] = np.multiply.accumulate(step)
    return have


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 byte offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, n+1 word offsets per text).

    Works through blocks of about a megabyte cut at separators, so memory is
    bounded by the block plus eight bytes a word, whatever a text's length.
    """
    data, off = buffers(texts)
    hashes, ends = [], []
    at, n = 0, len(data)
    cuts = off[1:-1]
    while at < n:
        to = min(n, at + BLOCK)
        while to < n:
            back = np.flatnonzero(_SPACE[data[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
                break
            to = min(n, to + BLOCK)
        part = data[at:to]
        word = ~_SPACE[part]
        first = np.empty(len(part), bool)
        first[0] = True
        np.logical_not(word[:-1], out=first[1:])
        inner = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, to)] - at
        first[inner] = True
        starts = np.flatnonzero(first & word)
        if len(starts):
            stop = ~word
            last = np.empty(len(part), bool)
            last[-1] = True
            last[:-1] = stop[1:]
            last[inner[inner > 0] - 1] = True
            stops = np.flatnonzero(last & word) + 1
            with np.errstate(over="ignore"):
                value = _BYTE[_LOWER[part] if lower else part] * _power("up", len(part))[: len(part)]
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(value, out=total[1:])
                h = (total[stops] - total[starts]) * _power("down", len(part))[starts]
                hashes.append(mix(h + (stops - starts).astype(np.uint64)))
            ends.append(starts + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begin = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return h, np.searchsorted(begin, off)


_STEP = mix(np.arange(1, 4097, dtype=np.uint64)) | U(1)


def windows(h: np.ndarray, off: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the w-word window starting at each word, whether it stays in its text)."""
    n = len(h)
    out = np.zeros(n, np.uint64)
    inside = np.zeros(n, bool)
    if n >= w:
        with np.errstate(over="ignore"):
            for k in range(w):
                out[: n - w + 1] += h[k : n - w + 1 + k] * _STEP[k]
            out = mix(out + U(w))
        left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
        inside = left >= w
    return out, inside


def whole(h: np.ndarray) -> np.ndarray:
    """Hash of one whole word sequence that is shorter than a window."""
    with np.errstate(over="ignore"):
        return mix((h * _STEP[: len(h)]).sum(dtype=np.uint64) + U(len(h)) * U(0xD6E8FEB86659FD93))


def shingle_sets(texts: pa.Array, w: int, lower: bool = True):
    """Yield per text the sorted distinct w-word shingle hashes.

    Fewer words than w: the whole sequence is the one shingle; none: empty.
    """
    h, off = words_of(texts, lower)
    sh, _ = windows(h, off, w)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= w:
            yield np.unique(sh[a : b - w + 1])
        elif b > a:
            yield np.atleast_1d(whole(h[a:b]))
        else:
            yield sh[:0]
