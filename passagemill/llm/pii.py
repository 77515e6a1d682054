"""Personal data by rules and a character BiLSTM with CRF transitions.

The rules' spans stay. The network, trained in numpy from labelled spans (those
that the rules find in a sample of the documents, spelt otherwise in their own
surroundings, and generated ones), reads
overlapping windows around the places where a span can be at all (every kind
has a digit or an at-sign); a character's scores are taken from the window in
which it is most central, the label sequence of each joined region is decoded
at once, and spans that overlap a rule's span or fail the kind's exact check
are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import lean

KINDS = ["email", "ip", "card", "phone"]
# The base patterns.
_AT_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

SEED = re.compile(r"[0-9@]|[\[(] ?(?:at|dot) ?[\])]", re.I)
REACH = 24  # characters around a seed that a region has at least
MARGIN = 8  # characters around an address that a region has at least
_WRITTEN_AT = re.compile(r"[\[(] ?at ?[\])]", re.I)
_DOT = re.compile(r"[\[(] ?dot ?[\])]", re.I)
_WRITTEN = re.compile(r"\s?[\w-]+(?:(?:\.|\s?[\[(] ?dot ?[\])]\s?)[\w-]+)+", re.I)
_RIGHT = re.compile(r"\s?[\w.%+-]+(?:\s?\.\s?[\w-]+)*")
WINDOW, OVERLAP = 96, 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four kinds by the fixed rules, leftmost and not overlapping within a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _AT_LEFT.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x) < 4 and int(x or "0") < 256 for x in (y.lstrip("0") for y in m[0].split("."))):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


# ---------------------------------------------------------------- characters

_CODE = np.ones(0x250, np.int16)
for _i, _c in enumerate("0123456789@.+-()[]_%:/=#,;'\" \n\t"):
    _CODE[ord(_c)] = _i + 4
_N = 4 + 32
_CODE[[c for c in range(128) if chr(c).isalpha()]] = 2
_CODE[[c for c in range(65, 91)]] = 3
for _i, _c in enumerate("adotcmehlpx"):
    _CODE[ord(_c)] = _N + _i
SYMBOLS = _N + 11 + 1


def codes(text: str) -> np.ndarray:
    """Class of each character: digits, signs and a few letters have their own."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_CODE), _CODE[np.minimum(points, len(_CODE) - 1)], 2).astype(np.int64)


# ------------------------------------------------------------ labelled spans

_SYLLABLES = "the and er in on re ti en th es an ha st ou de la le que sch ver ein ich cion mente osa ra auto info mar lin kel bo".split()


def _word(r: random.Random) -> str:
    w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    return w.capitalize() if r.random() < 0.15 else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _span(r: random.Random, kind: str) -> str:
    if kind == "email":
        user = r.choice([_word(r), f"{_word(r)}.{_word(r)}", f"{_word(r)}.{_digits(r, 2)}", f"{_word(r)}_{_digits(r, 3)}"]).lower()
        host = f"{_word(r).lower()}{r.choice(['', _digits(r, 1)])}"
        tld = r.choice(["com", "org", "net", "de", "fr", "es", "example.com"])
        if r.random() < 0.35:
            a, d = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" (at) ", "."), ("[at]", "."), (" @ ", ".")])
            return f"{user}{a}{host}{d}{tld}"
        return f"{user}@{host}.{tld}"
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = r.choice("3456") + _digits(r, 14)
        check = next(c for c in "0123456789" if luhn(body + c))
        n = body + check
        return r.choice([n, " ".join(n[i : i + 4] for i in range(0, 16, 4)), "-".join(n[i : i + 4] for i in range(0, 16, 4)), ".".join(n[i : i + 4] for i in range(0, 16, 4))])
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{r.randint(10, 99)} {a} {b}{c}", f"+{r.randint(1, 99)}{a}{b}{c}"])


def _other(r: random.Random) -> str:
    """Text with digits or signs that is no personal data."""
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    return r.choice(
        [
            f"version {r.randint(0, 20)}.{r.randint(0, 20)}.", f"Version {r.randint(1, 9)}.0.", str(r.randint(1800, 2030)), f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            f"{r.randint(1, 999)},{_digits(r, 3)}", f"${r.randint(1, 999)}.{_digits(r, 2)}", f"{r.randint(1, 99)}%", f"password={hexes(18)}", f'token = "{hexes(40)}"', "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
            f"{r.randint(0, 23)}:{_digits(r, 2)}", f"@{_word(r)}", f"{r.randint(1, 9)} x {r.randint(1, 9)} = {r.randint(1, 81)}", f"#{r.randint(1, 9999)}", f"{_word(r)}{r.randint(1, 99)}", f"{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}", f"{r.randint(100, 999)}-{r.randint(100, 999)}", _digits(r, r.randint(5, 22)), f"pp. {r.randint(1, 99)}-{r.randint(100, 400)}", f"ISBN {_digits(r, 13)}",
        ]
    )


def labelled(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of a few words with marked spans, made by a seeded generator."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += "".join(_word(r) + r.choice([" ", " ", " ", ", ", ". ", ".\n"]) for _ in range(r.randint(0, 4)))
            if r.random() < 0.6:
                kind = r.choice(KINDS)
                piece = _span(r, kind)
                spans.append((kind, len(text), len(text) + len(piece)))
            else:
                piece = _other(r)
            text += piece + r.choice([" ", " ", ". ", ", ", "\n", ") "])
        out.append((text, spans))
    return out


def respelled(r: random.Random, kind: str, span: str) -> str:
    """Another spelling of a span that a rule found, as people write it; the rules miss most of these."""
    digits = "".join(_DIGIT.findall(span))
    if kind == "email":
        user, _, host = span.partition("@")
        at, dot = r.choice([("[at]", "."), ("(at)", "."), (" (at) ", "."), (" [at] ", "."), (" @ ", "."), ("@ ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) ")])
        return user + at + host.replace(".", dot)
    if kind == "card":
        sep = r.choice([".", ".", " ", "-"])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "phone" and len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10] or '1'} {a} {b}{c}"])
    return span


CONTEXT = 60  # characters of a document on either side of a span that an example holds


def _contexts(batches):
    """(text, spans) of the surroundings of each span of the rules, and of a number or sign that is none."""
    for batch in batches:
        out = []
        for text in batch.column(0):
            text = text.as_py() or ""
            spans = sorted((a, b, k) for k, v in base_spans(text).items() for a, b in v)
            places = [(a, b) for a, b, _ in spans] + [m.span() for m in itertools.islice(re.finditer(r"\S*[0-9@]\S*", text), 20)]
            for a, b in places[:40]:
                lo, hi = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
                lo = min([lo, *(x for x, y, _ in spans if x < lo < y)])
                hi = max([hi, *(y for x, y, _ in spans if x < hi < y)])
                out.append((text[lo:hi], [f"{k}:{x - lo}:{y - lo}" for x, y, k in spans if lo <= x and y <= hi]))
        texts, found = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.string()))], ["text", "spans"])


def examples_of(docs: DataFrame, most_docs: int = 20_000, most: int = 1500, id_col: str = "doc_id", text_col: str = "text", seed: int = 3, respell: float = 0.7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled examples from documents: surroundings of the rules' spans, each as it is or with the span spelt otherwise.

    From the ``most_docs`` documents with the smallest hashed ids; of their surroundings at most ``most`` with a span
    and as many without, by the hash of their text. Numbers that fail a rule, dates and secrets are examples without a span.
    """
    some = docs.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(most_docs)
    rows = docs.join(F.broadcast(some), docs[id_col] == F.col("_id"), "left_semi").select(F.col(text_col).cast("string"))
    got = rows.mapInArrow(lean(_contexts), "text string, spans array<string>").distinct()
    order = [F.xxhash64("text"), "text"]
    held = got.where("size(spans) > 0").orderBy(*order).limit(most).unionByName(got.where("size(spans) = 0").orderBy(*order).limit(most)).collect()
    out = []
    for row in sorted(held, key=lambda x: (x.text, x.spans)):
        r = random.Random(f"{seed} {row.text}")
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans)]
        out.append(respelled_text(r, row.text, spans) if spans and r.random() < respell else (row.text, spans))
    return out


def respelled_text(r: random.Random, text: str, spans: list[tuple[str, int, int]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its spans spelt otherwise; overlapping spans are left as they are."""
    parts, out, at, size = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            return text, spans
        new = respelled(r, kind, text[a:b])
        parts += [text[at:a], new]
        size += a - at
        out.append((kind, size, size + len(new)))
        size, at = size + len(new), b
    return "".join([*parts, text[at:]]), out


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """0 outside, 2k+1 first and 2k+2 further characters of kind k."""
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[a:b] = 2 * k + 2
        out[a : a + 1] = 2 * k + 1
    return out


TAGS = 2 * len(KINDS) + 1
_ALLOWED = np.array([[b % 2 == 1 or b == 0 or a in (b, b - 1) for b in range(TAGS)] for a in range(TAGS)])
_BEGIN = np.array([b % 2 == 1 or b == 0 for b in range(TAGS)])


# ------------------------------------------------------------------- network


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(x, w, u, b, keep: bool):
    """x: time, batch, inputs. Returns hidden states (time, batch, units) and what back-propagation needs."""
    steps, batch, _ = x.shape
    units = u.shape[0]
    pre = x.reshape(-1, x.shape[2]) @ w + b
    pre = pre.reshape(steps, batch, 4 * units)
    h, c = np.zeros((batch, units), x.dtype), np.zeros((batch, units), x.dtype)
    hs = np.empty((steps, batch, units), x.dtype)
    memo = []
    for t in range(steps):
        z = pre[t] + h @ u
        gate = _sigmoid(z[:, : 3 * units])
        i, f, o = gate[:, :units], gate[:, units : 2 * units], gate[:, 2 * units :]
        g = np.tanh(z[:, 3 * units :])
        before = c
        c = f * c + i * g
        th = np.tanh(c)
        if keep:
            memo.append((gate, g, before, th, h))
        h = o * th
        hs[t] = h
    return hs, memo


def _lstm_back(x, w, u, memo, dh_all):
    steps, batch, _ = x.shape
    units = u.shape[0]
    dz_all = np.empty((steps, batch, 4 * units), x.dtype)
    dh, dc, du = np.zeros((batch, units), x.dtype), np.zeros((batch, units), x.dtype), np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        gate, g, before, th, h = memo[t]
        i, f, o = gate[:, :units], gate[:, units : 2 * units], gate[:, 2 * units :]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - th * th)
        dz = dz_all[t]
        dz[:, :units] = dc * g * i * (1 - i)
        dz[:, units : 2 * units] = dc * before * f * (1 - f)
        dz[:, 2 * units : 3 * units] = dh * th * o * (1 - o)
        dz[:, 3 * units :] = dc * i * (1 - g * g)
        du += h.T @ dz
        dh = dz @ u.T
        dc = dc * f
    flat = dz_all.reshape(-1, 4 * units)
    return (flat @ w.T).reshape(x.shape), x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


@dataclass
class Tagger:
    """Parameters: embedding e; forward wf uf bf; backward wb ub bb; output v a; transitions t, start s."""

    p: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x: time, batch of character classes."""
        p = self.p
        e = p["e"][x]
        hf, mf = _lstm(e, p["wf"], p["uf"], p["bf"], keep)
        hb, mb = _lstm(e[::-1], p["wb"], p["ub"], p["bb"], keep)
        h = np.concatenate((hf, hb[::-1]), 2)
        return h @ p["v"] + p["a"], (e, h, mf, mb)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences y and its gradients."""
        p = self.p
        em, (e, h, mf, mb) = self.emissions(x, True)
        steps, batch = y.shape
        trans = np.where(_ALLOWED, p["t"], -1e4)
        start = np.where(_BEGIN, p["s"], -1e4)
        alpha = np.empty_like(em)
        alpha[0] = em[0] + start
        for t in range(1, steps):
            alpha[t] = em[t] + _lse(alpha[t - 1][:, :, None] + trans[None], 1)
        beta = np.zeros_like(em)
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(trans[None] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        d_em = np.exp(alpha + beta - z[None, :, None])
        d_t = np.zeros_like(p["t"])
        for t in range(1, steps):
            d_t += np.exp(alpha[t - 1][:, :, None] + trans[None] + (em[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        d_s = d_em[0].sum(0)
        row = np.arange(batch)
        gold = em[0, row, y[0]] + start[y[0]]
        np.subtract.at(d_s, y[0], 1)
        for t in range(steps):
            d_em[t, row, y[t]] -= 1
            if t:
                gold = gold + em[t, row, y[t]] + trans[y[t - 1], y[t]]
                np.subtract.at(d_t, (y[t - 1], y[t]), 1)
        d_em /= batch
        d_h = d_em @ p["v"].T
        units = p["uf"].shape[0]
        de_f, wf, uf, bf = _lstm_back(e, p["wf"], p["uf"], mf, d_h[:, :, :units])
        de_b, wb, ub, bb = _lstm_back(e[::-1], p["wb"], p["ub"], mb, d_h[::-1, :, units:])
        de = np.zeros_like(p["e"])
        np.add.at(de, x.ravel(), (de_f + de_b[::-1]).reshape(-1, e.shape[2]))
        g = {"e": de, "wf": wf, "uf": uf, "bf": bf, "wb": wb, "ub": ub, "bb": bb, "v": h.reshape(-1, h.shape[2]).T @ d_em.reshape(-1, TAGS), "a": d_em.sum((0, 1)), "t": np.where(_ALLOWED, d_t, 0) / batch, "s": np.where(_BEGIN, d_s, 0) / batch}
        return float((z - gold).mean()), g

    def decode(self, em: np.ndarray) -> np.ndarray:
        """Most likely tag sequence of one text's emissions (time, tags)."""
        trans = np.where(_ALLOWED, self.p["t"], -1e4)
        best = em[0] + np.where(_BEGIN, self.p["s"], -1e4)
        back = np.empty((len(em), TAGS), np.int8)
        for t in range(1, len(em)):
            all_ = best[:, None] + trans
            back[t] = all_.argmax(0)
            best = all_.max(0) + em[t]
        out = np.empty(len(em), np.int64)
        out[-1] = best.argmax()
        for t in range(len(em) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, width: int = 64, units: int = 20, embed: int = 12, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Tagger:
    """Fit the tagger on labelled texts by Adam steps on windows of ``width`` characters."""
    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    p = {"e": init(SYMBOLS, embed) * np.float32(np.sqrt(SYMBOLS) * 0.3), "v": init(2 * units, TAGS), "a": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32), "s": np.zeros(TAGS, np.float32)}
    for d in "fb":
        p |= {f"w{d}": init(embed, 4 * units), f"u{d}": init(units, 4 * units), f"b{d}": np.zeros(4 * units, np.float32)}
        p[f"b{d}"][units : 2 * units] = 1
    model = Tagger(p)
    xs, ys = [], []
    for text, spans in examples:
        x, y = codes(text), tags_of(len(text), spans)
        for a in range(0, max(1, len(x) - width // 4), width * 3 // 4):
            part = np.zeros(width, np.int64)
            tag = np.zeros(width, np.int64)
            n = min(width, len(x) - a)
            part[:n], tag[:n] = x[a : a + n], y[a : a + n]
            if tag[0] and tag[0] % 2 == 0:  # a span that began before: no target here
                cut = int(np.argmax(np.append(tag != tag[0], True)))
                tag[:cut] = 0
                part[:cut] = 1
            xs.append(part)
            ys.append(tag)
    x, y = np.array(xs).T, np.array(ys).T
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    k = 0
    total = epochs * -(-x.shape[1] // batch)
    for _ in range(epochs):
        order = rng.permutation(x.shape[1])
        for a in range(0, len(order), batch):
            k += 1
            _, g = model.step(x[:, order[a : a + batch]], y[:, order[a : a + batch]])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            lr = rate * (1 - 0.9 * k / total)
            for name, v in g.items():
                v = v * min(1.0, 5.0 / max(norm, 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * v
                s[name] = 0.99 * s[name] + 0.01 * v * v
                p[name] -= (lr * (m[name] / (1 - 0.9**k)) / (np.sqrt(s[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return model


@functools.lru_cache(maxsize=2)
def standard(n: int = 1500, seed: int = 11) -> Tagger:
    """The tagger trained on the generator's labelled texts; made once a process."""
    return train(labelled(n, seed))


def fit(docs: DataFrame, generated: int = 1500, seed: int = 11, **options) -> Tagger:
    """The tagger trained on a bounded sample of the documents' own spans, respelt, and on generated texts.

    Without documents, ids or spans in them only the generated texts are learned from.
    """
    return train(labelled(generated, seed) + examples_of(docs, **options))


# ------------------------------------------------------------------ detection


def _address(text: str, a: int, b: int) -> tuple[int, int]:
    """The stretch of address characters around a sign at a to b."""
    m = _RIGHT.match(text, b)
    if a and text[a - 1].isspace():
        a -= 1
    while a and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
        a -= 1
    return a, m.end() if m else b


def regions(text: str) -> list[tuple[int, int]]:
    """Joined stretches around characters that a span needs; none ends within an address."""
    out: list[list[int]] = []
    for m in SEED.finditer(text):
        a, b = m.start() - REACH, m.end() + REACH
        if not m[0].isdigit():
            c, d = _address(text, *m.span())
            a, b = min(a, c - MARGIN), max(b, d + MARGIN)
        a, b = max(0, a), min(len(text), b)
        while out and a <= out[-1][1]:
            first, last = out.pop()
            a, b = min(a, first), max(b, last)
        out.append([a, b])
    return [(a, b) for a, b in out]


def written_out(text: str) -> list[tuple[int, int]]:
    """Addresses with both signs in brackets, which need no network."""
    out: list[tuple[int, int]] = []
    for m in _WRITTEN_AT.finditer(text) if "[" in text or "(" in text else ():
        start, _ = _address(text, *m.span())
        start += text[start].isspace()
        end = _WRITTEN.match(text, m.end())
        if start < m.start() and text[start:m.start()].strip() and end and _DOT.search(end[0]) and (not out or start >= out[-1][1]):
            out.append((start, end.end()))
    return out


def _fits(kind: str, text: str, a: int, b: int) -> bool:
    """The kind's exact check of a span of the network."""
    s = text[a:b]
    if (a and text[a - 1].isalnum() and s[0].isalnum()) or (b < len(text) and text[b].isalnum() and s[-1].isalnum()):
        return False
    digits = "".join(_DIGIT.findall(s))
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+\s?(?:@|\[ ?at ?\]|\( ?at ?\))\s?[\w-]+(?:\s?(?:\.|\[ ?dot ?\]|\( ?dot ?\))\s?[\w-]+)+", s, re.I))
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) < 4 and int(x) < 256 for x in parts)
    if kind == "card":
        return (16 <= len(digits) <= 19 or len(digits) == 15 and digits[:2] in ("34", "37")) and luhn(digits) and not re.search(r"[^0-9 .-]", s)
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9 .-]+[0-9]", s))


class Detector:
    """Rules and tagger over many texts at once."""

    def __init__(self, model: Tagger):
        self.model = model

    def found(self, texts: list[str]) -> list[dict[str, list[tuple[int, int]]]]:
        """Per text the spans of each kind: the rules' and what the tagger adds."""
        out = [base_spans(t) for t in texts]
        for t, spans in zip(texts, out):
            rules = [s for v in spans.values() for s in v]
            spans["email"] += [(a, b) for a, b in written_out(t) if not any(a < y and x < b for x, y in rules)]
            spans["email"].sort()
        jobs = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
        for first in range(0, len(jobs), 2000):
            some, held = [], 0
            for job in jobs[first : first + 2000]:
                some.append(job)
                held += job[2] - job[1]
                if held > 400_000:
                    self._add(texts, some, out)
                    some, held = [], 0
            if some:
                self._add(texts, some, out)
        return out

    def _add(self, texts, jobs, out) -> None:
        place, parts = [], []
        for k, (i, a, b) in enumerate(jobs):
            x = codes(texts[i][a:b])
            for at in range(0, max(1, len(x) - OVERLAP), WINDOW - OVERLAP):
                part = np.ones(WINDOW, np.int64)
                n = min(WINDOW, len(x) - at)
                part[:n] = x[at : at + n]
                place.append((k, at, n))
                parts.append(part)
        scores = [np.zeros((b - a, TAGS), np.float32) for _, a, b in jobs]
        for c in range(0, len(parts), 512):
            em, _ = self.model.emissions(np.array(parts[c : c + 512]).T)
            for j, (k, at, n) in enumerate(place[c : c + 512]):
                skip = OVERLAP // 2 if at else 0  # the earlier window has these nearer to its middle
                scores[k][at + skip : at + n] = em[skip:n, j]
        for (i, a, _), em in zip(jobs, scores):
            for kind, s, e in spans_of(self.model.decode(em)):
                s, e = s + a, e + a
                while s < e and texts[i][s].isspace():
                    s += 1
                while e > s and (texts[i][e - 1].isspace() or texts[i][e - 1] in ".,;"):
                    e -= 1
                taken = any(s < y and x < e for v in out[i].values() for x, y in v)
                if s < e and not taken:
                    fit = next((k for k in (kind, "card", "ip") if _fits(k, texts[i], s, e)), None)  # digits with dots may be marked as another kind
                    if fit:
                        out[i][fit].append((s, e))
                        out[i][fit].sort()


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    out, k = [], 0
    while k < len(tags):
        t = int(tags[k])
        if t % 2:
            e = k + 1
            while e < len(tags) and tags[e] == t + 1:
                e += 1
            out.append((KINDS[t // 2], k, e))
            k = e
        else:
            k += 1
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def _batched(texts: list[str], limit: int = 4_000_000):
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= limit:
            yield some
            some, held = [], 0
    if some:
        yield some


def _detect(model: Tagger):
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        detector = Detector(model)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows = []
            for some in _batched(texts):
                for text, spans in zip(some, detector.found(some)):
                    base = base_spans(text) if any(spans.values()) else spans
                    rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names)

    return run


def detect(docs: DataFrame, model: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, counts and digest of the rules' spans, all spans.

    Null texts are empty and have no spans; texts are read whole, however long. Positions are code points, ends
    exclusive. Repeated rows are read each; extra columns are ignored; an empty table gives no rows. Without a model
    the one of the generated texts is used.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_detect(model or standard())), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each stretch of overlapping spans replaced by its first span's kind in angle brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redact(model: Tagger):
    def run(batches):
        detector = Detector(model)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            new = []
            for some in _batched([x or "" for x in texts]):
                new += [redact(t, s) for t, s in zip(some, detector.found(some))]
            batch = batch.set_column(at, batch.schema.field(at), pa.array([None if o is None else n for o, n in zip(texts, new)], batch.schema.field(at).type))
            yield batch

    return run


def redact_docs(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The rows of ``docs`` with the spans in column text replaced; null texts stay null, other columns and repeated rows as they are."""
    return docs.mapInArrow(lean(_redact(model or standard())), docs.schema)
