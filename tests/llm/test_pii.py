import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.llm.pii import KINDS, Detector, Tagger, base_spans, detect, examples_of, fit, labelled, luhn, redact, redact_docs, regions, respelled_text, standard, tags_of, train, written_out
from passagemill.llm.queries import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return standard()


def brute(text):
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(re.sub(r"\D", "", m[0])) <= 19 and luhn(re.sub(r"[^0-9]", "", m[0]))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(2)
    alphabet = list("00112345.@+-() a%_é") + ["4111111111111111", "1.2.3.4", "a@b.c", "+1 (203) 555-8282"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert base_spans(text) == brute(text), text


def test_long_digit_runs():
    text = "0" * 5000 + ".1.1.1 and " + "9" * 5000 + ".1.1.1 and " + "0" * 9000 + "7.0.0.1"
    assert base_spans(text)["ip"] == [(0, 5006), (text.rindex(" ") + 1, len(text))]


def test_gradients():
    rng = np.random.default_rng(1)
    small = train(labelled(4, 1), epochs=1, width=12, units=3, embed=4, batch=2)
    p = {k: v.astype(float) for k, v in small.p.items()}
    model = Tagger(p)
    x = rng.integers(0, 30, (7, 3))
    y = np.array([tags_of(7, [("ip", 1, 4)]), tags_of(7, []), tags_of(7, [("phone", 0, 7)])]).T
    _, g = model.step(x, y)
    for name in p:
        flat, grad = p[name].reshape(-1), g[name].reshape(-1)
        for k in rng.choice(len(flat), min(4, len(flat)), replace=False):
            if name in "ts" and not grad[k]:
                continue
            keep = flat[k]
            flat[k] = keep + 1e-5
            up, _ = model.step(x, y)
            flat[k] = keep - 1e-5
            down, _ = model.step(x, y)
            flat[k] = keep
            assert abs((up - down) / 2e-5 - grad[k]) < 1e-4 * max(1, abs(grad[k])), name


def test_respelt_spans_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit(docs.where(~apart))
    r = random.Random(9)
    found = Counter()
    cases = [respelled_text(r, *x) if x[1] else x for x in examples_of(docs.where(apart), respell=0.0)]
    cases += [respelled_text(r, f"thandin {a}{x} {b} ere", [(k, 8 + len(a), 8 + len(a) + len(x))]) for k, x in (("email", "jo.ha24@mail7.example.com"), ("card", "4111111111111111"), ("phone", "+1 (203) 555-8282")) for a in ("", "the ", "erst. ") for b in ("and", "in the", "onat, er") for _ in range(3)]
    for (text, spans), got in zip(cases, Detector(model).found([t for t, _ in cases])):
        rules = base_spans(text)
        for kind, a, b in spans:
            if (a, b) not in rules[kind]:
                found[(kind, (a, b) in got[kind])] += 1
        found["extra"] += sum((k, a, b) not in spans and (a, b) not in rules[k] for k in KINDS for a, b in got[k])
    for kind in ("email", "card", "phone"):
        assert found[(kind, True)] >= 0.9 * (found[(kind, True)] + found[(kind, False)]) > 0, found
    assert found["extra"] <= 0.05 * len(cases), found
    assert fit(docs.where("false"), generated=20).p.keys() == model.p.keys()


def test_dotted_card(model):
    assert Detector(model).found(["card 4111.1111.1111.1111 ok"])[0]["card"] == [(5, 24)]


def test_held_out_spans(model):
    examples = labelled(300, 77)
    found = Detector(model).found([t for t, _ in examples])
    hit = miss = extra = 0
    for (_, spans), f in zip(examples, found):
        got, want = {(k, a, b) for k in f for a, b in f[k]}, set(spans)
        hit, miss, extra = hit + len(got & want), miss + len(want - got), extra + len(got - want)
    assert hit / (hit + miss) > 0.8 and hit / (hit + extra) > 0.97


def test_table(spark, model):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in detect(docs, model).collect()}
    for r in docs.collect():
        base = brute(r.text)
        line = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in base[k])
        g = got[r.doc_id]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(len(base[k]) for k in KINDS)
        assert g.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(g.spans.split(","))


def test_windows_of_a_long_region_are_joined(model):
    text = " ".join(f"call 555-{k:03d}-1234 or mail a{k}@b.com" for k in range(60))
    assert len(regions(text)) == 1
    assert [text[a:b] for a, b in base_spans(text)["email"]] == [text[a:b] for a, b in Detector(model).found([text])[0]["email"]]


def test_odd_rows(spark, odd, nothing, model):
    assert detect(odd, model).count() == 13 and detect(nothing, model).count() == 0
    assert all(r.spans == "" for r in detect(odd, model).collect())
    out = redact_docs(odd, model)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    for text in ("@" * 50_000, "1" * 50_000, "1.1.1.1." * 20_000, "+1" * 30_000, "a" * 200_000 + "@"):
        base_spans(text)
    assert redact("mail a@b.com, +1 (203) 555-8282.", base_spans("mail a@b.com, +1 (203) 555-8282.")) == "mail <EMAIL>, <PHONE>."


def test_long_and_written_out_addresses(model):
    whole = [
        "jane.doe (at) informatik.uni-heidelberg.de", "john [at] mycompany [dot] co [dot] uk", "firstname.middlename.surname.department [at] example [dot] org",
        "JOHN.SMITH [AT] MYCOMPANY [DOT] COM", "maria.fernandez (at) institut-fuer-informatik.uni-muenchen.de",
    ]
    texts = [f"please write to {a} today or call" for a in whole]
    for text, a, spans in zip(texts, whole, Detector(model).found(texts)):
        assert [text[x:y] for x, y in spans["email"]] == [a]
        assert any(x <= text.index(a) and text.index(a) + len(a) <= y for x, y in regions(text))
    for text in ("@" * 50_000, "a" * 200_000 + "@", "a[dot]" * 20_000, "a [at] " * 20_000, "1" * 50_000):
        regions(text)
        written_out(text)
