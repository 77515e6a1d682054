import random
import re

from passagemill.llm.url_filter import BLOCKED_HOSTS, SITE_RULES, GlobAutomaton, judge


def matches(glob, text):
    glob = re.sub(r"\*+", "*", glob)
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), text, re.S) is not None


def test_automaton_equals_regular_expressions():
    r = random.Random(1)
    globs = ["".join(r.choice("ab*?.") for _ in range(r.randint(0, 9))) for _ in range(120)] + ["a" * 200, "*" + "ab" * 60 + "*", "*b"]
    texts = ["".join(r.choice("ab.") for _ in range(r.randint(0, 14))) for _ in range(300)] + ["a" * 200, "x" + "ab" * 60, ""]
    got = GlobAutomaton(globs).match([t.encode() for t in texts])
    for t, row in zip(texts, got):
        assert row.tolist() == [matches(g, t) for g in globs]
    long = GlobAutomaton(["*b", "ab*", "*ba", "a?*b", "*"]).match([b"ab" * 4000, b"ab" * 2000])
    assert long.tolist() == [[True, True, False, True, True]] * 2


def brute(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in SITE_RULES:
        h, _, p = rule.text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule.text) > len(best.text)):
            best = rule
    verdict = best.action if best else "block" if any(matches(g, host) for g in BLOCKED_HOSTS) else "allow"
    return host, path, best and best.text, verdict


def test_urls(spark):
    urls = [
        None, "", "no scheme", "://", "http://net/", "http://a.NET/x", "http://anet/", "https://www.example.net/en/1?x=/de/", "https://example.net/EN/", "http://example.net", "http://example.com/de/x#y", "http://x.org/fr/", "http://org/fr/",
        "ftp://user@casino-win.example.org:80/a", "http://a.com/b.net/c", "http://a.net?q=/x", "http://a.net#/x", "http://ads-x.com", "http://h\n.net/\nen", "http://" + "a" * 9000 + ".net/" + "p" * 9000, "x://y://net/", "http://é.net/ü", "http://a.net/x", "http://a.net/x",
    ]
    rows = [(i, u, "h") for i, u in enumerate(urls)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, host string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [brute(u) for u in urls]
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
