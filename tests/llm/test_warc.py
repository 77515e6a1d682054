import base64
import gzip
import hashlib

import pytest

from passagemill.llm.queries import op9_transactions, table
from passagemill.llm.warc import RECORDS, assemble, captures, parse, records_of, resolve, write_archive

SF = "/root/testdata/sf0.001"


def brute(rows):
    first = {}
    for page, _, html in rows:
        first[html or ""] = max(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = first[html or ""]
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page == to else "revisit", None if page == to else to))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.metadata.page_id, r.response.length if r.revisited is None else r.revisited.length, r.response.digest, r.response.kind, r.revisited and r.revisited.page_id) for r in df.collect()), key=str)


def test_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, SF, "pages").collect()]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op9_transactions(spark, SF).collect()), key=str)
    assert got == brute(rows)


def test_odd_pages_and_round_trip(spark):
    page = "<p>é\r\n\r\nWARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n</p>\n"
    rows = [(1, "http://a.org/x y", page), (2, "http://b.org/", page), (3, None, None), (4, "u", ""), (5, "v\r\nX: y", "long " * 50_000), (6, "w", page + "\r\n\r\n"), (6, "w", page + "\r\n\r\n")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, body string")
    out = captures(df, with_payload=True)
    assert rows_of(out) == brute(rows)
    by = {r.metadata.page_id: r for r in out.collect()}
    assert by[2].response.payload.decode() == page and by[5].response.payload.decode() == rows[4][2]
    assert by[1].response.refers_to == by[2].response.record_id and by[1].request.target_uri == "http://a.org/x%20y"
    assert by[3].request.target_uri is None
    assert captures(df.where("false")).count() == 0


def test_files_are_gzipped_records(spark, tmp_path):
    write_archive(spark.createDataFrame([(1, "http://a.org/", "<p>x</p>")], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    assert data[:2] == b"\x1f\x8b"
    kinds = [h["warc-type"] for h, _ in parse(gzip.decompress(data))]
    assert kinds == ["request", "response", "metadata"]
    with pytest.raises(ValueError):
        list(parse(gzip.decompress(data)[:-60]))


def test_missing_partners(spark):
    ours = "\r\n\r\n".join(records_of(7, "http://a.org/", "x", None, None)[1:2]) + "\r\n\r\n"
    (h, b), = parse(ours.encode())
    row = (h["warc-record-id"], h["warc-record-id"], "response", None, None, None, len(b), None, None)
    one = assemble(spark.createDataFrame([row], RECORDS)).collect()
    assert len(one) == 1 and one[0].metadata is None and one[0].request is None


def test_files_are_rolled_by_bytes(spark, tmp_path):
    rows = [(i, "u", chr(97 + i % 26) * (3 << 20 if i % 10 == 0 else 50)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    write_archive(df, f"file://{tmp_path}/w", part_bytes=1 << 20)
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*")]
    assert max(map(len, files)) < 14 << 20
    assert sum(h["warc-type"] in ("response", "revisit") for f in files for h, _ in parse(f)) == 60


def test_revisits_without_their_response(spark):
    made = "\r\n\r\n".join(records_of(3, None, "x", 7, None)) + "\r\n\r\n"
    rows = [(h["warc-record-id"], h.get("warc-concurrent-to", h["warc-record-id"]), h["warc-type"], None, None, h.get("warc-refers-to"), None, {"pageId": "3"} if h["warc-type"] == "metadata" else None, None) for h, _ in parse(made.encode())]
    (one,) = resolve(assemble(spark.createDataFrame(rows, RECORDS))).collect()
    assert one.revisited is None and one.metadata.page_id == 3 and one.response.refers_to
