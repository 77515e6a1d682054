"""WARC archives of pages and their assembly into capture transactions.

Writing: each page is a request, a response or revisit, and a metadata record
tied together by concurrent-to identifiers, written by Spark's text writer with
the blank lines that end a WARC record as separator. Of pages with equal
payloads the one with the largest id is the response, the others revisit it.
Reading: files are parsed by content length, records are joined into one nested
row per capture through the identifiers, and a revisit is joined with the
response that its WARC-Refers-To names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
PART_BYTES = 8 << 20  # records are written in parts of this size, or of one capture if that is larger
FILE_PARTS = 4  # parts in a file
BROADCAST_ROWS = 500_000
RECORDS = "record_id string, capture string, kind string, target_uri string, digest string, refers_to string, length long, fields map<string,string>, payload binary"


def _name(kind: str, page, digest: str, url: str | None) -> str:
    text = f"{kind}\n{page}\n{digest}\n{url}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(text.encode('utf-8', 'surrogatepass')).digest())}>"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(kind: str, name: str, head: list[tuple[str, str]], block: str, mime: str) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in head)]
    return "\r\n".join([*lines, f"Content-Type: {mime}", f"Content-Length: {len(block.encode('utf-8', 'surrogatepass'))}"]) + END + block


def records_of(page, url: str | None, html: str, first, first_url: str | None) -> list[str]:
    """The three records of a page; ``first`` is the page it revisits, if any."""
    payload = html.encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = _name("response", page, digest, url)
    target = [("WARC-Target-URI", _clean(url))] if url else []
    tied = [("WARC-Concurrent-To", name), *target]
    path = re.sub(r"^[^:/?#]*://[^/?#]*", "", _clean(url or "")).partition("#")[0] or "/"
    host = re.search(r"://([^/?#]*)", _clean(url or ""))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}"
    about = f"pageId: {'' if page is None else page}"
    head = [*target, ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is None:
        main = _record("response", name, head, http + html, "application/http;msgtype=response")
    else:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name("response", first, digest, first_url))]
        main = _record("revisit", name, head, http, "application/http;msgtype=response")
    return [
        _record("request", _name("request", page, digest, url), tied, f"GET {path} HTTP/1.1\r\nHost: {host[1] if host else ''}{END}", "application/http;msgtype=request"),
        main,
        _record("metadata", _name("metadata", page, digest, url), tied, about, "application/warc-fields"),
    ]


def _to_records(part_bytes: int):
    """Rows of several records with what separates them, so that a file's size hangs on bytes and not on a count of records."""

    def run(batches):
        part, held = [], 0
        for batch in batches:
            for page, url, html, first, first_url in zip(*(c for c in batch.columns)):
                made = records_of(page.as_py(), url.as_py(), html.as_py(), first.as_py(), first_url.as_py())
                size = sum(map(len, made))
                if part and held + size > part_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(part)])], ["value"])
                    part, held = [], 0
                part += made
                held += size
        if part:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(part)])], ["value"])

    return run


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", part_bytes: int = PART_BYTES) -> None:
    """Write the pages as gzipped WARC files below ``path``.

    Null payloads are empty; empty payloads are equal ones like any other. A
    null url leaves out the target. Repeated rows are written each, extra
    columns are ignored, ties of ids among equal payloads are all responses.
    An empty table writes no records.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    pages = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("body"))
    pages = pages.withColumn("sha", F.sha1("body"))
    facts = ws.write(pages.select("page", "url", "sha"), "facts")
    groups = facts.groupBy("sha").agg(F.max(F.struct("page", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = ws.write(groups.select("sha", F.col("first.page").alias("first"), F.col("first.url").alias("first_url")), "groups")
    side = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    again = F.col("page") < F.col("first")
    rows = pages.join(side, "sha", "left").select("page", "url", "body", F.when(again, F.col("first")).alias("first"), F.when(again, F.col("first_url")).alias("first_url"))
    rows.mapInArrow(_to_records(part_bytes), "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_PARTS).text(path)
    ws.drop(facts, groups)


def parse(data: bytes):
    """Yield (headers, block) of each record in an archive file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        whole, rest = [], data
        while rest:
            z = zlib.decompressobj(31)
            whole.append(z.decompress(rest))
            rest = z.unused_data
        data = b"".join(whole)
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield head, block
        at = stop + 4 + size + 4


def _from_files(with_payload: bool):
    schema = pa.schema([("record_id", pa.string()), ("capture", pa.string()), ("kind", pa.string()), ("target_uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("length", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse(content.as_py()):
                    kind, name = head["warc-type"], head["warc-record-id"]
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    fields, payload = None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload digest of {name} does not fit")
                    elif kind == "metadata":
                        fields = [(k, v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8").split("\r\n"))]
                    rows.append((name, head.get("warc-concurrent-to", name), kind, head.get("warc-target-uri"), digest, head.get("warc-refers-to"), None if payload is None else len(payload), fields, payload if with_payload else None))
                    if len(rows) >= 3000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per WARC record below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_from_files(with_payload), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response or revisit, metadata.

    Records that miss their partners leave null fields. Captures written more
    than once give one row per writing.
    """

    def pick(kinds: list[str], *cols: str):
        return F.max(F.when(F.col("kind").isin(kinds), F.struct(*cols)))

    flat = records.withColumn("page_id", F.expr("try_cast(fields['pageId'] as bigint)"))
    rows = flat.groupBy("capture").agg(
        pick(["request"], "record_id", "target_uri").alias("request"),
        pick(["response", "revisit"], "kind", "record_id", "target_uri", "digest", "refers_to", "length", "payload").alias("response"),
        pick(["metadata"], "record_id", "page_id").alias("metadata"),
        F.greatest(F.count_if(F.col("kind").isin("response", "revisit")), F.lit(1)).alias("n"),
    )
    return rows.select("capture", "request", "response", "metadata", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("writing")).drop("writing")


def resolve(rows: DataFrame) -> DataFrame:
    """Captures with the response that a revisit refers to: column ``revisited`` (page_id, length), null for responses and where it is missing.

    A payload that very many captures revisit is one row of the small side; beyond the broadcast's bound the join's
    skewed partitions are split by Spark.
    """
    targets = rows.where("response.kind = 'response'").select(F.col("response.record_id").alias("_id"), F.struct(F.col("metadata.page_id").alias("page_id"), F.col("response.length").alias("length")).alias("revisited"))
    named = rows.where("response.kind = 'revisit'").select(F.col("response.refers_to").alias("_id")).distinct()
    found = Workspace(rows.sparkSession, "revisited").write(targets.join(named, "_id", "left_semi").groupBy("_id").agg(F.max("revisited").alias("revisited")), "targets")
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    refers = F.when(F.col("response.kind") == "revisit", F.col("response.refers_to"))
    return rows.withColumn("_id", refers).join(side, "_id", "left").drop("_id")


def captures(pages: DataFrame, path: str | None = None, with_payload: bool = False) -> DataFrame:
    """Write ``pages`` as an archive (below the shared folder unless given) and read its captures back, revisits resolved.

    Null and blank payloads are captures like any other; a repeated row is a capture of its own.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "archive")
    path = path or ws.path("warc")
    write_archive(pages, path)
    return resolve(ws.write(assemble(read_records(spark, path, with_payload)), "captures"))
