"""Reference sources: dictionaries, authority files, work catalogues, parallel works, merges and patches."""

from __future__ import annotations

import io
import json
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_fascicle, text_or_empty, truncated

DICT = "term string, source string, sanskrit string, gloss string"
GLOSS = 1000


# ------------------------------------------------------------ dictionaries


def entries(content: bytes, source: str):
    """(term, source, sanskrit, gloss) of one JSON dictionary in any of its four shapes."""
    try:
        got = json.loads(content)
    except ValueError:  # a broken file tells so as a row that readers can find and that no term has
        yield None, source, None, "unreadable"
        return
    if isinstance(got, list):
        for e in got:
            yield e.get("t"), source, e.get("s"), e.get("g")
        return
    for term, value in got.items():
        if isinstance(value, list):
            for e in value:
                yield term, source, None, e.get("def") if isinstance(e, dict) else str(e)
        elif isinstance(value, dict):
            gloss = value.get("def") or value.get("content")
            yield term, source, value.get("san"), gloss or "; ".join(str(value[k]) for k in ("san", "mnc", "mon") if value.get(k))
        else:
            yield term, source, None, str(value)


def _dictionaries(batches):
    import gzip

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = content.as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            rows = list(entries(data, path.rpartition("/")[2].partition(".")[0]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["term", "source", "sanskrit", "gloss"])


def read_dictionaries(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of two characters or more with a gloss, cut at a thousand characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").load(folder)
    rows = files.select("path", "content").mapInArrow(_dictionaries, DICT)
    return rows.where((F.length("term") >= 2) & (F.trim("gloss") != "")).withColumn("gloss", truncated(F.col("gloss"), GLOSS))


# --------------------------------------------------------------- authority

PERSONS = "person_id string, primary_name string, alt_names array<string>, gender string, dynasty string, birth_year int, death_year int, concise_bio string, teachers array<string>, students array<string>"
PLACES = "place_id string, primary_name string, alt_names array<string>, latitude double, longitude double, district string"


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _year(text: str | None) -> int | None:
    import re

    m = re.search(r"-?\d{1,4}", text or "")
    return int(m[0]) if m else None


def persons_in(content: bytes):
    for _, el in ET.iterparse(io.BytesIO(content)):
        if _local(el.tag) != "person":
            continue
        ident = next((v for k, v in el.attrib.items() if _local(k) == "id"), None)
        names = [" ".join("".join(n.itertext()).split()) for n in el if _local(n.tag) == "persName"]
        kids = {_local(c.tag): c for c in el}
        word = lambda k: " ".join("".join(kids[k].itertext()).split()) or None if k in kids else None
        year = lambda k: _year(kids[k].get("when") or kids[k].get("notBefore") or word(k)) if k in kids else None
        related = lambda kind: [r.get("active") or r.get("passive") or "" for r in el.iter() if _local(r.tag) == "relation" and r.get("name") == kind]
        if ident and names:
            yield ident, names[0], [n for n in dict.fromkeys(names[1:]) if n], (kids["sex"].get("value") or word("sex")) if "sex" in kids else None, word("floruit"), year("birth"), year("death"), word("note"), related("teacher"), related("student")
        el.clear()


def _point(parts: list[str]) -> tuple[float | None, float | None]:
    """Latitude and longitude; nulls where they are no two numbers."""
    try:
        return float(parts[0]), float(parts[1])
    except (IndexError, ValueError):
        return None, None


def places_in(content: bytes):
    for _, el in ET.iterparse(io.BytesIO(content)):
        if _local(el.tag) != "place":
            continue
        ident = next((v for k, v in el.attrib.items() if _local(k) == "id"), None)
        names = [" ".join("".join(n.itertext()).split()) for n in el if _local(n.tag) == "placeName"]
        geo = next(("".join(g.itertext()) for g in el.iter() if _local(g.tag) == "geo"), "")
        point = geo.replace(",", " ").split()
        district = next((" ".join("".join(d.itertext()).split()) for d in el.iter() if _local(d.tag) == "district"), None)
        if ident and names:
            yield ident, names[0], [n for n in dict.fromkeys(names[1:]) if n], *_point(point), district
        el.clear()


def _authority(parse, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = list(parse(content.as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _read_authority(spark: SparkSession, path: str, parse, ddl: str) -> DataFrame:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_authority(parse, schema), ddl)


def read_persons(spark: SparkSession, path: str) -> DataFrame:
    return _read_authority(spark, path, persons_in, PERSONS)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return _read_authority(spark, path, places_in, PLACES)


# ---------------------------------------------------------------- catalogs

# Order of the periods and the verbs that end a translator's name.
PERIOD_RANKS = {"Han": 1, "Three Kingdoms": 2, "Jin": 3, "Northern and Southern": 4, "Pre-Tang": 4, "Sui": 5, "Tang": 6, "Five Dynasties": 7, "Song": 8, "Yuan": 9, "Ming": 10, "Qing": 11}
VERBS = "譯撰述集編造著錄說注疏等共"


def period_rank(period: Column) -> Column:
    table = F.create_map(*(F.lit(x) for p in PERIOD_RANKS.items() for x in p))
    return F.coalesce(F.try_element_at(table, period), F.lit(99))


def strip_verbs(author: Column) -> Column:
    return F.regexp_replace(F.trim(author), f"[{VERBS}]+$", "")


def work_catalog(lines: DataFrame) -> DataFrame:
    """``id title (N卷)【dynasty translator】`` lines (column value) as rows; the first line of a work wins."""
    pattern = r"^\s*(\S+)\s+(.*?)\s*(?:\((\d+)卷\))?\s*(?:【(?:([^\s】]+)\s+)?([^】]*)】)?\s*$"
    part = lambda k: F.nullif(F.regexp_extract("value", pattern, k), F.lit(""))
    work = strip_fascicle(F.substring_index(part(1), "#", 1))
    rows = lines.withColumn("line", F.monotonically_increasing_id()).select("line", work.alias("work_id"), part(2).alias("title"), part(3).cast("int").alias("fascicles"), part(4).alias("dynasty"), strip_verbs(part(5)).alias("translator")).where("work_id is not null and title is not null")
    first = F.row_number().over(Window.partitionBy("work_id").orderBy("line"))
    return rows.withColumn("k", first).where("k = 1").drop("k", "line")


def parallel_works(lines: DataFrame) -> DataFrame:
    """``work: other other`` lines (column value) as directed edges."""
    work = strip_fascicle(F.trim(F.regexp_extract("value", r"^\s*([^\s:=,]+)", 1)))
    others = F.filter(F.split(F.regexp_replace("value", r"^\s*[^\s:=,]+[\s:=,]*", ""), r"[\s,;]+"), lambda s: s != "")
    rows = lines.select(work.alias("work_id"), F.explode(others).alias("other")).select("work_id", strip_fascicle(F.col("other")).alias("parallel_id"))
    return rows.where("work_id != '' and work_id != parallel_id").distinct()


def largest_source(files: DataFrame, priority: list[str]) -> DataFrame:
    """Files (work_id, source, path, bytes) of each work's source with most bytes; ties: later in ``priority``."""
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    sums = files.groupBy("work_id", "source").agg(F.sum("bytes").alias("total"))
    best = sums.groupBy("work_id").agg(F.max(F.struct("total", order.alias("o"), "source"))["source"].alias("source"))
    return files.join(best, ["work_id", "source"], "left_semi")


def patch(passages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Blank author, title and unknown period filled from the catalog (work_id, author, period, title)."""
    c = catalog.select(F.col("work_id").alias("source_work_id"), F.col("author").alias("_a"), F.col("period").alias("_p"), F.col("title").alias("_t"))
    rows = passages.join(c, "source_work_id", "left")
    fill = lambda now, new, also="": F.when((text_or_empty(now) == "") | (text_or_empty(now) == also), F.coalesce(new, now)).otherwise(F.col(now))
    return rows.withColumn("author", fill("author", "_a")).withColumn("period", fill("period", "_p", "Unknown Period")).withColumn("main_title", fill("main_title", "_t")).drop("_a", "_p", "_t")


# Keywords of the fallback classifiers, in order.
TRADITIONS = [("Chan/Zen", ["禪", "禅", "chan", "zen"]), ("Pure Land", ["淨土", "阿彌陀", "彌陀"]), ("Tiantai", ["天台", "法華"]), ("Huayan", ["華嚴"]), ("Vinaya", ["律", "戒"]), ("Madhyamaka", ["中論", "中觀"]), ("Yogacara", ["唯識", "瑜伽"]), ("Esoteric", ["陀羅尼", "真言", "密"])]
PERIODS = [("Tang", ["唐"]), ("Song", ["宋"]), ("Yuan", ["元"]), ("Ming", ["明"]), ("Qing", ["清"]), ("Sui", ["隋"]), ("Jin", ["晉"]), ("Han", ["漢"])]


def classify_traditions(c: Column) -> Column:
    """Every tradition one of whose keywords occurs, in order; none: Other."""
    found = F.array_compact(F.array(*(F.when(F.lower(c).rlike("|".join(ks)), F.lit(name)) for name, ks in TRADITIONS)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Other")))


def classify_period(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, ks in PERIODS:
        out = out.when(c.rlike("|".join(ks)), name)
    return out.otherwise("Unknown Period")
