"""TEI-XML files as passages: one row per identified paragraph or verse group."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_cjk, normalize

XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
SKIPPED = frozenset("note anchor lb pb milestone graphic figure space".split())
SCHEMA = "source_rel_path string, source_work_id string, main_title string, author string, source_url string, rights_notes string, xml_id string, div_path string, heading string, from_lb string, to_lb string, zh_text_raw string, is_verse boolean, contains_person boolean, contains_term boolean, contains_foreign boolean, passage_ord_in_file int"
_FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _text(el: ET.Element, out: list[str], marks: set[str]) -> None:
    """Text of an element without skipped children; their tails stay."""
    if el.text:
        out.append(el.text)
    for child in el:
        name = _local(child.tag)
        if name not in SKIPPED and name:
            marks.add(name)
            _text(child, out, marks)
        if child.tail:
            out.append(child.tail)


def header(root: ET.Element) -> dict[str, str]:
    """Title, author, first URL of the source description, availability."""
    first = lambda name: next((" ".join("".join(e.itertext()).split()) for e in root.iter() if _local(e.tag) == name), "")
    source = next((e for e in root.iter() if _local(e.tag) == "sourceDesc"), None)
    shown = " ".join([*source.itertext(), *(v for e in source.iter() for v in e.attrib.values())]) if source is not None else ""
    url = re.search(r"https?://[^\s<\"']+", shown)
    return {"main_title": first("title"), "author": first("author"), "source_url": url[0] if url else "", "rights_notes": first("availability")}


def work_of(path: str) -> str:
    stem = path.rpartition("/")[2].rpartition(".")[0] or path.rpartition("/")[2]
    return re.sub(r"_\d+$", "", stem)


def parse(content: bytes, path: str) -> Iterator[tuple]:
    """Rows of one file; a file that is no XML gives none."""
    try:
        root = ET.parse(io.BytesIO(content)).getroot()
    except ET.ParseError:
        return
    head, work, order = header(root), work_of(path), 0
    body = next((e for e in root.iter() if _local(e.tag) == "body"), None)
    divs: list[str] = []
    state = {"lb": None, "heading": ""}

    def last_lb(el: ET.Element) -> str | None:
        found = None
        for e in el.iter():
            if _local(e.tag) == "lb" and e.get("n"):
                found = e.get("n")
        return found

    stack = [(body, False)] if body is not None else []
    while stack:
        el, leaving = stack.pop()
        name = _local(el.tag)
        if leaving:
            divs.pop()
            continue
        if name == "div":
            divs.append(el.get("n") or el.get("type") or el.get(XML_ID) or "div")
            stack.append((el, True))
        elif name in ("head", "mulu"):
            state["heading"] = " ".join("".join(el.itertext()).split()) or state["heading"]
        elif name == "lb" and el.get("n"):
            state["lb"] = el.get("n")
        elif name in ("p", "lg") and el.get(XML_ID):
            out: list[str] = []
            marks: set[str] = set()
            _text(el, out, marks)
            start, end = state["lb"], last_lb(el)
            state["lb"] = end or start
            text = " ".join("".join(out).split())
            if text:
                yield (path, work, head["main_title"], head["author"], head["source_url"], head["rights_notes"], el.get(XML_ID), " / ".join(divs), state["heading"], start, state["lb"], text, name == "lg", "persName" in marks, "term" in marks, "foreign" in marks, order)
                order += 1
            continue
        stack += [(c, False) for c in reversed(list(el))]


def _files(batches):
    types = [pa.string()] * 12 + [pa.bool_()] * 4 + [pa.int32()]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = list(parse(content.as_py(), path))
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5000]), types)], _FIELDS)


def text_type(verse: Column, text: Column) -> Column:
    spoken = F.contains(text, F.lit("問")) & (F.contains(text, F.lit("答")) | F.contains(text, F.lit("云")) | F.contains(text, F.lit("曰")))
    return F.when(verse, "verse").when(spoken, "dialogue").otherwise("prose")


def read(spark: SparkSession, folder: str, glob: str = "*.xml", ideographs_only: bool = True) -> DataFrame:
    """Passages of all files below a folder; rows without text, or without ideographs if asked, are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    rows = files.select("path", "content").mapInArrow(_files, SCHEMA)
    rows = rows.where(contains_cjk(F.col("zh_text_raw"))) if ideographs_only else rows
    return rows.withColumn("passage_id", F.concat_ws("#", "source_work_id", "xml_id")).withColumn("zh_text_normalized", normalize(F.col("zh_text_raw"))).withColumn("text_type", text_type(F.col("is_verse"), F.col("zh_text_raw"))).drop("is_verse")
