"""Sheets of workbooks (XLSX) as tables of strings: each file is one task's, its lines are read as a stream."""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Iterable, Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "file string, line long, cells array<string>"
_TYPES = pa.schema([("file", pa.string()), ("line", pa.int64()), ("cells", pa.list_(pa.string()))])
#: Lines of a batch.
BATCH = 2_000


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(element) -> str:
    """The text of a string, without phonetic readings."""
    runs = [e for e in element if _local(e.tag) in ("t", "r")]
    return "".join(t.text or "" for e in runs for t in ([e] if _local(e.tag) == "t" else e) if _local(t.tag) == "t")


def _column(reference: str) -> int:
    n = 0
    for letter in reference:
        if letter.isdigit():
            break
        n = n * 26 + ord(letter.upper()) - 64
    return n - 1


def _part(book: zipfile.ZipFile, sheet: str | None) -> str | None:
    """The part that holds the sheet (the first without a name); None if the book has no such sheet."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _local(e.tag) == "sheet" and sheet in (None, e.get("name")):
            key = next(v for k, v in e.attrib.items() if k.startswith("{") and _local(k) == "id")
            return posixpath.normpath(posixpath.join("/xl", targets[key])).lstrip("/")
    return None


def _value(cell, shared: list[str]) -> str | None:
    parts = {_local(e.tag): e for e in cell}
    if cell.get("t") == "inlineStr":
        return _texts(parts["is"]) if "is" in parts else None
    v = parts["v"].text if "v" in parts else None
    return shared[int(v)] if v is not None and cell.get("t") == "s" else v


def _lines(content: bytes, sheet: str | None) -> Iterator[tuple[int, list[str | None]]]:
    with zipfile.ZipFile(BytesIO(content)) as book:
        part = _part(book, sheet)
        if part is None:
            return
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_texts(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        line = -1
        for _, e in ElementTree.iterparse(book.open(part)):
            if _local(e.tag) != "row":
                continue
            line = int(e.get("r", line + 2)) - 1
            found = {}
            for cell in e:
                i = _column(cell.get("r")) if cell.get("r") else max(found, default=-1) + 1
                found[i] = _value(cell, shared)
            yield line, [found.get(i) for i in range(max(found, default=-1) + 1)]
            e.clear()


def lines(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(file, line, cells) of a sheet in each workbook of the path; line counts from 0, as do columns.

    Without a name the first sheet is read. Cells are strings as stored (dates as day numbers), null where empty;
    a workbook without the sheet gives nothing, a file that is no workbook is an error.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                held = []
                for line, found in _lines(content.as_py(), sheet):
                    held.append({"file": file, "line": line, "cells": found})
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema=_TYPES)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=_TYPES)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, LINES)


def sheet(spark: SparkSession, path: str, name: str | None = None, header_row: int = 0) -> DataFrame:
    """The sheet as a table: names from line header_row of the first file, rows below it that hold any value.

    Columns without a name are called by their number; of equal names the later ones get their number behind.
    """
    found = lines(spark, path, name)
    top = found.filter(F.col("line") == header_row).orderBy("file").select("cells").first()
    names: list[str] = []
    for i, v in enumerate(top["cells"] if top else []):
        v = (v or "").strip() or f"column_{i}"
        names.append(f"{v}_{i}" if v in names else v)
    value = lambda i: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    body = found.filter((F.col("line") > header_row) & F.exists("cells", lambda c: F.trim(c) != ""))
    return body.select(*[value(i).alias(n) for i, n in enumerate(names)])
