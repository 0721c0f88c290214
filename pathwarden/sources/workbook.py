"""Sheets of workbooks (zipped XML) as rows, and the scan of the academies' registers.

Files are dealt to tasks; within one, a sheet's rows are read as a stream and only the shared strings are kept.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwarden.functions.roads import extract_district

# What the registers call their columns.
NAME_HEADERS = ("학원명", "교습소명")
ADDRESS_PART = "주소"
_BATCH = 4096


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _elements(z: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    """The elements called ``wanted``, one after another; those before it are dropped."""
    with z.open(name) as f:
        events = ElementTree.iterparse(f, ("start", "end"))
        _, root = next(events)
        for event, e in events:
            if event == "end" and _local(e.tag) == wanted:
                yield e
                root.clear()


def _text(e: ElementTree.Element) -> str:
    """The text of runs; phonetic hints aren't part of it."""
    out = []
    for c in e:
        if _local(c.tag) == "t":
            out.append(c.text or "")
        elif _local(c.tag) == "r":
            out.append(_text(c))
    return "".join(out)


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(name, member) of the sheets in their order."""
    kept = "xl/_rels/workbook.xml.rels"
    targets = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in ElementTree.fromstring(z.read(kept))}
    for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
        if _local(e.tag) == "sheet":
            member = targets[next(v for k, v in e.attrib.items() if _local(k) == "id")]
            if member.startswith("xl/worksheets/"):
                yield e.get("name"), member


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref.upper()).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def rows_of(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells as text) of the rows that a workbook stores; missing cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_text(e) for e in _elements(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        for name, member in _sheets(z):
            number = 0
            for row in _elements(z, member, "row"):
                number = int(row.get("r") or number + 1)
                cells: list[str | None] = []
                for c in row:
                    at = _column(c.get("r") or "")
                    at = len(cells) if at < 0 else at
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = c.get("t"), next((v.text for v in c if _local(v.tag) == "v"), None)
                    if kind == "inlineStr":
                        cells[at] = "".join(_text(v) for v in c if _local(v.tag) == "is")
                    elif value is not None:
                        cells[at] = shared[int(value)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else None if kind == "e" else value
                yield name, number, cells


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells array<string>) of all sheets of the workbooks at ``path`` (a file, folder or pattern)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "sheet", "row", "cells"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for sheet, number, cells in rows_of(content.as_py()):
                    rows.append((file, sheet, number, cells))
                    if len(rows) == _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, sheet string, row long, cells array<string>")


def places(cells: DataFrame) -> DataFrame:
    """(file, sheet, row, name, address) of each sheet of :func:`read_workbooks` that has both columns; the first row is the header."""
    at = lambda test: F.array_min(F.filter(F.transform("cells", lambda c, i: F.when(test(c), i)), lambda i: i.isNotNull()))
    first = cells.groupBy("file", "sheet").agg(F.min_by("cells", "row").alias("cells"), F.min("row").alias("head"))
    heads = first.select("file", "sheet", "head", at(lambda c: c.contains(ADDRESS_PART)).alias("address_at"), at(lambda c: c.isin(*NAME_HEADERS)).alias("name_at"))
    usable = heads.where("address_at is not null and name_at is not null")
    rows = cells.join(usable, ["file", "sheet"]).where(F.col("row") > F.col("head"))
    return rows.select("file", "sheet", "row", F.get("cells", F.col("name_at").cast("int")).alias("name"), F.get("cells", F.col("address_at").cast("int")).alias("address"))


def academy_counts(cells: DataFrame) -> DataFrame:
    """(district, count) of different (name, address) :func:`places`, counted in each sheet.

    A place without name or address, or whose address names no district, doesn't count.
    """
    unique = places(cells).drop("row").where("name is not null and address is not null").distinct()
    return unique.select(extract_district(F.col("address")).alias("district")).where("district is not null").groupBy("district").agg(F.count(F.lit(1)).alias("count"))
