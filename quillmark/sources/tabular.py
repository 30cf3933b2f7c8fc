"""Uploaded tables, CSV and XLSX: many files at once, each decoded and cut into rows by one task.

A file's rows are (path, row, cells, error): row numbers from 2 in each file, the header being row 1; cells by header
name, blanks as '', cells that a short row lacks as null. What is wrong with a file as a whole is one row of it with an
error and nothing else. Empty lines of CSV files don't count as rows; blank rows between those of a sheet do.
"""

from __future__ import annotations

import csv
import io
import re
import sys
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, row int, cells map<string,string>, error string"
# What is said of a file without a header or some of its columns.
NO_HEADER, MISSING = "File has no header row.", "Missing required column(s): "

_CELL = re.compile(r"([A-Z]+)(\d+)")


def csv_records(data: bytes) -> Iterator[list[str]]:
    """Records of a CSV file in UTF-8, with or without a byte order mark, else in Latin-1."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    csv.field_size_limit(sys.maxsize)
    return (r for r in csv.reader(io.StringIO(text, newline="")) if r)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node) -> str:
    """The text of a shared or inline string: its runs, without what is written above them."""
    if _local(node.tag) == "t":
        return node.text or ""
    return "".join(_texts(c) for c in node if _local(c.tag) not in ("rPh", "phoneticPr", "rPr"))


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _number(text: str) -> str:
    """A number as a sheet shows it: whole ones without a point, others with up to eleven digits."""
    x = float(text)
    return str(int(x)) if x == int(x) and abs(x) < 1e11 else f"{x:.11g}"


def xlsx_records(data: bytes) -> Iterator[list[str]]:
    """Records of an XLSX file's first sheet, from its first used cell to its last, rows in between included."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        first = next(s for s in book.iter() if _local(s.tag) == "sheet")
        key = next(v for k, v in first.attrib.items() if _local(k) == "id")
        target = next(r.attrib["Target"] for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.attrib["Id"] == key)
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared = [_texts(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        rows: dict[int, dict[int, str]] = {}
        at_row = at = 0
        with z.open(part) as f:
            for event, node in ElementTree.iterparse(f, ("start", "end")):
                tag = _local(node.tag)
                if event == "start":
                    if tag == "row":
                        at_row, at = int(node.attrib.get("r", at_row + 1)), 0
                    continue
                if tag == "row":
                    node.clear()
                if tag != "c":
                    continue
                if m := _CELL.fullmatch(node.attrib.get("r", "")):
                    at_row, at = int(m[2]), _column(m[1])
                kind, inner = node.attrib.get("t", "n"), {_local(c.tag): c for c in node}
                value = inner["v"].text or "" if "v" in inner else ""
                if kind == "inlineStr":
                    value = _texts(inner["is"]) if "is" in inner else ""
                elif kind == "s" and value:
                    value = shared[int(value)]
                elif kind == "b" and value:
                    value = "TRUE" if value == "1" else "FALSE"
                elif kind == "n" and value:
                    value = _number(value)
                if value:
                    rows.setdefault(at_row, {})[at] = value
                at += 1
    if not rows:
        return
    left, right = min(min(r) for r in rows.values()), max(max(r) for r in rows.values())
    for i in range(min(rows), max(rows) + 1):
        own = rows.get(i, {})
        yield [own.get(c, "") for c in range(left, right + 1)]


def as_rows(records: Iterable[list[str]], required: tuple[str, ...] = (), normalise: bool = True) -> Iterator[tuple[int | None, dict | None, str | None]]:
    """(row, cells, error) of a file's records. Headers are stripped and lower-cased unless they are to be kept, those
    without a name left out; of equal ones the last counts."""
    records = iter(records)
    header = next(records, None)
    if not header:
        yield None, None, NO_HEADER
        return
    place = {h.strip().lower() if normalise else h: i for i, h in enumerate(header) if h}
    lack = [c for c in required if c not in place]
    if lack:
        yield None, None, MISSING + ", ".join(lack)
        return
    for n, record in enumerate(records, 2):
        yield n, {k: record[i] if i < len(record) else None for k, i in place.items()}, None


def _file_rows(path: str, data: bytes, required: tuple[str, ...], normalise: bool) -> Iterator[tuple]:
    try:
        records = xlsx_records(data) if data[:4] == b"PK\x03\x04" else csv_records(data)
        yield from ((path, *r) for r in as_rows(records, required, normalise))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, csv.Error, ValueError, IndexError) as e:
        yield path, None, None, f"File can't be read: {type(e).__name__}"


def table_rows(spark: SparkSession, path: str, required: tuple[str, ...] = (), normalise: bool = True) -> DataFrame:
    """Rows of all CSV and XLSX files of a path, read by Spark from any store, a file at a time. Spark leaves out files
    without a single byte."""
    required = tuple(required)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                held: list[tuple] = []
                for r in _file_rows(name, content.as_py(), required, normalise):
                    held.append(r)
                    if len(held) == 10_000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, row, cells, error = zip(*rows, strict=True)
    cells = pa.array([None if c is None else list(c.items()) for c in cells], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(row, pa.int32()), cells, pa.array(error, pa.string())], ["path", "row", "cells", "error"])


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.required = options["path"], tuple(c for c in options.get("required", "").split(",") if c)

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = self._store()
        found = store.get_file_info(path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if found.type == fs.FileType.Directory else [found]
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.lower().endswith((".xlsx", ".csv"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = self._store()
        with store.open_input_stream(partition.path) as f:
            yield from _file_rows(partition.path, f.read(), self.required, True)


class SheetSource(DataSource):
    """`spark.read.format("sheets").load(path)`: a partition for each CSV or XLSX file; option `required`, column names
    parted by commas. Stores are those that Arrow opens; table_rows() reads from all that Spark does."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
