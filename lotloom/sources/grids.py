"""Grids out of files: HTML tables and workbook sheets as (source, row_idx, cells).

Parsing a format is the one thing that needs Python; it runs in Arrow batches, a document at a time,
and everything after it is DataFrame functions.
"""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

#: Rows that make a table a list of its own.
LEAST_ROWS = 4
GRID = "source string, row_idx int, cells array<string>"

_BLANKS = re.compile(r"[\s ​]+")


class _Tables(HTMLParser):
    """Keeps a stack of open tables; a closed one is a list, part of its cell, or a wrapper."""

    def __init__(self, least: int):
        super().__init__(convert_charrefs=True)
        self.least, self.open, self.done, self.seen = least, [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.seen += 1
            self.open.append({"n": self.seen, "rows": [], "row": None, "cell": None, "big": False, "trs": 0, "inner": []})
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                self._end_row(t)
                t["row"], t["trs"] = [], t["trs"] + 1
            elif tag in ("td", "th"):
                self._end_cell(t)
                if t["row"] is None:
                    t["row"], t["trs"] = [], t["trs"] + 1
                t["cell"] = {"own": [], "all": []}

    def handle_data(self, data):
        if self.open and data.strip() and (cell := self.open[-1]["cell"]) is not None:
            cell["own"].append(data.strip())
            cell["all"].append(data.strip())

    def handle_endtag(self, tag):
        if not self.open:
            return
        t = self.open[-1]
        if tag in ("td", "th"):
            self._end_cell(t)
        elif tag == "tr":
            self._end_row(t)
        elif tag == "table":
            self._end_table()

    def _end_cell(self, t):
        if t["cell"] is not None:
            t["row"].append(t["cell"])
            t["cell"] = None

    def _end_row(self, t):
        self._end_cell(t)
        row, inner = t["row"], t["inner"]
        if row is not None:
            if inner and not any(c["own"] for c in row):
                t["rows"] += [r for rows in inner for r in rows]  # a row that only wraps small tables
            else:
                t["rows"].append([_BLANKS.sub(" ", " ".join(c["all"])).strip() for c in row])
        t["row"], t["inner"] = None, []

    def _end_table(self):
        t = self.open[-1]
        self._end_row(t)
        self.open.pop()
        rows = [r for r in t["rows"] if any(r)]
        if not t["big"] and len(rows) >= self.least:
            self.done.append((t["n"], rows))
        if self.open:
            above = self.open[-1]
            above["big"] |= t["big"] or t["trs"] >= self.least
            above["trs"] += t["trs"]
            if t["trs"] < self.least and not t["big"] and above["cell"] is not None:
                above["inner"].append(rows)
                above["cell"]["all"] += [x for r in rows for x in r if x]

    def close(self):
        super().close()
        while self.open:
            self._end_table()


def html_tables(html: str | None, least: int = LEAST_ROWS) -> list[tuple[str, list[list[str]]]]:
    """("table n", rows) of every table with ``least`` rows that holds no other such table."""
    parser = _Tables(least)
    parser.feed(html or "")
    parser.close()
    return [(f"table {n}", rows) for n, rows in sorted(parser.done)]


def _stringified(text: str | None, kind: str | None = None) -> str:
    """A cell as text: whole numbers without a fraction, booleans as True and False, errors empty."""
    value = (text or "").strip()
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "e":
        return ""
    if kind in (None, "n") and re.fullmatch(r"-?\d+(?:\.\d+)?[eE][+-]?\d+", value):
        value = repr(float(value))
    return value[:-2] if re.fullmatch(r"-?\d+\.0", value) else value


def _sheet_files(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) of the sheets in the order of the workbook, by its relationships."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    files = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            files[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")
    return [(s.get("name"), files.get(s.get(link), f"xl/worksheets/sheet{k}.xml")) for k, s in enumerate(sheets, 1)]


def xlsx_sheets(data: bytes | None, name: str = "") -> list[tuple[str, list[list[str]]]]:
    """("file!sheet", rows) of a workbook; an unreadable one has none. Blank rows are left out."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
            out = []
            for sheet, file in _sheet_files(z):
                if file not in z.namelist():
                    continue
                rows = []
                for row in ElementTree.fromstring(z.read(file)).iter(f"{space}row"):
                    cells: list[str] = []
                    for c in row.iter(f"{space}c"):
                        letters = re.match("[A-Z]*", c.get("r", ""))[0]
                        at = len(cells)
                        if letters:
                            at = 0
                            for letter in letters:
                                at = at * 26 + ord(letter) - 64
                            at -= 1
                        cells += [""] * (at + 1 - len(cells))
                        value, kind = c.find(f"{space}v"), c.get("t")
                        raw = "" if value is None else value.text or ""
                        if kind == "s":
                            cells[at] = shared[int(raw)] if raw else ""
                        elif kind == "inlineStr":
                            cells[at] = "".join(t.text or "" for t in c.iter(f"{space}t"))
                        else:
                            cells[at] = "" if value is None else _stringified(raw, kind)
                    if any(x.strip() for x in cells):
                        rows.append(cells)
                out.append((f"{name}!{sheet}", rows))
            return out
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
        return []


def _grids(df: DataFrame, key: str, column: str, reader) -> DataFrame:
    ship(df.sparkSession)
    kind = df.schema[key].dataType

    def read(batches):
        for batch in batches:
            out: dict[str, list] = {key: [], "source": [], "row_idx": [], "cells": []}
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for source, rows in reader(value):
                    out[key] += [k] * len(rows)
                    out["source"] += [source] * len(rows)
                    out["row_idx"] += range(len(rows))
                    out["cells"] += rows
            yield pa.RecordBatch.from_arrays([pa.array(out[key], batch.schema.field(0).type), pa.array(out["source"], pa.string()), pa.array(out["row_idx"], pa.int32()), pa.array(out["cells"], pa.list_(pa.string()))], list(out))

    return df.select(key, column).mapInArrow(read, f"`{key}` {kind.simpleString()}, {GRID}")


def html_grids(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of all lists in an HTML column, long: key, source, row_idx, cells."""
    return _grids(df, key, column, html_tables)


def xlsx_grids(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of all sheets in a binary column of workbooks."""
    return _grids(df, key, column, xlsx_sheets)


def attachments(df: DataFrame, key: str, most: int = 25 << 20) -> DataFrame:
    """Workbooks sent as base64 (filename, content_base64): decoded; bad, large or other files are left out."""
    data = F.try_to_binary(F.col("content_base64"), F.lit("base64"))
    rows = df.where(F.lower("filename").rlike(r"\.xls[xm]$")).withColumn("__data", data)
    return xlsx_grids(rows.where(F.col("__data").isNotNull() & (F.length("__data") <= most)), key, "__data")
