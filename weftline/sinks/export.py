"""Exports in four formats, with a manifest.

``jsonl`` and ``csv`` are written by all tasks at once as part files. ``json`` (one list) and ``xlsx`` (one sheet) are
single files by their nature: rows stream through the driver one partition at a time, never as a whole.
"""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterator
from datetime import date, datetime
from itertools import chain
from pathlib import Path
from string import ascii_uppercase
from xml.sax.saxutils import XMLGenerator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

FORMATS = ("json", "jsonl", "csv", "xlsx")
#: Rows a sheet can hold.
SHEET_ROWS = 1_048_576

# Part names, namespaces and content types of the spreadsheet format.
WORKBOOK = "xl/workbook.xml"
SHEET = "xl/worksheets/sheet1.xml"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
CONTENT_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
TO_WORKBOOK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
TO_SHEET = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"
RELATIONS_TYPE = "application/vnd.openxmlformats-package.relationships+xml"
WORKBOOK_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
PARTS = {
    "[Content_Types].xml": ("Types", {"xmlns": CONTENT_TYPES}, [("Default", {"Extension": "rels", "ContentType": RELATIONS_TYPE}), ("Default", {"Extension": "xml", "ContentType": "application/xml"}), ("Override", {"PartName": "/" + WORKBOOK, "ContentType": WORKBOOK_TYPE}), ("Override", {"PartName": "/" + SHEET, "ContentType": SHEET_TYPE})]),
    "_rels/.rels": ("Relationships", {"xmlns": PACKAGE_RELATIONS}, [("Relationship", {"Id": "rId1", "Type": TO_WORKBOOK, "Target": WORKBOOK})]),
    "xl/_rels/workbook.xml.rels": ("Relationships", {"xmlns": PACKAGE_RELATIONS}, [("Relationship", {"Id": "rId1", "Type": TO_SHEET, "Target": "worksheets/sheet1.xml"})]),
}


def pick_format(fmt: str | None, path: str, enabled: tuple[str, ...] = FORMATS) -> str:
    """The format asked for, else the one of the suffix, else jsonl."""
    chosen = (fmt or Path(path).suffix.lstrip(".") or "jsonl").lower()
    if chosen not in FORMATS or chosen not in enabled:
        raise ValueError(f"format {chosen} is not enabled")
    return chosen


def column_name(index: int) -> str:
    """Letters of a sheet column, 0 is A. Names of one length are the numbers of as many base 26 digits, after all
    shorter names."""
    width, shorter = 1, 0
    while index - shorter >= 26**width:
        shorter += 26**width
        width += 1
    return "".join(ascii_uppercase[(index - shorter) // 26**place % 26] for place in reversed(range(width)))


def _plain(value: object) -> object:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value.isoformat() if isinstance(value, (date, datetime)) else value


def _cell(value: object) -> str:
    if value is None:
        return ""
    value = _plain(value)
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True) if isinstance(value, (dict, list)) else str(value)


def write(df: DataFrame, path: str, fmt: str | None = None) -> str:
    """Write a frame; gives the format. Keys of JSON are sorted; CSV and sheets keep the order of columns."""
    fmt = pick_format(fmt, path)
    if fmt == "jsonl":
        df.select(*sorted(df.columns)).write.mode("overwrite").json(path, ignoreNullFields=False)
    elif fmt == "csv":
        flat = df.select(*[F.to_json(c).alias(c) if "<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes])
        flat.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", escape='"')
    elif fmt == "json":
        _single(path, lambda f: _write_json(df, f))
    else:
        _write_xlsx(df, path)
    return fmt


def _single(path: str, body) -> None:
    """A whole file or none: written beside its place, then moved there."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        body(f)
    os.replace(part, path)


def _write_json(df: DataFrame, f) -> None:
    f.write("[")
    for n, row in enumerate(df.toLocalIterator()):
        f.write((",\n" if n else "\n") + json.dumps(_plain(row), ensure_ascii=False, sort_keys=True, indent=2))
    f.write("\n]")


def excel_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a byte order mark, as spreadsheet programs expect it."""
    import csv

    def body(f) -> None:
        f.write("﻿")
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow([_cell(v) for v in row])

    _single(path, body)


def _xml(out, root: str, attributes: dict[str, str], children: list[tuple[str, dict[str, str]]]) -> None:
    """A small document of a root and empty children."""
    x = XMLGenerator(out, "UTF-8", short_empty_elements=True)
    x.startDocument()
    x.startElement(root, attributes)
    for name, values in children:
        x.startElement(name, values)
        x.endElement(name)
    x.endElement(root)
    x.endDocument()


def _sheet(out, rows: Iterator[list]) -> None:
    """Rows as inline strings; cells stand in order, so they need no references."""
    x = XMLGenerator(out, "UTF-8")
    x.startDocument()
    x.startElement("worksheet", {"xmlns": MAIN})
    x.startElement("sheetData", {})
    for n, row in enumerate(rows, 1):
        if n > SHEET_ROWS:
            raise ValueError("a sheet cannot hold that many rows; export jsonl or csv")
        x.startElement("row", {})
        for value in row:
            x.startElement("c", {"t": "inlineStr"})
            x.startElement("is", {})
            x.startElement("t", {"xml:space": "preserve"})
            x.characters(_cell(value))
            for name in ("t", "is", "c"):
                x.endElement(name)
        x.endElement("row")
    x.endElement("sheetData")
    x.endElement("worksheet")
    x.endDocument()


def _write_xlsx(df: DataFrame, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(f"{path}.part", "w", zipfile.ZIP_DEFLATED) as book:
        for name, (root, attributes, children) in PARTS.items():
            with book.open(name, "w") as part:
                _xml(part, root, attributes, children)
        with book.open(WORKBOOK, "w") as part:
            x = XMLGenerator(part, "UTF-8", short_empty_elements=True)
            x.startDocument()
            for name, values in (("workbook", {"xmlns": MAIN, "xmlns:r": RELATIONS}), ("sheets", {}), ("sheet", {"name": "results", "sheetId": "1", "r:id": "rId1"})):
                x.startElement(name, values)
            for name in ("sheet", "sheets", "workbook"):
                x.endElement(name)
        with book.open(SHEET, "w") as part:
            _sheet(part, chain([df.columns], map(list, df.toLocalIterator())))
    os.replace(f"{path}.part", path)


def export(df: DataFrame, path: str, fmt: str | None = None, source: dict | None = None) -> dict:
    """Write and describe: format, path, columns, number of rows, what it was made from."""
    fmt = write(df, path, fmt)
    return {"format": fmt, "path": path, "columns": df.columns, "rows_count": df.count(), "source": source or {}}


def append_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    """Add a manifest to the list of exports."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").write.mode("append").text(path)
