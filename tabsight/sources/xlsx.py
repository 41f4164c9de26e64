"""Excel workbooks (.xlsx), read and written with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as E
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .layout import Layout, analyze_body, header_row, unique_labels

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates.
_DATES = {*range(14, 23), *range(45, 48)}


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    targets = {r.get("Id"): r.get("Target") for r in E.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = E.fromstring(z.read("xl/workbook.xml"))
    return [(s.get("name"), "xl/" + targets[s.get(_REL)].removeprefix("/xl/")) for s in book.iter(f"{_NS}sheet")]


def sheet_names(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [n for n, _ in _sheets(z)]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = E.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt") if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
    cells = root.find(f"{_NS}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in _DATES | own}


def rows(data: bytes, sheet: int | str = 0):
    """Each row of a sheet as a list of texts; blank cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheets = _sheets(z)
        if isinstance(sheet, str):
            found = [p for n, p in sheets if n == sheet]
            if not found:
                raise ValueError(f"no sheet {sheet}")
            path = found[0]
        elif not 0 <= sheet < len(sheets):
            raise ValueError(f"no sheet {sheet}: the workbook has {len(sheets)}")
        else:
            path = sheets[sheet][1]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in E.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        dates = _date_styles(z)
        expected = 1
        with z.open(path) as f:
            for _, row in E.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                at = int(row.get("r", expected))
                for _ in range(at - expected):
                    yield []
                expected = at + 1
                out: list[str | None] = []
                for c in row.iter(f"{_NS}c"):
                    letters = re.match(r"[A-Z]+", c.get("r", "")) if c.get("r") else None
                    column = 0
                    for x in letters[0] if letters else "":
                        column = column * 26 + ord(x) - 64
                    while letters and len(out) < column - 1:
                        out.append(None)
                    out.append(_value(c, shared, dates))
                yield out
                row.clear()


def _value(c: E.Element, shared: list[str], dates: set[int]) -> str | None:
    kind, v = c.get("t"), c.find(f"{_NS}v")
    if kind == "inlineStr":
        text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
    elif v is None or v.text is None:
        return None
    elif kind == "s":
        text = shared[int(v.text)]
    elif kind == "b":
        text = "true" if v.text == "1" else "false"
    elif kind in (None, "n") and int(c.get("s", 0)) in dates:
        moment = datetime(1899, 12, 30) + timedelta(days=float(v.text))
        text = moment.strftime("%Y-%m-%d" if not (moment.hour or moment.minute or moment.second) else "%Y-%m-%d %H:%M:%S")
    else:
        text = v.text
        if re.fullmatch(r"-?[0-9]+\.0", text):
            text = text[:-2]
    return text if text.strip() else None


def read_sheet(spark: SparkSession, path: str, sheet: int | str = 0, first_row: int | None = None, detect_layout: bool = True) -> tuple[DataFrame, Layout]:
    """A sheet as a table. The workbook is parsed on an executor, from any store Spark reads."""
    layout = Layout()

    def parse(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held, first = [], 0
                for r in rows(data, sheet):
                    held.append(r)
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string()))], ["_row", "cells"])
                        held, first = [], first + len(held)
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string()))], ["_row", "cells"])

    cells = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "_row long, cells array<string>")
    matrix = [list(r["cells"]) for r in cells.orderBy("_row").limit(40).collect()]
    at = first_row if first_row is not None else header_row(matrix, layout) if detect_layout else 0
    layout.header_row = at
    width = max((len(r) for r in matrix), default=1)
    labels = unique_labels((matrix[at] if matrix else []) + [None] * (width - len(matrix[at] if matrix else [])))
    df = cells.where(F.col("_row") > at).select("_row", *(F.get("cells", F.lit(i)).alias(x) for i, x in enumerate(labels)))
    names = sheet_names(store.content(spark, path, 512 << 20)) if detect_layout else []
    if len(names) > 1:
        layout.warnings.append(f"{len(names) - 1} other sheets not read")
    return (analyze_body(df, layout) if detect_layout else df.drop("_row")), layout


def write_workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of texts and numbers. Texts that a spreadsheet would take for a formula get an apostrophe."""
    names: list[str] = []
    for n in sheets:
        base = re.sub(r"[\[\]:*?/\\]", "_", n)[:31] or "Sheet"
        name, i = base, 2
        while name.lower() in {x.lower() for x in names}:
            name, i = f"{base[: 31 - len(str(i)) - 1]}_{i}", i + 1
        names.append(name)

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        text = str(v)
        text = f"'{text}" if text[:1] in ("=", "+", "-", "@") else text
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(len(names)))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{office}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, data in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in data) + "</sheetData></worksheet>")
    return out.getvalue()
