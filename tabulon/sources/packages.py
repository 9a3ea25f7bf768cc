"""Workbook packages beyond cells: defined names, sizes, number formats, and edits written into a copy of the package.

Packages are rows (``path, content``), many at a time; one that can't be read gives a row with
an error and stops nothing. Edits go to the parts they touch; all other parts, and what a
changed part holds besides cells and names, are carried over as they are.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections import defaultdict
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr, unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.values import NUMBER_PATTERN
from tabulon.plans import formula as f

from .files import _LINK, _MAIN, MOST_BYTES

#: Widest digit of the usual font and the padding of a column, in pixels; points in a pixel (fixed values).
DIGIT, PADDING, POINTS = 7.0, 5.0, 0.75
#: Number formats that a package need not spell out (fixed values).
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yyyy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}


def column_pixels(width: Column) -> Column:
    """A column's width in characters, as packages keep it, in pixels; 0 where there is none."""
    inner = F.floor((256 * width + float(int(128 / DIGIT))) / 256 * DIGIT) + PADDING
    return F.when(width > 0, inner).otherwise(0.0)


def column_width(pixels: Column) -> Column:
    """The way back: exact for whole pixels."""
    return F.when(pixels > PADDING, F.floor((pixels - PADDING) / DIGIT * 100 + 0.5) / 100).otherwise(0.0)


def row_pixels(points: Column) -> Column:
    return F.when(points > 0, F.round(points / POINTS, 2)).otherwise(0.0)


def row_points(pixels: Column) -> Column:
    return F.when(pixels > 0, F.round(pixels * POINTS, 4)).otherwise(0.0)


def packages(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of package files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _opened(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
        raise ValueError(f"a workbook of more than {MOST_BYTES} bytes")
    return z


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Sheets' names and parts, in order."""
    links = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[sheet.get(_LINK)]
        out.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return out


def _each(files: DataFrame, read: Callable[[zipfile.ZipFile], Iterator[tuple]], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``path``, the fields that ``read`` gives for a package, and ``error`` for one that can't be read."""
    names = ["path", *(n for n, _, _ in fields), "error"]
    kinds = [pa.string(), *(k for _, _, k in fields), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with _opened(data) as z:
                        rows = [(path, *r, None) for r in read(z)]
                except Exception as e:  # whatever a damaged package raises is its row
                    rows = [(path, *[None] * len(fields), f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, "path string, " + "".join(f"{n} {s}, " for n, s, _ in fields) + "error string")


def defined_names(files: DataFrame) -> DataFrame:
    """``path, name, refers_to, sheet, error``: names in capitals; sheet: whose name it is, null for the workbook's. Built-in names (``_xlnm.``) are left out."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        sheets = [s for s, _ in _sheets(z)]
        for x in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}definedName"):
            at = x.get("localSheetId")
            if x.get("name") and not x.get("name").startswith("_xlnm."):
                yield x.get("name").upper(), x.text or "", None if at is None else sheets[int(at)]

    return _each(files, read, [("name", "string", pa.string()), ("refers_to", "string", pa.string()), ("sheet", "string", pa.string())])


def sizes(files: DataFrame) -> DataFrame:
    """``path, sheet, axis, at, count, pixels, error``: columns and rows of their own size; at is zero-based."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        for name, part in _sheets(z):
            root = ET.fromstring(z.read(part))
            for x in root.iter(f"{_MAIN}col"):
                if x.get("width"):
                    yield name, "col", int(x.get("min")) - 1, int(x.get("max")) - int(x.get("min")) + 1, float(x.get("width"))
            for x in root.iter(f"{_MAIN}row"):
                if x.get("ht"):
                    yield name, "row", int(x.get("r")) - 1, 1, float(x.get("ht"))

    fields = [("sheet", "string", pa.string()), ("axis", "string", pa.string()), ("at", "int", pa.int32()), ("count", "int", pa.int32()), ("size", "double", pa.float64())]
    pixels = F.when(F.col("axis") == "col", column_pixels(F.col("size"))).when(F.col("axis") == "row", row_pixels(F.col("size")))
    return _each(files, read, fields).select("path", "sheet", "axis", "at", "count", pixels.alias("pixels"), "error")


def number_formats(files: DataFrame) -> DataFrame:
    """``path, sheet, r, c, format, error``: the number format of each cell that has another than General."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        if "xl/styles.xml" not in z.namelist():
            return
        styles = ET.fromstring(z.read("xl/styles.xml"))
        own = {int(x.get("numFmtId")): x.get("formatCode") for x in styles.iter(f"{_MAIN}numFmt")}
        table = styles.find(f"{_MAIN}cellXfs")
        codes = [] if table is None else [own.get(i, BUILT_IN.get(i, "General")) for x in table for i in [int(x.get("numFmtId", 0))]]
        for name, part in _sheets(z):
            for x in ET.fromstring(z.read(part)).iter(f"{_MAIN}c"):
                code = codes[int(x.get("s"))] if x.get("s") and int(x.get("s")) < len(codes) else "General"
                if code != "General":
                    at = f.parse_cell(x.get("r"))
                    yield name, at.row, at.col, code

    return _each(files, read, [("sheet", "string", pa.string()), ("r", "int", pa.int32()), ("c", "int", pa.int32()), ("format", "string", pa.string())])


_ROW = re.compile(r'<row\b[^>]*?\br="(\d+)"[^>]*?(?:/>|>.*?</row>)', re.DOTALL)
_CELL = re.compile(r'<c\b[^>]*?\br="([A-Z]+)\d+"[^>]*?(?:/>|>.*?</c>)', re.DOTALL)


def _cell(r: int, c: int, text: str, style: str) -> str:
    at = f'r="{f.column_letters(c)}{r + 1}"{style}'
    if text.startswith("=") and len(text) > 1:
        return f"<c {at}><f>{escape(text[1:])}</f></c>"
    if text.upper() in ("TRUE", "FALSE"):
        return f'<c {at} t="b"><v>{int(text.upper() == "TRUE")}</v></c>'
    if text in f.ERRORS:
        return f'<c {at} t="e"><v>{escape(text)}</v></c>'
    if re.match(NUMBER_PATTERN, text) and "%" not in text:
        return f"<c {at}><v>{text.strip()}</v></c>"
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text.removeprefix(chr(39)))}</t></is></c>'


def _edited_sheet(xml: str, edits: dict[tuple[int, int], str | None]) -> str:
    """A sheet's part with cells set (an empty or null input takes a cell away); a cell keeps its style."""
    if "<sheetData/>" in xml:
        xml = xml.replace("<sheetData/>", "<sheetData></sheetData>")
    start, end = xml.index("<sheetData>") + len("<sheetData>"), xml.index("</sheetData>")
    rows = {int(m[1]) - 1: m[0] for m in _ROW.finditer(xml, start, end)}
    by_row: dict[int, dict[int, str | None]] = defaultdict(dict)
    for (r, c), text in edits.items():
        by_row[r][c] = text
    for r, own in by_row.items():
        old = rows.get(r, f'<row r="{r + 1}"/>')
        head = re.match(r"<row\b[^>]*?(?=/?>)", old)[0]
        cells = {f.column_number(m[1]): m[0] for m in _CELL.finditer(old)}
        for c, text in own.items():
            style = re.search(r'\ss="\d+"', cells[c].partition(">")[0]) if c in cells else None
            if text:
                cells[c] = _cell(r, c, text, style[0] if style else "")
            elif style:
                cells[c] = f'<c r="{f.column_letters(c)}{r + 1}"{style[0]}/>'
            else:
                cells.pop(c, None)
        rows[r] = f"{head}>{''.join(cells[c] for c in sorted(cells))}</row>"
    return xml[:start] + "".join(rows[r] for r in sorted(rows)) + xml[end:]


_NAME = re.compile(r"<definedName\b([^>]*)>(.*?)</definedName>", re.DOTALL)


def _renamed_book(xml: str, names: dict[str, str | None]) -> str:
    """The workbook's part with names of the workbook set (null takes one away); others' names are carried over as they are."""
    kept, own = [], {}
    for m in _NAME.finditer(xml):
        name = re.search(r'\bname="([^"]*)"', m[1])
        if not name or "localSheetId=" in m[1] or name[1].startswith("_xlnm."):
            kept.append(m[0])
        else:
            own[unescape(name[1], {"&quot;": '"'}).upper()] = unescape(m[2])
    own = {k: v for k, v in (own | {k.upper(): v for k, v in names.items()}).items() if v is not None}
    body = "".join([*kept, *(f"<definedName name={quoteattr(k)}>{escape(v)}</definedName>" for k, v in sorted(own.items()))])
    body = f"<definedNames>{body}</definedNames>" if body else ""
    if "<definedNames" in xml:
        return re.sub(r"<definedNames\b.*?</definedNames>|<definedNames\s*/>", lambda _: body, xml, count=1, flags=re.DOTALL)
    return xml.replace("</sheets>", "</sheets>" + body, 1)


def _patched(data: bytes, cells: dict[str, dict[tuple[int, int], str | None]], names: dict[str, str | None]) -> bytes:
    out = io.BytesIO()
    with _opened(data) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as copy:
        parts = dict(_sheets(z))
        if gone := cells.keys() - parts.keys():
            raise KeyError(f"no sheet {sorted(gone)[0]!r}")
        changed = {parts[s]: own for s, own in cells.items()}
        for item in z.infolist():
            body = z.read(item)
            if item.filename in changed:
                body = _edited_sheet(body.decode("utf-8"), changed[item.filename]).encode()
            elif item.filename == "xl/workbook.xml" and names:
                body = _renamed_book(body.decode("utf-8"), names).encode()
            elif changed and item.filename == "xl/calcChain.xml":
                continue  # the order of calculation is made anew by who opens the file
            elif changed and item.filename in ("[Content_Types].xml", "xl/_rels/workbook.xml.rels"):
                body = re.sub(rb"<(?:Override|Relationship)\b[^>]*calcChain[^>]*/>", b"", body)
            copy.writestr(item, body)
    return out.getvalue()


def patched(files: DataFrame, cells: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``path, content, error``: packages (``path, content``) with edits written into them.

    cells: ``path, sheet, r, c, input``; an empty or null input takes a cell away, its style
    stays. names: ``path, name, refers_to`` of the workbook; null takes a name away. Of several
    edits of one cell or name the greatest counts. A package without edits comes back as it is;
    one that can't be read, or lacks a sheet that is edited, comes back as it is with an error.
    Edits of a path without a package are left out.
    """
    one = cells.groupBy("path", "sheet", "r", "c").agg(F.max("input").alias("input")).groupBy("path").agg(F.collect_list(F.struct("sheet", "r", "c", "input")).alias("cells"))
    own = files.select("path", "content").join(one, "path", "left")
    if names is None:
        own = own.withColumn("names", F.lit(None).cast("array<struct<name: string, refers_to: string>>"))
    else:
        many = names.groupBy("path", "name").agg(F.max("refers_to").alias("refers_to")).groupBy("path").agg(F.collect_list(F.struct("name", "refers_to")).alias("names"))
        own = own.join(many, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data, edits, names in zip(*(x.to_pylist() for x in b.columns), strict=True):
                by_sheet: dict[str, dict] = defaultdict(dict)
                for e in edits or []:
                    by_sheet[e["sheet"]][e["r"], e["c"]] = e["input"]
                error = None
                if edits or names:
                    try:
                        data = _patched(data, by_sheet, {n["name"]: n["refers_to"] for n in names or []})
                    except Exception as e:  # whatever a damaged package raises is its row
                        error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary()), pa.array([error], pa.string())], ["path", "content", "error"])

    return own.select("path", "content", "cells", "names").mapInArrow(run, "path string, content binary, error string")
