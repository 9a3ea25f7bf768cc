"""CSV and workbook files as cells, and back; clipboard text and HTML tables."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.plans import formula as f

#: Uncompressed bytes a workbook may have.
MOST_BYTES = 512 << 20
CELLS = "path string, sheet string, r int, c int, input string"


def read_csv_cells(spark: SparkSession, path: str, sheet: str = "Sheet1") -> DataFrame:
    """Cells of headerless CSV files, a file being a unit: rows may be ragged, empty fields give no cell.

    A formula that doesn't parse is kept as text, with ``quarantined`` true.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for r, row in enumerate(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""))):
                    for c, x in enumerate(row):
                        if x == "":
                            continue
                        bad = False
                        if x.startswith("=") and len(x) > 1:
                            try:
                                f.parse(x)
                            except f.FormulaError:
                                x, bad = "'" + x, True
                        rows.append((name, sheet, r, c, x, bad))
                    if len(rows) > 50_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return files.mapInArrow(run, CELLS + ", quarantined boolean")


def _rows(rows: list[tuple], last: str = "quarantined") -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_() if last == "quarantined" else pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "sheet", "r", "c", "input", last])


def write_csv_cells(cells: DataFrame, path: str, columns: int) -> None:
    """Shown values (``r, c, value``) as CSV files, rows in order; ``columns`` is the used width."""
    wide = cells.groupBy("r").agg(*[F.max(F.when(F.col("c") == i, F.col("value"))).alias(f"c{i}") for i in range(columns)])
    wide.repartitionByRange("r").sortWithinPartitions("r").drop("r").write.option("header", False).option("emptyValue", "").csv(path)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _string(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def workbook_cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """``sheet, r, c, input`` of a workbook package: formulas, numbers, booleans, texts, errors."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
            raise ValueError(f"a workbook of more than {MOST_BYTES} bytes")
        names = set(z.namelist())
        shared = [_string(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_LINK)]
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            for cell in ET.fromstring(z.read(part)).iter(f"{_MAIN}c"):
                at = f.parse_cell(cell.get("r"))
                formula, value, kind = cell.find(f"{_MAIN}f"), cell.find(f"{_MAIN}v"), cell.get("t", "n")
                if formula is not None and formula.text:
                    text = "=" + formula.text
                elif kind == "inlineStr":
                    text = _typed_text(_string(cell))
                elif value is None or value.text is None:
                    continue
                elif kind == "s":
                    text = _typed_text(shared[int(value.text)])
                elif kind == "b":
                    text = "TRUE" if value.text == "1" else "FALSE"
                else:
                    text = _typed_text(value.text) if kind == "str" else value.text
                yield sheet.get("name"), at.row, at.col, text


def _typed_text(s: str) -> str:
    """A text as one types it: with a quote in front where it would read as something else."""
    import re

    from tabulon.functions.values import NUMBER_PATTERN

    reads = re.match(NUMBER_PATTERN, s) or s.startswith(("=", "'")) or s.upper() in ("TRUE", "FALSE") or s in f.ERRORS
    return "'" + s if reads else s


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of workbook files; a file is a unit, sheets are read in turn. A file that can't be read gives one row, with an ``error``."""

    return workbooks(spark.read.format("binaryFile").load(path).select("path", "content"))


def workbooks(packages: DataFrame) -> DataFrame:
    """:func:`read_workbooks` of packages in a table (``path, content``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    for sheet, r, c, text in workbook_cells(data):
                        rows.append((name, sheet, r, c, text, None))
                        if len(rows) > 50_000:
                            yield _rows(rows, "error")
                            rows = []
                except Exception as e:  # whatever a damaged package raises is its row
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield _rows(rows, "error")

    return packages.select("path", "content").mapInArrow(run, CELLS + ", error string")


def workbook_bytes(sheets: dict[str, dict[tuple[int, int], str]]) -> bytes:
    """A minimal workbook package of inputs by sheet and position."""
    from xml.sax.saxutils import escape, quoteattr

    from tabulon.functions.values import NUMBER_PATTERN

    import re

    def cell(r: int, c: int, x: str) -> str:
        at = f'r="{f.column_letters(c)}{r + 1}"'
        if x.startswith("=") and len(x) > 1:
            return f"<c {at}><f>{escape(x[1:])}</f></c>"
        if x.upper() in ("TRUE", "FALSE"):
            return f'<c {at} t="b"><v>{int(x.upper() == "TRUE")}</v></c>'
        if x in f.ERRORS:
            return f'<c {at} t="e"><v>{escape(x)}</v></c>'
        if re.match(NUMBER_PATTERN, x) and "%" not in x:
            return f"<c {at}><v>{x.strip()}</v></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(x.removeprefix(chr(39)))}</t></is></c>'

    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        z.writestr("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
                   + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(n)) + "</Types>")
        z.writestr("_rels/.rels", head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", head + f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, s in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", head + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(n)) + "</Relationships>")
        for i, cells in enumerate(sheets.values()):
            rows: dict[int, list[str]] = {}
            for (r, c), x in sorted(cells.items()):
                rows.setdefault(r, []).append(cell(r, c, x))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", head + f"<worksheet {main}><sheetData>" + "".join(f'<row r="{r + 1}">{"".join(x)}</row>' for r, x in rows.items()) + "</sheetData></worksheet>")
    return out.getvalue()


def to_tsv(rows: list[list[str]]) -> str:
    """Clipboard text: fields with tabs, quotes or line ends are quoted."""
    quote = lambda x: '"' + x.replace('"', '""') + '"' if any(k in x for k in '\t\n\r"') else x
    return "\n".join("\t".join(map(quote, row)) for row in rows)


def from_tsv(text: str) -> list[list[str]]:
    """Rows of clipboard text, padded to one width."""
    import csv

    return _padded(list(csv.reader(io.StringIO(text, newline=""), delimiter="\t")))


def _padded(rows: list[list[str]]) -> list[list[str]]:
    wide = max(map(len, rows), default=0)
    return [row + [""] * (wide - len(row)) for row in rows]


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.open = self.done = False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.open = True
        elif tag == "br" and self.open:
            self.rows[-1][-1] += "\n"

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open = False
        elif tag == "table" and self.rows:
            self.done = True

    def handle_data(self, data):
        if self.open and not self.done:
            self.rows[-1][-1] += data


def html_table(html: str) -> list[list[str]]:
    """The first table of an HTML text, padded to one width."""
    p = _Tables()
    p.feed(html or "")
    return _padded([[x.strip() for x in row] for row in p.rows])


def page_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, r, c, value``: cells of the first table of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, r, c, x) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r, row in enumerate(html_table(h)) for c, x in enumerate(row)]
            if rows:
                kinds = [b.column(0).type, pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "r", "c", "value"])

    return pages.select(key, html).mapInArrow(run, f"key {kind}, r int, c int, value string")
