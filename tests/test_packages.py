from __future__ import annotations

import io
import zipfile
from functools import cache

from pyspark.sql import functions as F
from tabulon.sources import files, packages

STYLES = """<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="1"><numFmt numFmtId="164" formatCode="0.000&quot; kg&quot;"/></numFmts>
<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/></cellXfs></styleSheet>"""
SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:x="urn:other"><cols><col min="2" max="4" width="10.71" customWidth="1"/></cols>
<sheetData><row r="1" ht="30" x:keep="1"><c r="A1" s="1"><v>2.5</v></c><c r="C1" s="2"/></row><row r="4"><c r="B4"><f>A1*2</f><v>5</v></c></row></sheetData><x:odd a="1"/></worksheet>"""
NAMES = '<definedNames><definedName name="_xlnm.Print_Area" localSheetId="0">First!$A$1</definedName><definedName name="own" localSheetId="0">First!$A$9</definedName><definedName name="Rate">First!$A$1&amp;"x"</definedName></definedNames>'


@cache
def package() -> bytes:
    plain = files.workbook_bytes({"First": {(0, 0): "1"}, "Sec & ond": {(1, 1): "text"}})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as z, zipfile.ZipFile(out, "w") as copy:
        for i in z.infolist():
            body = z.read(i)
            body = SHEET.encode() if i.filename.endswith("sheet1.xml") else body.replace(b"</sheets>", b"</sheets>" + NAMES.encode()) if i.filename == "xl/workbook.xml" else body
            copy.writestr(i, body)
        copy.writestr("xl/styles.xml", STYLES)
        copy.writestr("xl/calcChain.xml", "<calcChain/>")
        copy.writestr("custom/odd.bin", b"\x00\x01")
    return out.getvalue()


def frame(spark, *extra):
    return spark.createDataFrame([("a", bytearray(package())), ("bad", bytearray(b"no package")), *extra], "path string, content binary")


def test_names_sizes_and_formats(spark):
    got = packages.defined_names(frame(spark)).collect()
    assert {(r.path, r.name, r.refers_to, r.sheet) for r in got if not r.error} == {("a", "OWN", "First!$A$9", "First"), ("a", "RATE", 'First!$A$1&"x"', None)}
    assert [r.path for r in got if r.error] == ["bad"]
    found = {(r.sheet, r.axis, r.at, r["count"], r.pixels) for r in packages.sizes(frame(spark)).collect() if not r.error}
    assert found == {("First", "col", 1, 3, 80.0), ("First", "row", 0, 1, 40.0)}
    formats = {(r.sheet, r.r, r.c, r.format) for r in packages.number_formats(frame(spark)).collect() if not r.error}
    assert formats == {("First", 0, 0, '0.000" kg"'), ("First", 0, 2, "m/d/yyyy")}


def test_sizes_survive_a_round_trip(spark):
    px = spark.range(6, 2000).select(F.col("id").cast("double").alias("p"))
    back = px.select("p", packages.column_pixels(packages.column_width(F.col("p"))).alias("q"), packages.row_pixels(packages.row_points(F.col("p"))).alias("h"))
    assert back.where("p <> q or p <> h").count() == 0


def test_edits_touch_nothing_else(spark):
    edits = [("a", "First", 0, 0, "7"), ("a", "First", 0, 1, "=SUM(A1:A2)"), ("a", "First", 3, 1, None), ("a", "First", 8, 0, "'=x <y>"), ("a", "Sec & ond", 1, 1, ""), ("bad", "S", 0, 0, "1"), ("gone", "S", 0, 0, "1"), ("c", "None", 0, 0, "1")]
    names = [("a", "Rate", "First!$B$2"), ("a", "new", '"<"&First!A1'), ("d", "RATE", None)]
    many = frame(spark, ("c", bytearray(package())), ("d", bytearray(package())), ("e", bytearray(package())))
    out = packages.patched(many, spark.createDataFrame(edits, "path string, sheet string, r int, c int, input string"), spark.createDataFrame(names, "path string, name string, refers_to string")).cache()
    rows = {r.path: r for r in out.collect()}
    assert set(rows) == {"a", "bad", "c", "d", "e"} and {k for k, r in rows.items() if r.error} == {"bad", "c"}
    assert bytes(rows["e"].content) == package() and bytes(rows["bad"].content) == b"no package"
    good = out.where("path in ('a', 'd')")
    cells = {(r.sheet, r.r, r.c): r.input for r in files.workbooks(good.where("path = 'a'")).collect()}
    assert cells == {("First", 0, 0): "7", ("First", 0, 1): "=SUM(A1:A2)", ("First", 8, 0): "'=x <y>"}
    read = {(r.path, r.name, r.refers_to, r.sheet) for r in packages.defined_names(good).collect()}
    assert read == {("a", "OWN", "First!$A$9", "First"), ("a", "RATE", "First!$B$2", None), ("a", "NEW", '"<"&First!A1', None), ("d", "OWN", "First!$A$9", "First")}
    assert {(r.r, r.c): r.format for r in packages.number_formats(good.where("path = 'a'")).collect()} == {(0, 0): '0.000" kg"', (0, 2): "m/d/yyyy"}
    with zipfile.ZipFile(io.BytesIO(package())) as old, zipfile.ZipFile(io.BytesIO(bytes(rows["a"].content))) as new:
        assert set(old.namelist()) - set(new.namelist()) == {"xl/calcChain.xml"}
        assert new.read("custom/odd.bin") == b"\x00\x01" and new.read("xl/styles.xml") == old.read("xl/styles.xml")
        sheet = new.read("xl/worksheets/sheet1.xml").decode()
        assert 'x:keep="1"' in sheet and '<x:odd a="1"/>' in sheet and "Print_Area" in new.read("xl/workbook.xml").decode()


def test_bad_files_are_rows(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(package())
    (tmp_path / "b.xlsx").write_bytes(b"PK broken")
    got = files.read_workbooks(spark, f"file://{tmp_path}").collect()
    assert {(r.sheet, r.r, r.c, r.input) for r in got if not r.error} == {("First", 0, 0, "2.5"), ("First", 3, 1, "=A1*2"), ("Sec & ond", 1, 1, "text")}
    assert [(r.path.rsplit("/", 1)[1], r.sheet) for r in got if r.error] == [("b.xlsx", None)]
    assert packages.defined_names(packages.packages(spark, f"file://{tmp_path}")).where("error is null").count() == 2
