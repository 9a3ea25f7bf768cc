from __future__ import annotations

import pytest
from tabulon.functions.registry import names
from tabulon.operators import evaluate as ev
from tabulon.plans import formula as f

GIVEN = {"A1": "3", "A2": "1", "A3": "'2", "A4": "", "B1": "x", "B2": "Y", "B3": "x", "C1": "=A1+A2", "C2": "=C1*2", "C3": "=D3", "D3": "=C3", "C4": "=1/0", "E1": "2024-01-31"}

CASES = [
    ("SUM(A1:A4)", "4"), ("SUM(A1:A4,\"2\")", "6"), ("C2", "8"), ("C3", "#CIRC!"), ("SUM(C1:C4)", "#CIRC!"), ("COUNT(A1:A4)", "2"), ("COUNTA(A1:B4)", "6"), ("AVERAGE(B1:B3)", "#DIV/0!"), ("COUNTIF(B1:B3,\"X\")", "2"), ("SUMIF(B1:B2,\"x\",A1)", "3"),
    ("VLOOKUP(1,A1:B3,2,FALSE)", "Y"), ("XLOOKUP(\"y\",B1:B3,A1:A3)", "1"), ("XLOOKUP(\"q\",B1:B3,A1:A3,\"none\")", "none"), ("MATCH(2,A1:A2,1)", "2"), ("INDEX(A1:B3,2,2)", "Y"), ("A1:A2", "#VALUE!"), ("SUM(A:A)", "4"), ("IFERROR(C4,0)", "0"), ("ISERROR(C4)", "TRUE"),
    ("ROWS(UNIQUE(B1:B3))", "2"), ("SUM(FILTER(A1:A2,A1:A2>2))", "3"), ("SUM(SEQUENCE(3))", "6"), ("INDEX(SORT(A1:A2),1)", "1"), ("SUM(OFFSET(A1,0,0,2))", "4"), ("SUM(INDIRECT(\"A1:A2\"))", "4"), ("ROW(B7)*COLUMN(B7)", "14"), ("LARGE(A1:A2,2)", "1"),
    ("EOMONTH(E1,1)", "45351"), ("TEXT(EOMONTH(E1,0),\"d mmm yyyy\")", "31 Jan 2024"), ("NETWORKDAYS(\"2024-01-01\",E1)", "23"), ("WORKDAY(E1,1)", "45323"), ("DATEDIF(E1,\"2024-03-01\",\"M\")", "1"), ("AGGREGATE(9,6,C1:C4)", "12"), ("SUBTOTAL(9,A1:A2)", "4"), ("0.1+0.2-0.3", "0"), ("TEXTJOIN(\"-\",TRUE,B1:B3)", "x-Y-x"),
    ("LET(a,2,b,a*3,b+A1)", "9"), ("SUMPRODUCT(A1:A2,A1:A2)", "10"), ("NOSUCH(1)", "#NAME?"), ("1+", "#NAME?"), ("rate*2", "0.4"), ("1/3", "0.333333333333333"), ("1E15*10", "1E+16"), ("A1:A2*2", "6"),
]


def book():
    return ev.Sheetbook({("S", c.row, c.col): x for a, x in GIVEN.items() for c in [f.parse_cell(a)]}, {"rate": "0.2"})


@pytest.mark.parametrize("text,want", CASES)
def test_formulas_over_cells(text, want):
    assert ev.display(book().result("=" + text, "S", 9, 9)) == want


def test_every_function_of_tables_is_known_to_cells():
    assert not [n for n in names() if n not in ev.EAGER and n not in ev.LAZY]
    assert len(ev.EAGER.keys() | ev.LAZY.keys()) == 135


def test_workbooks_in_parallel(spark):
    rows = [(w, "S", 0, 0, str(w)) for w in range(5)] + [(w, "S", 1, 0, "=A1*2") for w in range(5)] + [(0, "S", 2, 0, "=1/0")]
    got = {(r.w, r.r): (r.kind, r.display) for r in ev.evaluate(spark.createDataFrame(rows, "w int, sheet string, r int, c int, input string"), "w").collect()}
    assert got[4, 1] == ("num", "8") and got[0, 2] == ("error", "#DIV/0!") and len(got) == 11


def test_every_customer_is_evaluated(spark):
    from tabulon.plans import queries as q

    d = "/root/testdata/sf0.001"
    got = [r.c_custkey for r in q.queries()["workbook_values"](spark, d).collect()]
    assert sorted(got) == sorted(r.c_custkey for r in spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").collect())
