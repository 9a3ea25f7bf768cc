from __future__ import annotations

import random

import pytest
from tabulon.operators import evaluate as ev
from tabulon.operators import recalc
from tabulon.plans import formula as f

SCHEMA = "workbook_id string, sheet string, r int, c int, input string"


def cells_of(spark, books):
    rows = [(k, s, f.parse_cell(a).row, f.parse_cell(a).col, x) for k, sheets in books.items() for s, given in sheets.items() for a, x in given.items()]
    return spark.createDataFrame(rows, SCHEMA)


def shown(frame):
    return {(r.workbook_id, r.sheet, f.column_letters(r.c) + str(r.r + 1)): r.display for r in frame.collect()}


def circles(cells):
    """The formula cells that read themselves, however far around, whatever branch a choice would take."""
    reads = {}
    for (s, r, c), x in cells.items():
        try:
            refs = f.references(f.parse(x)) if x.startswith("=") and len(x) > 1 else []
        except f.FormulaError:
            refs = []
        inside = lambda a, lo, hi: (lo is None or a >= lo) and (hi is None or a <= hi)
        reads[s, r, c] = [k for k in cells for x in refs if k[0] == (x.sheet or s) and inside(k[1], x.first.row, x.last.row) and inside(k[2], x.first.col, x.last.col)]

    def reached(k):
        seen, todo = set(), list(reads[k])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += reads[n]
        return seen

    return {k for k in cells if len(cells) < 100 and k in reached(k)}


def want_of(books):
    """The values by the evaluator that walks one workbook in memory, with circles found beforehand."""
    out = {}
    for k, sheets in books.items():
        at = {(s, a): f.parse_cell(a) for s, given in sheets.items() for a in given}
        cells = {(s, c.row, c.col): sheets[s][a] for (s, a), c in at.items() if sheets[s][a] is not None}
        book = ev.Sheetbook(cells | dict.fromkeys(circles(cells), "#CIRC!"))
        for (s, a), c in at.items():
            out[k, s, a] = ev.shown(book.value(s, c.row, c.col))
    return out


GIVEN = {"A1": "3", "A2": "1", "A3": "'2", "A4": "", "A5": "TRUE", "B1": "x", "B2": "Y", "B3": "x", "B5": "#N/A", "D1": "2.5", "D2": "-4", "D3": "0.1", "E1": "10%"}
FORMULAS = [
    "A1+A2", "A1+A3", "A1+B1", "A4+1", "A4", "A5+1", "A4&\"x\"&A1", "A1=A3", "A1<B1", "B1=\"X\"", "A4=0", "A4=\"\"", "A5>B2", "B5+1", "IFERROR(B5,7)", "IF(A1>2,\"yes\",5)", "IF(A4,1,B2)",
    "SUM(A1:A5)", "SUM(A1:B5)", "SUM(A1:A2,D1:D3,4)", "SUM(A1:A2,A1:A2)", "AVERAGE(A1:A3)", "AVERAGE(B1:B3)", "MIN(D1:D3)", "MAX(B1:B2)", "COUNT(A1:B5)", "COUNTA(A1:B5)", "COUNTA(F1:F9)", "STDEV(D1:D3)", "MEDIAN(D1:D3)", "PRODUCT(D1:D2)",
    "SUM(D1:D3*2)", "SUM(D1:D3*A1:A3)", "SUM(D1:D3+A1:A2)", "SUM(D1:D3*E1)", "SUMPRODUCT(D1:D3,A1:A3)", "SUMPRODUCT(D1:D3,A1:A2)", "SUMPRODUCT((B1:B3=\"x\")*D1:D3)", "SUM(D1:D3*{0})".replace("{0}", "D1:E1"), "SUM(A:A)", "SUM(1:1)",
    "ROUND(SUM(A1:A2)*D1/3,2)", "D3+0.2-0.3", "1/0", "2^A1", "A1%", "-A1", "-B1", "UPPER(B1)&LEN(B2)", "LEFT(B2,1)", "AND(A1>1,A5)", "OR(A2>1,FALSE)", "NOT(A5)", "ISNUMBER(A1)&ISTEXT(B1)&ISBLANK(F9)&ISLOGICAL(A5)", "ISERROR(B5)", "CHOOSE(2,A1,B1)", "ABS(D2)", "1+", "A1:A2", "VLOOKUP(1,A1:B3,2,FALSE)",
]


def test_single_formulas_equal_the_walk_in_memory(spark):
    books = {f"w{i}": {"S": GIVEN | {"H1": "=" + x, "H2": "=H1"}} for i, x in enumerate(FORMULAS)}
    got, want = shown(recalc.recalculate(cells_of(spark, books))), want_of(books)
    assert {k: (FORMULAS[int(k[0][1:])], got[k]) for k in want if got[k] != want[k]} == {}, {k: want[k] for k in want if got[k] != want[k]}
    assert got.keys() == want.keys()


def test_levels_sheets_and_circles(spark):
    books = {
        "a": {"S": {"A1": "1", "A2": "=A1+T!A1", "A3": "=A2*2", "A4": "=SUM(A1:A3)"}, "T": {"A1": "=S!A1+4"}},
        "b": {"S": {"A1": "=B1", "B1": "=A1+1", "C1": "=B1+1", "D1": "=IFERROR(C1,9)", "E1": "=E1", "F1": "=SUM(F1:F2)", "F2": "3", "G1": "=D1+F2"}},
        "c": {"S": {"A1": "=Gone!A1", "A2": "=1+1"}},
        "d": {"S": {"A1": None, "A2": "=A1"}},
    }
    got, want = shown(recalc.recalculate(cells_of(spark, books))), want_of(books)
    assert got == want


def test_a_chain_of_three_thousand_cells_is_one_step(spark):
    n = 3000
    down = {"A1": "1", "A2": "=A1+1"} | {f"A{i}": f"=A{i - 1}+1" for i in range(3, n + 1)} | {f"B{i}": str(i % 7) for i in range(1, n + 1)}
    balance = {"C1": "=B1"} | {f"C{i}": f"=C{i - 1}+B{i}*2-SUM(B{i}:B{i})" for i in range(2, n + 1)} | {"E1": f"=A{n}+C{n}"}
    got = shown(recalc.recalculate(cells_of(spark, {"w": {"S": down | balance}})))
    assert all(got["w", "S", f"A{i}"] == str(i) for i in range(1, n + 1))
    total = 1
    for i in range(2, n + 1):
        total += i % 7
        assert got["w", "S", f"C{i}"] == str(total)
    assert got["w", "S", "E1"] == str(n + total)


def test_chains_that_read_each_other_are_taken_apart(spark):
    fib = {"A1": "1", "A2": "1"} | {f"A{i}": f"=A{i - 1}+A{i - 2}" for i in range(3, 14)}
    ring = {"C1": "=C5"} | {f"C{i}": f"=C{i - 1}" for i in range(2, 6)} | {"D1": "=C3"}
    books = {"w": {"S": fib | ring}}
    assert shown(recalc.recalculate(cells_of(spark, books))) == want_of(books)


def test_random_books_equal_the_walk_in_memory(spark):
    rng, books = random.Random(4), {}
    for k in range(40):
        given = {}
        for r in range(1, 5):
            for c in "ABC":
                x = rng.random()
                place = lambda: rng.choice("ABC") + str(rng.randint(1, 4))
                given[f"{c}{r}"] = str(rng.randint(-5, 5)) if x < 0.45 else rng.choice(["t", "TRUE", "", "1e3"]) if x < 0.55 else rng.choice([f"={place()}+{place()}", f"=SUM({c}1:{c}{max(1, r - 1)})" if r > 1 else "=1", f"=IF({place()}>0,{place()},2)", f"=MAX({place()},3)"])
        books[f"w{k}"] = {"S": given}
    got, want = shown(recalc.recalculate(cells_of(spark, books))), want_of(books)
    assert 0 < sum(v == "#CIRC!" for v in want.values()) < len(want) / 2
    assert {k: (v, got[k]) for k, v in want.items() if got[k] != v} == {}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert recalc.recalculate(empty).count() == 0
    rows = [(None, "S", 0, 0, "2"), (None, "s", 1, 0, "=A1*2"), ("x", "S", 0, 0, "1"), ("x", "S", 0, 0, "2"), ("x", "S", 0, 1, "=A1")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as ID", "2 as node", "'q' as outer")
    got = {(r.workbook_id, r.r, r.c): r.display for r in recalc.recalculate(frame).collect()}
    assert got == {(None, 0, 0): "2", (None, 1, 0): "4", ("x", 0, 0): "2", ("x", 0, 1): "2"}


@pytest.mark.parametrize("text", ["OFFSET(A1,1,0)", "FILTER(A1:A2,A1:A2>1)", "x+1", "SUM(A:A*2)"])
def test_what_needs_the_whole_workbook_has_no_plan(text):
    assert recalc.formula_plan("=" + text) is None


def test_formulas_and_addresses_that_repeat_are_parsed_once_a_batch(monkeypatch):
    import pyarrow as pa
    from tabulon.operators import parity, recalc

    parsed, plan, cell = [], recalc.formula_plan, parity.f.parse_cell
    texts = ["=A1+1", "=SUM(A1:A3)", "=A1+1", "=OFFSET(A1,1,1)", "=(", "=A1+1"] * 50
    wanted = [plan(t) for t in texts]
    monkeypatch.setattr(recalc, "formula_plan", lambda t: parsed.append(t) or plan(t))
    got = recalc._plans(pa.array(texts)).to_pylist()
    assert len(parsed) == 4 and [g and (g["outer"], len(g["singles"]), [i["text"] for i in g["inner"]]) for g in got] == [w and (w["outer"], len(w["singles"]), [i["text"] for i in w["inner"]]) for w in wanted]
    parsed.clear()
    monkeypatch.setattr(parity.f, "parse_cell", lambda t: parsed.append(t) or cell(t))
    assert parity._place(pa.array(["B2", "A1", "?", None, "B2"] * 9)).to_pylist() == [{"r": 1, "c": 1}, {"r": 0, "c": 0}, None, None, {"r": 1, "c": 1}] * 9
    assert len(parsed) == 3
