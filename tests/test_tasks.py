from __future__ import annotations

import pytest
from tabulon.operators import tasks as tk

STATE = "task_id string, sheet string, r int, c int, input string, display string, n double, err string"


def check(kind, area=(0, 0, 0, 0), other=None, expect=None, tolerance=None, names=None, sheet="S"):
    return (kind, sheet, *area, None if other is None else (sheet, *other), expect, tolerance, names)


def test_every_kind_of_check(spark):
    state = [("t", "S", 0, 0, "2", "2", 2.0, None), ("t", "S", 1, 0, "3", "3", 3.0, None), ("t", "S", 0, 1, "=A1+A2", "5", 5.0, None), ("t", "S", 5, 5, "=1/0", "#DIV/0!", None, "#DIV/0!")]
    before = [("t", "S", 0, 0, "2", "", 0.0, None), ("t", "S", 1, 0, "4", "", 0.0, None)]
    col, b1 = (0, 0, 1, 0), (0, 1, 0, 1)
    cases = [
        (check("CellDisplays", b1, expect="5"), True), (check("CellDisplays", (9, 9, 9, 9), expect="5"), False), (check("CellNumber", b1, expect="5.01", tolerance=0.1), True), (check("CellNumber", b1, expect="6"), False),
        (check("CellFormula", b1, expect="=a1 + a2"), True), (check("RangeFilled", col), True), (check("RangeFilled", (0, 0, 2, 0)), False), (check("SumsMatch", col, other=b1), True), (check("SumsMatch", col, other=col), True),
        (check("SumEquals", col, expect="5"), True), (check("NoErrors", col), True), (check("NoErrors", (0, 0, 9, 9)), False), (check("Unchanged", (0, 0, 0, 0)), True), (check("Unchanged", col), False),
        (check("SheetsExist", names=["s"]), True), (check("SheetsExist", names=["S", "T"]), False), (check("NameRefersTo", names=["rate"], expect="0.2"), True), (check("NameRefersTo", names=["other"], expect="0.2"), False),
    ]
    tasks = spark.createDataFrame([("t", [c for c, _ in cases])], f"task_id string, checks array<{tk.CHECK}>")
    books = spark.createDataFrame([("t", ["S"], {"RATE": "0.2"})], "task_id string, sheets array<string>, names map<string,string>")
    got = tk.grade(tasks, spark.createDataFrame(state, STATE), spark.createDataFrame(before, STATE), books)
    assert [(r.check, r.passed) for r in got.orderBy("index").collect()] == [(c[0], want) for c, want in cases]
    total = tk.grades(got).first()
    assert (total.passed, total.n_checks, total.n_passed) == (False, 18, sum(w for _, w in cases))


def test_runs_and_corrections(spark):
    a = spark.createDataFrame([("x", i, h) for i, h in enumerate("abcd")] + [("y", 0, "a")], "k string, index int, state_hash string")
    b = spark.createDataFrame([("x", i, h) for i, h in enumerate("abXd")] + [("y", 0, "a")], "k string, index int, state_hash string")
    agreed = tk.divergence(a, b, "k")
    assert {r.k: (r.agreed, r.valid) for r in agreed.collect()} == {"x": (2, False), "y": (1, True)}
    run = spark.createDataFrame([("x", ["1", "2", "3", "4"])], "k string, actions array<string>")
    fixed = spark.createDataFrame([("x", ["1", "2", "9"])], "k string, actions array<string>")
    row = tk.preference_rows(run, fixed, "k", agreed).first()
    assert (row.prompt, row.rejected, row.chosen) == (["1", "2"], ["3", "4"], ["9"])
    chain = spark.createDataFrame([("s", 1, "a", "b"), ("s", 2, "b", "c"), ("s", 3, "x", "d")], "session_id string, seq int, pre_state_digest string, post_state_digest string")
    assert [r.seq for r in tk.digest_chain(chain).collect()] == [3]
    old = spark.createDataFrame([("1", "demo", True), ("2", "demo", False), ("3", "variant", False)], "task_id string, origin string, passed boolean")
    new = spark.createDataFrame([("1", False), ("2", True), ("3", False)], "task_id string, passed boolean")
    assert {r.origin: (r.tasks, r.gained, r.lost) for r in tk.regressions(old, new).collect()} == {"demo": (2, 1, 1), "variant": (1, 0, 0)}


def test_tables_are_found(spark):
    rows = [("S", 0, 0, "text")] + [("S", 1, c, "text") for c in range(3)] + [("S", r, c, "num" if c else "text") for r in range(2, 12) for c in range(3)] + [("S", 5, 2, "bool")]
    got = tk.observed_tables(spark.createDataFrame(rows, "sheet string, r int, c int, kind string")).first()
    assert (got.header_row, got.columns, got.data_rows) == (1, 3, 10) and got.confidence == pytest.approx(0.35 + 0.5 * 2 / 3 + 0.15)
