from __future__ import annotations

import pytest
from tabulon.operators import workbook as wb
from tabulon.plans import formula as f


def build(spark, inputs):
    rows = [("Sheet1", c.row, c.col, x) for a, x in inputs.items() for c in [f.parse_cell(a)]]
    from tabulon.operators.cells import SCHEMA

    return wb.Workbook(spark.createDataFrame(rows, SCHEMA))


def shown(w, sheet="Sheet1"):
    return {f.column_letters(r.c) + str(r.r + 1): r.input for r in w.cells.collect() if r.sheet == sheet}


def test_actions(spark):
    w = build(spark, {"A1": "n", "A2": "3", "A3": "1", "A4": "b", "B2": "=A2*2", "B3": "=A3*2", "B4": "=A4"})
    s = wb.apply(w, {"action": "SortApply", "sheet": "Sheet1", "range": (0, 0, 4, 1), "keys": [(0, True)], "has_header": True})
    assert shown(s) == {"A1": "n", "A2": "1", "A3": "3", "A4": "b", "B2": "=A2*2", "B3": "=A3*2", "B4": "=A4"}
    assert shown(wb.apply(s, {"action": "Undo"})) == shown(w)
    assert shown(wb.apply(wb.apply(s, {"action": "Undo"}), {"action": "Redo"})) == shown(s)
    fill = wb.apply(w, {"action": "FillApply", "sheet": "sheet1", "source": (1, 0, 2, 1), "target": (1, 0, 5, 1)})
    assert {k: v for k, v in shown(fill).items() if k[1] in "456"} == {"A4": "-1", "A5": "-3", "A6": "-5", "B4": "=A4*2", "B5": "=A5*2", "B6": "=A6*2"}
    paste = wb.apply(w, {"action": "RangePaste", "sheet": "Sheet1", "source": (1, 1, 1, 1), "target": (0, 3, 1, 3), "mode": "formulas"})
    assert {k: v for k, v in shown(paste).items() if k[0] == "D"} == {"D1": "=C1*2", "D2": "=C2*2"}
    cut = wb.apply(w, {"action": "RangePaste", "sheet": "Sheet1", "source": (1, 0, 1, 0), "target": (8, 0, 8, 0), "cut": True})
    assert shown(cut)["B2"] == "=A9*2" and shown(cut)["A9"] == "3"
    view = wb.apply(w, {"action": "FilterApply", "sheet": "Sheet1", "range": (0, 0, 3, 1), "column": 0, "allowed": ["3"]})
    assert sorted({r.r for r in view.viewport("Sheet1", (0, 0, 9, 9)).collect()}) == [0, 1]
    assert view.viewport("Sheet1", (0, 0, 9, 9)).count() == 3
    named = wb.apply_all(w, [{"action": "SheetAdd", "name": "Two"}, {"action": "NameDefine", "name": "rate", "refers_to": "0.2"}, {"action": "FormatApply", "sheet": "Two", "range": (0, 0, 1, 1), "patch": {"bold": True}}, {"action": "FormatClear", "sheet": "Two", "range": (1, 1, 1, 1)}, {"action": "MergeApply", "sheet": "Sheet1", "range": (0, 0, 1, 1)}])
    assert named.names == {"RATE": "0.2"} and named.sheets == ("Sheet1", "Two") and "B2" not in shown(named)
    assert wb.format_of(named, "Two", 0, 0) == {"bold": True} and wb.format_of(named, "Two", 1, 1) == {}
    assert wb.apply(named, {"action": "Undo"}).sheets == ("Sheet1",)
    for bad in ({"action": "SheetDelete", "name": "Sheet1"}, {"action": "SheetAdd", "name": "SHEET1"}, {"action": "NameDefine", "name": "A1", "refers_to": "1"}, {"action": "NameDelete", "name": "x"}, {"action": "Redo"}, {"action": "What"}, {"action": "CellClear", "sheet": "No", "at": (0, 0)}):
        with pytest.raises(wb.ActionError):
            wb.apply(w, bad)


def test_digest_follows_state(spark):
    w = build(spark, {"A1": "1", "B2": "=A1"})
    same = wb.apply(wb.apply(w, {"action": "CellEdit", "sheet": "Sheet1", "at": (4, 4), "input": "x"}), {"action": "CellClear", "sheet": "Sheet1", "at": (4, 4)})
    assert wb.state_digest(w) == wb.state_digest(same) != wb.state_digest(wb.apply(w, {"action": "CellEdit", "sheet": "Sheet1", "at": (0, 0), "input": "2"}))
