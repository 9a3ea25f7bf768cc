from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tabulon.plans import formula as f


@pytest.mark.parametrize(
    "text,printed",
    [("=1+2*3", "1+2*3"), ("(1+2)*3", "(1+2)*3"), ("2^3^2", "2^3^2"), ("2^(3^2)", "2^(3^2)"), ("-2^2", "-2^2"), ("-(2^2)", "-(2^2)"), ("50%%", "50%%"), ("a&\"x\"\"y\"", 'a&"x""y"'), ("sum( a1 : b2 )", None), ("SUM(A1:B2,)", "SUM(A1:B2,)"), ("'My Sheet'!$A$1", "'My Sheet'!$A$1"), ("A:C", "A:C"), ("3:5", "3:5"), ("{Unit Price}*2", "{Unit Price}*2"), ("_xlfn.XLOOKUP(1,A1,B1)", "XLOOKUP(1,A1,B1)"), ("1<>2=TRUE", "1<>2=TRUE"), ("#N/A", "#N/A"), ("B2:A1", "A1:B2")],
)
def test_parse_and_print(text, printed):
    if printed is None:
        with pytest.raises(f.FormulaError):
            f.parse(text)
        return
    tree = f.parse(text)
    assert f.to_text(tree) == printed
    assert f.parse(f.to_text(tree)) == tree


@pytest.mark.parametrize("bad", ["", "=", "1+", "(1", "SUM(1", '"open', "1 2", "A1:", "{}"])
def test_what_does_not_parse(bad):
    with pytest.raises(f.FormulaError):
        f.parse(bad)


def test_sign_binds_tighter_than_power():
    assert f.parse("-2^2") == f.Binary("^", f.Unary("-", f.Number(2.0)), f.Number(2.0))


def test_shapes_shift_and_structural_edits():
    tree = f.parse("A1+$B$2*SUM(C1:C9)")
    assert f.shape(tree, 0, 3) == f.shape(f.shifted(tree, 5, 0), 5, 3)
    assert f.to_text(f.shifted(tree, -1, 0)) == "#REF!+$B$2*SUM(#REF!)"
    assert f.to_text(f.moved_by_insert(tree, "row", 4, 2, "S", "S")) == "A1+$B$2*SUM(C1:C11)"
    assert f.to_text(f.moved_by_delete(tree, "row", 2, 3, "S", "S")) == "A1+$B$2*SUM(C1:C6)"
    assert f.to_text(f.moved_by_delete(tree, "col", 1, 1, "S", "S")) == "A1+#REF!*SUM(B1:B9)"
    assert f.moved_by_delete(tree, "col", 1, 1, "S", "Other") == tree
    assert f.is_volatile(f.parse("NOW()+1")) and not f.is_volatile(tree)


cell = st.builds(f.Cell, st.integers(0, 40), st.integers(0, 40), st.booleans(), st.booleans())


@settings(max_examples=200, deadline=None)
@given(cell, cell, st.sampled_from(["row", "col"]), st.integers(0, 40), st.integers(1, 5))
def test_delete_undoes_insert(a, b, axis, at, count):
    ref = f.parse(f.to_text(f.Ref(a, b)).replace("$", "$"))
    assert f.moved_by_delete(f.moved_by_insert(ref, axis, at, count, "S", "S"), axis, at, count, "S", "S") == ref


@settings(max_examples=100, deadline=None)
@given(st.integers(0, f.MAX_COLS - 1))
def test_column_letters(n):
    assert f.column_number(f.column_letters(n)) == n
