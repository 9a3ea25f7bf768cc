"""Logical and information functions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tabulon.plans import formula as f

from . import values as V
from .registry import function


def pick(conditions: list, branches: list[V.Value], otherwise: V.Value) -> V.Value:
    """The first branch whose condition holds, errors and all (branches are lazy: CASE)."""
    kind, cols = V.unify([*branches, otherwise])
    col = err = None
    any_err = any(b.err is not None for b in (*branches, otherwise))
    null = F.lit(None).cast("string")
    for cond, c, b in zip(conditions, cols, branches, strict=False):
        col = F.when(cond, c) if col is None else col.when(cond, c)
        if any_err:
            e = null if b.err is None else b.err
            err = F.when(cond, e) if err is None else err.when(cond, e)
    if col is None:
        return otherwise
    col = col.otherwise(cols[-1])
    if any_err:
        err = err.otherwise(null if otherwise.err is None else otherwise.err)
    return V.Value(kind, col, err)


@function("IF", 2, 3)
def _if(c, args):
    cond = c.bool(args[0])
    no = c.value(args[2]) if len(args) > 2 else V.boolean(False)
    return pick([cond.col], [c.value(args[1])], no).with_err() if cond.err is None else _guard(cond.err, pick([cond.col], [c.value(args[1])], no))


def _guard(err, v: V.Value) -> V.Value:
    return V.Value(v.kind, v.col, V.first_error(err, v.err))


@function("IFS", 2, None)
def _ifs(c, args):
    if len(args) % 2:
        raise f.FormulaError("IFS takes pairs")
    out = V.failure(V.NA)
    for cond, value in reversed(list(zip(args[::2], args[1::2], strict=True))):
        test = c.bool(cond)
        out = pick([test.col], [c.value(value)], out)
        if test.err is not None:
            out = _guard(test.err, out)
    return out


def _all_any(is_and: bool):
    def build(c, args):
        cols, errs = [], []
        for a in args:
            v = c.value(a)
            if v.referenced and v.kind == V.TEXT:
                errs.append(v.err)
                continue
            b = V.to_bool(v)
            if v.referenced and v.kind == V.MIXED:  # cells that hold text don't count
                aside = V.is_blank(v) | v.col["s"].isNotNull()
                errs.append(v.err)
                cols.append(F.when(aside, F.lit(is_and)).otherwise(b.col))
                continue
            errs.append(b.err)
            cols.append(F.when(v.col.isNull(), F.lit(is_and)).otherwise(b.col) if v.referenced else b.col)
        if not cols:
            return V.failure(V.VALUE)
        out = cols[0]
        for x in cols[1:]:
            out = out & x if is_and else out | x
        return V.Value(V.BOOL, out, V.first_error(*errs))

    return build


function("AND", 1, None)(_all_any(True))
function("OR", 1, None)(_all_any(False))


@function("NOT", 1)
def _not(c, args):
    v = c.bool(args[0])
    return V.Value(V.BOOL, ~v.col, v.err)


def _fallback(args, c, condition):
    v, other = c.value(args[0]), c.value(args[1])
    if v.err is None:
        return v
    bad = condition(v.err)
    left = V.Value(v.kind, v.col, F.when(~bad, v.err), v.referenced)
    return pick([F.coalesce(bad, F.lit(False))], [other], left)


@function("IFERROR", 2)
def _iferror(c, args):
    return _fallback(args, c, lambda e: e.isNotNull())


@function("IFNA", 2)
def _ifna(c, args):
    return _fallback(args, c, lambda e: F.coalesce(e == V.NA, F.lit(False)))


def _is(test):
    def build(c, args):
        return V.Value(V.BOOL, test(c.value(args[0])))

    return build


def _good(v: V.Value):
    return F.lit(True) if v.err is None else v.err.isNull()


def _has(v: V.Value, *kinds: str):
    if v.kind == V.MIXED:
        own = [v.col[{V.NUM: "n", V.TEXT: "s", V.BOOL: "b"}[k]].isNotNull() for k in kinds]
        return _good(v) & F.greatest(*own, F.lit(False))
    return (_good(v) & v.col.isNotNull()) if v.kind in kinds else F.lit(False)


function("ISBLANK", 1)(_is(lambda v: _good(v) & V.is_blank(v) if v.referenced else F.lit(False)))
function("ISNUMBER", 1)(_is(lambda v: _has(v, V.NUM)))
function("ISTEXT", 1)(_is(lambda v: _has(v, V.TEXT)))
function("ISLOGICAL", 1)(_is(lambda v: _has(v, V.BOOL)))
function("ISERROR", 1)(_is(lambda v: F.lit(False) if v.err is None else v.err.isNotNull()))
function("ISERR", 1)(_is(lambda v: F.lit(False) if v.err is None else F.coalesce(v.err != V.NA, F.lit(False))))
function("ISNA", 1)(_is(lambda v: F.lit(False) if v.err is None else F.coalesce(v.err == V.NA, F.lit(False))))


@function("NA", 0)
def _na(c, args):
    return V.failure(V.NA)


@function("TYPE", 1)
def _type(c, args):
    v = c.value(args[0])
    code = {V.NUM: 1, V.EMPTY: 1, V.TEXT: 2, V.BOOL: 4}[v.kind]
    out = F.when(v.col.isNull(), F.lit(1.0)).otherwise(F.lit(float(code))) if v.referenced else F.lit(float(code))
    return V.Value(V.NUM, out if v.err is None else F.when(v.err.isNotNull(), F.lit(16.0)).otherwise(out))


@function("ISREF", 1)
def _isref(c, args):
    return V.boolean(isinstance(args[0], (f.Header, f.Ref)))


@function("LET", 3, None)
def _let(c, args):
    if len(args) % 2 == 0 or not all(isinstance(a, f.Name) for a in args[:-1:2]):
        raise f.FormulaError("LET takes names with values and a calculation")
    own, errs = c, []
    for name, value in zip(args[:-1:2], args[1:-1:2], strict=True):
        v = own.value(value)
        errs.append(v.err)
        own = replace(own, bound={**own.bound, name.name.upper(): v})
    out = own.value(args[-1])
    return V.Value(out.kind, out.col, V.first_error(*errs, out.err))


@function("CHOOSE", 2, None)
def _choose(c, args):
    i = c.num(args[0])
    n = F.floor(i.col)
    branches = [c.value(a) for a in args[1:]]
    out = pick([n == k + 1 for k in range(len(branches))], branches, V.failure(V.VALUE))
    return out if i.err is None else _guard(i.err, out)
