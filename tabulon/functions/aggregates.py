"""Aggregates: over a table, or over the arguments of a row."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.plans import formula as f

from . import values as V
from .registry import function


def gathered(c, args) -> list[tuple[V.Value, Column, Column | None]]:
    """Each argument with its numbers: columns give numbers alone, others are coerced."""
    out = []
    for a in args:
        v = c.value(a)
        if v.referenced or any(isinstance(n, f.Header) for n in f.walk(a)):
            out.append((v, V.numbers_of(v), v.err))
        else:
            n = V.to_number(v)
            out.append((v, n.col, n.err))
    return out


def first_of_rows(c, err: Column | None) -> Column | None:
    """The first error over the rows."""
    if err is None:
        return None
    return F.min_by(err, F.when(err.isNotNull(), F.col(c.position))) if c.position else F.min(err)


def over_rows(build):
    """An aggregate whose arguments are columns (or row expressions): ``build(compiler, numbers, values)``."""

    def make(c, args):
        if not any(isinstance(n, f.Header) for a in args for n in f.walk(a)):
            return of_constants(c, args, build)

        def run(own):
            found = gathered(own, args)
            constant = [x for x, a in zip(found, args, strict=True) if not any(isinstance(n, f.Header) for n in f.walk(a))]
            columns = [x for x, a in zip(found, args, strict=True) if any(isinstance(n, f.Header) for n in f.walk(a))]
            out = build(own, [F.when(x[2].isNull(), x[1]) if x[2] is not None else x[1] for x in columns], [x[0] for x in columns], [x[1] for x in constant])
            err = V.first_error(*(first_of_rows(c, x[2]) for x in columns), *(F.max(x[2]) for x in constant if x[2] is not None))
            return V.Value(out.kind, out.col, V.first_error(err, out.err))

        return c.aggregate(run)

    return make


def of_constants(c, args, build):
    """No column among the arguments: fold them as one row's values."""
    values = [c.num(a) for a in args]
    rows = F.array(*[v.col for v in values])
    out = build(c, None, values, rows)
    return V.Value(out.kind, out.col, V.first_error(*(v.err for v in values), out.err))


def _stat(of_column, of_array, when_none: float | None = None, code: str | None = None):
    """An aggregate by its column form (from a list of columns) and its array form."""

    def build(c, columns, values, constants):
        if columns is None:
            out = of_array(constants)
        else:
            out = of_column(columns, constants)
        if code is not None:
            return V.Value(V.NUM, out, V.when_error(out.isNull(), code))
        return V.Value(V.NUM, F.coalesce(out, F.lit(when_none)))

    return over_rows(build)


def _total(columns, constants):
    parts = [F.coalesce(F.sum(x), F.lit(0.0)) for x in columns] + constants
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _count(columns, constants):
    out = F.lit(float(len(constants)))
    for x in columns:
        out = out + F.count(x)
    return out


def _extreme(agg, pick):
    def of(columns, constants):
        parts = [agg(x) for x in columns] + constants
        return parts[0] if len(parts) == 1 else pick(*parts)

    return of


def _sum_array(a):
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _one(agg):
    """An aggregate of one column."""

    def of(columns, constants):
        if len(columns) != 1 or constants:
            raise f.FormulaError("this aggregate takes one column")
        return agg(columns[0])

    return of


def _spread(a, sample):
    n = F.size(a)
    mean = _sum_array(a) / n
    squares = F.aggregate(a, F.lit(0.0), lambda x, y: x + (y - mean) * (y - mean))
    return F.when(n > sample, squares / (n - sample))


def _median_array(a):
    s, n = F.sort_array(a), F.size(a)
    return (F.element_at(s, F.floor((n + 1) / 2).try_cast("int")) + F.element_at(s, F.ceil((n + 1) / 2).try_cast("int"))) / 2


def _product(columns, constants):
    parts = [F.product(x) for x in columns] + constants
    out = parts[0]
    for p in parts[1:]:
        out = out * p
    return out


@function("SUM", 1, None)
def _sum(c, args):
    out = over_rows(lambda c, columns, values, constants: V.finite(_sum_array(constants) if columns is None else _total(columns, constants), None))(c, args)
    return out


function("PRODUCT", 1, None)(_stat(_product, lambda a: F.aggregate(a, F.lit(1.0), lambda x, y: x * y), 0.0))
function("AVERAGE", 1, None)(_stat(lambda cs, k: F.try_divide(_total(cs, k), _count(cs, k)), lambda a: _sum_array(a) / F.size(a), code=V.DIV0))
function("MIN", 1, None)(_stat(_extreme(F.min, F.least), F.array_min, 0.0))
function("MAX", 1, None)(_stat(_extreme(F.max, F.greatest), F.array_max, 0.0))
function("MEDIAN", 1, None)(_stat(_one(F.median), _median_array, code=V.NUMERR))
function("STDEV", 1, None)(_stat(_one(F.stddev_samp), lambda a: F.sqrt(_spread(a, 1)), code=V.DIV0))


@function("COUNT", 1, None)
def _count_numbers(c, args):
    def run(own):
        out = F.lit(0.0)
        for a in args:
            v = own.value(a)
            if v.referenced or any(isinstance(n, f.Header) for n in f.walk(a)):
                number = V.numbers_of(v)
                good = number.isNotNull() if v.err is None else number.isNotNull() & v.err.isNull()
                out = out + (F.count(F.when(good, 1)) if v.kind in (V.NUM, V.MIXED) else F.lit(0.0))
            else:
                n = V.to_number(v)
                out = out + (F.lit(0.0 if v.kind == V.EMPTY else 1.0) if n.err is None else F.max(F.when(n.err.isNull(), 1.0).otherwise(0.0)))
        return V.Value(V.NUM, out.cast("double"))

    return c.aggregate(run)


@function("COUNTA", 1, None)
def _counta(c, args):
    def run(own):
        out = F.lit(0.0)
        for a in args:
            v = own.value(a)
            filled = ~V.is_blank(v) if v.err is None else ~V.is_blank(v) | v.err.isNotNull()
            out = out + F.count(F.when(filled, 1))
        return V.Value(V.NUM, out.cast("double"))

    return c.aggregate(run)


@function("COUNTBLANK", 1)
def _countblank(c, args):
    def run(own):
        v = own.value(args[0])
        blank = v.col.isNull() | (v.col == "") if v.kind == V.TEXT else v.col.isNull()
        if v.err is not None:
            blank = blank & v.err.isNull()
        return V.Value(V.NUM, F.count(F.when(blank, 1)).cast("double"))

    return c.aggregate(run)


def ungrouped(c, what: str) -> None:
    if c.mode == "summary" and c.grouped:
        raise f.FormulaError(f"{what} by group: use tabulon.operators.table")


def nth(c, column: Column, k: V.Value, largest: bool) -> V.Value:
    """The k-th number from an end: a bounded top-k of the table, not a sort of it."""
    ungrouped(c, "LARGE and SMALL")
    if k.literal is None:
        raise f.FormulaError("k has to be a constant")
    i = int(k.literal)
    if i < 1:
        return V.failure(V.NUMERR)
    rows = c.staged.select(column.alias("v")).where("v is not null")
    best = rows.orderBy(F.col("v").desc() if largest else F.col("v").asc()).limit(i)
    end = best.agg(F.when(F.count("*") == i, F.min("v") if largest else F.max("v")).alias("v")).scalar()
    return V.Value(V.NUM, end, V.when_error(end.isNull(), V.NUMERR))


def most_frequent(c, column: Column) -> V.Value:
    """The number with most rows, the earliest row's on a tie; if none repeats, #N/A."""
    ungrouped(c, "MODE")
    at = F.col(c.position) if c.position else F.monotonically_increasing_id()
    rows = c.staged.select(column.alias("v"), at.alias("p")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("p").alias("p"))
    best = rows.where("n > 1").orderBy(F.col("n").desc(), "p").limit(1).select("v").scalar()
    return V.Value(V.NUM, best, V.when_error(best.isNull(), V.NA))


def _end(largest: bool):
    def build(c, args):
        k = c.num(args[1])
        v = _rows(c).value(args[0])
        out = nth(c, v.col if v.kind == V.NUM else F.lit(None).cast("double"), k, largest)
        return _with_rows_error(c, v, out)

    return build


def _rows(c):
    return replace(c, mode="row", inside=True)


def _with_rows_error(c, v: V.Value, out: V.Value) -> V.Value:
    if v.err is None:
        return out
    err = c.staged.agg(first_of_rows(c, v.err).alias("e")).scalar()
    return V.Value(out.kind, out.col, V.first_error(err, out.err))


function("LARGE", 2)(_end(True))
function("SMALL", 2)(_end(False))


@function("MODE", 1)
def _mode(c, args):
    v = _rows(c).value(args[0])
    return _with_rows_error(c, v, most_frequent(c, v.col if v.kind == V.NUM else F.lit(None).cast("double")))


@function("RANK", 2, 3)
def _rank(c, args):
    """Competition rank of a number among a column's; to rank every row see ``tabulon.operators.table.rank_rows``."""
    order = c.constant(args[2] if len(args) > 2 else None, 0)
    if any(isinstance(n, f.Header) for n in f.walk(args[0])):
        raise f.FormulaError("to rank every row use tabulon.operators.table.rank_rows")
    x = c.num(args[0])

    def run(own):
        w = own.value(args[1])
        same = F.count_if(w.col == x.col)
        return V.Value(V.NUM, (F.count_if(w.col < x.col if order else w.col > x.col) + 1).cast("double"), V.first_error(x.err, V.when_error(same == 0, V.NA)))

    return c.aggregate(run)


@function("SUMPRODUCT", 1, None)
def _sumproduct(c, args):
    def run(own):
        product, errs = None, []
        for a in args:
            v = own.value(a)
            truth = v.col if v.kind == V.BOOL else v.col["b"] if v.kind == V.MIXED else F.lit(None).cast("boolean")
            n = F.coalesce(V.numbers_of(v), truth.cast("double"), F.lit(0.0))
            product = n if product is None else product * n
            errs.append(v.err)
        err = V.first_error(*errs)
        return V.finite(F.coalesce(F.sum(product if err is None else F.when(err.isNull(), product)), F.lit(0.0)), first_of_rows(c, err))

    return c.aggregate(run)


#: Codes of SUBTOTAL, and the first eleven of AGGREGATE.
_CODES = {
    1: (F.avg, V.DIV0), 2: (lambda x: F.count(x).cast("double"), None), 4: (F.max, 0.0), 5: (F.min, 0.0), 6: (F.product, 0.0),
    7: (F.stddev_samp, V.DIV0), 8: (F.stddev_pop, V.DIV0), 9: (F.sum, 0.0), 10: (F.var_samp, V.DIV0), 11: (F.var_pop, V.DIV0),
}


def _by_code(code: int, v: V.Value, visible: Column) -> V.Value:
    if code == 3:
        filled = v.col.isNotNull() if v.err is None else v.col.isNotNull() | v.err.isNotNull()
        return V.Value(V.NUM, F.count(F.when(visible & filled, 1)).cast("double"))
    agg, none = _CODES[code]
    shown = F.when(visible if v.err is None else visible & v.err.isNull(), v.col if v.kind == V.NUM else F.lit(None).cast("double"))
    out = agg(shown)
    return V.Value(V.NUM, out, V.when_error(out.isNull(), none)) if isinstance(none, str) else V.Value(V.NUM, out if none is None else F.coalesce(out, F.lit(none)))


@function("SUBTOTAL", 2)
def _subtotal(c, args):
    code = int(c.constant(args[0])) % 100

    def run(own):
        if code not in _CODES and code != 3:
            return V.failure(V.VALUE)
        v = own.value(args[1])
        visible = ~F.col(c.hidden) if c.hidden else F.lit(True)
        out = _by_code(code, v, visible)
        if code in (2, 3) or v.err is None:
            return out
        return V.Value(out.kind, out.col, V.first_error(first_of_rows(c, F.when(visible, v.err)), out.err))

    return c.aggregate(run)


def percentile_exclusive(column: Column, q: float) -> Column:
    """Linear at rank q*(n+1); null outside 1..n."""
    n = F.count(column)
    s = F.sort_array(F.collect_list(column))
    rank = F.lit(q) * (n + 1)
    low = F.floor(rank)
    at = lambda i: F.try_element_at(s, F.greatest(i, F.lit(1)).try_cast("int"))
    return F.when((rank >= 1) & (rank <= n), at(low) + (rank - low) * (at(F.least(low + 1, n)) - at(low)))


@function("AGGREGATE", 3, 4)
def _aggregate(c, args):
    code, option = int(c.constant(args[0])), int(c.constant(args[1], 0))
    k = c.constant(args[3]) if len(args) > 3 else None

    def run(own):
        if not 1 <= code <= 19 or not 0 <= option <= 7 or code >= 14 and k is None:
            return V.failure(V.VALUE)
        v = own.value(args[2])
        visible = ~F.col(c.hidden) if c.hidden and option in (1, 3, 5, 7) else F.lit(True)
        err = None if option in (2, 3, 6, 7) or v.err is None else first_of_rows(c, F.when(visible, v.err))
        shown = F.when(visible if v.err is None else visible & v.err.isNull(), v.col if v.kind == V.NUM else F.lit(None).cast("double"))
        if code <= 11:
            out = _by_code(code, v, visible)
        elif code == 12:
            m = F.median(shown)
            out = V.Value(V.NUM, m, V.when_error(m.isNull(), V.NUMERR))
        elif code == 13:
            out = most_frequent(c, shown)
        elif code in (14, 15):
            out = nth(c, shown, V.number(float(k)), code == 14)
        else:
            q = float(k) / 4 if code in (17, 19) else float(k)
            p = (F.percentile(shown, q) if 0 <= q <= 1 else F.lit(None).cast("double")) if code < 18 else percentile_exclusive(shown, q)
            out = V.Value(V.NUM, p, V.when_error(p.isNull(), V.NUMERR))
        return V.Value(out.kind, out.col, V.first_error(err, out.err))

    return c.aggregate(run)
