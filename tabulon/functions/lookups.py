"""Lookup functions over named tables: ``Rates`` is a table, ``Rates.owed`` its column.

A lookup joins the named table to the formula's frame: its rows are reduced to one per key
first, so the frame keeps its rows, and Catalyst chooses the join by measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.plans import formula as f

from . import values as V
from .logic import pick
from .registry import function


def _position(t) -> DataFrame:
    """A named table's rows with ``_p``, their position from 0."""
    return t.frame.withColumn("_p", F.col(t.position) if t.position else F.monotonically_increasing_id())


def _table(c, node):
    if not isinstance(node, f.Name) or node.name.upper() not in c.tables:
        raise f.FormulaError("this argument has to be a named table")
    return c.tables[node.name.upper()]


def _column(c, node):
    """The table and column that ``Table.Header`` names."""
    if isinstance(node, f.Name) and "." in node.name:
        table, _, header = node.name.partition(".")
        t = c.tables.get(table.upper())
        own = None if t is None else t._compiler().column_of(header)
        if own is not None:
            return t, own
    raise f.FormulaError("this argument has to be a named table's column, such as Rates.owed")


def _folded(v: V.Value) -> Column:
    return F.lower(v.col) if v.kind == V.TEXT else v.col


def _key_of(frame: DataFrame, name: str) -> V.Value:
    return V.of_column(F.col(f"`{name}`"), frame.schema[name].dataType)


def joined(c, x: V.Value, t, key: str, wanted: str | None, approximate: bool = False) -> V.Value:
    """The value of ``wanted`` (None: the position, from 1) in the row that matches x; no row is #N/A."""
    from tabulon.operators.lookup import approximate_lookup

    dim = _position(t)
    k = _key_of(dim, key)
    kind = T.DoubleType() if wanted is None else dim.schema[wanted].dataType
    if k.kind != x.kind and x.kind != V.EMPTY:
        return V.failure(V.NA)
    n = len(c.held[0].columns)
    at, hit, found = f"_k{n}", f"_h{n}", f"_v{n}"
    value = (F.col("_p") + 1).cast("double") if wanted is None else F.col(f"`{wanted}`")
    frame = c.held[0].withColumn(at, _folded(x))
    if approximate:
        if k.kind != V.NUM:
            raise f.FormulaError("an approximate lookup takes numbers")
        rows = dim.where(k.col.isNotNull()).groupBy(k.col.alias(hit)).agg(F.max_by(value, "_p").alias(found))
        c.held[0] = approximate_lookup(frame, at, rows.withColumn("_own", F.col(hit)), hit, {hit: "_own", found: found})
    else:
        rows = dim.where(k.col.isNotNull()).groupBy(_folded(k).alias(hit)).agg(F.min_by(value, "_p").alias(found))
        c.held[0] = frame.join(rows, F.col(at) == F.col(hit), "left")
    out = V.of_column(F.col(found), kind)
    miss = V.when_error(F.col(hit).isNull(), V.NA)
    return V.Value(out.kind, out.col, V.first_error(x.err, miss))


@function("VLOOKUP", 3, 4)
def _vlookup(c, args):
    t = _table(c, args[1])
    i = int(c.constant(args[2]))
    flag = c.constant(args[3] if len(args) > 3 else None, True)
    names = t.frame.columns
    if i < 1:
        return V.failure(V.VALUE)
    if i > len(names):
        return V.failure(V.REF)
    out = joined(c, c.value(args[0]), t, names[0], names[i - 1], bool(flag))
    return V.Value(out.kind, F.coalesce(out.col, F.lit(0.0)) if out.kind == V.NUM else out.col, out.err)


@function("XLOOKUP", 3, 5)
def _xlookup(c, args):
    t, key = _column(c, args[1])
    other, wanted = _column(c, args[2])
    if other is not t or len(args) > 4 and c.constant(args[4], 0.0) not in (0.0, 2.0):
        return V.failure(V.VALUE)
    out = joined(c, c.value(args[0]), t, key, wanted)
    if len(args) > 3 and not isinstance(args[3], f.Missing):
        missed = F.coalesce(out.err == V.NA, F.lit(False))
        return pick([missed], [c.value(args[3])], V.Value(out.kind, out.col, F.when(~missed, out.err)))
    return out


@function("LOOKUP", 3)
def _lookup(c, args):
    t, key = _column(c, args[1])
    _, wanted = _column(c, args[2])
    return joined(c, c.value(args[0]), t, key, wanted, approximate=True)


@function("MATCH", 2, 3)
def _match(c, args):
    t, key = _column(c, args[1])
    mode = c.constant(args[2] if len(args) > 2 else None, 1.0)
    if mode < 0:
        raise f.FormulaError("for the last cell at or above a value use tabulon.operators.lookup.match_position")
    return joined(c, c.value(args[0]), t, key, None, approximate=mode > 0)


@function("XMATCH", 2, 4)
def _xmatch(c, args):
    t, key = _column(c, args[1])
    mode = c.constant(args[2] if len(args) > 2 else None, 0.0)
    if mode not in (0.0, -1.0):
        raise f.FormulaError("use tabulon.operators.lookup.nearest_position for this mode")
    return joined(c, c.value(args[0]), t, key, None, approximate=mode < 0)


@function("INDEX", 2, 3)
def _index(c, args):
    """A cell by position: of a named column, or of a named table by row and column."""
    i = int(c.constant(args[1]))
    if isinstance(args[0], f.Name) and "." in args[0].name:
        t, name = _column(c, args[0])
    else:
        t = _table(c, args[0])
        j = int(c.constant(args[2] if len(args) > 2 else None, 1.0))
        if not 1 <= j <= len(t.frame.columns):
            return V.failure(V.REF)
        name = t.frame.columns[j - 1]
    if i < 1:
        return V.failure(V.VALUE)
    rows = _position(t).where(F.col("_p") == i - 1)
    cell = V.of_column(rows.agg(F.min(f"`{name}`")).scalar(), t.frame.schema[name].dataType)
    there = rows.agg(F.count("*")).scalar()
    return V.Value(cell.kind, cell.col, V.when_error(there == 0, V.REF), referenced=False)


@function("ROWS", 1)
def _rows(c, args):
    frame = _table(c, args[0]).frame if isinstance(args[0], f.Name) else c.staged
    return V.Value(V.NUM, frame.agg(F.count("*").cast("double")).scalar())


@function("COLUMNS", 1)
def _columns(c, args):
    return V.number(float(len(_table(c, args[0]).frame.columns) if isinstance(args[0], f.Name) else 1))


@function("ROW", 0, 1)
def _row(c, args):
    """The row's number, from 1, in the order of the position column."""
    if not c.position:
        raise f.FormulaError("ROW needs the rows' position")
    return V.Value(V.NUM, (F.col(c.position) + 1).cast("double"))


@function("COLUMN", 1)
def _column_number(c, args):
    """The place of a header among the frame's columns, from 1."""
    if not isinstance(args[0], f.Header):
        return V.failure(V.VALUE)
    own = c.column_of(args[0].name)
    return V.failure(V.REF) if own is None else V.number(float(c.frame.columns.index(own) + 1))
