"""Sheets as cells, one row each: ``sheet, r, c, input``; edits are frames to frames.

Positions are zero-based. An input is what was typed: ``=`` starts a formula, ``'`` a text.
Structural edits move cells and rewrite references of all formulas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import values as V
from tabulon.plans import formula as f

SCHEMA = "sheet string, r int, c int, input string"


def typed(cells: DataFrame) -> DataFrame:
    """``cells`` with ``kind``, ``n``, ``s``, ``b``, ``err``: what was typed, read as a value."""
    x = F.col("input")
    n = V.parse_number(x)
    error = x.isin(*f.ERRORS)
    kind = (
        F.when(x.isNull() | (x == ""), "empty").when(x.startswith("=") & (F.char_length(x) > 1), "formula").when(x.startswith("'"), "text").when(n.isNotNull(), "num")
        .when(F.upper(x).isin("TRUE", "FALSE"), "bool").when(error, "error").otherwise("text")
    )
    own = cells.withColumn("kind", kind)
    k = F.col("kind")
    return own.withColumns({
        "n": F.when(k == "num", n), "s": F.when(k == "text", F.when(x.startswith("'"), F.substr(x, F.lit(2))).otherwise(x)),
        "b": F.when(k == "bool", F.upper(x) == "TRUE"), "err": F.when(k == "error", x),
    })


def within(sheet: str, r0: int, c0: int, r1: int, c1: int) -> Column:
    return (F.col("sheet") == sheet) & F.col("r").between(r0, r1) & F.col("c").between(c0, c1)


def edit(cells: DataFrame, sheet: str, r: int, c: int, text: str) -> DataFrame:
    one = cells.sparkSession.createDataFrame([(sheet, r, c, text)], SCHEMA)
    return cells.where(~within(sheet, r, c, r, c)).unionByName(one)


def clear(cells: DataFrame, sheet: str, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    return cells.where(~within(sheet, r0, c0, r1, c1))


def merge(cells: DataFrame, sheet: str, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """A merged area keeps its first cell."""
    return cells.where(~within(sheet, r0, c0, r1, c1) | ((F.col("r") == r0) & (F.col("c") == c0)))


def rewritten(cells: DataFrame, change: Callable) -> DataFrame:
    """``cells`` with every formula's tree changed by ``change(tree, sheet, r, c)``; what doesn't parse stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for sheet, r, c, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if text is not None and text.startswith("=") and len(text) > 1:
                    try:
                        text = "=" + f.to_text(change(f.parse(text), sheet, r, c))
                    except f.FormulaError:
                        pass
                out.append(text)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], ["sheet", "r", "c", "input"])

    return cells.select("sheet", "r", "c", "input").mapInArrow(run, SCHEMA)


def insert(cells: DataFrame, axis: str, sheet: str, at: int, count: int) -> DataFrame:
    """Rows (``axis`` row) or columns inserted: cells move, references follow."""
    col = "r" if axis == "row" else "c"
    moved = cells.withColumn(col, F.when((F.col("sheet") == sheet) & (F.col(col) >= at), F.col(col) + count).otherwise(F.col(col)))
    return rewritten(moved, lambda tree, own, r, c: f.moved_by_insert(tree, axis, at, count, sheet, own))


def delete(cells: DataFrame, axis: str, sheet: str, at: int, count: int) -> DataFrame:
    """Rows or columns deleted: ranges shrink, references to what is gone become #REF!."""
    col = "r" if axis == "row" else "c"
    here = F.col("sheet") == sheet
    left = cells.where(~(here & F.col(col).between(at, at + count - 1)))
    moved = left.withColumn(col, F.when(here & (F.col(col) >= at + count), F.col(col) - count).otherwise(F.col(col)))
    return rewritten(moved, lambda tree, own, r, c: f.moved_by_delete(tree, axis, at, count, sheet, own))


def paste(cells: DataFrame, sheet: str, source: tuple[int, int, int, int], target: tuple[int, int], cut: bool = False) -> DataFrame:
    """An area copied (formulas shift) or moved (formulas stay as they are)."""
    r0, c0, r1, c1 = source
    dr, dc = target[0] - r0, target[1] - c0
    block = cells.where(within(sheet, r0, c0, r1, c1))
    if not cut:
        block = rewritten(block, lambda tree, own, r, c: f.shifted(tree, dr, dc))
    block = block.withColumns({"r": F.col("r") + dr, "c": F.col("c") + dc})
    rest = cells.where(~within(sheet, r0, c0, r1, c1)) if cut else cells
    return clear(rest, sheet, r0 + dr, c0 + dc, r1 + dr, c1 + dc).unionByName(block)


def rename_sheet(cells: DataFrame, old: str, new: str) -> DataFrame:
    def change(ref: f.Ref):
        return f.Ref(ref.first, ref.last, new) if ref.sheet is not None and ref.sheet.lower() == old.lower() else ref

    own = rewritten(cells, lambda tree, sheet, r, c: f.rewrite(tree, change))
    return own.withColumn("sheet", F.when(F.lower("sheet") == old.lower(), F.lit(new)).otherwise(F.col("sheet")))


def delete_sheet(cells: DataFrame, name: str) -> DataFrame:
    def change(ref: f.Ref):
        return f.Failure("#REF!") if ref.sheet is not None and ref.sheet.lower() == name.lower() else ref

    return rewritten(cells.where(F.lower("sheet") != name.lower()), lambda tree, sheet, r, c: f.rewrite(tree, change))


def find_replace(cells: DataFrame, find: str, new: str, match_case: bool = False, whole: bool = False) -> DataFrame:
    """Replacement in what was typed; a formula that no longer parses stays as it was."""
    import re

    pattern = "".join(f"[{x.upper()}{x.lower()}]" if not match_case and x.isascii() and x.isalpha() else re.escape(x) for x in find)
    pattern = f"^{pattern}$" if whole else pattern
    made = F.regexp_replace("input", pattern, new.replace("\\", "\\\\").replace("$", "\\$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for old, changed in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if changed is not None and changed.startswith("=") and changed != old:
                    try:
                        f.parse(changed)
                    except f.FormulaError:
                        changed = old
                out.append(changed)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], ["sheet", "r", "c", "input"])

    return cells.select("sheet", "r", "c", "input", made.alias("made")).mapInArrow(run, SCHEMA)


def shapes(cells: DataFrame) -> DataFrame:
    """``sheet, shape, n, first_r, first_c``: formulas grouped by what they are relative to their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r, c, text in zip(*(x.to_pylist() for x in b.columns[1:]), strict=True):
                try:
                    out.append(f.shape(f.parse(text), r, c))
                except f.FormulaError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], ["sheet", "r", "c", "shape"])

    own = cells.where(F.col("input").startswith("=") & (F.char_length("input") > 1)).select("sheet", "r", "c", "input").mapInArrow(run, "sheet string, r int, c int, shape string")
    first = F.min(F.struct("r", "c")).alias("first")
    return own.where("shape is not null").groupBy("sheet", "shape").agg(F.count("*").alias("n"), first).select("sheet", "shape", "n", F.col("first.r").alias("first_r"), F.col("first.c").alias("first_c"))
