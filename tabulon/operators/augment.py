"""Variants of recorded workbooks: literal rows repeated, literals scaled; and what a run changed beside its task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import values as V

from .cells import typed, within


def _formula(c: str = "input"):
    return F.col(c).startswith("=") & (F.char_length(c) > 1)


def append_rows(cells: DataFrame, sheet: str, count: int, key: str = "workbook_id") -> DataFrame:
    """``cells`` with each workbook's last used row of a sheet repeated ``count`` times below it: its literals, not its formulas."""
    filled = cells.where((F.col("sheet") == sheet) & F.col("input").isNotNull() & (F.col("input") != ""))
    last = filled.groupBy(key).agg(F.max("r").alias("r"))
    rows = filled.where(~_formula()).join(last, [key, "r"]).select(key, "sheet", "r", "c", "input")
    steps = F.sequence(F.lit(1), F.lit(count)) if count > 0 else F.array().cast("array<int>")
    more = rows.withColumn("_step", F.explode(steps)).withColumn("r", F.col("r") + F.col("_step")).drop("_step")
    return cells.select(key, "sheet", "r", "c", "input").unionByName(more)


def scale_literals(cells: DataFrame, sheet: str, area: tuple[int, int, int, int], factor: float) -> DataFrame:
    """``cells`` with the numbers typed in a range multiplied; formulas, texts and what lies outside stay."""
    r0, c0, r1, c1 = area
    own = typed(cells)
    scaled = F.when(within(sheet, r0, c0, r1, c1) & (F.col("kind") == "num"), V.display_number(F.col("n") * F.lit(float(factor))))
    return own.withColumn("input", F.coalesce(scaled, "input")).select(*cells.columns)


def incidental_changes(changed: DataFrame, areas: DataFrame, key: str = "task_id") -> DataFrame:
    """Changed cells (``key, sheet, r, c``) that no check of their task names (``key, sheet, r0, c0, r1, c1``)."""
    a, b = changed.alias("a"), areas.alias("b")
    named = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.lower("a.sheet") == F.lower("b.sheet")) & F.col("a.r").between(F.col("b.r0"), F.col("b.r1")) & F.col("a.c").between(F.col("b.c0"), F.col("b.c1"))
    return a.join(b, named, "left_anti")


def recipe_outcomes(variants: DataFrame, graded: DataFrame, key: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): variants whose replay passes all its checks, and the others with the checks that failed.

    variants: ``key, ...``; graded: the rows of :func:`tabulon.operators.tasks.grade`. A variant without a graded check is rejected.
    """
    by = graded.groupBy(key).agg(F.bool_and("passed").alias("_passed"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))).alias("failed"))
    own = variants.join(by, key, "left")
    return own.where(F.coalesce("_passed", F.lit(False))).drop("_passed", "failed"), own.where(~F.coalesce("_passed", F.lit(False))).drop("_passed")
