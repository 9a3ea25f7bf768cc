"""Lookups as joins: exact, approximate, by wildcard; positions and cells of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .table import boundaries, fold_key, range_bucket


def first_by_key(dim: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key (text without regard to case): the first by position, with the key as ``_key``."""
    row = F.struct(*[F.col(c) for c in dim.columns])
    return dim.where(F.col(key).isNotNull()).groupBy(fold_key(dim, key).alias("_key")).agg(F.min_by(row, position).alias("_dim"))


def exact_lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str, returns: dict[str, str], position: str, default: Column | None = None) -> DataFrame:
    """``df`` with columns of the first matching row of ``dim`` (new name -> its column); a miss is null or ``default``.

    Each row of ``df`` stays once. Catalyst broadcasts the reduced dimension if it is small by its size.
    """
    dim = first_by_key(dim, dim_key, position)
    joined = df.join(dim, fold_key(df, key) == F.col("_key"), "left")
    made = [F.when(F.col("_key").isNotNull(), F.col(f"_dim.{c}")).otherwise(F.lit(None) if default is None else default).alias(n) for n, c in returns.items()]
    return joined.select(*[df[c] for c in df.columns], *made)


def approximate_lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str, returns: dict[str, str], parts: int = 64, position: str | None = None) -> DataFrame:
    """``df`` with columns of the ``dim`` row of the greatest numeric key at or below the row's key; null below all.

    Of rows with equal keys the last by ``position`` counts, or without one that of the greatest values.

    Both sides are dealt into ranges of the key; within a range the last dimension row seen
    counts, and a range begins with the last one of the ranges before it. No task sees all rows.
    """
    cuts = boundaries(df.select(F.col(key).cast("double").alias("_k")), "_k", parts)
    hit = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(returns.values())])
    of_dim = dim.where(F.col(dim_key).isNotNull()).groupBy(F.col(dim_key).cast("double").alias("_k")).agg((F.max(hit) if position is None else F.max_by(hit, position)).alias("_hit"))
    of_dim = of_dim.withColumn("_b", range_bucket(F.col("_k"), cuts))
    left = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(key).cast("double").alias("_k"))
    left = left.withColumn("_b", F.when(F.col("_k").isNull(), -1).otherwise(range_bucket(F.col("_k"), cuts)))
    both = left.withColumn("_hit", F.lit(None).cast(of_dim.schema["_hit"].dataType)).withColumn("_side", F.lit(1))
    both = both.unionByName(of_dim.withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType)).withColumn("_side", F.lit(0)))
    order = Window.partitionBy("_b").orderBy("_k", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(order)).where("_side = 1")
    # at most parts + 1 rows: each range's last key, carried on
    ends = of_dim.groupBy("_b").agg(F.max_by("_hit", "_k").alias("_end"))
    ranges = dim.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_b"))
    carried = ranges.join(ends, "_b", "left").select("_b", F.last("_end", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    full = seen.join(carried, "_b", "left").withColumn("_hit", F.when(F.col("_k").isNotNull(), F.coalesce("_hit", "_carried")))
    return full.select("_row.*", *[F.col(f"_hit.r{i}").alias(n) for i, n in enumerate(returns)])


def wildcard_rows(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text matches a wildcard pattern."""
    from tabulon.functions.conditional import wildcard_pattern

    return df.where(F.col(column).rlike(wildcard_pattern(pattern)))


def match_position(df: DataFrame, column: str, x, position: str, mode: int = 0) -> DataFrame:
    """MATCH: one row ``position``: 0 the first equal, 1 the last at or below x, -1 the last at or above; null if none."""
    c = F.lower(F.col(column)) if isinstance(x, str) else F.col(column)
    want = F.lit(x.lower() if isinstance(x, str) else x)
    if mode == 0:
        return df.agg(F.min(F.when(c == want, F.col(position))).alias("position"))
    return df.agg(F.max(F.when(c <= want if mode > 0 else c >= want, F.col(position))).alias("position"))


def nearest_position(df: DataFrame, column: str, x: float, position: str, mode: int) -> DataFrame:
    """XMATCH -1 and 1: the equal cell, else the nearest smaller or larger one anywhere; the first of equals."""
    c = F.col(column)
    side = c <= x if mode < 0 else c >= x
    best = F.struct((-F.abs(c - x)).alias("d"), (-F.col(position)).alias("p"))
    return df.agg(F.max(F.when(side, best)).alias("b")).select((-F.col("b.p")).alias("position"))


def cell_at(df: DataFrame, position: str, row: int, column: str) -> DataFrame:
    """INDEX: the value of a column in the row of a position."""
    return df.where(F.col(position) == row).select(F.col(column).alias("value"))


def transpose_cells(cells: DataFrame) -> DataFrame:
    """Rows and columns of a cells frame swapped."""
    return cells.withColumns({"r": F.col("c"), "c": F.col("r")})


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that were added, removed or changed: keys, ``change`` and each column's value before and after."""
    a, b = before.select(*keys, F.struct(*columns).alias("_a")), after.select(*keys, F.struct(*columns).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    sides = [x for c in columns for x in (F.col(f"_a.{c}").alias(f"{c}_before"), F.col(f"_b.{c}").alias(f"{c}_after"))]
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", *sides)
