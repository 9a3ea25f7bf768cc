"""References that depend on data, over tables: OFFSET, INDIRECT and HLOOKUP for every row at once.

A table is read as a grid: rows numbered from 0 in an order, columns as listed. Each asking row
makes an area of that grid. Sums, counts and means over areas come from a summed-area table by
two lookups a row, whatever the areas' sizes; other aggregates from a tree of blocks, of which
an area takes two at most at each level. Single cells are looked up by their row's number.

Grids are kept in compressed files, from whose size Catalyst takes them for far smaller than
they are. So joins with a grid of many rows name their kind, and none is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import values as V
from tabulon.plans.formula import MAX_COLS, MAX_ROWS

from .scratch import settle

#: Children of a block of the tree.
FAN = 32
#: Rows of a grid up to which Catalyst chooses how to join it, and blocks up to which a level of the tree is broadcast.
SMALL, TOP = 50_000, 1_024
_AT = ("r0", "c0", "r1", "c1")


def numbered(df: DataFrame, order: Sequence[str], name: str = "r") -> DataFrame:
    """``df`` with its rows numbered from 0 in the ascending order of columns, and ``_part``, the range of that order a row lies in.

    Rows are dealt by ranges of the order; a range starts after the rows of those before it.
    Rows that the order doesn't tell apart are numbered as they come.
    """
    keys = [F.col(f"`{c}`") for c in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = settle(placed, "numbered").withColumn("_part", F.shiftright("_place", 33).cast("int"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))  # a row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before - F.col("_first")).alias("_shift"))
    return placed.join(starts, "_part").withColumn(name, F.col("_place") + F.col("_shift")).drop("_place", "_shift")


class Grid:
    """Numeric columns of a table as a grid of cells; what isn't a number is an empty cell.

    ``scale``: digits after the point of exact decimal sums; without it sums are doubles.
    """

    def __init__(self, df: DataFrame, order: Sequence[str], columns: Sequence[str], scale: int | None = None):
        kind = "double" if scale is None else f"decimal(38,{scale})"
        self.columns, self.kind = list(columns), kind
        values = F.array(*[F.col(f"`{c}`").cast(kind) for c in columns])
        self.rows = settle(numbered(df.select(*[f"`{c}`" for c in order], values.alias("v")), order).select("r", "_part", "v"), "grid")
        self.size = self.rows.count()

    def joined(self, df: DataFrame, kind: str) -> DataFrame:
        """``df``, a table of the grid's rows, with the kind of its joins, unless the grid is small."""
        return df if self.size <= SMALL else df.hint(kind)

    def sums(self) -> DataFrame:
        """``r, s, n``: over all rows up to r, the sum and number of the first 0, 1, ... columns' cells."""
        k = range(len(self.columns))
        zero = F.lit(0).cast(self.kind)
        own = self.rows.select("r", "_part", *[F.coalesce(F.get("v", F.lit(j)), zero).alias(f"s{j}") for j in k], *[F.get("v", F.lit(j)).isNotNull().cast("long").alias(f"n{j}") for j in k])
        names = [f"{x}{j}" for x in "sn" for j in k]
        held = own.groupBy("_part").agg(*[F.sum(c).alias(c) for c in names])  # a row per range
        earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        held = held.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in names])
        within = Window.partitionBy("_part").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
        run = own.select("r", "_part", *[F.sum(c).over(within).alias(c) for c in names]).join(held, "_part")

        def along(x: str, start: Column) -> Column:
            out, parts = start, [start]
            for j in k:
                out = out + F.col(f"{x}{j}") + F.col(f"_{x}{j}")
                parts.append(out)
            return F.array(*parts)

        return run.select("r", along("s", zero).alias("s"), along("n", F.lit(0).cast("long")).alias("n"))

    def blocks(self) -> list[tuple[DataFrame, int]]:
        """Per level ``i, lo, hi`` and how many blocks it has: for each of the block's children, in their order, each column's least and greatest cell.

        A child of level 0 is a row, a child of another level is a block of the level before.
        """
        child = self.rows.select("r", F.col("v").alias("lo"), F.col("v").alias("hi"))
        out, n, k = [], self.size, range(len(self.columns))
        while True:
            n = -(-n // FAN)
            sides = F.array_sort(F.collect_list(F.struct("r", "lo", "hi")))
            level = child.groupBy(F.floor(F.col("r") / FAN).alias("i")).agg(sides.alias("x")).select("i", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
            level = settle(level, "blocks")
            out.append((level, n))
            if n <= 1:
                return out
            column = lambda c, j: F.transform(c, lambda x: F.get(x, F.lit(j)))
            best = [F.array(*[agg(column(c, j)) for j in k]).alias(c) for agg, c in ((F.array_min, "lo"), (F.array_max, "hi"))]
            child = level.select(F.col("i").alias("r"), *best)


def offset(rows: Column, columns: Column, height: Column | int = 1, width: Column | int = 1) -> Column:
    """OFFSET of the grid's first cell, as an area: ``r0, c0, r1, c1, err``. Outside of a sheet, or without cells, it is #REF!."""
    whole = lambda x: F.floor(x).cast("long") if isinstance(x, Column) else F.lit(x).cast("long")
    r, c, h, w = whole(rows), whole(columns), whole(height), whole(width)
    bad = (r < 0) | (c < 0) | (h < 1) | (w < 1) | (r + h > MAX_ROWS) | (c + w > MAX_COLS)
    err = F.when(F.coalesce(bad, F.lit(True)), F.lit(V.REF))
    return F.struct(r.alias("r0"), c.alias("c0"), (r + h - 1).alias("r1"), (c + w - 1).alias("c1"), err.alias("err"))


_CORNER = r"\$?([A-Z]{1,3})\$?([0-9]{1,7})"


def indirect(text: Column) -> Column:
    """INDIRECT of a text such as ``B12`` or ``$A$2:C9``, as an area of the grid. What is no reference is #REF!."""
    whole = F.upper(F.trim(text))
    pattern = f"^{_CORNER}(?::{_CORNER})?$"
    part = lambda i: F.regexp_extract(whole, pattern, i)
    column = lambda s: F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda n, x: F.when(x == "", n).otherwise(n * 26 + F.ascii(x) - 64)) - 1
    row = lambda s: s.try_cast("long") - 1
    one = part(3) == ""
    r, c = row(part(2)), column(part(1))
    r2, c2 = F.when(one, r).otherwise(row(part(4))), F.when(one, c).otherwise(column(part(3)))
    ok = F.coalesce(whole.rlike(pattern), F.lit(False))
    bad = ~ok | (F.least(r, r2) < 0) | (F.greatest(r, r2) >= MAX_ROWS) | (F.greatest(c, c2) >= MAX_COLS)
    err = F.when(F.coalesce(bad, F.lit(True)), F.lit(V.REF))
    return F.struct(F.least(r, r2).alias("r0"), F.least(c, c2).alias("c0"), F.greatest(r, r2).alias("r1"), F.greatest(c, c2).alias("c1"), err.alias("err"))


def _clipped(asking: DataFrame, area: str, grid: Grid) -> DataFrame:
    """``asking`` with ``_r0, _r1`` (both ends' rows; the first after the last where the grid has none) and ``_c0, _c1``."""
    a = F.col(area)
    return asking.withColumns({
        "_r0": F.greatest(a["r0"], F.lit(0)), "_r1": F.least(a["r1"], F.lit(grid.size - 1)),
        "_c0": F.least(a["c0"], F.lit(len(grid.columns))).cast("int"), "_c1": F.least(a["c1"], F.lit(len(grid.columns) - 1)).cast("int"),
    })


def _key(row: Column) -> Column:
    """``row``, or a row that no grid has where it is null: what asks for none would otherwise meet in one task."""
    return F.coalesce(row, -1 - F.monotonically_increasing_id().bitwiseAND(0xFFFFF))


def totals_over(asking: DataFrame, area: str, grid: Grid) -> DataFrame:
    """``asking`` with ``sum``, ``count``, ``average`` of the numbers in each row's area, and ``err``.

    An area's error comes first; the average of no numbers is #DIV/0!. Cells beyond the table are empty.
    """
    table = settle(grid.sums(), "sums")
    end = grid.joined(table.select(F.col("r").alias("_r1"), F.col("s").alias("_s1"), F.col("n").alias("_n1")), "merge")
    start = grid.joined(table.select((F.col("r") + 1).alias("_r0"), F.col("s").alias("_s0"), F.col("n").alias("_n0")), "merge")
    own = _clipped(asking, area, grid).withColumn("_some", (F.col("_r0") <= F.col("_r1")) & (F.col("_c0") <= F.col("_c1")))
    met = own.withColumn("_r0", _key(F.when(F.col("_r0") > 0, F.col("_r0")))).withColumn("_r1", _key(F.col("_r1")))
    met = met.join(end, "_r1", "left").join(start, "_r0", "left")
    some = F.col("_some")

    def total(x: str, kind: str) -> Column:
        at = lambda side, c: F.coalesce(F.get(f"_{x}{side}", c), F.lit(0).cast(kind))
        lo, hi = F.col("_c0"), F.col("_c1") + 1
        return F.when(some, at(1, hi) - at(1, lo) - at(0, hi) + at(0, lo)).otherwise(F.lit(0).cast(kind))

    s, n, failed = total("s", grid.kind), total("n", "long"), F.col(area)["err"]
    own = met.withColumns({"sum": F.when(failed.isNull(), s.cast("double")), "count": F.when(failed.isNull(), n)})
    own = own.withColumn("err", F.coalesce(failed, F.when(F.col("count") == 0, F.lit(V.DIV0))))
    return own.withColumn("average", F.try_divide(F.col("sum"), F.col("count"))).select(*asking.columns, "sum", "count", "average", "err")


def _pieces(levels: int) -> Column:
    """Of the rows ``_r0`` to ``_r1``, the pieces ``level, i, first, n``: n children of block i from the first (0, 1, ...) on.

    At each level what is left is cut at the ends of blocks: whole blocks are left to the next
    level, a piece at either end is not. The last level has one block.
    """
    out = []
    for level in range(levels):
        size = FAN**level  # rows of a child
        a, b = F.expr(f"(_r0 + {size - 1}) div {size}"), F.expr(f"(_r1 + 1) div {size}")  # whole children
        up, down = F.expr(f"(_r0 + {size * FAN - 1}) div {size * FAN}"), F.expr(f"(_r1 + 1) div {size * FAN}")
        piece = lambda lo, hi, level=level: F.struct(F.lit(level).alias("level"), F.floor(lo / FAN).alias("i"), (lo % FAN).cast("int").alias("first"), (hi - lo).cast("int").alias("n"))
        within = F.lit(True) if level == levels - 1 else up > down  # both ends in one block
        out += [piece(a, F.when(within, b).otherwise(up * FAN)), piece(F.when(within, b).otherwise(down * FAN), b)]
    return F.filter(F.array(*out), lambda x: x["n"] > 0)


def extremes_over(asking: DataFrame, area: str, grid: Grid) -> DataFrame:
    """``asking`` with ``least`` and ``greatest`` of the numbers in each row's area (0 where there are none), and ``err``.

    Each distinct area is worked out once; it meets at most two blocks of each level. Levels of few blocks, which all wide areas share, are broadcast.
    """
    place = ["_r0", "_r1", "_c0", "_c1"]
    own = settle(_clipped(asking, area, grid), "asking")
    some = (F.col("_r0") <= F.col("_r1")) & (F.col("_c0") <= F.col("_c1")) & F.col(area)["err"].isNull()
    blocks = grid.blocks()
    asked = settle(own.where(some).select(*place).distinct().select("*", F.explode(_pieces(len(blocks))).alias("p")).select(*place, "p.*"), "pieces")
    found = None
    for level, (table, n) in enumerate(blocks):
        table = F.broadcast(table) if n <= TOP else table.hint("merge")
        met = asked.where(F.col("level") == level).join(table, "i")
        cells = lambda c: F.flatten(F.transform(F.slice(c, F.col("first") + 1, F.col("n")), lambda v: F.slice(v, F.col("_c0") + 1, F.col("_c1") - F.col("_c0") + 1)))
        here = met.select(*place, F.array_min(cells("lo")).alias("lo"), F.array_max(cells("hi")).alias("hi"))
        found = here if found is None else found.unionByName(here)
    best = grid.joined(found.groupBy(*place).agg(F.min("lo").alias("least"), F.max("hi").alias("greatest")), "merge")
    failed = F.col(area)["err"]
    shown = {c: F.when(failed.isNull(), F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in ("least", "greatest")}
    return own.join(best, place, "left").withColumns(shown | {"err": failed}).select(*asking.columns, "least", "greatest", "err")


def cell_at(asking: DataFrame, area: str, grid: Grid) -> DataFrame:
    """``asking`` with ``value``, the one cell of each row's area (0 where it is empty), and ``err``: areas of more cells are #VALUE!."""
    a = F.col(area)
    many = (a["r0"] != a["r1"]) | (a["c0"] != a["c1"])
    err = F.coalesce(a["err"], F.when(many, F.lit(V.VALUE)))
    cells = grid.joined(grid.rows.select(F.col("r").alias("_r"), "v"), "merge")
    own = asking.withColumns({"err": err, "_r": _key(F.when(err.isNull(), a["r0"])), "_c": a["c0"].cast("int")})
    value = F.when(F.col("err").isNull(), F.coalesce(F.get("v", F.col("_c")).cast("double"), F.lit(0.0)))
    return own.join(cells, "_r", "left").withColumn("value", value).select(*asking.columns, "value", "err")


def hlookup(asking: DataFrame, key: Column, grid: Grid, index: Column, approximate: bool = False) -> DataFrame:
    """``asking`` with ``value`` and ``err`` of HLOOKUP: the grid's headers are the first line, ``index`` 2 is the grid's row 0.

    Headers are compared without regard to case. approximate: the last header, of ascending
    ones, that isn't greater. No header is #N/A, an index below 1 #VALUE!, one beyond the table
    #REF!; index 1 gives no number and is #VALUE! too.
    """
    names = F.array(*[F.lit(c.lower()) for c in grid.columns])
    wanted = F.lower(key)
    place = F.size(F.filter(names, lambda x: x <= wanted)) if approximate else F.array_position(names, wanted).cast("int")
    at = F.floor(index).cast("long")
    own = asking.withColumns({"_j": F.coalesce(place, F.lit(0)), "_r": at - 2})
    err = F.when(F.coalesce(at < 2, F.lit(True)), F.lit(V.VALUE)).when(at > grid.size + 1, F.lit(V.REF)).when(F.col("_j") < 1, F.lit(V.NA))
    cells = grid.joined(grid.rows.select(F.col("r").alias("_r"), "v"), "merge")
    met = own.withColumn("err", err).withColumn("_r", _key(F.when(F.col("err").isNull(), F.col("_r")))).join(cells, "_r", "left")
    value = F.when(F.col("err").isNull(), F.coalesce(F.get("v", F.col("_j") - 1).cast("double"), F.lit(0.0)))
    return met.withColumn("value", value).select(*asking.columns, "value", "err")
