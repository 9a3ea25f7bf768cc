"""Summaries of workbooks as cells: views, filter menus, errors, dependencies, plans by shape.

Cells are evaluated ones (``key, sheet, r, c, input, kind, err, display``), many workbooks in one frame.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.plans import formula as f

from .scratch import settle

#: Fixed parameters: errors listed of a workbook, cells listed by fan-in, the longest chain that is followed.
ERRORS, MOST, DEEPEST = 32, 5, 32
#: Rows and columns of a tile: a range meets the cells of its tiles.
TILE_ROWS, TILE_COLUMNS = 1024, 64

Area = tuple[int, int, int, int]  # r0, c0, r1, c1; zero-based, inclusive


def a1(r: Column, c: Column) -> Column:
    """A cell's address, such as AB12."""
    letter = lambda x: F.char(F.floor(x) % 26 + 65)
    two, three = c - 26, c - 702
    letters = F.when(c < 26, letter(c)).when(c < 702, F.concat(letter(two / 26), letter(two))).otherwise(F.concat(letter(three / 676), letter(three / 26), letter(three)))
    return F.concat(letters, (r + 1).cast("string"))


def viewport(cells: DataFrame, sheet: str, r: int, c: int, rows: int, columns: int) -> DataFrame:
    """A rectangle's cells in reading order."""
    here = (F.col("sheet") == sheet) & F.col("r").between(r, r + rows - 1) & F.col("c").between(c, c + columns - 1)
    return cells.where(here).orderBy("r", "c")


def column_values(cells: DataFrame, sheet: str, area: Area, c: int) -> DataFrame:
    """``value``: what a filter menu offers for a column: its distinct shown texts below the header, "" where a cell is empty, sorted."""
    r0, _, r1, _ = area
    own = cells.where((F.col("sheet") == sheet) & (F.col("c") == c) & F.col("r").between(r0 + 1, r1)).select("r", F.coalesce("display", F.lit("")).alias("value"))
    values = own.groupBy("value").agg(F.count_distinct("r").alias("n"))
    absent = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where(F.col("n") < r1 - r0).select(F.lit("").alias("value"))
    return values.select("value").unionAll(absent).distinct().orderBy("value")


def errors_by_book(cells: DataFrame, key: str = "workbook_id", most: int = ERRORS) -> DataFrame:
    """``key, total, errors``: how many cells of a workbook show an error, and the first of them by sheet and place."""
    wrong = cells.where("err is not null").select(key, F.struct("sheet", "r", "c", F.col("err").alias("code"), F.when(F.col("input").startswith("="), F.col("input")).alias("formula")).alias("e"))
    place = Window.partitionBy(key).orderBy("e.sheet", "e.r", "e.c")
    listed = wrong.withColumn("_i", F.row_number().over(place)).where(F.col("_i") <= most)
    return wrong.groupBy(key).agg(F.count("*").alias("total")).join(listed.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("errors")), key)


_AREAS = pa.list_(pa.struct([("sheet", pa.string()), ("r0", pa.int32()), ("c0", pa.int32()), ("r1", pa.int32()), ("c1", pa.int32())]))


def _areas(text: str) -> list[dict]:
    try:
        refs = f.references(f.parse(text))
    except f.FormulaError:
        return []
    top = 2**31 - 1
    low = lambda x, end: end if x is None else x
    out = []
    for x in refs:
        rows, columns = sorted((low(x.first.row, 0), low(x.last.row, top))), sorted((low(x.first.col, 0), low(x.last.col, top)))
        out.append({"sheet": x.sheet and x.sheet.lower(), "r0": rows[0], "c0": columns[0], "r1": rows[1], "c1": columns[1]})
    return out


def _formulas(cells: DataFrame, key: str) -> DataFrame:
    return settle(cells.where(F.col("input").startswith("=") & (F.char_length("input") > 1)).select(key, "sheet", "r", "c", "input"), "formulas")


def dependents(cells: DataFrame, key: str = "workbook_id") -> DataFrame:
    """``key, sheet, r, c, by``: formula cells, and each formula cell (``by``: sheet, r, c) that reads them.

    Ranges are cut to what their sheet uses and meet cells by tiles.
    """

    def run(column: pa.Array) -> pa.Array:
        return pa.array([_areas(t) for t in column.to_pylist()], _AREAS)

    kind = "array<struct<sheet: string, r0: int, c0: int, r1: int, c1: int>>"
    own = _formulas(cells, key)
    reads = own.select(key, F.struct("sheet", "r", "c").alias("by"), F.explode(F.array_distinct(F.arrow_udf(run, kind)("input"))).alias("a"))
    reads = reads.withColumn("_sheet", F.coalesce("a.sheet", F.lower("by.sheet")))
    used = own.groupBy(key, F.lower("sheet").alias("_sheet")).agg(F.max("r").alias("_r"), F.max("c").alias("_c"))
    tiles = lambda lo, hi, size: F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))
    cut = reads.join(used, [key, "_sheet"]).withColumns({"r1": F.least("a.r1", "_r"), "c1": F.least("a.c1", "_c")}).where("a.r0 <= r1 and a.c0 <= c1")
    cut = cut.withColumn("_i", tiles(F.col("a.r0"), F.col("r1"), TILE_ROWS)).withColumn("_j", tiles(F.col("a.c0"), F.col("c1"), TILE_COLUMNS)).drop("_r", "_c")
    target = own.select(key, "sheet", "r", "c", F.lower("sheet").alias("_sheet"), F.floor(F.col("r") / TILE_ROWS).alias("_i"), F.floor(F.col("c") / TILE_COLUMNS).alias("_j"))
    inside = target.join(cut, [key, "_sheet", "_i", "_j"]).where("r between a.r0 and r1 and c between a.c0 and c1")
    return inside.select(key, "sheet", "r", "c", "by").distinct()


def dependency_summary(cells: DataFrame, key: str = "workbook_id", most: int = MOST, deepest: int = DEEPEST) -> DataFrame:
    """``key, formula_cells, leaf_formulas, max_depth, most_depended_on`` of each workbook with formulas.

    A leaf is a formula that no formula reads. Depth is how often leaves can be peeled off, ``deepest``
    at most; a circle is never peeled. Of equal counts the first address by text is listed.
    """
    edges = settle(dependents(cells, key), "dependents")
    own = _formulas(cells, key)
    read = edges.groupBy(key, "sheet", "r", "c").agg(F.count("*").alias("n")).withColumn("at", F.concat("sheet", F.lit("!"), a1(F.col("r"), F.col("c"))))
    first = Window.partitionBy(key).orderBy(F.desc("n"), "at")
    top = read.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= most)
    listed = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "at", "n"))).alias("_top"))
    # cells that nothing left reads are peeled off round by round; circles, and what they read, stay
    left = own.select(key, F.struct("sheet", "r", "c").alias("cell"))
    depth = None
    for k in range(1, deepest + 1):
        still = edges.join(left.select(key, F.col("cell").alias("by")), [key, "by"], "left_semi").select(key, F.struct("sheet", "r", "c").alias("cell")).distinct()
        still = settle(still, "chains")
        after = still.groupBy(key).agg(F.count("*").alias("_m"))
        peeled = settle(left.groupBy(key).agg(F.count("*").alias("_n")).join(after, key, "left").where("_n > coalesce(_m, 0)").select(key, F.lit(k).alias("depth")), "peeled")
        depth = peeled if depth is None else depth.unionAll(peeled)
        left = still.join(peeled.select(key), key, "left_semi")
        if left.isEmpty():
            break
    depth = settle(depth.groupBy(key).agg(F.max("depth").alias("max_depth")), "depths")
    out = own.groupBy(key).agg(F.count("*").alias("formula_cells")).join(read.groupBy(key).agg(F.count("*").alias("_read")), key, "left").join(depth, key, "left").join(listed, key, "left")
    shown = F.transform(F.coalesce("_top", F.array().cast("array<struct<_i: int, at: string, n: bigint>>")), lambda x: F.struct(x["at"], x["n"]))
    return out.select(key, "formula_cells", (F.col("formula_cells") - F.coalesce("_read", F.lit(0))).alias("leaf_formulas"), F.coalesce("max_depth", F.lit(0)).alias("max_depth"), shown.alias("most_depended_on"))


def plan_shapes(plans: DataFrame, support: int, most_words: int = 8) -> DataFrame:
    """``id, shape, support, slots, keywords`` of plan shapes that at least ``support`` plans have, the most first.

    plans: ``shape`` (array of step names), ``bindings`` (array of texts), ``instruction``. A slot
    lists the bindings seen there, the most frequent first; keywords are words that more than half of a shape's instructions hold.
    """
    own = plans.withColumn("id", F.array_join("shape", " -> "))
    shapes = own.groupBy("id").agg(F.first("shape").alias("shape"), F.count("*").alias("support")).where(F.col("support") >= support)
    seen = own.select("id", F.posexplode("bindings").alias("slot", "value")).where("value is not null").groupBy("id", "slot", "value").agg(F.count("*").alias("n"))
    by_slot = seen.groupBy("id", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))), lambda x: x["value"]).alias("seen"))
    slots = by_slot.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "seen"))), lambda x: x["seen"]).alias("slots"))
    words = own.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("instruction", F.lit(""))), F.lit(r"([a-z]{3,})"), F.lit(1)))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    place = Window.partitionBy("id").orderBy(F.desc("n"), "word")
    common = words.join(shapes.select("id", "support"), "id").where(F.col("n") * 2 > F.col("support")).withColumn("_i", F.row_number().over(place)).where(F.col("_i") <= most_words)
    common = common.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "word"))), lambda x: x["word"]).alias("keywords"))
    return shapes.join(slots, "id", "left").join(common, "id", "left").orderBy(F.desc("support"), "id")
