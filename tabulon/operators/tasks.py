"""Tasks over workbook states: grading, recorded runs, corrections, scorecards.

States are frames of cells with their values: ``sheet, r, c, input, display, n, err``, by a
run's key. Checks are rows; grading joins them to the cells they are about.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A check: what, where (inclusive, zero-based), and what is expected there.
CHECK = (
    "struct<check:string,sheet:string,r0:int,c0:int,r1:int,c1:int,other:struct<sheet:string,r0:int,c0:int,r1:int,c1:int>,expect:string,tolerance:double,names:array<string>>"
)
KINDS = ("CellDisplays", "CellNumber", "CellFormula", "RangeFilled", "SumsMatch", "SumEquals", "NoErrors", "Unchanged", "SheetsExist", "NameRefersTo")


def _in(area: str) -> Column:
    a = lambda x: F.col(f"{area}.{x}")
    return (F.lower("v.sheet") == F.lower(a("sheet"))) & F.col("v.r").between(a("r0"), a("r1")) & F.col("v.c").between(a("c0"), a("c1"))


def grade(tasks: DataFrame, state: DataFrame, initial: DataFrame, books: DataFrame, key: str = "task_id") -> DataFrame:
    """``key, index, check, passed`` for every check of every task.

    tasks: ``key, checks``; state and initial: cells after and before; books: ``key, sheets
    (array), names (map)``. A check without its cells fails, but for NoErrors and Unchanged.
    """
    checks = tasks.select(key, F.posexplode("checks").alias("index", "check"))
    cell = lambda f: F.struct(key, "sheet", "r", "c", *f)
    now = state.select(cell(["input", "display", "n", "err"]).alias("v"))
    was = initial.select(cell(["input"]).alias("v"))
    here = checks.where("check.check not in ('SheetsExist', 'NameRefersTo')")
    own = here.join(now, (F.col(key) == F.col(f"v.{key}")) & (_in("check") | _in("check.other")))
    inside, other = _in("check"), _in("check.other")
    filled = F.col("v.input").isNotNull() & (F.col("v.input") != "")
    sums = own.groupBy(key, "index").agg(
        F.count(F.when(inside & filled, 1)).alias("filled"), F.count(F.when(inside & F.col("v.err").isNotNull(), 1)).alias("errors"),
        F.sum(F.when(inside, F.col("v.n"))).alias("total"), F.sum(F.when(other, F.col("v.n"))).alias("other_total"),
        F.max(F.when(inside, F.col("v.display"))).alias("display"), F.max(F.when(inside, F.col("v.n"))).alias("number"), F.max(F.when(inside, F.col("v.input"))).alias("formula"),
    )
    changed = here.where("check.check = 'Unchanged'").join(now.unionByName(was.select(F.struct("v.*", F.lit(None).cast("string").alias("display"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("string").alias("err")).alias("v"))), (F.col(key) == F.col(f"v.{key}")) & _in("check"))
    # a cell that is the same before and after occurs twice with one input
    changed = changed.groupBy(key, "index", "v.sheet", "v.r", "v.c").agg(F.count("*").alias("k"), F.count_distinct("v.input").alias("d")).where("k <> 2 or d > 1").groupBy(key, "index").agg(F.count("*").alias("changed"))
    full = checks.join(sums, [key, "index"], "left").join(changed, [key, "index"], "left").join(books.select(key, "sheets", "names"), key, "left")
    c = lambda x: F.col(f"check.{x}")
    close = lambda a, b: F.coalesce(F.abs(a - b) <= F.coalesce(c("tolerance"), F.lit(1e-9)), F.lit(False))
    want = c("expect").try_cast("double")
    area = (c("r1") - c("r0") + 1).cast("long") * (c("c1") - c("c0") + 1)
    lower = lambda a: F.transform(a, lambda x: F.lower(x))
    plain = lambda x: F.regexp_replace(F.upper(x), r"\s", "")
    passed = (
        F.when(c("check") == "CellDisplays", F.coalesce(F.col("display") == c("expect"), F.lit(False)))
        .when(c("check") == "CellNumber", close(F.col("number"), want))
        .when(c("check") == "CellFormula", F.coalesce(plain(F.col("formula")) == plain(c("expect")), F.lit(False)))
        .when(c("check") == "RangeFilled", F.coalesce(F.col("filled") == area, F.lit(False)))
        .when(c("check") == "SumsMatch", close(F.coalesce("total", F.lit(0.0)), F.coalesce("other_total", F.lit(0.0))))
        .when(c("check") == "SumEquals", close(F.coalesce("total", F.lit(0.0)), want))
        .when(c("check") == "NoErrors", F.coalesce(F.col("errors"), F.lit(0)) == 0)
        .when(c("check") == "Unchanged", F.coalesce(F.col("changed"), F.lit(0)) == 0)
        .when(c("check") == "SheetsExist", F.coalesce(F.size(F.array_except(lower(c("names")), lower(F.col("sheets")))) == 0, F.lit(False)))
        .when(c("check") == "NameRefersTo", F.coalesce(plain(F.element_at("names", F.upper(F.element_at(c("names"), 1)))) == plain(c("expect")), F.lit(False)))
        .otherwise(F.lit(False))
    )
    return full.select(key, "index", c("check").alias("check"), passed.alias("passed"))


def grades(checked: DataFrame, key: str = "task_id") -> DataFrame:
    """``key, passed, n_checks, n_passed``: a task passes if all its checks do."""
    return checked.groupBy(key).agg(F.bool_and("passed").alias("passed"), F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"))


def divergence(recorded: DataFrame, replayed: DataFrame, key: str, index: str = "index", digest: str = "state_hash") -> DataFrame:
    """``key, agreed``: how many first steps of two runs have the same state; runs that agree all the way are valid."""
    a = recorded.select(key, index, F.col(digest).alias("_a"))
    b = replayed.select(key, index, F.col(digest).alias("_b"))
    both = a.join(b, [key, index], "full_outer")
    first = both.groupBy(key).agg(F.min(F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col(index))).alias("first"), (F.max(index) + 1).alias("n"))
    return first.select(key, F.coalesce("first", "n").alias("agreed"), F.col("first").isNull().alias("valid"))


def preference_rows(attempts: DataFrame, repairs: DataFrame, key: str, agreed: DataFrame) -> DataFrame:
    """``key, prompt, rejected, chosen``: an attempt and its repair, split where they part (arrays of actions)."""
    joined = attempts.select(key, F.col("actions").alias("a")).join(repairs.select(key, F.col("actions").alias("b")), key).join(agreed.select(key, "agreed"), key)
    rest = lambda x: F.slice(x, F.col("agreed").cast("int") + 1, F.greatest(F.size(x), F.lit(1)))
    return joined.select(key, F.slice("a", F.lit(1), F.col("agreed").cast("int")).alias("prompt"), rest(F.col("a")).alias("rejected"), rest(F.col("b")).alias("chosen"))


def regressions(incumbent: DataFrame, candidate: DataFrame, key: str = "task_id", by: Sequence[str] = ("origin",)) -> DataFrame:
    """``by, tasks, gained, lost``: tasks that only one of two policies passes."""
    a, b = incumbent.select(key, *by, F.col("passed").alias("_a")), candidate.select(key, F.col("passed").alias("_b"))
    return a.join(b, key).groupBy(*by).agg(F.count("*").alias("tasks"), F.count_if(~F.col("_a") & F.col("_b")).alias("gained"), F.count_if(F.col("_a") & ~F.col("_b")).alias("lost"))


def digest_chain(records: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """Records whose state before isn't the state after the record before: a sound export has none."""
    w = Window.partitionBy(session).orderBy(order)
    return records.withColumn("_before", F.lag("post_state_digest").over(w)).where("_before is not null and _before <> pre_state_digest").drop("_before")


def observed_tables(cells: DataFrame, most_rows: int = 51) -> DataFrame:
    """``sheet, header_row, columns, data_rows, confidence``: the first row with two texts or more and data below it.

    cells: typed cells (``sheet, r, c, kind``). Confidence is 0.35, plus 0.5 for the share of
    columns with one kind, plus 0.15 for depth (full from ten rows on).
    """
    near = cells.where((F.col("r") < most_rows) & (F.col("kind") == "text")).groupBy("sheet", "r").agg(F.count("*").alias("n")).where("n >= 2")
    below = cells.where("kind <> 'empty'").groupBy("sheet").agg(F.max("r").alias("last"))
    head = near.join(below, "sheet").where("last > r").groupBy("sheet").agg(F.min("r").alias("header_row"))
    own = cells.where("kind <> 'empty' and kind <> 'error'").join(head, "sheet")
    titles = own.where("r = header_row and kind = 'text'").select("sheet", "c", "header_row")
    kinds = own.where("r > header_row").groupBy("sheet", "c").agg(F.count_distinct("kind").alias("kinds"), F.max("r").alias("last"))
    columns = titles.join(kinds, ["sheet", "c"], "left")
    out = columns.groupBy("sheet", "header_row").agg(F.count("*").alias("columns"), F.count_if(F.col("kinds") == 1).alias("typed"), (F.max("last") - F.first("header_row")).alias("data_rows"))
    depth = F.least(F.coalesce("data_rows", F.lit(0)) / 10, F.lit(1.0))
    return out.select("sheet", "header_row", "columns", "data_rows", (0.35 + 0.5 * F.col("typed") / F.col("columns") + 0.15 * depth).alias("confidence"))
