"""Tables: formulas, filters, sorts, set-like operations and ranks over a DataFrame.

Row order is data only where an operator says so: such operators take a position column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import values as V
from tabulon.functions.conditional import matches
from tabulon.plans import formula as f
from tabulon.plans.compiler import DEFAULT_NOW_MS, Compiler, result


@dataclass(frozen=True)
class Table:
    """A frame with what formulas need: the rows' position, hidden rows, names, the clock."""

    frame: DataFrame
    position: str | None = None
    hidden: str | None = None
    names: dict[str, str] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)  # named tables that lookups refer to
    now_ms: int = DEFAULT_NOW_MS

    def _compiler(self, **more) -> Compiler:
        return Compiler(self.frame, now_ms=self.now_ms, names={k.upper(): v for k, v in self.names.items()}, tables={k.upper(): v for k, v in self.tables.items()}, position=self.position, hidden=self.hidden, **more)

    def derive(self, columns: dict[str, str] | None = None, errors: str = "null", **more: str) -> Table:
        """New columns by row formulas; a column of that name is replaced. errors: ``null`` or ``display``."""
        c = self._compiler()
        made = {name: result(c.compile(text), errors) for name, text in ({**(columns or {}), **more}).items()}
        keep = [x for x in self.frame.columns if x not in made]
        return replace(self, frame=c.staged.select(*keep, *[v.alias(k) for k, v in made.items()]))

    def where(self, formula: str) -> Table:
        """Rows for which a formula is TRUE; errors and blanks don't count."""
        c = self._compiler()
        v = c.compile(formula)
        test = V.to_bool(v)
        good = F.lit(True) if test.err is None else test.err.isNull()
        return replace(self, frame=c.staged.where(good & F.coalesce(test.col, F.lit(False))).select(*self.frame.columns))

    def matching(self, header: str, criterion) -> Table:
        """Rows whose cell meets a criterion, such as ``">=5"``, ``"a*"`` or a number."""
        c = self._compiler()
        return replace(self, frame=self.frame.where(matches(c.header(header), criterion)))

    def hide_unless(self, header: str, allowed: Sequence[str]) -> Table:
        """A view filter: marks rows whose shown text isn't among ``allowed``."""
        shown = V.displayed(self._compiler().header(header))
        return replace(self, frame=self.frame.withColumn("_hidden", ~shown.isin(list(allowed))), hidden="_hidden")

    def reconcile(self, left: str, right: str, aggregate: str = "SUM", by: Sequence[str] = ()) -> DataFrame:
        """``by, variance``: an aggregate of one column less that of another."""
        return self.summarise({"variance": f"{aggregate}({{{left}}})-{aggregate}({{{right}}})"}, by)

    def summarise(self, formulas: dict[str, str], by: Sequence[str] = (), errors: str = "null") -> DataFrame:
        """Aggregate formulas over all rows, or over groups."""
        c = self._compiler(mode="summary", grouped=bool(by))
        made = [result(c.compile(text), errors).alias(name) for name, text in formulas.items()]
        return c.staged.groupBy(*by).agg(*made) if by else c.staged.agg(*made)

    def spill(self, text: str) -> DataFrame:
        """The rows of a formula that gives an array: UNIQUE, SORT, SORTBY, FILTER, SEQUENCE, TRANSPOSE, TEXTSPLIT.

        Arguments that are arrays are columns or row formulas; rows come in order where the function orders them.
        """
        node = f.parse(text)
        if not isinstance(node, f.Call) or node.name not in _SPILLS:
            raise f.FormulaError("not a formula that gives an array")
        return _SPILLS[node.name](self, node.args)

    def _with(self, nodes: Sequence) -> tuple[DataFrame, list[str]]:
        """The frame with row formulas as columns a0, a1, ..., and their names."""
        c = self._compiler()
        made = [result(c.value(n)).alias(f"a{i}") for i, n in enumerate(nodes)]
        keep = [F.col(self.position).alias("_pos")] if self.position else [F.monotonically_increasing_id().alias("_pos")]
        return c.staged.select(*keep, *made), [f"a{i}" for i in range(len(nodes))]

    def find(self, term: str, headers: Sequence[str], match_case: bool = False, whole: bool = False) -> DataFrame:
        """Rows and columns whose shown text holds a term; letters A-Z fold unless ``match_case``."""
        c = self._compiler()
        fold = (lambda x: x) if match_case else ascii_lower
        want = term if match_case else term.translate(_ASCII)
        tests = [F.when(_has(fold(V.displayed(c.header(h))), want, whole), F.lit(h)) for h in headers]
        at = F.array_compact(F.array(*tests))
        keep = [self.position] if self.position else self.frame.columns
        return self.frame.select(*keep, F.explode(at).alias("header"))

    def replace_text(self, header: str, find: str, new: str, match_case: bool = True, whole: bool = False) -> Table:
        """Literal replacement in a text column."""
        c = F.col(header)
        if whole:
            out = F.when((c if match_case else ascii_lower(c)) == (find if match_case else find.translate(_ASCII)), F.lit(new)).otherwise(c)
        elif match_case:
            out = F.replace(c, F.lit(find), F.lit(new))
        else:
            import re

            pattern = "".join(f"[{x.upper()}{x.lower()}]" if x.isascii() and x.isalpha() else re.escape(x) for x in find)
            out = F.regexp_replace(c, pattern, new.replace("\\", "\\\\").replace("$", "\\$"))
        return replace(self, frame=self.frame.withColumn(header, out))


_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _has(c: Column, want: str, whole: bool) -> Column:
    return c == want if whole else c.contains(want)


def fold_key(df: DataFrame, name: str) -> Column:
    """A key under which equal cells meet: text without regard to case."""
    return F.lower(F.col(name)) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name)


def sort_rows(df: DataFrame, keys: Sequence[tuple[str, bool]], position: str | None = None) -> DataFrame:
    """Rows in the order of ``keys`` (column, ascending), blanks last either way, ties by position."""
    order = [fold_key(df, k).asc_nulls_last() if up else fold_key(df, k).desc_nulls_last() for k, up in keys]
    return df.orderBy(*order, *([F.col(position)] if position else []))


def top_rows(df: DataFrame, keys: Sequence[tuple[str, bool]], n: int, position: str | None = None) -> DataFrame:
    """The first n rows of :func:`sort_rows`: each task keeps n."""
    return sort_rows(df, keys, position).limit(n)


def unique_rows(df: DataFrame, columns: Sequence[str], position: str, exactly_once: bool = False) -> DataFrame:
    """Distinct rows without regard to case, as first seen, with their position; or those that occur once."""
    keys = [fold_key(df, c).alias(f"_k{i}") for i, c in enumerate(columns)]
    rows = df.select(*keys, F.struct(F.col(position), *[F.col(c) for c in columns]).alias("_row"))
    first = rows.groupBy(*[f"_k{i}" for i in range(len(columns))]).agg(F.min_by("_row", f"_row.{position}").alias("_row"), F.count("*").alias("_n"))
    if exactly_once:
        first = first.where("_n = 1")
    return first.select("_row.*")


# --- order statistics over ranges of values, so that no step puts all rows in one task


def boundaries(df: DataFrame, column: str, parts: int = 64) -> list[float]:
    """Values that cut a numeric column into ranges of about equal size (a bounded list)."""
    found = df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.002)
    return sorted({float(x) for x in found})


def range_bucket(column: Column, cuts: list[float]) -> Column:
    """The number of cuts at or below a value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= column))


def rank_rows(df: DataFrame, column: str, name: str = "rank", ascending: bool = False, parts: int = 64) -> DataFrame:
    """``df`` with each row's competition rank by a numeric column; null ranks nothing.

    Rows are counted per distinct value, distinct values are ranked within ranges of the
    column, and a range starts after all rows of the ranges before it.
    """
    x = F.col(column).cast("double")
    counts = df.where(x.isNotNull()).groupBy(x.alias("_v")).agg(F.count("*").alias("_n"))
    bucket = range_bucket(F.col("_v"), boundaries(df.select(x.alias("_v")), "_v", parts))
    counts = counts.withColumn("_b", -bucket if not ascending else bucket)
    sums = counts.groupBy("_b").agg(F.sum("_n").alias("_s"))  # one row per range
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    order = F.col("_v").asc() if ascending else F.col("_v").desc()
    within = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.join(sums, "_b").select("_v", (F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)) + 1).alias(name))
    return df.join(ranks, x == F.col("_v"), "left").drop("_v")


def running_total(df: DataFrame, position: str, value: str, name: str = "running", parts: int = 64) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each, in the order of a numeric position.

    This is what a column of formulas like ``=F2+E3`` computes.
    """
    at = F.col(position).cast("double")
    own = df.withColumn("_b", range_bucket(at, boundaries(df.select(at.alias("_p")), "_p", parts)))
    sums = own.groupBy("_b").agg(F.sum(value).alias("_s"))
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_b").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn(name, F.sum(value).over(within)).join(sums, "_b").withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.col("_before")).drop("_b", "_before")


def largest_by_group(df: DataFrame, by: Sequence[str], column: str, k: int, largest: bool = True) -> DataFrame:
    """LARGE or SMALL by group: ``by, value``; groups of fewer than k numbers have no row. Tasks keep k rows a group."""
    order = F.col(column).desc() if largest else F.col(column).asc()
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.where(F.col(column).isNotNull()).withColumn("_r", at).where(F.col("_r") <= k).where(F.col("_r") == k).select(*by, F.col(column).alias("value"))


def mode_by_group(df: DataFrame, by: Sequence[str], column: str, position: str) -> DataFrame:
    """MODE by group: the most frequent value, the earliest on a tie; groups without a repeat have no row."""
    n = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"), F.min(position).alias("_p")).where("_n > 1")
    return n.groupBy(*by).agg(F.max_by(column, F.struct("_n", -F.col("_p"))).alias("mode"))


def duplicates(df: DataFrame, column: str, name: str = "duplicate") -> DataFrame:
    """``df`` with whether a cell's value occurs more than once (blanks never do): counts per value are joined back."""
    key = fold_key(df, column)
    n = df.where(F.col(column).isNotNull()).groupBy(key.alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_k")
    return df.join(n, key == F.col("_k"), "left").withColumn(name, F.col("_k").isNotNull()).drop("_k")


def fill_series(df: DataFrame, position: str, seeds: Sequence[float], name: str) -> DataFrame:
    """A numeric series from its first values: a constant step goes on, other seeds repeat."""
    at = F.col(position)
    steps = {round(b - a, 9) for a, b in zip(seeds, seeds[1:], strict=False)}
    if len(seeds) > 1 and len(steps) == 1:
        return df.withColumn(name, F.lit(float(seeds[0])) + at * F.lit(float(seeds[1] - seeds[0])))
    values = F.array(*[F.lit(float(x)) for x in seeds])
    return df.withColumn(name, F.element_at(values, (F.pmod(at, F.lit(len(seeds))) + 1).cast("int")))


def sequence_rows(spark, rows: int, columns: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    """SEQUENCE: ``r, c, value``, row by row."""
    i = F.col("id")
    return spark.range(rows * columns).select(F.floor(i / columns).cast("long").alias("r"), F.pmod(i, F.lit(columns)).alias("c"), (F.lit(float(start)) + i * F.lit(float(step))).alias("value"))


def sequences(df: DataFrame, keep: Sequence[str], rows: Column, columns: Column, start: Column, step: Column) -> DataFrame:
    """SEQUENCE for every row of a table: ``keep, r, c, value``, as many lines and columns as the row asks for; none where either is below 1 or missing."""
    n, w = F.floor(rows).cast("long"), F.floor(columns).cast("long")
    own = df.select(*keep, w.alias("_w"), start.cast("double").alias("_start"), step.cast("double").alias("_step"), F.when((n >= 1) & (w >= 1), n * w).alias("_n"))
    each = own.where(F.col("_n").isNotNull()).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_i"))
    return each.select(*keep, F.expr("_i div _w").alias("r"), F.expr("_i % _w").alias("c"), (F.col("_start") + F.col("_i") * F.col("_step")).alias("value"))


def text_split(df: DataFrame, column: str, delimiters: Sequence[str], keep: Sequence[str] = (), ignore_empty: bool = False) -> DataFrame:
    """TEXTSPLIT by columns: ``keep, pos, piece``; of several delimiters the longest counts first."""
    import re

    pattern = "|".join(re.escape(d) for d in sorted(delimiters, key=len, reverse=True))
    parts = F.split(F.col(column), pattern)
    if ignore_empty:
        parts = F.filter(parts, lambda x: x != "")
    return df.select(*keep, F.posexplode(parts).alias("pos", "piece"))


def conditional_format(df: DataFrame, rules: Sequence[tuple[str, dict[str, str]]], attributes: Sequence[str]) -> DataFrame:
    """A column per attribute: that of the first rule (a formula and what it sets) that holds and sets it."""
    c = Compiler(df)
    tests = []
    for formula, sets in rules:
        b = V.to_bool(c.compile(formula))
        tests.append((F.coalesce(b.col & (F.lit(True) if b.err is None else b.err.isNull()), F.lit(False)), sets))
    made = []
    for a in attributes:
        found = [F.when(t, F.lit(s[a])) for t, s in tests if a in s]
        made.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(a))
    return c.staged.select(*df.columns, *made)


# --- formulas that give arrays


def _constant(t: Table, args: tuple, i: int, default):
    return t._compiler().constant(args[i] if i < len(args) else None, default)


def _spill_unique(t: Table, args: tuple) -> DataFrame:
    df, names = t._with(args[:1])
    return unique_rows(df, names, "_pos", bool(_constant(t, args, 2, False))).orderBy("_pos").drop("_pos")


def _spill_sort(t: Table, args: tuple) -> DataFrame:
    df, names = t._with(args[:1])
    return sort_rows(df, [(names[0], _constant(t, args, 2, 1.0) >= 0)], "_pos").drop("_pos")


def _spill_sortby(t: Table, args: tuple) -> DataFrame:
    df, names = t._with([args[0], *args[1::2]])
    ways = [_constant(t, args, 2 + 2 * i, 1.0) >= 0 for i in range(len(names) - 1)]
    return sort_rows(df, list(zip(names[1:], ways, strict=True)), "_pos").select("a0")


def _spill_filter(t: Table, args: tuple) -> DataFrame:
    c = t._compiler()
    mask = V.to_bool(c.value(args[1]))
    good = F.lit(True) if mask.err is None else mask.err.isNull()
    shown = result(c.value(args[0])).alias("a0")
    kept = c.staged.where(good & F.coalesce(mask.col, F.lit(False)))
    return kept.select(shown)


def _spill_sequence(t: Table, args: tuple) -> DataFrame:
    rows, columns = int(_constant(t, args, 0, 1.0)), int(_constant(t, args, 1, 1.0))
    if rows < 1 or columns < 1:
        raise f.FormulaError(V.VALUE)
    return sequence_rows(t.frame.sparkSession, rows, columns, _constant(t, args, 2, 1.0), _constant(t, args, 3, 1.0))


def _spill_textsplit(t: Table, args: tuple) -> DataFrame:
    df, names = t._with(args[:1])
    return text_split(df, names[0], [str(_constant(t, args, 1, ""))], ["_pos"], bool(_constant(t, args, 3, False)))


def _spill_transpose(t: Table, args: tuple) -> DataFrame:
    df, names = t._with(args[:1])
    return df.select(F.lit(0).alias("r"), F.col("_pos").alias("c"), F.col(names[0]).alias("value"))


_SPILLS = {"UNIQUE": _spill_unique, "SORT": _spill_sort, "SORTBY": _spill_sortby, "FILTER": _spill_filter, "SEQUENCE": _spill_sequence, "TEXTSPLIT": _spill_textsplit, "TRANSPOSE": _spill_transpose}
