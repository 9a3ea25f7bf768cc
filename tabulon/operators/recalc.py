"""Recalculation: values of all formula cells of many workbooks, level by level.

A formula is taken apart into templates that name its operands by number, so all cells that
compute the same thing share one compiled expression: the aggregates over ranges
(``SUM({m0})``), and what is done with their results and with single cells (``\\g0*\\s1``).
Operands are data. They are found by joins of positions; a range meets the cells of its tiles;
blocks in a calculation are joined position by position, and shorter ones are padded with #N/A.

Cells are evaluated when all they read is known. Cells of one template in a line, each of
which reads the one before (running balances), form a chain, which is one step: its cells are
folded in order, so the number of steps doesn't grow with a column's length. What never gets
ready is in a circle or behind one; circles are found by colours and become #CIRC!.

A workbook's cells may be spread over tasks. What is kept in one task is a chain (a line of a
sheet). Distinct templates, not formulas, come to the driver, where they are compiled in batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import values as V
from tabulon.functions.registry import REGISTRY
from tabulon.plans import formula as f
from tabulon.plans.compiler import Compiler

from .cells import typed
from .scratch import settle
from .summary import TILE_COLUMNS, TILE_ROWS

#: Functions over ranges, functions that give one of their arguments, and others of single values.
AGGREGATES = frozenset("SUM PRODUCT AVERAGE MIN MAX COUNT COUNTA MEDIAN STDEV SUMPRODUCT".split())
BRANCHING = frozenset("IF IFS CHOOSE IFERROR IFNA".split())
SCALARS = BRANCHING | frozenset(
    "AND OR NOT ISNUMBER ISTEXT ISLOGICAL ISBLANK ISERROR ISERR ISNA NA ROUND ROUNDUP ROUNDDOWN ABS INT MOD POWER SQRT CEILING FLOOR MROUND TRUNC SIGN EXP LN LOG10 LOG "
    "CONCATENATE LEFT RIGHT MID LEN TRIM UPPER LOWER PROPER SUBSTITUTE REPT EXACT DATE".split()
)
#: Templates compiled into one plan; levels after which the tables of values are made one; cells of a block of a chain.
BATCH, MERGE, BLOCK = 48, 8, 1024
_TOP = 2**31 - 1
_CELL = "struct<n: double, s: string, b: boolean, err: string>"
_AREA = "struct<sheet: string, r0: int, c0: int, r1: int, c1: int>"
_PLAN = f"struct<outer: string, singles: array<struct<sheet: string, r: int, c: int>>, inner: array<struct<text: string, dense: boolean, slots: array<{_AREA}>>>>"


class _Unsupported(Exception):  # noqa: N818
    pass


def _area(ref: f.Ref) -> dict:
    low = lambda x, end: end if x is None else x
    a, b = ref.first, ref.last
    return {"sheet": ref.sheet and ref.sheet.lower(), "r0": low(a.row, 0), "c0": low(a.col, 0), "r1": low(b.row, _TOP), "c1": low(b.col, _TOP)}


def _aggregate(node: f.Call) -> dict:
    dense = node.name == "SUMPRODUCT" or any(not isinstance(a, f.Ref) and f.references(a) for a in node.args)
    if dense and node.name != "SUMPRODUCT" and len(node.args) > 1:
        raise _Unsupported
    slots: list[dict] = []

    def slot(ref: f.Ref):
        area = _area(ref)
        if dense and _TOP in (area["r1"], area["c1"]):
            raise _Unsupported
        if not dense or area not in slots:
            slots.append(area)
        return f.Header(f"m{len(slots) - 1 if not dense else slots.index(area)}")

    if any(isinstance(n, (f.Call, f.Name, f.Header, f.Failure)) for a in node.args for n in f.walk(a)):
        raise _Unsupported
    return {"text": f.to_text(f.Call(node.name, tuple(f.rewrite(a, slot) for a in node.args))), "dense": dense, "slots": slots}


def formula_plan(text: str) -> dict | None:
    """A formula's templates and operands; None if it needs what only the evaluator of whole workbooks has."""
    try:
        tree = f.parse(text)
    except f.FormulaError:
        return {"outer": V.NAME, "singles": [], "inner": []}
    singles: dict[tuple, int] = {}
    inner: list[dict] = []

    def convert(node):
        if isinstance(node, f.Ref):
            if not node.single:
                raise _Unsupported
            at = (node.sheet and node.sheet.lower(), node.first.row, node.first.col)
            return f.Name(f"\\s{singles.setdefault(at, len(singles))}")
        if isinstance(node, f.Call):
            if node.name in AGGREGATES and f.references(node):
                inner.append(_aggregate(node))
                return f.Name(f"\\g{len(inner) - 1}")
            if node.name not in SCALARS | AGGREGATES:
                raise _Unsupported
            least, most, _ = REGISTRY[node.name]
            if len(node.args) < least or most is not None and len(node.args) > most:
                raise _Unsupported
            return f.Call(node.name, tuple(map(convert, node.args)))
        if isinstance(node, f.Unary):
            return f.Unary(node.op, convert(node.arg))
        if isinstance(node, f.Binary):
            return f.Binary(node.op, convert(node.left), convert(node.right))
        if isinstance(node, (f.Name, f.Header)):
            raise _Unsupported
        return node

    try:
        outer = f.to_text(convert(tree))
    except (_Unsupported, RecursionError):
        return None
    return {"outer": outer, "singles": [{"sheet": s, "r": r, "c": c} for s, r, c in singles], "inner": inner}


def _plans(column: pa.Array) -> pa.Array:
    area = pa.struct([("sheet", pa.string()), *((x, pa.int32()) for x in ("r0", "c0", "r1", "c1"))])
    single = pa.struct([("sheet", pa.string()), ("r", pa.int32()), ("c", pa.int32())])
    inner = pa.struct([("text", pa.string()), ("dense", pa.bool_()), ("slots", pa.list_(area))])
    kind = pa.struct([("outer", pa.string()), ("singles", pa.list_(single)), ("inner", pa.list_(inner))])
    own = column.dictionary_encode()  # workbooks of one make repeat their formulas, so each is parsed once a batch
    return pa.array([formula_plan(t) for t in own.dictionary.to_pylist()], kind).take(own.indices)


class _Unnamed(Exception):  # noqa: N818
    """An intermediate result that has no name yet."""

    def __init__(self, value: V.Value):
        self.value = value


@dataclass
class CellCompiler(Compiler):
    """Templates to columns. Operands have their kind in the data, and so have the branches of a choice."""

    mixing: bool = False
    staging: bool = False  # name intermediate results by columns of the frame
    lets: tuple | None = None  # or by variables of lambdas, those known so far
    uses: list[int] = field(default_factory=lambda: [0])

    def value(self, node) -> V.Value:
        out = (replace(self, mixing=False) if self.mixing else self).tree(node)
        out = V.mixed(out) if self.mixing else out
        return self.bind(out) if isinstance(node, (f.Call, f.Binary, f.Unary)) else out

    def num(self, node) -> V.Value:
        return self.bind(V.to_number(self.value(node)))

    def binary(self, node: f.Binary) -> V.Value:
        if node.op in "+-*/^":
            return self.arithmetic(node.op, self.num(node.left), self.num(node.right))
        return Compiler.binary(self, node)

    def bind(self, v: V.Value) -> V.Value:
        if v.literal is not None or v.referenced or not self.staging and self.lets is None:
            return v
        if self.lets is not None:
            self.uses[0] += 1
            if self.uses[0] > len(self.lets):
                raise _Unnamed(v)
            named = self.lets[self.uses[0] - 1]
            return V.Value(v.kind, named["v"], None if v.err is None else named["e"])
        n = len(self.held[0].columns)
        names = [f"_t{n}", f"_e{n}"]
        self.held[0] = self.held[0].withColumns({names[0]: v.col} | ({names[1]: v.err} if v.err is not None else {}))
        return V.Value(v.kind, F.col(names[0]), None if v.err is None else F.col(names[1]))

    def call(self, node: f.Call) -> V.Value:
        own = replace(self, mixing=True) if node.name in BRANCHING else self
        return Compiler.call(own, node)

    @staticmethod
    def arithmetic(op: str, x: V.Value, y: V.Value) -> V.Value:
        out = Compiler.arithmetic(op, x, y)
        if op == "^":
            return out
        col = F.when(V.numbers_equal(x.col, y.col), F.lit(0.0)).otherwise(out.col) if op == "-" else out.col
        return V.finite(col, out.err)


def _cell(v: V.Value) -> Column:
    """A result as a cell: an empty one is zero, and an error holds nothing else."""
    m = V.mixed(v)
    good = F.lit(True) if v.err is None else v.err.isNull()
    n = F.when(good, F.when(V.is_blank(m), F.lit(0.0)).otherwise(m.col["n"]))
    err = F.lit(None).cast("string") if v.err is None else v.err
    return F.struct(n.alias("n"), F.when(good, m.col["s"]).alias("s"), F.when(good, m.col["b"]).alias("b"), err.alias("err"))


def _failed(code: str) -> Column:
    return F.struct(F.lit(None).cast("double").alias("n"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("boolean").alias("b"), F.lit(code).alias("err"))


def _named_by_lambdas(compile_with, lets: tuple = ()) -> Column:
    """``compile_with(lets)`` with each intermediate result computed once: ``transform(array(x), let -> ...)[0]``.

    The compilation starts again with one more name whenever it meets a result without one.
    """
    try:
        return compile_with(lets)
    except _Unnamed as x:
        v = x.value
        item = F.struct(v.col.alias("v"), (F.lit(None).cast("string") if v.err is None else v.err).alias("e"))
        return F.get(F.transform(F.array(item), lambda let: _named_by_lambdas(compile_with, (*lets, let))), F.lit(0))


def _compiled(frame: DataFrame, outer: str, singles, results, staging: bool) -> tuple[DataFrame, Column]:
    """The frame with intermediate results, and the outer template's value; ``singles(i)`` and ``results(k)`` give the operands' columns."""
    tree = f.parse(outer)
    bound = {}
    for name in {n.name for n in f.walk(tree) if isinstance(n, f.Name)}:
        i = int(name[2:])
        bound[name.upper()] = V.of_cell(singles(i)) if name[1] == "s" else V.Value(V.NUM, results(i)["n"], results(i)["err"])
    try:
        if not staging:
            return frame, _named_by_lambdas(lambda lets: _cell(CellCompiler(frame, mode="summary", bound=bound, lets=lets).value(tree)))
        compiler = CellCompiler(frame, mode="summary", bound=bound, staging=True)
        value = _cell(compiler.value(tree))
        return compiler.staged, value
    except f.FormulaError:
        return frame, _failed(V.NAME)


def inside(areas: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Points (key, _sheet, r, c, ...) within areas (key, _sheet, r0, c0, r1, c1, ...), joined by tiles."""
    used = points.groupBy(key, "_sheet").agg(F.max("r").alias("_r"), F.max("c").alias("_c"))
    cut = areas.join(used, [key, "_sheet"]).withColumns({"r1": F.least("r1", "_r"), "c1": F.least("c1", "_c")}).where("r0 <= r1 and c0 <= c1").drop("_r", "_c")
    tiles = lambda lo, hi, size: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    cut = cut.withColumn("_i", tiles("r0", "r1", TILE_ROWS)).withColumn("_j", tiles("c0", "c1", TILE_COLUMNS))
    placed = points.withColumns({"_i": F.floor(F.col("r") / TILE_ROWS), "_j": F.floor(F.col("c") / TILE_COLUMNS)})
    return placed.join(cut, [key, "_sheet", "_i", "_j"]).where("r between r0 and r1 and c between c0 and c1").drop("_i", "_j")


class _Books:
    """Formulas and known values of workbooks on their way through the levels."""

    def __init__(self, formulas: DataFrame, constants: DataFrame, key: str):
        self.key, self.formulas = key, formulas
        self.parts = [constants]
        self.edges = settle(self._edges(), "reads")
        self.nodes = settle(self._nodes(), "nodes")
        self.left = self.nodes.select("node").distinct()
        self.waits = settle(self._waits(), "waits")

    @property
    def values(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out

    def known(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > MERGE:
            levels = self.parts[1]
            for p in self.parts[2:]:
                levels = levels.unionByName(p)
            self.parts = [self.parts[0], settle(levels, "values")]

    def _edges(self) -> DataFrame:
        """``src, dst, ranged``: the formula dst reads the formula src; ranged: through a range."""
        own = self.formulas
        sheet = lambda a: F.coalesce(a["sheet"], F.col("_sheet"))
        one = F.transform("singles", lambda a: F.struct(sheet(a).alias("_sheet"), a["r"].alias("r0"), a["c"].alias("c0"), a["r"].alias("r1"), a["c"].alias("c1"), F.lit(False).alias("ranged")))
        many = F.transform(F.flatten(F.transform("inner", lambda i: i["slots"])), lambda a: F.struct(sheet(a).alias("_sheet"), a["r0"], a["c0"], a["r1"], a["c1"], F.lit(True).alias("ranged")))
        areas = own.select(self.key, F.col("id").alias("dst"), F.explode(F.array_distinct(F.concat(one, many))).alias("a")).select(self.key, "dst", "a.*")
        points = own.select(self.key, "_sheet", "r", "c", F.col("id").alias("src"))
        return inside(areas, points, self.key).groupBy("src", "dst").agg(F.max("ranged").alias("ranged"))

    def _nodes(self) -> DataFrame:
        """``id, node, t, link``: t null for a cell of its own, else its place in the chain ``node``, and which operand is the cell before."""
        k = self.key
        own = self.formulas.select(k, "_sheet", "r", "c", "id", "shape", "singles")
        reads = own.select(k, "_sheet", "r", "c", "id", "shape", F.posexplode("singles").alias("link", "a"))
        reads = reads.where("a.sheet is null or a.sheet = _sheet").withColumns({"dr": F.col("r") - F.col("a.r"), "dc": F.col("c") - F.col("a.c")}).where("dr <> 0 or dc <> 0")
        before = own.select(k, "_sheet", F.col("r").alias("_r"), F.col("c").alias("_c"), "shape")
        links = reads.withColumns({"_r": F.col("a.r"), "_c": F.col("a.c")}).join(before, [k, "_sheet", "_r", "_c", "shape"])
        first = links.groupBy("id").agg(F.min_by(F.struct(k, "_sheet", "r", "c", "shape", "link", "dr", "dc"), "link").alias("x")).select("id", "x.*")
        t = F.when(F.col("dr") != 0, F.floor(F.col("r") / F.col("dr"))).otherwise(F.floor(F.col("c") / F.when(F.col("dc") != 0, F.col("dc")).otherwise(1)))
        placed = first.withColumn("t", t).withColumns({"_a": F.col("r") - F.col("t") * F.col("dr"), "_b": F.col("c") - F.col("t") * F.col("dc")})
        line = [k, "_sheet", "shape", "link", "dr", "dc", "_a", "_b"]
        run = placed.withColumn("_run", F.col("t") - F.row_number().over(Window.partitionBy(*line).orderBy("t")))
        whole = Window.partitionBy(*line, "_run")
        chains = run.withColumns({"node": F.min("id").over(whole), "_n": F.count("*").over(whole)}).where("_n > 1").select("id", "node", "t", "link")
        nodes = settle(self._placed(chains), "chains")
        # a chain that reads itself in another way is no chain
        src, dst = nodes.select(F.col("id").alias("src"), F.col("node").alias("_s"), F.col("t").alias("_ts")), nodes.select(F.col("id").alias("dst"), F.col("node").alias("_d"), F.col("t").alias("_td"))
        bad = self.edges.join(src.where("_ts is not null"), "src").join(dst, "dst").where("_s = _d and (ranged or _td - _ts <> 1)").select(F.col("_d").alias("node")).distinct()
        return self._without(nodes, bad)

    def _placed(self, chains: DataFrame) -> DataFrame:
        return self.formulas.select("id").join(chains, "id", "left").select("id", F.coalesce("node", "id").alias("node"), "t", "link")

    def _without(self, nodes: DataFrame, bad: DataFrame) -> DataFrame:
        """The nodes with the cells of bad chains on their own."""
        marked = nodes.join(bad.select("node", F.lit(True).alias("_bad")), "node", "left")
        own = lambda c, other: F.when(F.col("_bad"), other).otherwise(F.col(c)).alias(c)
        null = F.lit(None)
        return marked.select("id", own("node", F.col("id")), own("t", null), own("link", null))

    def _waits(self) -> DataFrame:
        """``src, dst`` between nodes that are left."""
        src, dst = self.nodes.select(F.col("id").alias("src"), F.col("node").alias("_s"), "t"), self.nodes.select(F.col("id").alias("dst"), F.col("node").alias("_d"))
        both = self.edges.join(src, "src").join(dst, "dst").where("_s <> _d or t is null").select(F.col("_s").alias("src"), F.col("_d").alias("dst")).distinct()
        return both.join(self.left.select(F.col("node").alias("src")), "src", "left_semi")

    def done(self, nodes: DataFrame) -> None:
        self.left = settle(self.left.join(nodes, "node", "left_anti"), "left")
        self.waits = settle(self.waits.join(nodes.select(F.col("node").alias("src")), "src", "left_anti"), "waits")

    def step(self) -> bool:
        """Evaluate what is ready; False if nothing is left."""
        ready = settle(self.left.join(self.waits.select(F.col("dst").alias("node")), "node", "left_anti"), "ready")
        if ready.isEmpty():
            if self.left.isEmpty():
                return False
            self._circles()
            return True
        self.known(self._evaluated(ready))
        self.done(ready)
        return True

    # --- values

    def _evaluated(self, ready: DataFrame) -> DataFrame:
        own = self.formulas.join(self.nodes.join(ready, "node", "left_semi"), "id")
        # a template's cells lie together, so that its plan reads them alone
        own = settle(self._operands(own).withColumn("alone", F.col("t").isNull()).repartitionByRange("alone", "outer", "id").sortWithinPartitions("alone", "outer"), "operands")
        parts = []
        for batch in _batches(own, "alone", "outer", "link"):
            out = None
            for alone, outer, link in batch:
                rows = own.where((F.col("alone") == alone) & (F.col("outer") == outer))
                one = self._single(rows, outer) if alone else self._folded(rows.where(F.col("link") == link), outer, link)
                out = one if out is None else out.unionByName(one)
            parts.append(settle(out, "level"))
        result = parts[0]
        for more in parts[1:]:
            result = result.unionByName(more)
        return result

    def _single(self, rows: DataFrame, outer: str) -> DataFrame:
        staged, value = _compiled(rows, outer, lambda i: F.get(F.col("sv"), F.lit(i)), lambda k: F.get(F.col("gv"), F.lit(k)), True)
        return staged.select(self.key, "_sheet", "r", "c", value.alias("v"))

    def _folded(self, rows: DataFrame, outer: str, link: int) -> DataFrame:
        """Chains in order. What a cell gave is the next one's operand ``link``; blocks keep an append cheap."""
        item = F.struct("t", self.key, "_sheet", "r", "c", "sv", "gv")
        chains = rows.groupBy("node").agg(F.array_sort(F.collect_list(item)).alias("xs"))
        start = F.get(F.get(F.col("xs"), F.lit(0))["sv"], F.lit(link))
        empty = F.array().cast(f"array<{_CELL}>")
        zero = F.struct(F.array().cast(f"array<array<{_CELL}>>").alias("full"), F.array(start.cast(_CELL)).alias("last"))

        def merge(acc, x):
            before = F.element_at(acc["last"], -1)
            single = lambda i: before if i == link else F.get(x["sv"], F.lit(i))
            value = _compiled(rows, outer, single, lambda k: F.get(x["gv"], F.lit(k)), False)[1].cast(_CELL)
            over = F.size(acc["last"]) >= BLOCK
            full = F.when(over, F.array_append(acc["full"], acc["last"])).otherwise(acc["full"])
            return F.struct(full.alias("full"), F.array_append(F.when(over, empty).otherwise(acc["last"]), value).alias("last"))

        folded = F.aggregate("xs", zero, merge, lambda acc: F.flatten(F.array_append(acc["full"], acc["last"])))
        pairs = chains.select("xs", folded.alias("vs")).select(F.posexplode("xs").alias("at", "x"), "vs")
        return pairs.select(f"x.{self.key}", "x._sheet", "x.r", "x.c", F.get("vs", F.col("at") + 1).alias("v"))

    def _operands(self, own: DataFrame) -> DataFrame:
        """``own`` with ``sv``, the single cells' values, and ``gv``, the aggregates' results, in the order of their numbers."""
        k = self.key
        values = self.values
        ones = own.select("id", k, "_sheet", F.posexplode("singles").alias("i", "a")).select("id", k, F.coalesce("a.sheet", "_sheet").alias("_sheet"), "i", F.col("a.r").alias("r"), F.col("a.c").alias("c"))
        ones = ones.join(values, [k, "_sheet", "r", "c"], "left")
        in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c])
        singles = ones.groupBy("id").agg(in_order("v").alias("sv"))
        inner = own.select("id", k, "_sheet", F.posexplode("inner").alias("i", "g")).select("id", k, "_sheet", "i", "g.*")
        found = self._aggregates(settle(inner, "aggregates"), values)
        out = own.join(singles, "id", "left")
        if found is None:
            return out.withColumn("gv", F.lit(None).cast("array<struct<n: double, err: string>>"))
        return out.join(found.groupBy("id").agg(in_order("g").alias("gv")), "id", "left")

    def _aggregates(self, inner: DataFrame, values: DataFrame) -> DataFrame | None:
        """``id, i, g``: results of aggregates over ranges; None if there are none."""
        k, out = self.key, []
        null = F.lit(None).cast(_CELL)
        for batch in _batches(inner.where("not dense"), "text"):
            batch = [t for t, in batch]
            rows = inner.where(F.col("text").isin(batch))
            areas = rows.select("id", k, "i", "text", "_sheet", F.posexplode("slots").alias("x", "a")).select("id", k, "i", "text", "x", F.coalesce("a.sheet", "_sheet").alias("_sheet"), "a.r0", "a.c0", "a.r1", "a.c1")
            members = inside(areas, values, k).select("id", "i", "text", "x", F.struct(F.col("r") - F.col("r0"), F.col("c") - F.col("c0")).alias("place"), "v")
            none = rows.select("id", "i", "text", F.lit(-1).alias("x"), F.lit(None).cast("struct<col1: int, col2: int>").alias("place"), null.alias("v"))
            members = settle(members.unionByName(none), "members")  # so that an aggregate over nothing has a row
            out += [self._grouped(members.where(F.col("text") == t), t, lambda j: F.when(F.col("x") == j, F.col("v"))) for t in batch]
        for batch in _batches(inner.where("dense"), "text"):
            batch = [t for t, in batch]
            rows = settle(self._aligned(inner.where(F.col("text").isin(batch)), values), "blocks")
            out += [self._grouped(rows.where(F.col("text") == t), t, lambda j: F.get("vs", F.lit(j))) for t in batch]
        if not out:
            return None
        result = out[0]
        for more in out[1:]:
            result = result.unionByName(more)
        return result

    def _aligned(self, rows: DataFrame, values: DataFrame) -> DataFrame:
        """``id, i, text, place, vs``: blocks position by position; one row or column goes along with all, shorter blocks are padded."""
        k = self.key
        size = lambda hi, lo: F.array_max(F.transform("slots", lambda a: a[hi] - a[lo] + 1))
        spots = rows.withColumns({"_h": size("r1", "r0").cast("long"), "_w": size("c1", "c0").cast("long")})
        spots = spots.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_h") * F.col("_w") - 1)))
        spots = spots.withColumns({"_i": F.expr("int(p div _w)"), "_j": F.expr("int(p % _w)")})
        each = spots.select("id", k, "i", "text", "_sheet", "p", "_i", "_j", "_h", "_w", F.posexplode("slots").alias("x", "a"))
        each = each.withColumns({"h": F.expr("a.r1 - a.r0 + 1"), "w": F.expr("a.c1 - a.c0 + 1")})
        product = F.col("text").startswith("SUMPRODUCT")
        odd = F.when(product, ((F.col("h") != F.col("_h")) | (F.col("w") != F.col("_w"))) & (F.col("h") * F.col("w") > 1))
        short = (F.col("h") > 1) & (F.col("_i") >= F.col("h")) | (F.col("w") > 1) & (F.col("_j") >= F.col("w"))
        each = each.select(
            "id", k, "i", "text", "p", "x", F.coalesce("a.sheet", "_sheet").alias("_sheet"), F.coalesce(odd, F.lit(False)).alias("odd"), (short & ~product).alias("short"),
            (F.col("a.r0") + F.when(F.col("h") > 1, F.col("_i")).otherwise(0)).alias("r"), (F.col("a.c0") + F.when(F.col("w") > 1, F.col("_j")).otherwise(0)).alias("c"),
        )
        met = each.join(values, [k, "_sheet", "r", "c"], "left")
        v = F.when(F.col("odd"), _failed(V.VALUE)).when(F.col("short"), _failed(V.NA)).otherwise(F.col("v"))
        vs = F.transform(F.array_sort(F.collect_list(F.struct("x", v.alias("v")))), lambda e: e["v"])
        return met.groupBy("id", "i", "text", "p").agg(vs.alias("vs")).withColumnRenamed("p", "place")

    def _grouped(self, rows: DataFrame, text: str, operand) -> DataFrame:
        n = len({x.name for x in f.walk(f.parse(text)) if isinstance(x, f.Header)})
        frame = rows.select("id", "i", "place", *[operand(j).alias(f"m{j}") for j in range(n)])
        compiler = _Members(frame, mode="summary", grouped=True, position="place")
        try:
            v = compiler.compile(text)
            n, err = v.col.cast("double"), F.lit(None).cast("string") if v.err is None else v.err
        except f.FormulaError:
            n, err = F.lit(None).cast("double"), F.lit(V.NAME)
        return frame.groupBy("id", "i").agg(F.struct(F.when(err.isNull(), n).alias("n"), err.alias("err")).alias("g"))

    # --- circles

    def _circles(self) -> None:
        """Nodes that read themselves, however far around: cells become #CIRC!, chains are taken apart and tried again."""
        edges = settle(self.waits.join(self.left.select(F.col("node").alias("dst")), "dst", "left_semi"), "circle-edges")
        while True:  # what leads out of circles goes
            inner = settle(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "circle-edges")
            if inner.count() == edges.count():
                break
            edges = inner
        colours = settle(edges.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")), "colours")
        while True:  # the greatest node that leads to a node is its colour
            came = edges.join(colours.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_c"))
            following = settle(colours.join(came, "node", "left").select("node", F.greatest("colour", F.coalesce("_c", "colour")).alias("colour")), "colours")
            if following.join(colours.withColumnRenamed("colour", "_old"), "node").where("colour <> _old").isEmpty():
                break
            colours = following
        back = edges.join(colours.select(F.col("node").alias("src"), "colour"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("_d")), "dst").where("colour = _d").select("src", "dst")
        circle = settle(colours.where("node = colour").select("node"), "circle")
        while True:  # and what also leads back to it, within its colour, is in its circle
            more = settle(circle.union(back.join(circle.select(F.col("node").alias("dst")), "dst", "left_semi").select("src")).distinct(), "circle")
            if more.count() == circle.count():
                break
            circle = more
        inside_it = back.join(circle.withColumnRenamed("node", "src"), "src", "left_semi").join(circle.withColumnRenamed("node", "dst"), "dst", "left_semi")
        circle = settle(inside_it.select(F.col("dst").alias("node")).distinct(), "circle")
        members = self.nodes.join(circle, "node", "left_semi")
        chains = settle(members.where("t is not null").select("node").distinct(), "unchained")
        if chains.isEmpty():
            self.known(settle(self.formulas.join(members.select("id"), "id").select(self.key, "_sheet", "r", "c", _failed("#CIRC!").alias("v")), "level"))
            self.done(circle)
            return
        freed = self.nodes.join(chains, "node", "left_semi").select(F.col("id").alias("node"))
        left = self.left.join(chains, "node", "left_anti").union(freed)
        self.nodes = settle(self._without(self.nodes, chains), "nodes")
        self.left = settle(left, "left")
        self.waits = settle(self._waits(), "waits")


class _Members(CellCompiler):
    """Aggregates' templates: headers are operands by position."""

    def header(self, name: str) -> V.Value:
        return V.of_cell(F.col(name))


def _batches(rows: DataFrame, *columns: str) -> list[list[tuple]]:
    """The distinct templates, in batches."""
    found = sorted((tuple(r) for r in rows.select(*columns).distinct().collect()), key=str)
    return [found[i : i + BATCH] for i in range(0, len(found), BATCH)]


def recalculate(cells: DataFrame, key: str = "workbook_id") -> DataFrame:
    """``key, sheet, r, c, input, kind, n, s, b, err, display`` of all cells (``key, sheet, r, c, input``).

    Where a cell is given twice, the greatest input counts; a null input is an empty cell, and a
    null key a workbook like others. Formulas that don't parse are #NAME?. Workbooks with a
    formula that needs references computed from data, lookups in ranges, arrays, dates from
    texts, names, or a sheet that isn't there, are evaluated whole, a workbook at a time. An
    empty table gives none; other columns play no part.
    """
    from .evaluate import evaluate

    own = cells.select(F.struct(F.col(key)).alias("_key"), F.lower("sheet").alias("_sheet"), "sheet", "r", "c", "input")
    own = own.groupBy("_key", "_sheet", "r", "c").agg(F.max_by(F.struct("sheet", "input"), F.coalesce("input", F.lit(""))).alias("x"))
    own = own.select(F.xxhash64("_key").alias("_book"), F.col(f"_key.{key}").alias(key), "_sheet", "x.sheet", "r", "c", "x.input")
    own = settle(own, "cells")
    is_formula = F.col("input").startswith("=") & (F.char_length("input") > 1)
    formulas = own.where(is_formula).withColumn("p", F.arrow_udf(_plans, _PLAN)("input")).withColumn("id", F.monotonically_increasing_id())
    formulas = formulas.select("*", "p.*").drop("p").withColumn("shape", F.to_json(F.struct("outer", F.transform("inner", lambda i: i["text"]).alias("texts"))))
    formulas = settle(formulas, "formulas")
    named = F.concat(F.transform("singles", lambda a: a["sheet"]), F.transform(F.flatten(F.transform("inner", lambda i: i["slots"])), lambda a: a["sheet"]))
    asked = formulas.select("_book", F.explode(F.array_distinct(named)).alias("_sheet")).where("_sheet is not null")
    absent = asked.join(own.where("input is not null").select("_book", "_sheet").distinct(), ["_book", "_sheet"], "left_anti").select("_book")
    whole = settle(formulas.where("outer is null").select("_book").union(absent).distinct(), "whole-books")
    rest = own.join(whole, "_book", "left_anti")
    n, s, b = F.col("n"), F.col("s"), F.col("b")
    constants = typed(rest.where(~is_formula & F.col("input").isNotNull())).where("kind <> 'empty'")
    constants = settle(constants.select("_book", "_sheet", "r", "c", F.struct(n.alias("n"), s.alias("s"), b.alias("b"), F.col("err").alias("err")).alias("v")), "constants")
    books = _Books(settle(formulas.join(whole, "_book", "left_anti"), "formulas"), constants, "_book")
    while books.step():
        pass
    out = rest.join(books.values, ["_book", "_sheet", "r", "c"], "left").select(key, "sheet", "r", "c", "input", "v.*")
    kind = F.when(F.col("err").isNotNull(), "error").when(n.isNotNull(), "num").when(s.isNotNull(), "text").when(b.isNotNull(), "bool").otherwise("empty")
    shown = V.displayed(V.Value(V.MIXED, F.struct("n", "s", "b"), F.col("err")))
    out = out.select(key, "sheet", "r", "c", "input", kind.alias("kind"), "n", "s", "b", "err", shown.alias("display"))
    if whole.isEmpty():
        return out
    return out.unionByName(evaluate(own.join(whole, "_book", "left_semi"), key))
