"""Syntax trees to Catalyst columns.

A formula over a table compiles to one column expression. In a row formula ``{Header}`` is
the row's value and an aggregate runs over the whole table, as a scalar subquery; in a
summary formula aggregates are those of the grouping. Nothing runs in Python per row but the
few functions that have no closed form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import values as V
from tabulon.functions.registry import REGISTRY

from . import formula as f

#: The clock's default: an injected constant, never the wall clock, so that results repeat.
DEFAULT_NOW_MS = 1_704_110_400_000


def plain_header(name: str) -> str:
    """Headers match without regard to case, spaces and punctuation."""
    return re.sub(r"[\W_]+", "", name.lower())


@dataclass
class Compiler:
    frame: DataFrame
    mode: str = "row"  # "row", "summary"
    now_ms: int = DEFAULT_NOW_MS
    names: dict[str, str] = field(default_factory=dict)
    tables: dict[str, object] = field(default_factory=dict)  # named tables, for lookups
    bound: dict[str, V.Value] = field(default_factory=dict)
    position: str | None = None  # a column with the row's position, for what depends on order
    hidden: str | None = None  # a boolean column: rows a filter hides
    depth: int = 0
    grouped: bool = False  # a summary by keys
    inside: bool = False  # within an aggregate's argument
    held: list[DataFrame] = field(default_factory=list)  # the frame with intermediate columns, shared by copies

    def __post_init__(self) -> None:
        if not self.held:
            self.held.append(self.frame)

    def compile(self, text: str) -> V.Value:
        return self.value(f.parse(text))

    @property
    def staged(self) -> DataFrame:
        """The frame with a column for each intermediate result that formulas refer to."""
        return self.held[0]

    def bind(self, v: V.Value) -> V.Value:
        """Name an intermediate result by a column of its own, so that uses of it don't repeat its tree."""
        if v.literal is not None or v.referenced or self.mode == "summary" and not self.inside:
            return v
        n = len(self.held[0].columns)
        names = [f"_t{n}", f"_e{n}"]
        cols = {names[0]: v.col} | ({names[1]: v.err} if v.err is not None else {})
        self.held[0] = self.held[0].withColumns(cols)
        return V.Value(v.kind, F.col(names[0]), None if v.err is None else F.col(names[1]))

    # --- trees

    def value(self, node) -> V.Value:
        out = self.tree(node)
        plain = isinstance(node, f.Binary) and node.op in ("+", "-", "*", "&") and out.err is None
        return self.bind(out) if isinstance(node, (f.Call, f.Binary)) and not plain else out

    def tree(self, node) -> V.Value:
        if isinstance(node, f.Number):
            return V.number(node.value)
        if isinstance(node, f.Text):
            return V.text(node.value)
        if isinstance(node, f.Boolean):
            return V.boolean(node.value)
        if isinstance(node, f.Failure):
            return V.failure(node.code)
        if isinstance(node, f.Missing):
            return V.empty()
        if isinstance(node, f.Header):
            return self.header(node.name)
        if isinstance(node, f.Name):
            return self.name(node.name)
        if isinstance(node, f.Unary):
            return self.unary(node)
        if isinstance(node, f.Binary):
            return self.binary(node)
        if isinstance(node, f.Call):
            return self.call(node)
        return V.failure(V.REF)  # cell references have no meaning in a table

    def column_of(self, name: str) -> str | None:
        """The frame's column of a header: by exact name, else by its plain form."""
        if name in self.frame.columns:
            return name
        wanted = plain_header(name)
        return next((c for c in self.frame.columns if plain_header(c) == wanted), None)

    def header(self, name: str) -> V.Value:
        own = self.column_of(name)
        if own is None:
            return V.failure(V.REF)
        return V.of_column(F.col(f"`{own}`"), self.frame.schema[own].dataType)

    def name(self, name: str) -> V.Value:
        key = name.upper()
        if key in self.bound:
            return self.bound[key]
        if key in self.names and self.depth < 8:
            return replace(self, depth=self.depth + 1).value(f.parse(self.names[key]))
        return V.failure(V.NAME)

    def unary(self, node: f.Unary) -> V.Value:
        v = self.value(node.arg)
        if node.op == "+":
            return v
        n = V.to_number(v)
        if n.literal is not None:
            return V.number(-n.literal if node.op == "-" else n.literal / 100)
        return V.Value(V.NUM, -n.col if node.op == "-" else n.col / 100, n.err)

    def binary(self, node: f.Binary) -> V.Value:
        a, b = self.value(node.left), self.value(node.right)
        if node.op in ("=", "<>", "<", "<=", ">", ">="):
            return V.compare(node.op, a, b)
        if node.op == "&":
            x, y = V.to_text(a), V.to_text(b)
            return V.Value(V.TEXT, F.concat(x.col, y.col), V.first_error(x.err, y.err))
        x, y = V.to_number(a), V.to_number(b)
        return self.arithmetic(node.op, x, y)

    @staticmethod
    def arithmetic(op: str, x: V.Value, y: V.Value) -> V.Value:
        err = V.first_error(x.err, y.err)
        a, b = x.col, y.col
        if op == "+":
            return V.finite(a + b, err) if x.err is not None or y.err is not None else V.Value(V.NUM, a + b)
        if op == "-":
            return V.Value(V.NUM, a - b, err)
        if op == "*":
            return V.Value(V.NUM, a * b, err)
        if op == "/":
            if y.literal:
                return V.Value(V.NUM, a / b, err)
            return V.Value(V.NUM, F.try_divide(a, b), V.first_error(err, V.when_error(b == 0, V.DIV0)))
        zero = (a == 0) & (b == 0)
        out = V.finite(F.pow(a, b), V.first_error(err, V.when_error(zero, V.NUMERR), V.when_error((a == 0) & (b < 0), V.DIV0)))
        return out

    def call(self, node: f.Call) -> V.Value:
        if node.name not in REGISTRY:
            return V.failure(V.NAME)
        least, most, build = REGISTRY[node.name]
        if len(node.args) < least or most is not None and len(node.args) > most:
            raise f.FormulaError(f"{node.name} takes {least} to {most if most is not None else 'any number of'} arguments, not {len(node.args)}")
        return build(self, node.args)

    # --- arguments

    def num(self, node) -> V.Value:
        return V.to_number(self.value(node))

    def text(self, node) -> V.Value:
        return V.to_text(self.value(node))

    def bool(self, node) -> V.Value:
        return V.to_bool(self.value(node))

    def option(self, args: tuple, i: int, default: float) -> V.Value:
        """A numeric argument that may be left out."""
        return self.num(args[i]) if i < len(args) and not isinstance(args[i], f.Missing) else V.number(default)

    def constant(self, node, default=None):
        """The Python constant of an argument; ValueError if it depends on data."""
        if node is None or isinstance(node, f.Missing):
            return default
        v = self.value(node)
        if v.literal is None:
            raise f.FormulaError("this argument has to be a constant")
        return v.literal

    # --- aggregates

    def aggregate(self, build) -> V.Value:
        """``build(compiler of rows)`` gives an aggregate value; in a row formula it becomes a scalar of the whole table."""
        own = replace(self, mode="row", inside=True)
        out: V.Value = build(own)
        if self.mode == "summary":
            return out
        if self.inside:
            raise f.FormulaError("an aggregate within an aggregate's argument")
        cols = [out.col.alias("v")] + ([out.err.alias("e")] if out.err is not None else [])
        one = self.staged.agg(*cols)
        return V.Value(out.kind, one.select("v").scalar(), None if out.err is None else one.select("e").scalar())


def result(v: V.Value, errors: str = "null") -> Column:
    """The column to return: errors as null, or ``display`` everything as shown."""
    if errors == "display":
        return V.displayed(v)
    return v.col if v.err is None else F.when(v.err.isNull(), v.col)


def load_functions() -> None:
    from tabulon.functions import aggregates, conditional, dates, finance, logic, lookups, mathematics, numberformat, texts  # noqa: F401


load_functions()
