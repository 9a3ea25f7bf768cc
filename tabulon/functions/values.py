"""Typed values of formulas: a Spark column, its kind, and the error it may be.

Errors are values: a :class:`Value` carries a string column that is null where the value is
good. A null value without an error is an empty cell. All partial operations are guarded,
so that ANSI mode never raises.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUM, TEXT, BOOL, EMPTY = "num", "text", "bool", "empty"
#: A cell of any kind: a struct of ``n``, ``s``, ``b`` (one of them, or none where it is empty).
MIXED = "mixed"
DIV0, VALUE, REF, NAME, NA, NUMERR, CALC = "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#N/A", "#NUM!", "#CALC!"

#: Numbers as typed: decimal, exponent, one trailing percent sign.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*%?\s*$"


@dataclass(frozen=True)
class Value:
    kind: str
    col: Column
    err: Column | None = None
    #: Whether it comes from a cell or column (referenced values aren't coerced in aggregates).
    referenced: bool = False
    #: The Python constant, if it is one.
    literal: object = None

    def with_err(self, *more: Column | None) -> Value:
        return Value(self.kind, self.col, first_error(self.err, *more), self.referenced)


def first_error(*errs: Column | None) -> Column | None:
    """The first of the errors, left to right; None if none can occur."""
    known = [e for e in errs if e is not None]
    return None if not known else known[0] if len(known) == 1 else F.coalesce(*known)


def when_error(condition: Column, code: str) -> Column:
    return F.when(condition, F.lit(code))


def number(x: float) -> Value:
    return Value(NUM, F.lit(float(x)), literal=float(x))


def text(x: str) -> Value:
    return Value(TEXT, F.lit(x), literal=x)


def boolean(x: bool) -> Value:
    return Value(BOOL, F.lit(bool(x)), literal=bool(x))


def failure(code: str) -> Value:
    return Value(EMPTY, F.lit(None).cast("double"), F.lit(code))


def empty() -> Value:
    return Value(EMPTY, F.lit(None).cast("double"), referenced=True)


def serial_of_timestamp(c: Column) -> Column:
    """Days since 1899-12-30 with the time of day as fraction (dates from March 1900 on)."""
    d = F.to_date(c)
    seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.datediff(d, F.lit("1899-12-30").cast("date")).cast("double") + seconds / F.lit(86400.0)


def of_column(c: Column, kind: T.DataType) -> Value:
    """A frame's column as referenced values."""
    if isinstance(kind, T.BooleanType):
        return Value(BOOL, c, referenced=True)
    if isinstance(kind, T.NumericType):
        return Value(NUM, c.cast("double"), referenced=True)
    if isinstance(kind, T.DateType):
        return Value(NUM, F.datediff(c, F.lit("1899-12-30").cast("date")).cast("double"), referenced=True)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Value(NUM, serial_of_timestamp(c), referenced=True)
    return Value(TEXT, c.cast("string"), referenced=True)


def fifteen(c: Column) -> Column:
    """A double rounded to 15 significant digits."""
    return F.format_string("%.14e", c).cast("double")


def display_number(c: Column) -> Column:
    """At most 15 significant digits; whole numbers below 1e15 without a point."""
    whole = (F.abs(c) < 1e15) & (F.floor(c) == c)
    near = fifteen(c)
    plain = F.regexp_replace(near.cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    usual = (F.abs(near) < 1e15) & (F.abs(near) >= 1e-9)
    return F.when(c.isNull(), F.lit(None)).when(whole, F.when(c == 0, F.lit("0")).otherwise(c.cast("decimal(16,0)").cast("string"))).when(usual, plain).otherwise(near.cast("string"))


def of_cell(c: Column) -> Value:
    """A struct ``n, s, b, err`` as a referenced value; a null struct is an empty cell."""
    return Value(MIXED, c, c["err"], referenced=True)


def mixed(v: Value) -> Value:
    """The same value with its kind in the data."""
    if v.kind == MIXED:
        return v
    own = {NUM: "n", TEXT: "s", BOOL: "b"}.get(v.kind)
    null = {"n": "double", "s": "string", "b": "boolean"}
    parts = [(v.col if name == own else F.lit(None).cast(kind)).alias(name) for name, kind in null.items()]
    return Value(MIXED, F.struct(*parts), v.err, v.referenced)


def is_blank(v: Value) -> Column:
    """Whether a value is empty, errors aside."""
    return v.col["n"].isNull() & v.col["s"].isNull() & v.col["b"].isNull() if v.kind == MIXED else v.col.isNull()


def numbers_of(v: Value) -> Column:
    """What a column gives to an aggregate: its numbers, null for the rest."""
    return v.col if v.kind == NUM else v.col["n"] if v.kind == MIXED else F.lit(None).cast("double")


def to_number(v: Value) -> Value:
    """Empty is 0, TRUE 1; text must read as a number, else #VALUE!."""
    if v.kind == MIXED:
        read = parse_number(v.col["s"])
        unread = when_error(v.col["s"].isNotNull() & read.isNull(), VALUE)
        return Value(NUM, F.coalesce(v.col["n"], v.col["b"].cast("double"), read, F.lit(0.0)), first_error(v.err, unread))
    if v.kind == NUM:
        return Value(NUM, F.coalesce(v.col, F.lit(0.0)) if v.referenced else v.col, v.err, literal=v.literal)
    if v.kind == EMPTY:
        return Value(NUM, F.lit(0.0), v.err, literal=0.0)
    if v.kind == BOOL:
        return Value(NUM, F.coalesce(v.col.cast("double"), F.lit(0.0)), v.err)
    if isinstance(v.literal, str):
        import re

        if re.match(NUMBER_PATTERN, v.literal):
            s = v.literal.strip()
            return number(float(s.rstrip("% ")) / (100 if s.endswith("%") else 1))
        return failure(VALUE)
    n = parse_number(v.col)
    return Value(NUM, F.when(v.col.isNull(), F.lit(0.0)).otherwise(n), first_error(v.err, when_error(v.col.isNotNull() & n.isNull(), VALUE)))


def parse_number(c: Column) -> Column:
    """The number a text spells, else null."""
    t = F.trim(c)
    percent = t.endswith("%")
    bare = F.regexp_replace(t, r"\s*%$", "")
    n = F.when(t.rlike(NUMBER_PATTERN), bare.try_cast("double"))
    n = F.when(percent, n / 100).otherwise(n)
    return F.when(F.abs(n) < float("inf"), n)


def to_text(v: Value) -> Value:
    if v.kind == MIXED:
        truth = F.when(v.col["b"], F.lit("TRUE")).when(~v.col["b"], F.lit("FALSE"))
        return Value(TEXT, F.coalesce(v.col["s"], display_number(v.col["n"]), truth, F.lit("")), v.err)
    if v.kind == TEXT:
        return Value(TEXT, F.coalesce(v.col, F.lit("")) if v.referenced else v.col, v.err, literal=v.literal)
    if v.kind == EMPTY:
        return Value(TEXT, F.lit(""), v.err, literal="")
    if v.kind == BOOL:
        return Value(TEXT, F.when(v.col.isNull(), F.lit("")).when(v.col, F.lit("TRUE")).otherwise(F.lit("FALSE")), v.err)
    if isinstance(v.literal, float):
        from tabulon.plans.formula import number_text

        return text(number_text(v.literal))
    return Value(TEXT, F.coalesce(display_number(v.col), F.lit("")), v.err)


def to_bool(v: Value) -> Value:
    if v.kind == MIXED:
        up = F.upper(v.col["s"])
        unread = when_error(v.col["s"].isNotNull() & ~up.isin("TRUE", "FALSE"), VALUE)
        return Value(BOOL, F.coalesce(v.col["b"], v.col["n"] != 0, up == "TRUE", F.lit(False)), first_error(v.err, unread))
    if v.kind == BOOL:
        return Value(BOOL, F.coalesce(v.col, F.lit(False)) if v.referenced else v.col, v.err)
    if v.kind == EMPTY:
        return Value(BOOL, F.lit(False), v.err)
    if v.kind == NUM:
        return Value(BOOL, F.coalesce(v.col != 0, F.lit(False)), v.err)
    up = F.upper(v.col)
    ok = up.isin("TRUE", "FALSE")
    return Value(BOOL, F.coalesce(up == "TRUE", F.lit(False)), first_error(v.err, when_error(v.col.isNotNull() & ~ok, VALUE)))


def finite(c: Column, err: Column | None) -> Value:
    """A computed number; not finite is #NUM!."""
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return Value(NUM, F.when(~bad, c), first_error(err, when_error(bad, NUMERR)))


def numbers_equal(a: Column, b: Column) -> Column:
    """Equal to 15 significant digits."""
    return (a == b) | (F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 5e-16)


_RANK = {NUM: 0, TEXT: 1, BOOL: 2}


def _compare_mixed(op: str, a: Value, b: Value, err: Column | None) -> Value:
    x, y = mixed(a).col, mixed(b).col
    rank = lambda m: F.when(m["n"].isNotNull(), 0).when(m["s"].isNotNull(), 1).when(m["b"].isNotNull(), 2)
    own, other = F.coalesce(rank(x), rank(y), F.lit(0)), F.coalesce(rank(y), rank(x), F.lit(0))
    zero = {"n": F.lit(0.0), "s": F.lit(""), "b": F.lit(False)}
    part = lambda m, f: F.coalesce(F.lower(m[f]) if f == "s" else m[f], zero[f])
    by = lambda test: F.when(own == 0, test("n")).when(own == 1, test("s")).otherwise(test("b"))
    alike = by(lambda f: numbers_equal(part(x, f), part(y, f)) if f == "n" else part(x, f) == part(y, f))
    same = (own == other) & alike
    less = (own < other) | ((own == other) & by(lambda f: part(x, f) < part(y, f)) & ~alike)
    more = ~same & ~less
    return Value(BOOL, {"=": same, "<>": ~same, "<": less, "<=": less | same, ">": more, ">=": more | same}[op], err)


def compare(op: str, a: Value, b: Value) -> Value:
    """Number < text < boolean; text without regard to case; empty as the other side's zero."""
    err = first_error(a.err, b.err)
    if MIXED in (a.kind, b.kind):
        return _compare_mixed(op, a, b, err)
    kinds = {a.kind, b.kind} - {EMPTY}
    if len(kinds) == 2:
        ra, rb = _RANK[a.kind], _RANK[b.kind]
        fixed = {"=": False, "<>": True, "<": ra < rb, "<=": ra < rb, ">": ra > rb, ">=": ra > rb}[op]
        # an empty cell takes the other side's kind
        zero = {NUM: number(0), TEXT: text(""), BOOL: boolean(False)}
        out = F.lit(fixed)
        if a.referenced:
            out = F.when(a.col.isNull(), compare(op, zero[b.kind], b).col).otherwise(out)
        if b.referenced:
            out = F.when(b.col.isNull(), compare(op, a, zero[a.kind]).col).otherwise(out)
        return Value(BOOL, out, err)
    kind = next(iter(kinds), NUM)
    convert = {NUM: to_number, TEXT: to_text, BOOL: to_bool}[kind]
    x, y = convert(a).col, convert(b).col
    if kind == TEXT:
        x, y = F.lower(x), F.lower(y)
    same = numbers_equal(x, y) if kind == NUM else x == y
    out = {"=": same, "<>": ~same, "<": (x < y) & ~same, "<=": (x < y) | same, ">": (x > y) & ~same, ">=": (x > y) | same}[op]
    return Value(BOOL, out, err)


def unify(values: list[Value]) -> tuple[str, list[Column]]:
    """One kind for the branches of a condition: their own if they share it, else text."""
    kinds = {v.kind for v in values if v.kind != EMPTY}
    if MIXED in kinds:
        return MIXED, [F.struct(*[mixed(v).col[x].alias(x) for x in ("n", "s", "b")]) for v in values]
    if len(kinds) <= 1:
        kind = next(iter(kinds), NUM)
        null = {NUM: "double", TEXT: "string", BOOL: "boolean"}[kind]
        return kind, [v.col if v.kind == kind else F.lit(None).cast(null) for v in values]
    return TEXT, [to_text(v).col for v in values]


def displayed(v: Value) -> Column:
    """What the cell shows: its text, or its error's code."""
    shown = to_text(v).col
    return shown if v.err is None else F.coalesce(v.err, shown)
