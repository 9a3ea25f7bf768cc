"""Criteria and the aggregates that take them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.plans import formula as f

from . import values as V
from .aggregates import first_of_rows
from .registry import function

_OPS = ("<>", ">=", "<=", ">", "<", "=")


def wildcard_pattern(pattern: str, whole: bool = True) -> str:
    """``*`` any run, ``?`` one character, ``~`` takes the next one as it is; without regard to case."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            i += 1
            out.append(_quoted(pattern[i]))
        else:
            out.append(".*" if c == "*" else "." if c == "?" else _quoted(c))
        i += 1
    body = "".join(out)
    return f"(?isu)^{body}$" if whole else f"(?isu){body}"


def _quoted(c: str) -> str:
    return "\\" + c if not c.isalnum() and ord(c) < 128 and not c.isspace() else c


def has_wildcards(pattern: str) -> bool:
    return bool(re.search(r"[*?~]", pattern))


def matches(v: V.Value, criterion) -> Column:
    """Whether a cell meets a criterion: a number, a boolean, or text with an operator in front.

    Numbers meet numbers, text meets text (with wildcards under ``=`` and ``<>``), a mismatch
    of types meets ``<>`` alone, an empty cell meets blank criteria alone. Errors meet none.
    """
    good = F.lit(True) if v.err is None else v.err.isNull()
    if isinstance(criterion, bool):
        return good & F.coalesce(v.col == criterion, F.lit(False)) if v.kind == V.BOOL else F.lit(False)
    if isinstance(criterion, (int, float)):
        op, operand = "=", float(criterion)
    else:
        op = next((o for o in _OPS if criterion.startswith(o)), "=")
        operand = criterion.removeprefix(op) if criterion.startswith(op) else criterion
    full = v.col.isNotNull()
    if operand == "":
        blank = v.col.isNull()
        if op == "=":
            return good & blank
        if op == "<>":
            return good & full
        return F.lit(False)
    if isinstance(operand, str):
        number = re.match(V.NUMBER_PATTERN, operand)
        if number:
            s = operand.strip()
            operand = float(s.rstrip("% ")) / (100 if s.endswith("%") else 1)
        elif operand.upper() in ("TRUE", "FALSE"):
            want = operand.upper() == "TRUE"
            same = F.coalesce(v.col == want, F.lit(False)) if v.kind == V.BOOL else F.lit(False)
            return good & (same if op == "=" else ~same) if op in ("=", "<>") else F.lit(False)
        else:
            from .dates import parse_date_constant

            serial = parse_date_constant(operand)
            if serial is not None and v.kind == V.NUM:
                operand = serial
    if isinstance(operand, float):
        if v.kind != V.NUM:
            return good & F.lit(op == "<>") & full if op == "<>" else F.lit(False)
        x, y = v.col, F.lit(operand)
        test = {"=": V.numbers_equal(x, y), "<>": ~V.numbers_equal(x, y), "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return good & F.coalesce(test, F.lit(op == "<>"))
    if v.kind != V.TEXT:
        return good & full if op == "<>" else F.lit(False)
    low = F.lower(v.col)
    if op in ("=", "<>"):
        same = v.col.rlike(wildcard_pattern(operand)) if has_wildcards(operand) else low == operand.lower()
        same = F.coalesce(same, F.lit(False))
        return good & (same if op == "=" else ~same)
    y = operand.lower()
    test = {"<": low < y, "<=": low <= y, ">": low > y, ">=": low >= y}[op]
    return good & F.coalesce(test, F.lit(False))


def _criterion(c, node):
    v = c.value(node)
    if v.literal is None and v.kind != V.EMPTY:
        raise f.FormulaError("a criterion has to be a constant; join on data-dependent criteria")
    return "" if v.literal is None else v.literal


def _all(c, own, pairs):
    test, err = None, None
    for where, criterion in pairs:
        v = own.value(where)
        m = matches(v, _criterion(c, criterion))
        test = m if test is None else test & m
        err = V.first_error(err, v.err)
    return test, err


def _pairs(args):
    if len(args) % 2:
        raise f.FormulaError("criteria come in pairs with their ranges")
    return list(zip(args[::2], args[1::2], strict=True))


def _counting(pairs_of):
    def build(c, args):
        def run(own):
            test, err = _all(c, own, pairs_of(args))
            return V.Value(V.NUM, F.count_if(test).cast("double"), first_of_rows(c, err))

        return c.aggregate(run)

    return build


def _folding(split, mean: bool):
    def build(c, args):
        target, pairs = split(args)

        def run(own):
            test, _ = _all(c, own, pairs)
            v = own.value(target)
            x = F.when(test if v.err is None else test & v.err.isNull(), v.col if v.kind == V.NUM else F.lit(None).cast("double"))
            err = first_of_rows(c, None if v.err is None else F.when(test, v.err))
            if mean:
                out = F.avg(x)
                return V.Value(V.NUM, out, V.first_error(err, V.when_error(out.isNull(), V.DIV0)))
            return V.finite(F.coalesce(F.sum(x), F.lit(0.0)), err)

        return c.aggregate(run)

    return build


def _one(args):
    return (args[2] if len(args) > 2 else args[0]), [(args[0], args[1])]


def _many(args):
    return args[0], _pairs(args[1:])


function("COUNTIF", 2)(_counting(_pairs))
function("COUNTIFS", 2, None)(_counting(_pairs))
function("SUMIF", 2, 3)(_folding(_one, False))
function("SUMIFS", 3, None)(_folding(_many, False))
function("AVERAGEIF", 2, 3)(_folding(_one, True))
function("AVERAGEIFS", 3, None)(_folding(_many, True))
