"""Mathematical functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .registry import function

SNAP = 1e-9


def _scale(digits: V.Value) -> Column:
    return F.lit(10.0 ** float(digits.literal)) if digits.literal is not None else F.pow(F.lit(10.0), F.floor(digits.col))


def _digits(rule):
    def build(c, args):
        x, d = c.num(args[0]), c.option(args, 1, 0)
        if d.literal is not None:
            d = V.number(float(int(d.literal)))
        negative = d.literal is not None and d.literal < 0
        p = F.lit(10.0 ** -d.literal) if negative else _scale(d)
        size = F.abs(x.col) / p if negative else F.abs(x.col) * p
        cut = rule(size)
        return V.finite(F.signum(x.col) * (cut * p if negative else cut / p), V.first_error(x.err, d.err))

    return build


#: Halves go away from zero; the snap makes decimal halves such as 2.675 count as halves.
function("ROUND", 2)(_digits(lambda s: F.floor(s + 0.5 + SNAP).cast("double")))
function("ROUNDUP", 2)(_digits(lambda s: F.ceil(s - SNAP).cast("double")))
function("ROUNDDOWN", 2)(_digits(lambda s: F.floor(s + SNAP).cast("double")))
function("TRUNC", 1, 2)(_digits(lambda s: F.floor(s).cast("double")))


def _one(rule, bad=None, code=V.NUMERR):
    """A function of one number; ``bad`` tells where it fails."""

    def build(c, args):
        x = c.num(args[0])
        if bad is None:
            return V.Value(V.NUM, rule(x.col), x.err)
        wrong = bad(x.col)
        return V.Value(V.NUM, F.when(~wrong, rule(x.col)), V.first_error(x.err, V.when_error(wrong, code)))

    return build


function("ABS", 1)(_one(F.abs))
function("SIGN", 1)(_one(F.signum))
function("SQRT", 1)(_one(F.sqrt, lambda x: x < 0))
function("LN", 1)(_one(F.ln, lambda x: x <= 0))
function("LOG10", 1)(_one(F.log10, lambda x: x <= 0))


@function("EXP", 1)
def _exp(c, args):
    x = c.num(args[0])
    return V.finite(F.exp(x.col), x.err)


@function("INT", 1)
def _int(c, args):
    x = c.num(args[0])
    near = F.rint(x.col)
    return V.Value(V.NUM, F.when(F.abs(x.col - near) < SNAP, near).otherwise(F.floor(x.col).cast("double")), x.err)


@function("MOD", 2)
def _mod(c, args):
    n, d = c.num(args[0]), c.num(args[1])
    err = V.first_error(n.err, d.err, V.when_error(d.col == 0, V.DIV0))
    return V.Value(V.NUM, n.col - d.col * F.floor(F.try_divide(n.col, d.col)), err)


@function("POWER", 2)
def _power(c, args):
    return c.arithmetic("^", c.num(args[0]), c.num(args[1]))


def _multiple(rule):
    def build(c, args):
        x, s = c.num(args[0]), c.num(args[1])
        wrong = (x.col > 0) & (s.col < 0)
        out = F.when(s.col == 0, F.lit(0.0)).otherwise(rule(F.try_divide(x.col, s.col)).cast("double") * s.col)
        return V.Value(V.NUM, F.when(~wrong, out), V.first_error(x.err, s.err, V.when_error(wrong, V.NUMERR)))

    return build


function("CEILING", 2)(_multiple(lambda q: F.ceil(q - SNAP)))
function("FLOOR", 2)(_multiple(lambda q: F.floor(q + SNAP)))


@function("MROUND", 2)
def _mround(c, args):
    x, m = c.num(args[0]), c.num(args[1])
    wrong = (m.col != 0) & (F.signum(x.col) * F.signum(m.col) < 0)
    out = F.when(m.col == 0, F.lit(0.0)).otherwise(F.floor(F.abs(F.try_divide(x.col, m.col)) + 0.5 + SNAP) * m.col)
    return V.Value(V.NUM, F.when(~wrong, out), V.first_error(x.err, m.err, V.when_error(wrong, V.NUMERR)))


@function("LOG", 1, 2)
def _log(c, args):
    x, b = c.num(args[0]), c.option(args, 1, 10)
    wrong = (x.col <= 0) | (b.col <= 0)
    if b.literal == 10.0:
        return V.Value(V.NUM, F.when(~wrong, F.log10(x.col)), V.first_error(x.err, V.when_error(x.col <= 0, V.NUMERR)))
    return V.Value(V.NUM, F.when(~wrong, F.try_divide(F.ln(x.col), F.ln(b.col))), V.first_error(x.err, b.err, V.when_error(wrong, V.NUMERR), V.when_error(b.col == 1, V.DIV0)))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm, in as many steps as the smaller number may need: 1.45 for each of its bits, and 2."""
    start = F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, s["b"]).otherwise(s["a"] % F.when(s["b"] == 0, F.lit(1).cast("long")).otherwise(s["b"])).alias("b"))
    steps = F.floor(F.log2(F.greatest(F.coalesce(F.least(a, b), F.lit(1)), F.lit(1)).cast("double") + 1) * 1.45).cast("int") + 2
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["a"])


def _whole(c, args):
    found = [c.num(a) for a in args]
    err = V.first_error(*(x.err for x in found), *(V.when_error(x.col < 0, V.NUMERR) for x in found))
    return [F.floor(F.abs(x.col)).try_cast("long") for x in found], err


@function("GCD", 1, None)
def _gcd_of(c, args):
    xs, err = _whole(c, args)
    out = xs[0]
    for x in xs[1:]:
        out = _gcd(out, x)
    return V.Value(V.NUM, out.cast("double"), err)


@function("LCM", 1, None)
def _lcm_of(c, args):
    xs, err = _whole(c, args)
    out = xs[0]
    for x in xs[1:]:
        common = c.bind(V.Value(V.NUM, _gcd(out, x))).col
        out = F.when((out == 0) | (x == 0), F.lit(0).cast("long")).otherwise(F.try_divide(out, common).try_cast("long") * x)
    return V.finite(out.cast("double"), err)
