"""Financial functions: closed forms as columns, roots by bisection over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import values as V
from .registry import function

#: Bisection: bounds, iterations, tolerance.
LOW, HIGH, ROUNDS, TOLERANCE = -0.999999, 10.0, 200, 1e-12


def _terms(c, args, names: tuple[int, ...], defaults: dict[int, float]):
    found = [c.option(args, i, defaults[i]) if i in defaults else c.num(args[i]) for i in names]
    return found, V.first_error(*(x.err for x in found))


def _growth(rate, nper, due):
    """(1+r)^n, and the annuity's factor with payments at the start of periods where due."""
    g = F.pow(1 + rate, nper)
    return g, (1 + rate * F.when(due != 0, 1.0).otherwise(0.0)) * F.try_divide(g - 1, rate)


@function("PMT", 3, 5)
def _pmt(c, args):
    (r, n, pv, fv, due), err = _terms(c, args, (0, 1, 2, 3, 4), {3: 0, 4: 0})
    g, a = _growth(r.col, n.col, due.col)
    out = F.when(r.col == 0, -F.try_divide(pv.col + fv.col, n.col)).otherwise(-F.try_divide(pv.col * g + fv.col, a))
    return V.finite(out, V.first_error(err, V.when_error(n.col == 0, V.NUMERR)))


@function("FV", 3, 5)
def _fv(c, args):
    (r, n, pmt, pv, due), err = _terms(c, args, (0, 1, 2, 3, 4), {3: 0, 4: 0})
    g, a = _growth(r.col, n.col, due.col)
    return V.finite(F.when(r.col == 0, -(pv.col + pmt.col * n.col)).otherwise(-(pv.col * g + pmt.col * a)), err)


@function("PV", 3, 5)
def _pv(c, args):
    (r, n, pmt, fv, due), err = _terms(c, args, (0, 1, 2, 3, 4), {3: 0, 4: 0})
    g, a = _growth(r.col, n.col, due.col)
    out = F.when(r.col == 0, -(fv.col + pmt.col * n.col)).otherwise(-F.try_divide(fv.col + pmt.col * a, g))
    return V.finite(out, V.first_error(err, V.when_error(g == 0, V.NUMERR)))


@function("NPER", 3, 5)
def _nper(c, args):
    (r, pmt, pv, fv, due), err = _terms(c, args, (0, 1, 2, 3, 4), {3: 0, 4: 0})
    p = pmt.col * (1 + r.col * F.when(due.col != 0, 1.0).otherwise(0.0))
    ratio = F.try_divide(p - fv.col * r.col, p + pv.col * r.col)
    flat = r.col == 0
    wrong = F.when(flat, pmt.col == 0).otherwise(ratio.isNull() | (ratio <= 0) | (r.col <= -1))
    out = F.when(flat, -F.try_divide(pv.col + fv.col, pmt.col)).otherwise(F.try_divide(F.ln(F.when(ratio > 0, ratio)), F.ln(1 + r.col)))
    return V.finite(F.when(~wrong, out), V.first_error(err, V.when_error(wrong, V.NUMERR)))


@function("NPV", 2, None)
def _npv(c, args):
    from tabulon.plans import formula as f

    rate = c.num(args[0])
    if len(args) == 2 and isinstance(args[1], f.Header) and c.position:
        def build(own):
            v = own.value(args[1])
            term = V.to_number(v).col / F.pow(1 + rate.col, F.col(c.position) + 1)
            return V.finite(F.coalesce(F.sum(F.when(v.col.isNotNull(), term)), F.lit(0.0)), rate.err)

        return c.aggregate(build)
    flows = [c.num(a) for a in args[1:]]
    out = sum((x.col / F.pow(1 + rate.col, F.lit(float(i + 1))) for i, x in enumerate(flows)), F.lit(0.0))
    return V.finite(F.when(rate.col != -1, out), V.first_error(rate.err, *(x.err for x in flows), V.when_error(rate.col == -1, V.NUMERR)))


def bisect(f, n: int) -> np.ndarray:
    """Roots of ``f(rates)`` for n rows at once on [LOW, HIGH]; NaN where the ends have one sign."""
    low, high = np.full(n, LOW), np.full(n, HIGH)
    at_low, at_high = f(low), f(high)
    bad = ~(np.isfinite(at_low) & np.isfinite(at_high)) | (at_low * at_high > 0)
    for _ in range(ROUNDS):
        mid = (low + high) / 2
        v = f(mid)
        left = (at_low * v) <= 0
        high = np.where(left, mid, high)
        at_low = np.where(left, at_low, v)
        low = np.where(left, low, mid)
        if np.all((high - low) < TOLERANCE):
            break
    return np.where(bad, np.nan, (low + high) / 2)


def _rates(nper: pa.Array, pmt: pa.Array, pv: pa.Array, fv: pa.Array, due: pa.Array) -> pa.Array:
    n, p, v, w, d = (x.to_numpy(zero_copy_only=False).astype(float) for x in (nper, pmt, pv, fv, due))

    def value(r: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            g = (1 + r) ** n
            a = np.where(np.abs(r) < 1e-12, n, (g - 1) / r) * (1 + r * (d != 0))
            return v * g + p * a + w

    return pa.array(bisect(value, len(n)), from_pandas=True)


@function("RATE", 3, 6)
def _rate(c, args):
    (n, pmt, pv, fv, due), err = _terms(c, args, (0, 1, 2, 3, 4), {3: 0, 4: 0})
    out = F.arrow_udf(_rates, "double")(n.col, pmt.col, pv.col, fv.col, due.col)
    return V.Value(V.NUM, out, V.first_error(err, V.when_error(out.isNull(), V.NUMERR)))


def _internal(flows: pa.Array) -> pa.Array:
    out = []
    for row in flows.to_pylist():
        v = np.array([x["v"] for x in sorted(row or [], key=lambda x: x["p"]) if x["v"] is not None], dtype=float)
        if not ((v > 0).any() and (v < 0).any()):
            out.append(None)
            continue
        t = np.arange(len(v))

        def value(r, v=v, t=t):
            with np.errstate(all="ignore"):
                return np.array([(v / (1 + r[0]) ** t).sum()])

        r = bisect(value, 1)[0]
        out.append(None if np.isnan(r) else float(r))
    return pa.array(out, pa.float64())


@function("IRR", 1, 2)
def _irr(c, args):
    from tabulon.plans import formula as f

    udf = F.arrow_udf(_internal, "double")
    if isinstance(args[0], f.Header):
        if not c.position:
            raise f.FormulaError("IRR over a column needs the rows' position")

        def build(own):
            v = own.value(args[0])
            flows = F.collect_list(F.struct(F.col(c.position).try_cast("long").alias("p"), v.col.alias("v")))
            return V.Value(V.NUM, flows, v.err)

        flows = build(c).col
        if c.mode == "summary":
            raise f.FormulaError("use tabulon.operators.table.internal_rates for IRR by group")
        out = udf(c.staged.agg(flows.alias("v")).scalar())
        return V.Value(V.NUM, out, V.when_error(out.isNull(), V.NUMERR))
    raise f.FormulaError("IRR takes a column")
