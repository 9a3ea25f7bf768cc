"""Dates and times as serial numbers.

Serial 1 is 1900-01-01 and 60 the day 1900-02-29 that never was, so serials from 61 on count
from 1899-12-30 and earlier ones from 1899-12-31. The clock is injected.
"""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .registry import function

LAST_SERIAL = 2_958_465
EPOCH_MS = -2_209_161_600_000  # 1899-12-30 in milliseconds


def _lit_date(s: str) -> Column:
    return F.lit(s).cast("date")


def to_date(serial: Column) -> Column:
    """The calendar date of a serial; serial 60 is taken for 1900-02-28 (its parts are corrected where they matter)."""
    n = F.floor(serial).try_cast("int")
    return F.when(n >= 61, F.date_add(_lit_date("1899-12-30"), n)).when(n == 60, _lit_date("1900-02-28")).otherwise(F.date_add(_lit_date("1899-12-31"), n))


def to_serial(date: Column) -> Column:
    n = F.datediff(date, _lit_date("1899-12-30"))
    return F.when(n >= 61, n).otherwise(n - 1).cast("double")


def serial_of(year: int, month: int, day: int) -> float:
    n = (dt.date(year, month, day) - dt.date(1899, 12, 30)).days
    return float(n if n >= 61 else n - 1)


_ISO = re.compile(r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?\s*$")
_US = re.compile(r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$")


def parse_date_constant(s: str) -> float | None:
    """A serial from ISO or month/day/year text."""
    m = _ISO.match(s)
    if m:
        parts = [int(x or 0) for x in m.groups()]
        y, mo, d, h, mi, se = parts
    elif m := _US.match(s):
        mo, d, y = map(int, m.groups())
        h = mi = se = 0
    else:
        return None
    try:
        return serial_of(y, mo, d) + (h * 3600 + mi * 60 + se) / 86400
    except ValueError:
        return None


def parse_date(t: Column) -> Column:
    """Serial of a date text (ISO, or month/day/year), else null."""
    iso = F.when(t.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"), F.try_to_date(F.trim(t), "y-M-d"))
    us = F.when(t.rlike(r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$"), F.try_to_date(F.trim(t), "M/d/y"))
    stamp = F.when(t.rlike(r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?\s*$"), F.try_to_timestamp(F.replace(F.trim(t), F.lit("T"), F.lit(" "))))
    return F.coalesce(to_serial(iso), to_serial(us), V.serial_of_timestamp(stamp))


def as_serial(c, node) -> V.Value:
    """A date argument: a serial, or text that reads as a date or a number."""
    v = c.value(node)
    if v.kind != V.TEXT:
        n = V.to_number(v)
    elif isinstance(v.literal, str) and (s := parse_date_constant(v.literal)) is not None:
        n = V.number(s)
    else:
        s = F.coalesce(parse_date(v.col), V.parse_number(v.col))
        n = V.Value(V.NUM, F.when(v.col.isNull(), F.lit(0.0)).otherwise(s), V.first_error(v.err, V.when_error(v.col.isNotNull() & s.isNull(), V.VALUE)))
    return V.Value(V.NUM, n.col, V.first_error(n.err, V.when_error((n.col < 0) | (n.col > LAST_SERIAL + 1), V.NUMERR)), literal=n.literal)


@function("DATE", 3)
def _date(c, args):
    y, m, d = (c.num(a) for a in args)
    year = F.floor(y.col).try_cast("int")
    year = F.when(year < 1900, year + 1900).otherwise(year)
    months = year * 12 + F.floor(m.col).try_cast("int") - 1
    own_year, own_month = F.floor(months / 12).try_cast("int"), (F.pmod(months, F.lit(12)) + 1).try_cast("int")
    first = F.try_make_date(own_year, own_month, F.lit(1)) if hasattr(F, "try_make_date") else F.make_date(F.least(F.greatest(own_year, F.lit(1)), F.lit(9999)), own_month, F.lit(1))
    serial = to_serial(first) + F.floor(d.col) - 1
    leap = (own_year == 1900) & (own_month == 2) & (F.floor(d.col) == 29)
    late = (own_year == 1900) & (own_month <= 2) & (serial >= 60)
    out = F.when(leap, F.lit(60.0)).when(late, serial).otherwise(serial)
    bad = out.isNull() | (out < 1) | (out > LAST_SERIAL)
    return V.Value(V.NUM, F.when(~bad, out), V.first_error(y.err, m.err, d.err, V.when_error(bad, V.NUMERR)))


def _part(rule, at_60: int):
    def build(c, args):
        s = as_serial(c, args[0])
        out = F.when(F.floor(s.col) == 60, F.lit(float(at_60))).otherwise(rule(to_date(s.col)).cast("double"))
        return V.Value(V.NUM, out, s.err)

    return build


def _year(c, args):
    s = as_serial(c, args[0])
    n = F.floor(s.col)
    return V.Value(V.NUM, F.when(n < 61, F.lit(1900.0)).otherwise(F.year(to_date(s.col)).cast("double")), s.err)


function("YEAR", 1)(_year)
function("MONTH", 1)(_part(lambda d: F.month(d), 2))
function("DAY", 1)(_part(lambda d: F.dayofmonth(d), 29))


@function("DATEVALUE", 1)
def _datevalue(c, args):
    t = c.text(args[0])
    s = F.floor(parse_date(t.col))
    return V.Value(V.NUM, s.cast("double"), V.first_error(t.err, V.when_error(s.isNull(), V.VALUE)))


def _months(rule):
    def build(c, args):
        s, m = as_serial(c, args[0]), c.num(args[1])
        k = F.when(m.col >= 0, F.floor(m.col)).otherwise(F.ceil(m.col)).try_cast("int")
        out = to_serial(rule(F.add_months(to_date(s.col), k)))
        bad = (F.floor(s.col) == 60) | (out < 1) | (out > LAST_SERIAL)
        return V.Value(V.NUM, F.when(~bad, out), V.first_error(s.err, m.err, V.when_error(bad, V.NUMERR)))

    return build


function("EOMONTH", 2)(_months(F.last_day))
function("EDATE", 2)(_months(lambda d: d))


@function("DAYS", 2)
def _days(c, args):
    b, a = as_serial(c, args[0]), as_serial(c, args[1])
    return V.Value(V.NUM, F.floor(b.col).cast("double") - F.floor(a.col), V.first_error(b.err, a.err))


@function("DATEDIF", 3)
def _datedif(c, args):
    a, b = as_serial(c, args[0]), as_serial(c, args[1])
    unit = str(c.constant(args[2])).upper()
    err = V.first_error(a.err, b.err, V.when_error(F.floor(a.col) > F.floor(b.col), V.NUMERR))
    x, y = to_date(a.col), to_date(b.col)
    whole = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x) - F.when(F.dayofmonth(y) < F.dayofmonth(x), 1).otherwise(0)
    days = F.floor(b.col) - F.floor(a.col)
    rest = F.when(F.dayofmonth(y) >= F.dayofmonth(x), F.dayofmonth(y) - F.dayofmonth(x)).otherwise(F.dayofmonth(y) + F.dayofmonth(F.last_day(F.add_months(y, F.lit(-1)))) - F.dayofmonth(x))
    forms = {"Y": F.floor(whole / 12), "M": whole, "D": days, "MD": rest, "YM": F.pmod(whole, F.lit(12)), "YD": F.datediff(y, F.add_months(x, (F.floor(whole / 12) * 12).try_cast("int")))}
    if unit not in forms:
        return V.failure(V.NUMERR)
    return V.Value(V.NUM, forms[unit].cast("double"), err)


@function("WEEKDAY", 1, 2)
def _weekday(c, args):
    s, kind = as_serial(c, args[0]), int(c.constant(args[1] if len(args) > 1 else None, 1))
    if kind not in (1, 2, 3):
        return V.failure(V.NUMERR)
    # serial 1 counts as a Sunday, as the calendar with its extra day has it
    sunday = F.pmod(F.floor(s.col) - 1, F.lit(7))
    out = {1: sunday + 1, 2: F.pmod(sunday + 6, F.lit(7)) + 1, 3: F.pmod(sunday + 6, F.lit(7))}[kind]
    return V.Value(V.NUM, out.cast("double"), s.err)


def _workdays_before(n: Column) -> Column:
    """Monday-to-Friday days in serials 1..n (serial 1 is a Sunday)."""
    weeks, rest = F.floor(n / 7), F.pmod(n, F.lit(7))
    return weeks * 5 + F.least(F.greatest(rest - 1, F.lit(0)), F.lit(5))


def _holidays(c, args, i) -> list[float]:
    """Holidays are constants: one date, or several joined by commas in a text."""
    if i >= len(args):
        return []
    v = c.constant(args[i])
    found = [v] if isinstance(v, float) else [parse_date_constant(x) for x in str(v).split(",")]
    return sorted({float(int(x)) for x in found if x is not None and int(x - 1) % 7 not in (0, 6)})


@function("NETWORKDAYS", 2, 3)
def _networkdays(c, args):
    a, b = as_serial(c, args[0]), as_serial(c, args[1])
    x, y = F.floor(F.least(a.col, b.col)), F.floor(F.greatest(a.col, b.col))
    n = _workdays_before(y) - _workdays_before(x - 1)
    for h in _holidays(c, args, 2):
        n = n - F.when((x <= h) & (y >= h), 1).otherwise(0)
    return V.Value(V.NUM, (F.when(a.col > b.col, -n).otherwise(n)).cast("double"), V.first_error(a.err, b.err))


@function("WORKDAY", 2, 3)
def _workday(c, args):
    s, n = as_serial(c, args[0]), c.num(args[1])
    holidays = [np.datetime64("1899-12-30") + int(h) for h in _holidays(c, args, 2)]

    def step(start: pa.Array, count: pa.Array) -> pa.Array:
        x = start.to_numpy(zero_copy_only=False).astype(float)
        k = np.nan_to_num(count.to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        ok = np.isfinite(x)
        d = np.datetime64("1899-12-30") + np.nan_to_num(np.floor(x)).astype("timedelta64[D]")
        roll = np.where(k > 0, 0, 1)
        forward = np.busday_offset(d, np.where(k > 0, k, 0), roll="backward", holidays=holidays)
        back = np.busday_offset(d, np.where(k < 0, k, 0), roll="forward", holidays=holidays)
        out = np.where(k == 0, d, np.where(roll == 0, forward, back))
        return pa.array((out - np.datetime64("1899-12-30")).astype(np.int64).astype(float), mask=~ok)

    out = F.arrow_udf(step, "double")(s.col, F.when(n.col >= 0, F.floor(n.col)).otherwise(F.ceil(n.col)).cast("double"))
    bad = (out < 1) | (out > LAST_SERIAL)
    return V.Value(V.NUM, F.when(~bad, out), V.first_error(s.err, n.err, V.when_error(bad, V.NUMERR)))


@function("YEARFRAC", 2, 3)
def _yearfrac(c, args):
    a, b = as_serial(c, args[0]), as_serial(c, args[1])
    basis = int(c.constant(args[2] if len(args) > 2 else None, 0))
    if basis not in range(5):
        return V.failure(V.NUMERR)
    x, y = F.least(a.col, b.col), F.greatest(a.col, b.col)
    d1, d2 = to_date(x), to_date(y)
    days = F.floor(y) - F.floor(x)
    if basis in (0, 4):
        p, q = F.dayofmonth(d1), F.dayofmonth(d2)
        p30 = F.least(p, F.lit(30))
        q30 = F.when((q == 31) & (p30 == 30), 30).otherwise(q) if basis == 0 else F.least(q, F.lit(30))
        out = ((F.year(d2) - F.year(d1)) * 360 + (F.month(d2) - F.month(d1)) * 30 + (q30 - p30)) / F.lit(360.0)
    elif basis == 1:
        years = F.year(d2) - F.year(d1) + 1
        length = (F.datediff(F.make_date(F.year(d2) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(d1), F.lit(1), F.lit(1)))) / years
        out = days / length
    else:
        out = days / F.lit(360.0 if basis == 2 else 365.0)
    return V.Value(V.NUM, out.cast("double"), V.first_error(a.err, b.err))


def now_serial(now_ms: int) -> float:
    return (now_ms - EPOCH_MS) / 86_400_000


@function("NOW", 0)
def _now(c, args):
    return V.number(now_serial(c.now_ms))


@function("TODAY", 0)
def _today(c, args):
    return V.number(float(int(now_serial(c.now_ms))))


@function("TIME", 3)
def _time(c, args):
    h, m, s = (c.num(a) for a in args)
    total = F.floor(h.col) * 3600 + F.floor(m.col) * 60 + F.floor(s.col)
    out = F.pmod(total, F.lit(86400)) / F.lit(86400.0)
    return V.Value(V.NUM, F.when(total >= 0, out), V.first_error(h.err, m.err, s.err, V.when_error(total < 0, V.NUMERR)))


def seconds_of_day(serial: Column) -> Column:
    return F.pmod(F.floor((serial - F.floor(serial)) * 86400 + 0.5), F.lit(86400))


def _clock(rule):
    def build(c, args):
        v = c.value(args[0])
        s = as_serial(c, args[0]) if v.kind != V.TEXT else _time_or_date(v)
        return V.Value(V.NUM, F.floor(rule(seconds_of_day(s.col))).cast("double"), s.err)

    return build


def parse_time(t: Column) -> Column:
    """The fraction of a day in ``H:MM[:SS] [AM|PM]``, else null."""
    pattern = F.lit(r"(?i)^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM)?\s*$")
    g = lambda i: F.regexp_extract(t, r"(?i)^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM)?\s*$", i)
    h, m = g(1).try_cast("int"), g(2).try_cast("int")
    s = F.coalesce(F.nullif(g(3), F.lit("")).try_cast("int"), F.lit(0))
    half = F.upper(g(4))
    hour = F.when(half == "PM", F.pmod(h, F.lit(12)) + 12).when(half == "AM", F.pmod(h, F.lit(12))).otherwise(h)
    ok = F.regexp_like(t, pattern) & (m < 60) & (s < 60) & (h < 24) & ((half == "") | ((h >= 1) & (h <= 12)))
    return F.when(ok, (hour * 3600 + m * 60 + s) / F.lit(86400.0))


def _time_or_date(v: V.Value) -> V.Value:
    out = F.coalesce(parse_time(v.col), parse_date(v.col), V.parse_number(v.col))
    return V.Value(V.NUM, out, V.first_error(v.err, V.when_error(out.isNull(), V.VALUE)))


function("HOUR", 1)(_clock(lambda s: s / 3600))
function("MINUTE", 1)(_clock(lambda s: F.pmod(s, F.lit(3600)) / 60))
function("SECOND", 1)(_clock(lambda s: F.pmod(s, F.lit(60))))


@function("TIMEVALUE", 1)
def _timevalue(c, args):
    t = c.text(args[0])
    out = parse_time(t.col)
    return V.Value(V.NUM, out, V.first_error(t.err, V.when_error(out.isNull(), V.VALUE)))


def splitmix(x: int) -> int:
    """One step of splitmix64."""
    m = (1 << 64) - 1
    z = (x + 0x9E3779B97F4A7C15) & m
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
    return z ^ (z >> 31)


def draw(now_ms: int, salt: int = 0) -> float:
    """A number in [0, 1) that depends on the clock and the salt alone."""
    return (splitmix((now_ms ^ salt) & ((1 << 64) - 1)) >> 11) / float(1 << 53)


@function("RAND", 0)
def _rand(c, args):
    return V.number(draw(c.now_ms))


@function("RANDBETWEEN", 2)
def _randbetween(c, args):
    import math

    low, high = math.ceil(c.constant(args[0])), math.floor(c.constant(args[1]))
    if low > high:
        return V.failure(V.NUMERR)
    return V.number(float(low + math.floor(draw(c.now_ms, splitmix(low & 0xFFFFFFFF) ^ (high & 0xFFFFFFFF)) * (high - low + 1))))
