"""Text functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


from . import values as V
from .conditional import wildcard_pattern
from .registry import function

LONGEST = 32_767


def _joined(c, args):
    parts = [c.text(a) for a in args]
    return V.Value(V.TEXT, F.concat(*[p.col for p in parts]), V.first_error(*(p.err for p in parts)))


function("CONCAT", 1, None)(_joined)
function("CONCATENATE", 1, None)(_joined)


def joined_by(items: Column, delimiter: Column) -> Column:
    """Array to text with a delimiter that may be a column."""
    return F.aggregate(items, F.struct(F.lit("").alias("s"), F.lit(False).alias("any")), lambda a, x: F.struct(F.when(a["any"], F.concat(a["s"], delimiter, x)).otherwise(x).alias("s"), F.lit(True).alias("any")), lambda a: a["s"])


def pieces(t: Column, delimiter: Column) -> Column:
    """A text split at a delimiter taken as it is."""
    return F.split(t, F.concat(F.lit(r"\Q"), F.replace(delimiter, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))


@function("TEXTJOIN", 3, None)
def _textjoin(c, args):
    d, skip, parts = c.text(args[0]), c.bool(args[1]), [c.text(a) for a in args[2:]]
    every = F.array(*[p.col for p in parts])
    kept = F.when(skip.col, F.filter(every, lambda x: x != "")).otherwise(every)
    out = joined_by(kept, d.col)
    return V.Value(V.TEXT, out, V.first_error(d.err, skip.err, *(p.err for p in parts)))


def _count_of(c, args, i, default):
    n = c.option(args, i, default)
    return F.floor(n.col).try_cast("int"), n.err, V.when_error(n.col < 0, V.VALUE)


@function("LEFT", 1, 2)
def _left(c, args):
    t = c.text(args[0])
    n, err, bad = _count_of(c, args, 1, 1)
    return V.Value(V.TEXT, F.substr(t.col, F.lit(1), F.greatest(n, F.lit(0))), V.first_error(t.err, err, bad))


@function("RIGHT", 1, 2)
def _right(c, args):
    t = c.text(args[0])
    n, err, bad = _count_of(c, args, 1, 1)
    return V.Value(V.TEXT, F.right(t.col, F.greatest(n, F.lit(0))), V.first_error(t.err, err, bad))


@function("MID", 3)
def _mid(c, args):
    t, s, n = c.text(args[0]), c.num(args[1]), c.num(args[2])
    bad = V.when_error((s.col < 1) | (n.col < 0), V.VALUE)
    at = F.greatest(F.floor(s.col).try_cast("int"), F.lit(1))
    return V.Value(V.TEXT, F.substr(t.col, at, F.greatest(F.floor(n.col).try_cast("int"), F.lit(0))), V.first_error(t.err, s.err, n.err, bad))


def _of_text(rule, kind=V.TEXT):
    def build(c, args):
        t = c.text(args[0])
        return V.Value(kind, rule(t.col), t.err)

    return build


function("LEN", 1)(_of_text(lambda t: F.char_length(t).cast("double"), V.NUM))
function("UPPER", 1)(_of_text(F.upper))
function("LOWER", 1)(_of_text(F.lower))
function("TRIM", 1)(_of_text(lambda t: F.regexp_replace(F.trim(t), " +", " ")))
function("CLEAN", 1)(_of_text(lambda t: F.regexp_replace(t, r"[\x00-\x1F]", "")))
#: Capitals after anything that isn't a letter: runs of letters are capitalised each.
function("PROPER", 1)(_of_text(lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")))


@function("SUBSTITUTE", 3, 4)
def _substitute(c, args):
    t, old, new = (c.text(a) for a in args[:3])
    err = V.first_error(t.err, old.err, new.err)
    if len(args) < 4:
        return V.Value(V.TEXT, F.when(old.col == "", t.col).otherwise(F.replace(t.col, old.col, new.col)), err)
    n = c.num(args[3])
    k = F.floor(n.col).try_cast("int")
    parts = pieces(t.col, old.col)
    there = (old.col != "") & (k >= 1) & (k < F.size(parts))
    at = F.when(there, k).otherwise(1)
    out = F.concat(joined_by(F.slice(parts, F.lit(1), at), old.col), new.col, joined_by(F.slice(parts, at + 1, F.size(parts)), old.col))
    return V.Value(V.TEXT, F.when(there, out).otherwise(t.col), V.first_error(err, n.err, V.when_error(k < 1, V.VALUE)))


@function("REPLACE", 4)
def _replace(c, args):
    t, s, n, new = c.text(args[0]), c.num(args[1]), c.num(args[2]), c.text(args[3])
    bad = V.when_error((s.col < 1) | (n.col < 0), V.VALUE)
    at, k = F.greatest(F.floor(s.col).try_cast("int"), F.lit(1)), F.greatest(F.floor(n.col).try_cast("int"), F.lit(0))
    out = F.concat(F.substr(t.col, F.lit(1), at - 1), new.col, F.substr(t.col, at + k))
    return V.Value(V.TEXT, out, V.first_error(t.err, s.err, n.err, new.err, bad))


def _found(at: Column, err) -> V.Value:
    return V.Value(V.NUM, F.when(at > 0, at.cast("double")), V.first_error(err, V.when_error(F.coalesce(at, F.lit(0)) == 0, V.VALUE)))


@function("FIND", 2, 3)
def _find(c, args):
    needle, hay, start = c.text(args[0]), c.text(args[1]), c.option(args, 2, 1)
    s = F.floor(start.col).try_cast("int")
    ok = (s >= 1) & (s <= F.char_length(hay.col) + 1)
    at = F.when(ok, F.when(needle.col == "", s).otherwise(F.position(needle.col, hay.col, s)))
    return _found(at, V.first_error(needle.err, hay.err, start.err))


@function("SEARCH", 2, 3)
def _search(c, args):
    hay, start = c.text(args[1]), c.option(args, 2, 1)
    needle = c.text(args[0])
    s = F.floor(start.col).try_cast("int")
    ok = (s >= 1) & (s <= F.char_length(hay.col) + 1)
    rest = F.substr(hay.col, F.greatest(s, F.lit(1)))
    if isinstance(needle.literal, str) and re.search(r"[*?~]", needle.literal):
        hit = F.regexp_instr(rest, F.lit(wildcard_pattern(needle.literal, whole=False)))
    else:
        hit = F.when(needle.col == "", F.lit(1)).otherwise(F.position(F.lower(needle.col), F.lower(rest)))
    return _found(F.when(ok, F.when(hit > 0, hit + s - 1).otherwise(0)), V.first_error(needle.err, hay.err, start.err))


@function("TEXT", 2)
def _text(c, args):
    from .numberformat import formatted

    v, code = c.value(args[0]), c.constant(args[1])
    return formatted(v, str(code))


@function("VALUE", 1)
def _value(c, args):
    from .dates import parse_date

    v = c.value(args[0])
    if v.kind != V.TEXT:
        return V.to_number(v)
    n = F.coalesce(V.parse_number(v.col), parse_date(v.col))
    out = F.when(v.col.isNull(), F.lit(0.0)).otherwise(n) if v.referenced else n
    return V.Value(V.NUM, out, V.first_error(v.err, V.when_error(out.isNull(), V.VALUE)))


@function("NUMBERVALUE", 1, 3)
def _numbervalue(c, args):
    t = c.text(args[0])
    dec = c.constant(args[1] if len(args) > 1 else None, ".")[:1]
    grp = c.constant(args[2] if len(args) > 2 else None, ",")[:1]
    bare = F.regexp_replace(t.col, r"\s", "")
    bare = F.replace(bare, F.lit(grp), F.lit("")) if grp else bare
    bare = F.replace(bare, F.lit(dec), F.lit(".")) if dec != "." else bare
    n = F.when(bare == "", F.lit(0.0)).otherwise(V.parse_number(bare))
    return V.Value(V.NUM, n, V.first_error(t.err, V.when_error(n.isNull(), V.VALUE)))


@function("REPT", 2)
def _rept(c, args):
    t, n = c.text(args[0]), c.num(args[1])
    k = F.floor(n.col)
    bad = (n.col < 0) | (F.char_length(t.col) * k > LONGEST)
    out = F.repeat(t.col, F.when(~bad, k).otherwise(0).try_cast("int"))
    return V.Value(V.TEXT, out, V.first_error(t.err, n.err, V.when_error(bad, V.VALUE)))


@function("EXACT", 2)
def _exact(c, args):
    a, b = c.text(args[0]), c.text(args[1])
    return V.Value(V.BOOL, a.col == b.col, V.first_error(a.err, b.err))


@function("CHAR", 1)
def _char(c, args):
    n = c.num(args[0])
    k = F.floor(n.col)
    ok = (k >= 1) & (k <= 255)
    return V.Value(V.TEXT, F.char(F.when(ok, k).otherwise(1).try_cast("int")), V.first_error(n.err, V.when_error(~ok, V.VALUE)))


@function("CODE", 1)
def _code(c, args):
    t = c.text(args[0])
    return V.Value(V.NUM, F.ascii(t.col).cast("double"), V.first_error(t.err, V.when_error(t.col == "", V.VALUE)))


def _side(before: bool):
    def build(c, args):
        t, d = c.text(args[0]), c.text(args[1])
        n = int(c.constant(args[2] if len(args) > 2 else None, 1))
        err = V.first_error(t.err, d.err)
        if n == 0:
            return V.failure(V.VALUE)
        parts = pieces(t.col, d.col)
        size = F.size(parts)
        left = F.lit(n) if n > 0 else size + n
        there = (left >= 1) & (left < size)
        cut = F.slice(parts, F.lit(1), F.greatest(F.when(there, left).otherwise(0), F.lit(0))) if before else F.slice(parts, F.when(there, left + 1).otherwise(1), F.when(there, size - left).otherwise(0))
        joined = joined_by(cut, d.col)
        return V.Value(V.TEXT, F.when(there, joined), V.first_error(err, V.when_error(d.col == "", V.VALUE), V.when_error(~there, V.NA)))

    return build


function("TEXTBEFORE", 2, 3)(_side(True))
function("TEXTAFTER", 2, 3)(_side(False))

