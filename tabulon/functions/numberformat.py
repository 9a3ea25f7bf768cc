"""Number formats: ``0 # , . %`` patterns, dates and times, sections for signs and text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .dates import seconds_of_day, to_date

_MONTHS = {1: "M", 2: "MM", 3: "MMM", 4: "MMMM"}


def sections(code: str) -> list[str]:
    """Split at semicolons outside quotes."""
    out, quoted, own = [], False, ""
    i = 0
    while i < len(code):
        c = code[i]
        if c == "\\" and i + 1 < len(code):
            own += code[i : i + 2]
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        if c == ";" and not quoted:
            out.append(own)
            own = ""
        else:
            own += c
        i += 1
    return [*out, own]


def is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.', "", code)
    return bool(re.search(r"[ymdhsYMDHS]", bare)) and not re.search(r"[0#]", bare)


def _date(serial: Column, code: str) -> Column:
    d, s = to_date(serial), seconds_of_day(serial)
    half = re.search(r"AM/PM", code, re.IGNORECASE) is not None
    items = re.findall(r'"[^"]*"|\\.|AM/PM|am/pm|[yY]+|[mM]+|[dD]+|[hH]+|[sS]+|.', code)
    kinds = [t[0].lower() if t[0].lower() in "ymdhs" and t.lower() != "am/pm" else "" for t in items]
    parts = []
    for i, t in enumerate(items):
        k, n = kinds[i], len(t)
        if k == "m":
            before = next((kinds[j] for j in range(i - 1, -1, -1) if kinds[j]), "")
            after = next((kinds[j] for j in range(i + 1, len(items)) if kinds[j]), "")
            if before == "h" or after == "s":
                v = F.floor(F.pmod(s, F.lit(3600)) / 60)
                parts.append(F.lpad(v.cast("string"), 2, "0") if n > 1 else v.cast("string"))
            elif n == 5:
                parts.append(F.substring(F.date_format(d, "MMMM"), 1, 1))
            else:
                parts.append(F.date_format(d, _MONTHS[min(n, 4)]))
        elif k == "y":
            parts.append(F.date_format(d, "yy" if n <= 2 else "yyyy"))
        elif k == "d":
            parts.append(F.date_format(d, {1: "d", 2: "dd", 3: "E"}.get(n, "EEEE")))
        elif k == "h":
            h = F.floor(s / 3600)
            h = F.when(F.pmod(h, F.lit(12)) == 0, F.lit(12)).otherwise(F.pmod(h, F.lit(12))) if half else h
            parts.append(F.lpad(h.cast("string"), 2, "0") if n > 1 else h.cast("string"))
        elif k == "s":
            v = F.pmod(s, F.lit(60))
            parts.append(F.lpad(v.cast("string"), 2, "0") if n > 1 else v.cast("string"))
        elif t.lower() == "am/pm":
            parts.append(F.when(s < 43200, F.lit("AM")).otherwise(F.lit("PM")))
        else:
            parts.append(F.lit(t[1:-1] if t.startswith('"') else t[1:] if t.startswith("\\") else t))
    return F.concat(*parts)


def _literal(s: str) -> str:
    return re.sub(r'"([^"]*)"|\\(.)|_(.)|\*(.)', lambda m: m[1] if m[1] is not None else m[2] or (" " if m[3] else ""), s)


def _number(x: Column, code: str) -> Column:
    """A magnitude by one section's pattern."""
    m = re.search(r"[0#?][0#?,.]*|\.[0#?]+", re.sub(r'"[^"]*"|\\.', lambda k: "\0" * len(k.group()), code))
    if not m:
        return F.lit(_literal(code))
    prefix, pattern, suffix = code[: m.start()], m.group(), code[m.end() :]
    scale = pattern[len(pattern.rstrip(",")) :].count(",")
    pattern = pattern.rstrip(",")
    whole, _, part = pattern.partition(".")
    percent = code.count("%") - sum(k.count("%") for k in re.findall(r'"[^"]*"', code))
    value = x * float(100**percent) / float(1000**scale)
    least, most = part.count("0"), len(part)
    digits = max(1, whole.count("0")) if "0" in whole else 0
    rounded = F.floor(value * float(10**most) + 0.5 + 1e-9)
    units, rest = F.floor(rounded / float(10**most)), F.pmod(rounded, F.lit(10**most))
    left = units.cast("decimal(38,0)").cast("string")
    left = F.lpad(left, F.greatest(F.char_length(left), F.lit(digits)), F.lit("0")) if digits else F.when(units == 0, F.lit("")).otherwise(left)
    if "," in whole:
        left = F.regexp_replace(left, r"(\d)(?=(\d{3})+$)", "$1,")
    out = left
    if most:
        right = F.lpad(rest.cast("decimal(38,0)").cast("string"), most, "0")
        if least < most:
            right = F.concat(F.substring(right, 1, least), F.regexp_replace(F.substr(right, F.lit(least + 1)), "0+$", ""))
        out = F.concat(left, F.lit("."), right)
    return F.concat(F.lit(_literal(prefix)), out, F.lit(_literal(suffix)))


def formatted(v: V.Value, code: str) -> V.Value:
    """The text of a value by a format code (a constant)."""
    shown = V.to_text(v)
    if code.strip().lower() in ("general", "") or code.startswith("["):
        return shown if code else V.Value(V.TEXT, F.lit(""), v.err)
    if v.kind == V.TEXT:
        n = V.parse_number(v.col)
        out = formatted(V.Value(V.NUM, n), code)
        return V.Value(V.TEXT, F.when(n.isNull(), shown.col).otherwise(out.col), v.err)
    if v.kind == V.BOOL:
        return shown
    x = V.to_number(v)
    if is_date(code):
        return V.Value(V.TEXT, _date(x.col, code), V.first_error(x.err, V.when_error(x.col < 0, V.VALUE)))
    own = sections(code)
    size = F.abs(x.col)
    render = lambda c: _number(size, c) if c else F.lit("")
    if len(own) == 1:
        out = render(own[0])
        return V.Value(V.TEXT, F.when((x.col < 0) & out.rlike("[1-9]"), F.concat(F.lit("-"), out)).otherwise(out), x.err)
    zero = own[2] if len(own) > 2 else own[0]
    return V.Value(V.TEXT, F.when(x.col > 0, render(own[0])).when(x.col < 0, render(own[1])).otherwise(render(zero)), x.err)
