"""Lexer, parser and printer of the formula language.

Operators from loose to tight: comparisons, ``&``, ``+ -``, ``* /``, ``^`` (left to right),
sign, ``%``. ``{Header}`` names a table column; ``A1``, ``$A$1:B2``, ``A:C``, ``2:5`` and
``Sheet!A1`` are cell references.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Error codes.
ERRORS = ("#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#N/A", "#NUM!", "#CIRC!", "#SPILL!", "#CALC!")
MAX_ROWS, MAX_COLS = 1_048_576, 16_384
#: Functions whose value may change without their arguments changing.
VOLATILE = frozenset({"NOW", "TODAY", "RAND", "RANDBETWEEN", "OFFSET", "INDIRECT"})


class FormulaError(ValueError):
    """A formula that doesn't parse."""


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Boolean:
    value: bool


@dataclass(frozen=True)
class Failure:
    code: str


@dataclass(frozen=True)
class Header:
    name: str


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Cell:
    """Zero-based; None on an axis that an open range leaves out."""

    row: int | None
    col: int | None
    row_fixed: bool = False
    col_fixed: bool = False


@dataclass(frozen=True)
class Ref:
    first: Cell
    last: Cell
    sheet: str | None = None

    @property
    def single(self) -> bool:
        return self.first == self.last and self.first.row is not None and self.first.col is not None


@dataclass(frozen=True)
class Missing:
    """An argument left empty."""


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str  # "-", "+" or "%"
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


_TOKENS = re.compile(
    r"""(?P<space>\s+)
    |(?P<error>\#(?:DIV/0!|VALUE!|REF!|NAME\?|N/A|NUM!|CIRC!|SPILL!|CALC!))
    |(?P<text>"(?:[^"]|"")*")
    |(?P<header>\{[^{}]+\})
    |(?P<sheet>(?:'(?:[^']|'')+'|[A-Za-z_][\w.]*)!)
    |(?P<area>\$?[A-Za-z]{1,3}\$?\d+:\$?[A-Za-z]{1,3}\$?\d+(?![\w.(])|\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}(?![\w.(])|\$?\d+:\$?\d+(?![\w.(]))
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<cell>\$?[A-Za-z]{1,3}\$?\d+(?![\w.(]))
    |(?P<word>[A-Za-z_\\][\w.\\]*)
    |(?P<op><>|<=|>=|[-+*/^&=<>%(),])""",
    re.VERBOSE,
)
_PREFIXES = ("_XLFN._XLWS.", "_XLFN.", "_XLWS.")


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(number: int) -> str:
    out = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def parse_cell(text: str) -> Cell:
    m = re.fullmatch(r"(\$?)([A-Za-z]{1,3})?(\$?)(\d+)?", text)
    if not m or not (m[2] or m[4]):
        raise FormulaError(f"bad reference {text!r}")
    col = column_number(m[2]) if m[2] else None
    row = int(m[4]) - 1 if m[4] else None
    if col is not None and col >= MAX_COLS or row is not None and not 0 <= row < MAX_ROWS:
        raise FormulaError("#REF!")
    fixed = (m[1] == "$", m[3] == "$") if m[2] else (False, m[1] == "$" or m[3] == "$")
    return Cell(row, col, fixed[1], fixed[0])


class _Parser:
    LEVELS = {"=": 1, "<>": 1, "<": 1, "<=": 1, ">": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}

    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise FormulaError(f"can't read {text[at : at + 10]!r}")
            if m.lastgroup != "space":
                self.items.append((m.lastgroup, m.group()))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, op: str | None = None) -> tuple[str, str]:
        kind, value = self.peek()
        if op is not None and (kind, value) != ("op", op):
            raise FormulaError(f"expected {op!r}, not {value!r}")
        self.at += 1
        return kind, value

    def expression(self, level: int = 1):
        left = self.operand()
        while True:
            kind, op = self.peek()
            own = self.LEVELS.get(op, 0) if kind == "op" else 0
            if own < level or not own:
                return left
            self.take()
            left = Binary(op, left, self.expression(own + 1))

    def operand(self):
        kind, value = self.peek()
        if kind == "op" and value in "+-":
            self.take()
            return Unary(value, self.operand())
        out = self.primary()
        while self.peek() == ("op", "%"):
            self.take()
            out = Unary("%", out)
        return out

    def primary(self):
        kind, value = self.take()
        if kind == "number":
            return Number(float(value))
        if kind == "text":
            return Text(value[1:-1].replace('""', '"'))
        if kind == "error":
            return Failure(value)
        if kind == "header":
            return Header(value[1:-1].strip())
        if kind == "sheet":
            name = value[:-1]
            name = name[1:-1].replace("''", "'") if name.startswith("'") else name
            kind, value = self.take()
            if kind == "error":
                return Failure(value)
            return self.reference(kind, value, name)
        if kind in ("cell", "area"):
            return self.reference(kind, value, None)
        if kind == "word":
            if self.peek() == ("op", "("):
                return Call(self.function(value), self.arguments())
            if value.upper() in ("TRUE", "FALSE"):
                return Boolean(value.upper() == "TRUE")
            return Name(value)
        if (kind, value) == ("op", "("):
            out = self.expression()
            self.take(")")
            return out
        raise FormulaError(f"unexpected {value!r}" if value else "unexpected end")

    def reference(self, kind: str, value: str, sheet: str | None):
        if kind not in ("cell", "area"):
            raise FormulaError(f"expected a reference, not {value!r}")
        first, _, last = value.partition(":")
        try:
            a = parse_cell(first)
            b = parse_cell(last) if last else a
        except FormulaError as e:
            if str(e) == "#REF!":
                return Failure("#REF!")
            raise
        low = lambda x, y: None if x is None else min(x, y)
        high = lambda x, y: None if x is None else max(x, y)
        if last:
            a, b = Cell(low(a.row, b.row), low(a.col, b.col), a.row_fixed, a.col_fixed), Cell(high(a.row, b.row), high(a.col, b.col), b.row_fixed, b.col_fixed)
        return Ref(a, b, sheet)

    @staticmethod
    def function(word: str) -> str:
        name = word.upper()
        for prefix in _PREFIXES:
            name = name.removeprefix(prefix)
        return name

    def arguments(self) -> tuple:
        self.take("(")
        out: list = []
        if self.peek() == ("op", ")"):
            self.take()
            return ()
        while True:
            out.append(Missing() if self.peek() in (("op", ","), ("op", ")")) else self.expression())
            kind, value = self.take()
            if (kind, value) == ("op", ")"):
                return tuple(out)
            if (kind, value) != ("op", ","):
                raise FormulaError(f"expected ',' or ')', not {value!r}")


def parse(text: str):
    """The syntax tree of a formula; a leading ``=`` is optional."""
    p = _Parser(text.strip().removeprefix("="))
    out = p.expression()
    if p.peek()[0] != "end":
        raise FormulaError(f"unexpected {p.peek()[1]!r}")
    return out


def walk(node):
    """A node and all below it, depth first."""
    yield node
    below = node.args if isinstance(node, Call) else (node.arg,) if isinstance(node, Unary) else (node.left, node.right) if isinstance(node, Binary) else ()
    for n in below:
        yield from walk(n)


def headers(node) -> list[str]:
    return list(dict.fromkeys(n.name for n in walk(node) if isinstance(n, Header)))


def references(node) -> list[Ref]:
    return [n for n in walk(node) if isinstance(n, Ref)]


def is_volatile(node) -> bool:
    return any(isinstance(n, Name) or isinstance(n, Call) and n.name in VOLATILE for n in walk(node))


def _cell_text(c: Cell) -> str:
    col = "" if c.col is None else ("$" if c.col_fixed else "") + column_letters(c.col)
    return col + ("" if c.row is None else ("$" if c.row_fixed else "") + str(c.row + 1))


def number_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.15g}"


def to_text(node, level: int = 0, cell=_cell_text) -> str:
    """Canonical text with the parentheses that are needed. ``cell`` prints one corner of a reference."""
    if isinstance(node, Number):
        return number_text(node.value)
    if isinstance(node, Text):
        return '"' + node.value.replace('"', '""') + '"'
    if isinstance(node, Boolean):
        return "TRUE" if node.value else "FALSE"
    if isinstance(node, Failure):
        return node.code
    if isinstance(node, Header):
        return "{" + node.name + "}"
    if isinstance(node, Name):
        return node.name
    if isinstance(node, Missing):
        return ""
    if isinstance(node, Ref):
        sheet = ""
        if node.sheet is not None:
            plain = re.fullmatch(r"[A-Za-z_][\w.]*", node.sheet) and not re.fullmatch(r"[A-Za-z]{1,3}\d+", node.sheet)
            sheet = (node.sheet if plain else "'" + node.sheet.replace("'", "''") + "'") + "!"
        one = cell(node.first)
        return sheet + (one if node.single else f"{one}:{cell(node.last)}")
    if isinstance(node, Call):
        return f"{node.name}({','.join(to_text(a, 0, cell) for a in node.args)})"
    if isinstance(node, Unary):
        inner = to_text(node.arg, 7 if node.op == "%" else 6, cell)
        text, own = (inner + "%", 7) if node.op == "%" else (node.op + inner, 6)
    else:
        own = _Parser.LEVELS[node.op]
        text = to_text(node.left, own, cell) + node.op + to_text(node.right, own + 1, cell)
    return f"({text})" if own < level else text


def shape(node, row: int, col: int) -> str:
    """The formula relative to its cell: copies of one formula have one shape."""

    def corner(c: Cell) -> str:
        out = ""
        if c.row is not None:
            out += f"R{c.row + 1}" if c.row_fixed else f"R[{c.row - row}]"
        if c.col is not None:
            out += f"C{c.col + 1}" if c.col_fixed else f"C[{c.col - col}]"
        return out

    return to_text(node, 0, corner)


def rewrite(node, change):
    """The tree with each reference replaced by ``change(ref)``, which may give any node."""
    if isinstance(node, Ref):
        return change(node)
    if isinstance(node, Call):
        return Call(node.name, tuple(rewrite(a, change) for a in node.args))
    if isinstance(node, Unary):
        return Unary(node.op, rewrite(node.arg, change))
    if isinstance(node, Binary):
        return Binary(node.op, rewrite(node.left, change), rewrite(node.right, change))
    return node


def shifted(node, rows: int, cols: int):
    """The formula as if copied ``rows`` down and ``cols`` right; what leaves the grid becomes #REF!."""

    def move(ref: Ref):
        out = []
        for c in (ref.first, ref.last):
            r = c.row if c.row is None or c.row_fixed else c.row + rows
            k = c.col if c.col is None or c.col_fixed else c.col + cols
            if r is not None and not 0 <= r < MAX_ROWS or k is not None and not 0 <= k < MAX_COLS:
                return Failure("#REF!")
            out.append(Cell(r, k, c.row_fixed, c.col_fixed))
        return Ref(out[0], out[1], ref.sheet)

    return rewrite(node, move)


def moved_by_insert(node, axis: str, at: int, count: int, sheet: str, own_sheet: str):
    """References after ``count`` rows or columns were inserted at ``at`` in ``sheet``."""

    def move(ref: Ref):
        if (ref.sheet or own_sheet).lower() != sheet.lower():
            return ref
        push = lambda v: v if v is None or v < at else v + count
        most = MAX_ROWS if axis == "row" else MAX_COLS
        value = lambda c: c.row if axis == "row" else c.col
        if value(ref.last) is not None and push(value(ref.first)) >= most:
            return Failure("#REF!")
        place = lambda c: Cell(push(c.row), c.col, c.row_fixed, c.col_fixed) if axis == "row" else Cell(c.row, push(c.col), c.row_fixed, c.col_fixed)
        return Ref(place(ref.first), place(ref.last), ref.sheet)

    return rewrite(node, move)


def moved_by_delete(node, axis: str, at: int, count: int, sheet: str, own_sheet: str):
    """References after ``count`` rows or columns at ``at`` were deleted: ranges shrink, what is gone is #REF!."""

    def move(ref: Ref):
        if (ref.sheet or own_sheet).lower() != sheet.lower():
            return ref
        a, b = (ref.first.row, ref.last.row) if axis == "row" else (ref.first.col, ref.last.col)
        if a is None:
            return ref
        if at <= a and b < at + count:
            return Failure("#REF!")
        low = a if a < at else at if a < at + count else a - count
        high = b if b < at else at - 1 if b < at + count else b - count
        if axis == "row":
            return Ref(Cell(low, ref.first.col, ref.first.row_fixed, ref.first.col_fixed), Cell(high, ref.last.col, ref.last.row_fixed, ref.last.col_fixed), ref.sheet)
        return Ref(Cell(ref.first.row, low, ref.first.row_fixed, ref.first.col_fixed), Cell(ref.last.row, high, ref.last.row_fixed, ref.last.col_fixed), ref.sheet)

    return rewrite(node, move)
