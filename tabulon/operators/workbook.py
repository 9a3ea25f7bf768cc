"""Workbooks as immutable states: cells as a frame, view state beside it, actions from state to state.

``apply(workbook, action)`` is the one way to change a workbook. Cells are never gathered but for
what an action's own bound allows; sheets, names, merges, formats, rules and sizes are small and live on
the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import values as V
from tabulon.plans import formula as f

from . import cells as C

#: Cells that a fill may start from, and that one formatting action may touch.
MOST_SOURCE, MOST_FORMATTED = 10_000, 200_000

Area = tuple[int, int, int, int]


class ActionError(ValueError):
    """An action that can't be applied; the workbook stays as it was."""


@dataclass(frozen=True)
class Workbook:
    cells: DataFrame
    sheets: tuple[str, ...] = ("Sheet1",)
    names: dict[str, str] = field(default_factory=dict)
    filters: dict[str, tuple[Area, int, tuple[str, ...]]] = field(default_factory=dict)
    merges: tuple[tuple[str, Area], ...] = ()
    formats: tuple[tuple[str, Area, tuple[tuple[str, object], ...]], ...] = ()
    rules: tuple[tuple[str, Area, str, str], ...] = ()  # sheet, area, formula, attribute=value
    sizes: dict[tuple[str, str, int], float] = field(default_factory=dict)
    frozen: dict[str, tuple[int, int]] = field(default_factory=dict)
    undone: tuple[Workbook, ...] = ()
    before: Workbook | None = None

    @staticmethod
    def empty(spark: SparkSession) -> Workbook:
        return Workbook(spark.createDataFrame([], C.SCHEMA))

    def viewport(self, sheet: str, area: Area) -> DataFrame:
        """Cells of an area with their formats' number code; rows that the sheet's filter hides are left out."""
        own = C.typed(self.cells.where(C.within(sheet, *area)))
        hidden = self.hidden_rows(sheet)
        return own if hidden is None else own.join(hidden, "r", "left_anti")

    def hidden_rows(self, sheet: str) -> DataFrame | None:
        """Rows that the sheet's filter hides: a header row never is."""
        if sheet not in self.filters:
            return None
        (r0, _, r1, _), column, allowed = self.filters[sheet]
        rows = self.cells.sparkSession.range(r0 + 1, r1 + 1).select(F.col("id").cast("int").alias("r"))
        kept = self.cells.where(C.within(sheet, r0 + 1, column, r1, column) & F.coalesce("input", F.lit("")).isin(list(allowed))).select("r")
        if "" in allowed:
            kept = kept.unionAll(rows.join(self.cells.where(C.within(sheet, r0 + 1, column, r1, column)), "r", "left_anti").select("r"))
        return rows.join(kept, "r", "left_anti")


def _sheet(w: Workbook, name: str) -> str:
    own = next((s for s in w.sheets if s.lower() == name.lower()), None)
    if own is None:
        raise ActionError(f"no sheet {name!r}")
    return own


def _meets(a: Area, b: Area) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def _inside(a: Area, b: Area) -> bool:
    return b[0] <= a[0] and a[2] <= b[2] and b[1] <= a[1] and a[3] <= b[3]


def _edit(w, a):
    r, c = a["at"]
    return replace(w, cells=C.edit(w.cells, _sheet(w, a["sheet"]), r, c, a["input"]))


def _clear(w, a):
    area = a["range"] if "range" in a else (*a["at"], *a["at"])
    return replace(w, cells=C.clear(w.cells, _sheet(w, a["sheet"]), *area))


def _paste(w, a):
    """Copies tile over a target that is an exact multiple of the source."""
    sheet, (r0, c0, r1, c1), target = _sheet(w, a["sheet"]), a["source"], a["target"]
    high, wide = r1 - r0 + 1, c1 - c0 + 1
    down, across = (target[2] - target[0] + 1, target[3] - target[1] + 1)
    fits = down % high == 0 and across % wide == 0
    spots = [(target[0] + i * high, target[1] + j * wide) for i in range(down // high if fits else 1) for j in range(across // wide if fits else 1)]
    source = w.cells
    if a.get("mode") == "values" and not a.get("cut"):
        source = source.where(~(C.within(sheet, r0, c0, r1, c1) & F.col("input").startswith("=")))
    out = C.paste(source, sheet, (r0, c0, r1, c1), spots[0], bool(a.get("cut")))
    for at in spots[1:]:
        out = C.paste(out, sheet, (r0, c0, r1, c1), at)
    if a.get("cut"):
        dr, dc = spots[0][0] - r0, spots[0][1] - c0

        def follow(ref: f.Ref, own: str):
            if (ref.sheet or own).lower() != sheet.lower() or ref.first.row is None or ref.first.col is None:
                return ref
            if not _inside((ref.first.row, ref.first.col, ref.last.row, ref.last.col), (r0, c0, r1, c1)):
                return ref
            go = lambda x: f.Cell(x.row + dr, x.col + dc, x.row_fixed, x.col_fixed)
            return f.Ref(go(ref.first), go(ref.last), ref.sheet)

        out = C.rewritten(out, lambda tree, own, r, c: f.rewrite(tree, lambda ref: follow(ref, own)))
    elif source is not w.cells:
        out = out.unionByName(w.cells.where(C.within(sheet, r0, c0, r1, c1) & F.col("input").startswith("=")))
    return replace(w, cells=out)


def _fill_value(seeds: list[str | None], k: int, shift: Callable[[str, int], str]) -> str | None:
    """The k-th value (from 0) of a filled line: formulas shift, even steps go on, a counter at a text's end counts, others repeat."""
    numbers = [float(x) for x in seeds if x is not None and re.match(V.NUMBER_PATTERN, x) and "%" not in x]
    steps = {round(b - a, 9) for a, b in zip(numbers, numbers[1:], strict=False)}
    if len(numbers) == len(seeds) > 1 and len(steps) == 1:
        return f.number_text(numbers[0] + k * (numbers[1] - numbers[0]))
    one = seeds[k % len(seeds)]
    if one is not None and one.startswith("=") and len(one) > 1:
        return shift(one, k - k % len(seeds))
    m = re.fullmatch(r"(.*?\D)(\d+)", one or "")
    if m and len(seeds) == 1:
        return m[1] + str(int(m[2]) + k).zfill(len(m[2]) if m[2].startswith("0") else 0)
    return one


def _fill(w, a):
    sheet, (r0, c0, r1, c1), target = _sheet(w, a["sheet"]), a["source"], a["target"]
    if (r1 - r0 + 1) * (c1 - c0 + 1) > MOST_SOURCE:
        raise ActionError("the source of a fill is too large")
    rows = w.cells.where(C.within(sheet, r0, c0, r1, c1)).collect()
    at = {(x.r, x.c): x.input for x in rows}
    down = target[2] > r1 or target[0] < r0
    made = []
    for line in range(c0, c1 + 1) if down else range(r0, r1 + 1):
        seeds = [at.get((i, line) if down else (line, i)) for i in (range(r0, r1 + 1) if down else range(c0, c1 + 1))]
        for k, i in enumerate(range(r0, target[2] + 1) if down else range(c0, target[3] + 1)):
            if k < len(seeds):
                continue

            def shift(text: str, by: int) -> str:
                return "=" + f.to_text(f.shifted(f.parse(text), by if down else 0, 0 if down else by))  # noqa: B023

            x = _fill_value(seeds, k, shift)
            if x is not None:
                made.append((sheet, i, line, x) if down else (sheet, line, i, x))
    area = (r1 + 1, c0, target[2], c1) if down else (r0, c1 + 1, r1, target[3])
    left = C.clear(w.cells, sheet, *area)
    return replace(w, cells=left.unionByName(w.cells.sparkSession.createDataFrame(made, C.SCHEMA)) if made else left)


def _structural(edit: Callable, axis: str):
    def run(w, a):
        if a["count"] < 1 or a["at"] < 0:
            raise ActionError("nothing to insert or delete")
        return replace(w, cells=edit(w.cells, axis, _sheet(w, a["sheet"]), a["at"], a["count"]))

    return run


def _sort(w, a):
    """Rows of an area by columns, blanks last; a grid has at most 1,048,576 rows, so one ordered pass is bounded."""
    sheet, (r0, c0, r1, c1) = _sheet(w, a["sheet"]), a["range"]
    top = r0 + bool(a.get("has_header"))
    block = w.cells.where(C.within(sheet, top, c0, r1, c1))
    own = C.typed(block)
    rank = F.when(F.col("kind") == "num", 0).when(F.col("kind") == "bool", 2).otherwise(1)
    keys, order = [], []
    for i, (column, up) in enumerate(a["keys"]):
        cell = F.when((F.col("c") == column) & (F.col("kind") != "empty"), F.struct(rank.alias("t"), F.col("n"), F.lower(F.coalesce("s", "input")).alias("s"), F.col("b")))
        keys.append(F.max(cell).alias(f"k{i}"))
        parts = [F.col(f"k{i}.{x}") for x in ("t", "n", "s", "b")]
        order += [F.col(f"k{i}").isNull()] + [p.asc_nulls_last() if up else p.desc_nulls_last() for p in parts]
    rows = own.groupBy("r").agg(*keys)
    moved = rows.select("r", (F.row_number().over(Window.orderBy(*order, "r")) - 1 + top).alias("to"))
    block = block.join(moved, "r").select("sheet", F.col("to").alias("r"), "c", "input", (F.col("to") - F.col("r")).alias("by"))
    still = block.where("by = 0 or not startswith(input, '=')").drop("by")
    shifted = block.where("by <> 0 and startswith(input, '=')").groupBy("by").applyInArrow(_shift_rows, C.SCHEMA)
    return replace(w, cells=w.cells.where(~C.within(sheet, top, c0, r1, c1)).unionByName(still).unionByName(shifted))


def _shift_rows(table):
    """Formulas of rows that moved alike shift by that distance."""
    import pyarrow as pa

    by = table.column("by")[0].as_py()
    out = []
    for text in table.column("input").to_pylist():
        try:
            text = "=" + f.to_text(f.shifted(f.parse(text), by, 0))
        except f.FormulaError:
            pass
        out.append(text)
    return pa.table({"sheet": table.column("sheet"), "r": table.column("r").cast(pa.int32()), "c": table.column("c"), "input": pa.array(out, pa.string())})


def _filter(w, a):
    return replace(w, filters={**w.filters, _sheet(w, a["sheet"]): (tuple(a["range"]), a["column"], tuple(a["allowed"]))})


def _filter_clear(w, a):
    own = _sheet(w, a["sheet"])
    return replace(w, filters={k: v for k, v in w.filters.items() if k != own})


def _merge(w, a):
    sheet, area = _sheet(w, a["sheet"]), tuple(a["range"])
    left = tuple(m for m in w.merges if m[0] != sheet or not _meets(m[1], area))
    return replace(w, cells=C.merge(w.cells, sheet, *area), merges=(*left, (sheet, area)))


def _merge_clear(w, a):
    sheet, area = _sheet(w, a["sheet"]), tuple(a["range"])
    return replace(w, merges=tuple(m for m in w.merges if m[0] != sheet or not _meets(m[1], area)))


def _format(w, a):
    r0, c0, r1, c1 = a["range"]
    if (r1 - r0 + 1) * (c1 - c0 + 1) > MOST_FORMATTED:
        raise ActionError("too many cells to format at once")
    return replace(w, formats=(*w.formats, (_sheet(w, a["sheet"]), tuple(a["range"]), tuple(sorted(a["patch"].items())))))


def _format_clear(w, a):
    return replace(w, formats=(*w.formats, (_sheet(w, a["sheet"]), tuple(a["range"]), (("clear", True),))))


def format_of(w: Workbook, sheet: str, r: int, c: int) -> dict[str, object]:
    """A cell's format: later patches win, a clearing forgets those before it."""
    out: dict[str, object] = {}
    for s, (r0, c0, r1, c1), patch in w.formats:
        if s == sheet and r0 <= r <= r1 and c0 <= c <= c1:
            out = {} if patch == (("clear", True),) else {**out, **dict(patch)}
    return out


def _find_replace(w, a):
    if not a["find"]:
        raise ActionError("nothing to find")
    area = C.within(_sheet(w, a["sheet"]), *a["range"]) if a.get("range") else F.col("sheet") == _sheet(w, a["sheet"])
    return replace(w, cells=w.cells.where(~area).unionByName(C.find_replace(w.cells.where(area), a["find"], a["replace"], a.get("match_case", False), a.get("whole_cell", False))))


def _sheet_add(w, a):
    if not a["name"] or any(s.lower() == a["name"].lower() for s in w.sheets):
        raise ActionError("sheet names are unique and not empty")
    return replace(w, sheets=(*w.sheets, a["name"]))


def _sheet_rename(w, a):
    own = _sheet(w, a["from"])
    if any(s.lower() == a["to"].lower() for s in w.sheets if s != own) or not a["to"]:
        raise ActionError("sheet names are unique and not empty")
    swap = lambda x: a["to"] if x == own else x
    return replace(
        w, cells=C.rename_sheet(w.cells, own, a["to"]), sheets=tuple(map(swap, w.sheets)), filters={swap(k): v for k, v in w.filters.items()}, merges=tuple((swap(s), m) for s, m in w.merges),
        formats=tuple((swap(s), *x) for s, *x in w.formats), rules=tuple((swap(s), *x) for s, *x in w.rules),
    )


def _sheet_delete(w, a):
    own = _sheet(w, a["name"])
    if len(w.sheets) == 1:
        raise ActionError("the last sheet stays")
    return replace(w, cells=C.delete_sheet(w.cells, own), sheets=tuple(s for s in w.sheets if s != own), merges=tuple(m for m in w.merges if m[0] != own), formats=tuple(x for x in w.formats if x[0] != own), rules=tuple(x for x in w.rules if x[0] != own))


def _resize(w, a):
    own = _sheet(w, a["sheet"])
    sizes = dict(w.sizes)
    for i in range(a["at"], a["at"] + a["count"]):
        sizes.pop((own, a["axis"], i), None)
        if a.get("size") is not None:
            sizes[own, a["axis"], i] = float(a["size"])
    return replace(w, sizes=sizes)


def _rule_add(w, a):
    try:
        f.parse(a["formula"])
    except f.FormulaError as e:
        raise ActionError(str(e)) from e
    return replace(w, rules=(*w.rules, (_sheet(w, a["sheet"]), tuple(a["range"]), a["formula"], a["format"])))


def _rule_clear(w, a):
    own, area = _sheet(w, a["sheet"]), tuple(a["range"])
    return replace(w, rules=tuple(x for x in w.rules if x[0] != own or not _inside(x[1], area)))


def _freeze(w, a):
    return replace(w, frozen={**w.frozen, _sheet(w, a["sheet"]): (a["rows"], a["cols"])})


def _name_define(w, a):
    name = a["name"]
    if not re.fullmatch(r"[A-Za-z_\\][\w.\\]{0,254}", name) or re.fullmatch(r"\$?[A-Za-z]{1,3}\$?\d+", name) or name.upper() in ("TRUE", "FALSE"):
        raise ActionError(f"{name!r} can't be a name")
    try:
        f.parse(a["refers_to"])
    except f.FormulaError as e:
        raise ActionError(str(e)) from e
    return replace(w, names={**w.names, name.upper(): a["refers_to"]})


def _name_delete(w, a):
    if a["name"].upper() not in w.names:
        raise ActionError(f"no name {a['name']!r}")
    return replace(w, names={k: v for k, v in w.names.items() if k != a["name"].upper()})


ACTIONS: dict[str, Callable] = {
    "CellEdit": _edit, "CellClear": _clear, "RangeClear": _clear, "RangePaste": _paste, "FillApply": _fill, "RowInsert": _structural(C.insert, "row"), "RowDelete": _structural(C.delete, "row"),
    "ColInsert": _structural(C.insert, "col"), "ColDelete": _structural(C.delete, "col"), "SortApply": _sort, "FilterApply": _filter, "FilterClear": _filter_clear, "MergeApply": _merge, "MergeClear": _merge_clear,
    "FormatApply": _format, "FormatClear": _format_clear, "FindReplace": _find_replace, "SheetAdd": _sheet_add, "SheetRename": _sheet_rename, "SheetDelete": _sheet_delete, "Resize": _resize, "CondAdd": _rule_add,
    "CondClear": _rule_clear, "FreezePanes": _freeze, "NameDefine": _name_define, "NameDelete": _name_delete,
}


def apply(w: Workbook, action: dict) -> Workbook:
    """The workbook after an action. Undo and Redo move along the states; any other action forgets what was undone."""
    kind = action["action"]
    if kind == "Undo":
        if w.before is None:
            raise ActionError("nothing to undo")
        return replace(w.before, undone=(*w.undone, replace(w, undone=())))
    if kind == "Redo":
        if not w.undone:
            raise ActionError("nothing to redo")
        return replace(w.undone[-1], undone=w.undone[:-1])
    if kind not in ACTIONS:
        raise ActionError(f"unknown action {kind!r}")
    return replace(ACTIONS[kind](w, action), undone=(), before=w)


def apply_all(w: Workbook, actions: list[dict]) -> Workbook:
    """Actions in order as one step to undo; the first error leaves the ones before it applied."""
    out = w
    for a in actions:
        out = apply(out, a)
    return replace(out, before=w)


def state_digest(w: Workbook) -> str:
    """SHA-256 of the cells in order of place: hashed per row, summed per sheet, so that no task holds a workbook."""
    import hashlib

    row = F.sha2(F.concat_ws("\x1f", "sheet", F.col("r").cast("string"), F.col("c").cast("string"), "input"), 256)
    parts = [F.sum(F.conv(F.substr(row, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    got = w.cells.where("input is not null and input <> ''").agg(F.count("*").cast("string"), *parts).first()
    return hashlib.sha256("|".join(str(x) for x in got).encode() + repr((w.sheets, sorted(w.names.items()))).encode()).hexdigest()[:32]
