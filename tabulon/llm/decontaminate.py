"""Benchmark decontamination by canonical templates.

Numbers, units and names become typed placeholders, so that a question with other figures or
people has the same template. Windows of the template are joined by their text; the windows
of a document that follow an item along one diagonal form a run, and the values behind the
placeholders must correspond one to one along it (the same value always has the same partner).
Every window of an item is also joined by its raw tokens, so that a verbatim copy is found
whatever the item is made of. Scripts without spaces have a token per character.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, pick, slices, texts

#: Tokens of a window, literal ones it needs, tokens of a run that make a document contaminated.
WINDOW, LITERALS, RUN = 8, 5, 10
#: Tokens of a run in an item of a script without spaces, where a token is a character.
RUN_UNSPACED = 20
#: Bits of the filter of benchmark windows: its size is fixed, whatever the benchmark.
FILTER_LOG2 = 23

#: Words that are units after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces "
    "ton tons ml l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months "
    "year years usd eur gbp dollar dollars euro euros cent cents percent pct mph kmh hz khz mhz ghz b kb mb gb tb w kw mw v kv a ma j kj cal kcal c f k pa kpa bar".split()
)

#: Characters of scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana and Han.
_CHARACTER = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: What a token is: a character of those scripts, a word, a number, or a sentence's end.
TOKEN = re.compile(rf"(?=[^\W\d_])[{_CHARACTER}]|[^\W\d_{_CHARACTER}]+(?:['’][^\W\d_{_CHARACTER}]+)*|\d+(?:[.,:]\d+)*|[.!?。！？\n]+")
LITERAL, CAPITAL, NUMBER, UNIT, END = range(5)
PLACEHOLDER = {NUMBER: "<num>", UNIT: "<unit>", CAPITAL: "<name>"}
_CODE = {k: np.uint64(xxhash.xxh64_intdigest(v, 1) & ~7) for k, v in PLACEHOLDER.items()}
_MULTIPLIER = 0x9E3779B97F4A7C15
#: Classes of characters; powers that weigh a token's characters by place.
OTHER, LETTER, DIGIT, STOP, SINGLE = range(5)
_POWERS = np.cumprod(np.full(4096, _MULTIPLIER, dtype=np.uint64), dtype=np.uint64)


def _describe(c: str) -> tuple[int, int]:
    """A character's class, and the character in lower case."""
    kind = SINGLE if re.match(rf"(?=[^\W\d_])[{_CHARACTER}]", c) else LETTER if re.match(r"[^\W\d_]", c) else DIGIT if re.match(r"\d", c) else STOP if c in ".!?。！？\n" else OTHER
    low = c.lower()
    return kind, ord(low) if len(low) == 1 else ord(c)


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every character up to U+FFFF."""
    kind, low = zip(*map(_describe, map(chr, range(1 << 16))), strict=True)
    return np.array(kind, dtype=np.int8), np.array(low, dtype=np.uint32)


def characters(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, class and lower case of a text's characters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds, lower = _characters()
    near = np.minimum(code, 0xFFFF)
    kind, low = kinds[near], lower[near]
    far = np.flatnonzero(code > 0xFFFF)
    if len(far):
        own, at = np.unique(code[far], return_inverse=True)
        described = np.array([_describe(chr(c)) for c in own.tolist()])
        kind[far], low[far] = described[at, 0], described[at, 1]
    return code, kind, low


def _fold(h: np.ndarray) -> np.ndarray:
    """Token codes from weighed sums: their lowest three bits are free."""
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) & ~np.uint64(7)


@lru_cache(1)
def unit_codes() -> np.ndarray:
    return _fold(np.array([((np.array(list(map(ord, u)), dtype=np.uint64) + np.uint64(1)) * _POWERS[: len(u)]).sum(dtype=np.uint64) for u in UNITS]))


def _between(kind: np.ndarray, joins: np.ndarray, side: int) -> np.ndarray:
    """Places of ``joins`` whose neighbours are both of class ``side``."""
    at = np.flatnonzero(joins)
    at = at[(at > 0) & (at < len(kind) - 1)]
    return at[(kind[at - 1] == side) & (kind[at + 1] == side)]


class Tokens:
    """The canonical tokens (TOKEN) of some texts, one after the other: hash and class of each, and the text it belongs to.

    There are two readings. In the first a sentence's first word is no name; in the second it
    is one unless it is among ``words``, the codes (sorted) of words that the benchmark has in
    lower case. Without such a list both are the first.
    """

    def __init__(self, items: list[str], words: np.ndarray | None = None):
        self.joined = "\n".join(items) + "\n"  # a text's end ends a sentence
        code, char, low = characters(self.joined)
        letters = _between(char, (code == ord("'")) | (code == ord("’")), LETTER)
        digits = _between(char, (code == ord(".")) | (code == ord(",")) | (code == ord(":")), DIGIT)
        char[letters], char[digits] = LETTER, DIGIT
        new = (char != np.concatenate([[OTHER], char[:-1]])) | (char == SINGLE)
        at = np.flatnonzero(char != OTHER)
        start = np.flatnonzero(new[at])
        size = np.diff(np.append(start, len(at)))
        place = np.arange(len(at)) - np.repeat(start, size)
        upper = low != code
        own = np.add.reduceat((low[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place % len(_POWERS)], start)
        own = _fold(own)
        capitals = np.add.reduceat(upper[at], start, dtype=np.int64)
        start = at[start]
        self.start, self.end, self.lower = start, start + size, capitals == 0
        kind = np.array([LITERAL, LITERAL, NUMBER, END, LITERAL], dtype=np.int8)[char[start]]
        kind[upper[start] & (kind == LITERAL) & ((capitals < size) | (size == 1))] = CAPITAL
        capital = np.flatnonzero(kind == CAPITAL)
        kind[capital[np.isin(own[capital], unit_codes())]] = LITERAL
        before = np.concatenate([[END], kind[:-1]])
        after = np.flatnonzero((before == NUMBER) & (kind <= CAPITAL))
        kind[after[np.isin(own[after], unit_codes())]] = UNIT
        first = np.flatnonzero((kind == CAPITAL) & (before == END))
        kind[first] = LITERAL
        named = kind.copy()
        if words is not None:
            known = words[np.minimum(np.searchsorted(words, own[first]), len(words) - 1)] == own[first] if len(words) else np.zeros(len(first), dtype=bool)
            named[first[~known]] = CAPITAL
        kept = kind != END
        self.kinds, self.own, self.single = [kind[kept], named[kept]], own[kept], char[start[kept]] == SINGLE
        self.start, self.end, self.lower = self.start[kept], self.end[kept], self.lower[kept]
        self.codes = []
        for k in self.kinds:
            own_codes = self.own.copy()
            for placeholder, c in _CODE.items():
                own_codes[k == placeholder] = c
            self.codes.append(own_codes)
        ends = np.cumsum(np.fromiter(map(len, items), dtype=np.int64, count=len(items)) + 1)
        self.item = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.item, np.arange(len(items) + 1))

    def raw(self, i: int) -> str:
        return self.joined[self.start[i] : self.end[i]].lower()

    def __len__(self) -> int:
        return len(self.own)

    def _hashes(self, code: np.ndarray, n: int, seed: int) -> np.ndarray:
        count = max(len(code) - n + 1, 0)
        h = np.full(count, seed, dtype=np.uint64)
        for j in range(n):
            h *= np.uint64(_MULTIPLIER)
            h += code[j : j + count] >> np.uint64(3)
        return h

    def windows(self, n: int, reading: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of windows of ``n`` tokens of one text that hold enough literals (LITERALS, or all but one of LITERALS tokens); none for fewer tokens.

        Of the second reading only those that differ from the first.
        """
        count = len(self) - n + 1
        if n < LITERALS or count < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        within = lambda flags: (lambda c: c[n:] - c[:count])(np.concatenate([[0], np.cumsum(flags)]))
        ok = within(self.kinds[reading] == LITERAL) >= min(LITERALS, n - 1)
        ok &= self.item[:count] == self.item[n - 1 :]
        if reading:
            ok &= within(self.kinds[0] != self.kinds[1]) > 0
            at = np.flatnonzero(ok)
            h = np.zeros(len(at), dtype=np.uint64)
            for j in range(n):
                h = h * np.uint64(_MULTIPLIER) + (self.codes[1][at + j] >> np.uint64(3))
            return at, h
        return np.flatnonzero(ok), self._hashes(self.codes[0], n, 0)[ok]

    def raw_windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of ``n`` tokens of one text, with placeholders' values as they are."""
        h = self._hashes(self.own, n, 1)
        ok = self.item[: len(h)] == self.item[n - 1 :] if len(h) else np.zeros(0, dtype=bool)
        return np.flatnonzero(ok), h[ok]

    def text(self, start: int, n: int, reading: int = 0) -> str:
        kind = self.kinds[reading]
        return " ".join(PLACEHOLDER.get(int(kind[i])) or self.raw(i) for i in range(start, start + n))

    def raw_text(self, start: int, n: int) -> str:
        """The window's tokens after an equals sign, which no template has."""
        return "=" + " ".join(map(self.raw, range(start, start + n)))

    def slots(self, start: int, n: int, reading: int = 0) -> list[str]:
        kind = self.kinds[reading]
        return [self.raw(i) for i in range(start, start + n) if kind[i] != LITERAL]

    def all_windows(self, n: int, kept=lambda hashes: slice(None)) -> Iterator[tuple[int, str, list[str], int]]:
        """Start, text, slots and hash (signed) of all windows of ``n`` tokens, template and raw, whose hashes ``kept`` keeps."""
        for reading in (0, 1):
            starts, hashes = self.windows(n, reading)
            at = kept(hashes)
            for s, h in zip(starts[at].tolist(), hashes[at].view(np.int64).tolist(), strict=True):
                yield s, self.text(s, n, reading), self.slots(s, n, reading), h
        starts, hashes = self.raw_windows(n)
        at = kept(hashes)
        for s, h in zip(starts[at].tolist(), hashes[at].view(np.int64).tolist(), strict=True):
            yield s, self.raw_text(s, n), self.slots(s, n), h

    def need(self, item: int, run: int) -> int:
        """Tokens of a run that tell a text: ``run``, or the whole of a shorter one; more where most tokens are characters."""
        own = self.single[self.first[item] : self.first[item + 1]]
        if 2 * own.sum() > len(own):
            run = run * RUN_UNSPACED // RUN
        return min(run, len(own))


def _cells(h: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - FILTER_LOG2)
    return [(h * np.uint64(m)) >> shift for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def lower_case_words(benchmark: DataFrame) -> np.ndarray:
    """Codes, sorted, of the words that the benchmark has in lower case; a long for each word of its vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            t = Tokens(texts(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(t.own[t.lower & (t.kinds[0] == LITERAL)]).view(np.int64))], ["w"])

    found = pick(benchmark, "text").mapInArrow(run, "w long").distinct().toArrow().column("w").to_numpy()
    return np.sort(found.view(np.uint64))


WINDOW_ROWS = "pos long, n int, template string, slots array<string>"


def item_windows(benchmark: DataFrame, words: np.ndarray, window: int = WINDOW, least: int = RUN) -> DataFrame:
    """``item_id, item_tokens, need, pos, n, template, slots, hash``; an item shorter than a window is one window.

    A row per template window, in both readings, and one per raw window.
    """
    src = pick(benchmark, "item_id", "text").where("text is not null")
    shared = benchmark.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for item, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                t = Tokens([text], shared.value)
                n = min(window, len(t))
                if not n:
                    continue
                need = t.need(0, least)
                rows += [(item, len(t), need, s, n, template, slots, h) for s, template, slots, h in t.all_windows(n)]
            if rows:
                kinds = [b.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["item_id", "item_tokens", "need", "pos", "n", "template", "slots", "hash"])

    return src.mapInArrow(run, f"item_id {src.schema['item_id'].dataType.simpleString()}, item_tokens long, need long, {WINDOW_ROWS}, hash long")


def window_filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A Bloom filter of the items' window hashes (2**FILTER_LOG2 bits), and the window sizes in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            for c in _cells(h):
                yield pa.RecordBatch.from_arrays([pa.array((c >> np.uint64(5)).astype(np.int64)), pa.array((np.uint64(1) << (c & np.uint64(31))).astype(np.int64))], ["w", "m"])

    rows = items.select("hash").mapInArrow(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bits = np.zeros(1 << (FILTER_LOG2 - 5), dtype=np.uint32)
    bits[rows.column("w").to_numpy()] = rows.column("m").to_numpy().astype(np.uint32)
    return bits, sorted(r.n for r in items.select("n").distinct().collect())


def document_windows(docs: DataFrame, words: np.ndarray, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """``doc_id, text_hash, pos, n, template, slots``: the documents' windows that the filter lets pass."""
    src = pick(docs, "doc_id", "text").where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    shared = docs.sparkSession.sparkContext.broadcast((words, bits))  # the benchmark's vocabulary, 2**FILTER_LOG2 bits

    def passed(h: np.ndarray, table: np.ndarray) -> np.ndarray:
        at = np.arange(len(h))
        for c in _cells(h):  # the second cell is read where the first is set
            c = c[at]
            at = at[((table[c >> np.uint64(5)] >> (c & np.uint64(31)).astype(np.uint32)) & np.uint32(1)) == 1]
        return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shared.value
        for b in slices(batches, "text", 2_000_000):
            t = Tokens(texts(b.column(2)), known)
            at, rows = [], []
            for n in sizes:
                for s, template, slots, _ in t.all_windows(n, lambda hashes: passed(hashes, table)):
                    at.append(int(t.item[s]))
                    rows.append((s - int(t.first[at[-1]]), n, template, slots))
            if rows:
                take = pa.array(at)
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "text_hash", "pos", "n", "template", "slots"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, {WINDOW_ROWS}")


def longest_run(hits: list[tuple[int, int, list[str], list[str]]]) -> tuple[int, int, bool]:
    """Of one diagonal's windows (pos, n, document's slots, item's slots): tokens of the longest run with consistent slots, its start, whether all its slots are equal.

    A run's windows overlap or adjoin, and pair the values on both sides one to one. It grows
    at its end; where a window contradicts it, it loses windows at its start until it fits.
    """
    best = (0, 0, False)
    hits = sorted(hits)
    pairs: Counter = Counter()  # how many windows of the run hold each pair of values
    sides: Counter = Counter()  # with how many partners each value stands, on either side
    torn = differing = 0  # values with several partners; pairs of unequal values
    first = 0
    for j, (pos, n, ours, theirs) in enumerate(hits):
        if j and pos > hits[j - 1][0] + hits[j - 1][1]:
            first, torn, differing = j, 0, 0
            pairs.clear()
            sides.clear()
        for x, y in zip(ours, theirs, strict=True):
            pairs[x, y] += 1
            if pairs[x, y] == 1:
                differing += x != y
                for side in ((0, x), (1, y)):
                    sides[side] += 1
                    torn += sides[side] == 2
        while torn:
            for x, y in zip(*hits[first][2:], strict=True):
                pairs[x, y] -= 1
                if not pairs[x, y]:
                    differing -= x != y
                    for side in ((0, x), (1, y)):
                        sides[side] -= 1
                        torn -= sides[side] == 1
            first += 1
        if first <= j and pos + n - hits[first][0] > best[0]:
            best = (pos + n - hits[first][0], hits[first][0], not differing)
    return best


def _runs(hits: pa.Array) -> pa.Array:
    """Each diagonal's longest run; of several windows at a place that with the fewest slots counts."""
    out = []
    for group in hits.to_pylist():
        own = {h["pos"]: (h["pos"], h["n"], h["ours"], h["theirs"]) for h in sorted(group, key=lambda h: -len(h["ours"]))}
        out.append(longest_run(list(own.values())))
    cols = zip(*out, strict=True) if out else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["tokens", "start", "exact"])


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """``doc_id, text_hash, item_id, item_tokens, r``: for each row's text and each item it holds, the longest run of each diagonal that has one."""
    judge = F.arrow_udf(_runs, "struct<tokens:long,start:long,exact:boolean>")
    words = lower_case_words(benchmark)
    items = item_windows(benchmark, words, window, run)
    bits, sizes = window_filter(items)
    found = document_windows(docs, words, bits, sizes).alias("d").join(items.alias("i"), ["template", "n"])
    diagonal = found.select(
        "d.doc_id", "d.text_hash", "i.item_id", "i.item_tokens", "i.need", (F.col("d.pos") - F.col("i.pos")).alias("diagonal"),
        # values of a raw window are equal, whatever stands before it
        F.struct(F.col("d.pos").alias("pos"), "n", F.col("d.slots").alias("ours"), F.when(F.startswith("template", F.lit("=")), F.col("d.slots")).otherwise(F.col("i.slots")).alias("theirs")).alias("hit"),
    )
    keys = ("doc_id", "text_hash", "item_id", "item_tokens", "need", "diagonal")
    runs = diagonal.groupBy(*keys).agg(F.collect_set("hit").alias("hits")).select(*keys, judge("hits").alias("r"))
    return runs.where(F.col("r.tokens") >= F.col("need")).select("doc_id", "text_hash", "item_id", "item_tokens", "r")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """Pairs of a contaminated document and a benchmark item it holds, over whole texts.

    ``doc_id, item_id, matched_tokens, item_tokens, start_token, exact``: the longest run of
    tokens that both share, as template with consistent slots or as they stand, of ``run`` tokens
    (twice as many in scripts without spaces) or the whole item at least; exact tells whether
    the placeholders' values are the same too. Of equally long runs an exact one counts, then
    the first.

    A clean document has no row. Null texts hold nothing. Items of fewer than LITERALS tokens
    are found as they stand, in other letter case or punctuation too; an item without a token
    gives no row. Rows that repeat a document or an item give one row. Null ids stay null.
    Other columns play no part; with an empty table the result is empty. A window that many
    items share meets each of them; the rows of one diagonal are no more than thrice the item's
    windows.
    """
    enough = contaminated_rows(docs, benchmark, window, run)
    best = enough.groupBy("doc_id", "item_id").agg(F.max(F.struct("r.tokens", "r.exact", (-F.col("r.start")).alias("back"), "item_tokens")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.tokens").alias("matched_tokens"), "b.item_tokens", (-F.col("b.back")).alias("start_token"), "b.exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    Each row is judged by its own text, rows without a doc_id or that share one too. Null
    texts stay. All columns stay, whatever their names.
    """
    bad = contaminated_rows(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    plain, at, names = by_position(docs)
    own = F.col(at["doc_id"]).eqNullSafe(F.col("_id")) & (F.xxhash64(at["text"]) == F.col("_h"))
    return plain.join(bad, own, "left_anti").toDF(*names)
