"""Language identification by n-gram filters whose cells are language bitmasks.

Training counts four-byte windows of lower-cased UTF-8 text per language over all training
rows. A window belongs to each language whose share of it comes near the largest share; a
Bloom filter, bit-sliced so that a cell holds one bit per language, keeps that. One lookup
of a window returns all its languages at once; a text's hits per language, corrected for
each language's false-positive rate, decide.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, pick, slices, texts

CELLS_LOG2, MOST_LANGUAGES = 21, 63
#: A language has a window if its relative frequency is this share of the greatest, at least.
SHARE, LEAST_COUNT = 0.25, 2
#: Corrected share of windows that a text in a learned language has at least. On sf0.1 held-out documents have 0.55
#: or more (half of them 0.98), random letters 0.04 or less, Polish and Finnish sentences 0.02 and 0.13.
LEAST_SHARE = 0.2
#: Windows a task holds before it hands counts on.
HOLD = 2_000_000

_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that windows may hold: small letters, space, and all of multi-byte characters.
_OK = np.array([c == 32 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_SPACES = str.maketrans("\t\n\r\x0b\x0c", "     ")


def windows(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' windows as 32-bit numbers, in order, and how many each text has."""
    raw = [b"  " + t.lower().translate(_SPACES).encode("utf-8", "surrogatepass") + b"  " for t in items]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    b = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if not len(b):
        return np.empty(0, np.uint32), np.zeros(len(items), np.int64)
    ok = _OK[b]
    ok = ok[:-3] & ok[1:-2] & ok[2:-1] & ok[3:]
    ends = np.cumsum(sizes)
    for back in range(1, 4):  # none across two texts
        at = ends[:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    w = b.astype(np.uint32)
    w = w[:-3] | w[1:-2] << 8 | w[2:-1] << 16 | w[3:] << 24
    ok &= w != 0x20202020
    before = np.concatenate([[0], np.cumsum(ok)])
    n = before[np.minimum(ends, len(ok))] - before[np.minimum(ends - sizes, len(ok))]
    return w[ok], n


def cells(w: np.ndarray) -> list[np.ndarray]:
    """The two cells of each window."""
    x = w.astype(np.uint64)
    shift = np.uint64(64 - CELLS_LOG2)
    return [((x + np.uint64(1)) * np.uint64(m)) >> shift for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


@dataclass
class Model:
    """languages: in the order of their bits; table: a mask per cell; false_rate: per language; first: the most frequent one."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    first: int

    def shares(self, items: list[str]) -> np.ndarray:
        """Of each text the share of windows that each language knows, corrected for false positives."""
        w, n = windows(items)
        a, b = cells(w)
        masks = self.table[a] & self.table[b]
        ends = np.cumsum(n)
        hits = np.zeros((len(items), len(self.languages)))
        for i in range(len(self.languages)):
            total = np.concatenate([[0], np.cumsum((masks >> i) & 1, dtype=np.int64)])
            hits[:, i] = total[ends] - total[ends - n]
        return np.clip((hits / np.maximum(n, 1)[:, None] - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)

    def predict(self, items: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 for those without a letter."""
        if not self.languages:
            return ["und"] * len(items), np.zeros(len(items))
        share = self.shares(items)
        share[:, self.first] += 1e-12  # ties and no evidence: the most frequent language
        best = share.argmax(axis=1)
        top = share[np.arange(len(items)), best]
        second = np.partition(np.column_stack([share, np.zeros(len(items))]), -2, axis=1)[:, -2]
        score = np.where(top > 1e-9, 0.5 + 0.5 * (top - second) / np.maximum(top, 1e-9), 0.0)
        letters = [bool(_LETTER.search(t)) for t in items]
        return [self.languages[i] if ok else "und" for i, ok in zip(best, letters, strict=True)], np.where(letters, np.clip(score, 0, 1), 0.0)

    def told(self, items: list[str]) -> np.ndarray:
        """Whether each text has a letter and LEAST_SHARE of some language's windows; all have where nothing was learned."""
        if not self.languages:
            return np.ones(len(items), dtype=bool)
        return (self.shares(items).max(axis=1) >= LEAST_SHARE) & np.array([bool(_LETTER.search(t)) for t in items], dtype=bool)


def window_counts(rows: DataFrame) -> DataFrame:
    """``(lang, w, n)``: windows per language over all rows (lang, text); tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                w = np.concatenate([p[0] for p in parts])
                n = np.concatenate([p[1] for p in parts])
                own, at = np.unique(w, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(own.astype(np.int64)), pa.array(np.bincount(at, weights=n, minlength=len(own)).astype(np.int64))], ["lang", "w", "n"])
            held.clear()

        for b in slices(batches, "text", 8_000_000):
            by = defaultdict(list)
            for lang, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                by[lang].append(text)
            for lang, items in by.items():
                own, n = np.unique(windows(items)[0], return_counts=True)
                held[lang].append((own, n))
                size += len(own)
            if size > HOLD:
                yield from flush()
                size = 0
        yield from flush()

    return rows.select("lang", "text").mapInArrow(run, "lang string, w long, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))


def train(rows: DataFrame) -> Model:
    """Learn from all rows (lang, text) with a language. At most MOST_LANGUAGES languages, else ValueError."""
    from .common import discard, materialise

    counts = materialise(window_counts(pick(rows, "lang", "text").where("lang is not null")), "lang-windows")
    totals = {r.lang: r.t for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    languages = sorted(totals)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a mask has {MOST_LANGUAGES}")
    if not languages:
        return Model([], np.zeros(1 << CELLS_LOG2, np.uint8), np.zeros(0), 0)
    known = F.create_map(*[x for i, la in enumerate(languages) for x in (F.lit(la), F.struct(F.lit(i).alias("i"), F.lit(float(totals[la])).alias("t")))])
    rated = counts.withColumn("k", known[F.col("lang")]).select("w", "n", F.col("k.i").alias("i"), (F.col("n") / F.col("k.t")).alias("p"))
    own = rated.groupBy("w").agg(F.max("p").alias("top"), F.collect_list(F.struct("i", "p", "n")).alias("all"))
    bit = lambda m, x: m.bitwiseOR(F.when((x["p"] >= F.col("top") * SHARE) & (x["n"] >= LEAST_COUNT), F.call_function("shiftleft", F.lit(1).cast("long"), x["i"])).otherwise(F.lit(0).cast("long")))
    masks = own.select("w", F.aggregate("all", F.lit(0).cast("long"), bit).alias("m")).where("m <> 0")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(1)
            for c in cells(b.column(0).to_numpy().astype(np.uint32)):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), m], ["c", "m"])

    # at most 2**CELLS_LOG2 rows, whatever the corpus
    filled = masks.mapInArrow(place, "c long, m long").groupBy("c").agg(F.bit_or("m").alias("m")).toArrow()
    discard(counts)
    kind = next(k for k, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(languages) <= most)
    table = np.zeros(1 << CELLS_LOG2, dtype=kind)
    table[filled.column("c").to_numpy()] = filled.column("m").to_numpy().astype(kind)
    fill = np.array([((table >> kind(i)) & kind(1)).mean() for i in range(len(languages))])
    return Model(languages, table, fill**2, languages.index(max(languages, key=lambda la: (totals[la], la))))


def predictor(docs: DataFrame, model: Model):
    """A column function text -> struct(lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**CELLS_LOG2 cells of at most 8 bytes

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(column: pa.Array) -> pa.Array:
        langs, scores = [], []
        for b in slices([pa.RecordBatch.from_arrays([column], ["text"])], "text"):
            la, sc = shared.value.predict(texts(b.column(0)))
            langs += la
            scores.append(sc)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["lang_pred", "score"])

    return predict


def teller(docs: DataFrame, model: Model):
    """A column function text -> whether its language can be told (:meth:`Model.told`)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def told(column: pa.Array) -> pa.Array:
        parts = [shared.value.told(texts(b.column(0))) for b in slices([pa.RecordBatch.from_arrays([column], ["text"])], "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=bool))

    return told


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: a language, and crc32(doc_id as text) mod 3 not 1."""
    return pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    Learns from :func:`training_rows` alone; a prediction sees nothing but the text.
    lang_pred is a learned language, or ``und`` where the text is null, has no letter, or
    nothing was learned. score, 0 to 1: how far the language leads (0.5: no lead). Texts
    without a known window get the language with most training text. Repeated rows give a
    row each, null ids count as the text ``null``, other columns play no part, an empty
    table gives an empty result.
    """
    predict = predictor(docs, train(training_rows(docs)))
    src = pick(docs, "doc_id", "text").select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), predict("text").alias("p"))
    return src.select("doc_id", "held_out", "p.lang_pred", "p.score")
