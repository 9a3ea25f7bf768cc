"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle is hashed once. The hash's top bits choose a bin, and a bin keeps its least hash.
An empty bin takes the value of the first filled bin in a random order of its own (the same for
all documents), so two documents fill an empty bin alike as often as they are alike. Only the
lowest ``bits`` bits of a bin are stored, as hex digits; different values agree on these by
chance with probability 2^-bits, which the likeness corrects for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, pick, slices, texts

WIDTH, BINS, BITS = 5, 512, 4
#: Bytes of text that are hashed at a time.
BLOCK = 4 << 20
#: Odd multiplier of the words' polynomial hash, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word (a run of bytes other than ASCII white space) of ``raw``."""
    hashes, starts = [], []
    at = 0
    while at < len(raw):
        end = at + BLOCK
        while end < len(raw) and not _SPACE[raw[end]]:  # a block ends between words
            end += 1
        part = np.frombuffer(raw, dtype=np.uint8, count=min(end, len(raw)) - at, offset=at)
        inside = np.concatenate([[False], ~_SPACE[part], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[::2], edge[1::2]
        up, down = _powers(_BASE, len(part) + 1), _powers(_INVERSE, len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * up[:-1], dtype=np.uint64)])
        own = (sums[last] - sums[first]) * down[first]
        hashes.append(mix(own + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        starts.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_hashes(items: list[str], width: int) -> list[np.ndarray]:
    """Per text the hashes of its shingles of ``width`` words, A-Z lower-cased.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in items]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    words, starts = word_hashes(b"\n".join(raw))
    cut = np.concatenate([[0], np.searchsorted(starts, ends)])
    chain = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for j in range(width if len(chain) else 0):
        chain = mix(chain + words[j : j + len(chain)])
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(chain[a : b - width + 1])
        else:
            whole = np.full(1, b - a, dtype=np.uint64)
            for w in words[a:b]:
                whole = mix(whole + w)
            out.append(whole[: b > a])
    return out


@lru_cache(maxsize=4)
def _places(bins: int) -> np.ndarray:
    """Row i: at which turn bin i, while empty, looks at each other bin."""
    order = np.argsort(mix(np.arange(bins * bins, dtype=np.uint64)).reshape(bins, bins), axis=1, kind="stable")
    turn = np.empty((bins, bins), dtype=np.int32)
    np.put_along_axis(turn, order, np.arange(bins, dtype=np.int32)[None, :], axis=1)
    return turn


def minima(hashes: np.ndarray, bins: int) -> np.ndarray | None:
    """Each bin's least hash, empty bins filled; none for no hashes. ``bins`` is a power of two."""
    if not len(hashes):
        return None
    ordered = np.sort(hashes)
    at = (ordered >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    filled, least = at[new], ordered[new]
    out = np.zeros(bins, dtype=np.uint64)
    out[filled] = least
    if len(filled) < bins:
        empty = np.ones(bins, dtype=bool)
        empty[filled] = False
        turns = _places(bins)[np.flatnonzero(empty)[:, None], filled[None, :]]
        out[empty] = least[turns.argmin(axis=1)]
    return out


def packed(least: np.ndarray | None, bits: int) -> bytes:
    """The lowest ``bits`` bits (4 or 8) of each bin, in bytes; nothing for none."""
    if least is None:
        return b""
    low = (least & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return (low if bits == 8 else (low[::2] << 4) | low[1::2]).tobytes()


def fingerprints_of(items: list[str], width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """Packed fingerprints of texts; a text without words has an empty one."""
    return [packed(minima(h, bins), bits) for h in shingle_hashes(items, width)]


def alike(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of two fingerprints, corrected for chance and held within 0 and 1.

    Of two empty ones 1, of an empty and another one 0.
    """
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    same = (x == 0).sum() if bits == 8 else (x >> 4 == 0).sum() + (x & 15 == 0).sum()
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (same / (len(x) * 8 // bits) - chance) / (1 - chance))))


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """:func:`alike` of two columns of fingerprints in hex, without Python. Null if one is null."""
    digits, chance = bits // 4, 2.0**-bits
    bins = (F.length(a) / digits).cast("int")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(bins, F.lit(1))), lambda i: (i - 1) * digits + 1)
    same = F.aggregate(starts, F.lit(0), lambda n, i: n + F.when(F.substr(a, i, F.lit(digits)) == F.substr(b, i, F.lit(digits)), 1).otherwise(0))
    share = (same / F.greatest(bins, F.lit(1)) - chance) / (1 - chance)
    some = F.when((F.length(a) == 0) | (F.length(b) == 0), F.when(a == b, 1.0).otherwise(0.0))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.coalesce(some, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))))


def fingerprints(docs: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``doc_id, fingerprint`` (hex) for every row of ``docs``; compare with :func:`likeness`.

    Null and empty texts, and texts of white space, have an empty fingerprint. Repeated rows
    give a row each, null ids too; other columns play no part; an empty table gives none.
    """
    src = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [x.hex() for x in fingerprints_of(texts(b.column(1)), width, bins, bits)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(items: list[str], own: list[bytes], following: list[str], theirs: list[bytes], shape: tuple[int, int, int]) -> list[pa.Array]:
    new = [edited(t, f) for t, f in zip(items, following, strict=True)]
    other = fingerprints_of(new, *shape)
    return [
        pa.array([len(t) for t in items], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
        pa.array([x.hex() for x in own], pa.string()),
        pa.array([x.hex() for x in other], pa.string()),
        pa.array([alike(x, y, shape[2]) for x, y in zip(own, other, strict=True)], pa.float64()),
        pa.array([alike(x, y, shape[2]) for x, y in zip(own, theirs, strict=True)], pa.float64()),
    ]


def edit_study(docs: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """How alike each document's fingerprint is to that of its edited text and to the next document's.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``
    for every row. Documents stand in ascending order of doc_id, null ids first, rows of one id
    by their text's XXH64 and then as the table has them; the next of the last is the first (of
    an only document itself). Null texts count as empty: no characters, an empty fingerprint.
    Repeated rows give a row each. Other columns play no part. An empty table gives none.

    Texts are dealt by ranges of that order (rows of one id too, so none outgrows a task) and
    each task walks its range once. What is next to the last row of a range is found by a join
    of one row per range.
    """
    shape = (width, bins, bits)
    src = pick(docs, "doc_id", "text")
    id_type = src.schema["doc_id"].dataType.simpleString()
    keyed = src.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("r"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("r")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, held = TaskContext.get().partitionId(), True, None

        def batch(ids: pa.Array, columns: list[pa.Array], left: str | None = None) -> pa.RecordBatch:
            nonlocal head
            n = len(ids)
            first = [items[0] if head else None] + [None] * (n - 1)
            last = [None] * (n - 1) + [left]
            head = False
            return pa.RecordBatch.from_arrays([ids, *columns, pa.array([part] * n, pa.int32()), pa.array(first, pa.string()), pa.array(last, pa.string())], names)

        names = ["doc_id", *(c.split()[0] for c in _RESULT.split(", ")), "part", "head_text", "open_text"]
        for b in slices(batches, "text"):
            ids, items = b.column(0), texts(b.column(1))
            own = fingerprints_of(items, *shape)
            if held:
                ids, items, own = pa.concat_arrays([held[0], ids]), [held[1], *items], [held[2], *own]
            if len(items) > 1:
                yield batch(ids[:-1], _compare(items[:-1], own[:-1], items[1:], own[1:], shape))
            held = ids[-1:], items[-1], own[-1]
        if held:
            items = [held[1]]
            empty = [pa.array([len(held[1])], pa.int64()), *(pa.array([x], pa.string()) for x in (None, held[2].hex(), None)), *[pa.nulls(1, pa.float64())] * 2]
            yield batch(held[0], empty, held[1])

    found = materialise(ranged.mapInArrow(walk, f"doc_id {id_type}, {_RESULT}, part int, head_text string, open_text string"), "fingerprints")
    parts = sorted(r.part for r in found.where("head_text is not null").select("part").collect())  # one per range
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    heads = found.where("head_text is not null").select(F.col("part").alias("after"), "head_text", F.col("fingerprint").alias("theirs"))
    opened = found.where("open_text is not null").select("doc_id", "part", "open_text", "fingerprint")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "open_text"):
            items, following, own, theirs = (b.column(c).to_pylist() for c in ("open_text", "head_text", "fingerprint", "theirs"))
            columns = _compare(items, list(map(bytes.fromhex, own)), following, list(map(bytes.fromhex, theirs)), shape)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *(c.split()[0] for c in _RESULT.split(", "))])

    closed = opened.join(following, "part").join(heads, "after").select("doc_id", "open_text", "head_text", "fingerprint", "theirs").mapInArrow(close, f"doc_id {id_type}, {_RESULT}")
    return found.where("open_text is null").drop("part", "head_text", "open_text").unionByName(closed)
