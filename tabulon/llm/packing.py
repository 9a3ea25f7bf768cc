"""Packing along a space-filling curve: neighbours in content share sequences.

Documents are hashed to vectors, projected to three dimensions and sorted by Hilbert key
across the cluster; each range of the curve is then one stream of tokens that is cut into
sequences. Only a range's end can leave a short sequence, and that is cut into powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, texts
from .tokens import default_path, encoder

DIMENSIONS, BITS, BUCKETS = 3, 16, 256


def hashed_vector(text: str) -> np.ndarray:
    """Counts of hashed four-byte windows, as a unit vector of BUCKETS dimensions."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.zeros(BUCKETS)
    for i in range(0, max(0, len(raw) - 3), 1 << 20):
        part = raw[i : i + (1 << 20) + 3].astype(np.uint32)
        gram = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
        counts += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    norm = np.sqrt((counts**2).sum())
    return counts / norm if norm else counts


def projection() -> np.ndarray:
    return np.random.default_rng(20_24).standard_normal((BUCKETS, DIMENSIONS))


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of points with unsigned coordinates below 2**bits, one row per point.

    Works from the highest bit down: each level's octant is reflected and exchanged into the
    curve's standard position (Skilling's transpose form), then the bits are interleaved.
    """
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= t
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def curve_keys(items: list[str]) -> np.ndarray:
    flat = np.stack([hashed_vector(t) for t in items]) @ projection()
    scaled = np.clip((flat + 4) / 8, 0, 1) * ((1 << BITS) - 1)
    return hilbert_key(scaled.astype(np.uint64))


PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def _powers(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


class Packer:
    """Cuts one stream of documents into full sequences; ``end`` gives the tail in powers of two."""

    def __init__(self, size: int, first_id: int):
        self.size, self.sequence, self.fill = size, first_id, 0
        self.open: list[tuple] = []  # pieces of the sequence that isn't full yet
        self.rows: list[tuple] = []

    def _row(self, doc, start: int, ids: bytes, total: int, offset: int) -> None:
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset))

    def _close(self) -> None:
        for piece in self.open:
            self._row(*piece)
        self.open, self.fill, self.sequence = [], 0, self.sequence + 1

    def add(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while at < total:
            n = min(self.size - self.fill, total - at)
            self.open.append((doc, at, ids[4 * at : 4 * (at + n)], total, self.fill))
            self.fill, at = self.fill + n, at + n
            if self.fill == self.size:
                self._close()

    def end(self) -> None:
        rest, room = self.open, _powers(self.fill)
        self.open = []
        for size in room:
            fill = 0
            while fill < size:
                doc, start, ids, total, _ = rest.pop(0)
                n = min(size - fill, len(ids) // 4)
                self._row(doc, start, ids[: 4 * n], total, fill)
                fill += n
                if 4 * n < len(ids):
                    rest.insert(0, (doc, start + n, ids[4 * n :], total, 0))
            self.sequence += 1
        self.fill = 0


def pack(docs: DataFrame, size: int = 1024, tokenizer_path: str | None = None) -> DataFrame:
    """Pack all documents, each followed by id 0, into sequences of at most ``size`` ids.

    One row per piece: doc_id, start (the document's ids before it), length, ids_crc32,
    doc_tokens (with the closing id), sequence_id, offset. All sequences are full but for
    those at the end of a range of the curve, whose lengths are powers of two, so nothing is
    padded (``size`` should be a power of two).

    Null and empty texts are the closing id alone. Repeated rows are packed each. Null ids
    stay null. Other columns play no part. An empty table gives no pieces. Copies, which have
    one key, are told apart by doc_id, so ranges stay even. One document's ids are held at a
    time, beside the open sequence.
    """
    path = tokenizer_path or default_path()
    src = pick(docs, "doc_id", "text")
    id_type = src.schema["doc_id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(texts(b.column(1)))), b.column(0), b.column(1)], ["key", "doc_id", "text"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(size, TaskContext.get().partitionId() << 36), encoder(path).ids
        ids = None
        for b in slices(batches, "text"):
            ids = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                packer.add(doc, encode(text) + b"\0\0\0\0")
            if len(packer.rows) > 4096:
                yield _batch(packer.rows, ids)
                packer.rows = []
        packer.end()
        if packer.rows:
            yield _batch(packer.rows, ids)

    along = src.mapInArrow(keyed, f"key long, doc_id {id_type}, text string")
    ranged = along.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", F.xxhash64("text"))
    return ranged.select("doc_id", "text").mapInArrow(packed, PIECES.format(id=id_type))


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type] + [pa.int64()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
