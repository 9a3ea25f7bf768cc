"""Cross-tokenizer alignment: groups and links of two tokenizers' tokens over the same bytes.

Tokenizer A is a byte-level vocabulary of the ``tokenizers`` library and encodes a space and the
text; B is a ``sentencepiece`` model, which adds that space itself. Both cut the same bytes, so
two pointers over the cumulative ends of their tokens walk both at once: each step is a link (an
A and a B token that overlap), and where both end together a group closes.

Both cut at single spaces, so the walk is done once for each distinct unit (a space and what
follows it up to the next one), and a text is put together from its units. Texts that this
doesn't hold for (more than one white space together, or at an end) are walked whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import head_bound, materialise, pick, slices, texts
from .tokens import _byte_of, default_path, encoder

#: Distinct units, and links, that a task remembers.
MOST_UNITS, MOST_LINKS = 250_000, 4_000_000
#: Pairs whose counts are broadcast; rarer ones meet their counts in a shuffle.
HEAD = 1 << 17
#: What parts a group's A ids and B ids, and what parts groups.
MARKS = ";|"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Tokens, groups and links of texts; remembers units. ``marks``: what parts a group's A ids and B ids, and what parts groups."""

    def __init__(self, a_path: str, b_path: str, marks: str = MARKS):
        import sentencepiece

        self.within, self.between = marks
        self.a = encoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = self._bytes_of_a()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.n_b = len(self.b_bytes)
        # no piece may reach over the start of the next unit
        across = re.compile("[^▁]▁")
        self.by_unit = self.a.ranked is not None and not any(across.search(self.b.id_to_piece(i)) for i in range(self.n_b))
        self._forget()

    def _bytes_of_a(self) -> list[bytes]:
        of, out = _byte_of(), []
        library = self.a.library
        for i in range(library.get_vocab_size()):
            entry = library.id_to_token(i) or ""
            out.append(bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode())
        return out

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8")

    def _forget(self) -> None:
        self.units: dict[str, int] = {}
        self.text: list[str] = []
        self.counts = array("q")  # tokens of A, tokens of B, groups, links
        self.first = array("q")
        self.links = array("q")

    def merge(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]]:
        """Groups as text and links as ``a_id * n_b + b_id``, of tokens that cut the same bytes."""
        groups, links = [], []
        i = j = from_i = from_j = 0
        end_a, end_b = len(self.a_bytes[a[0]]), len(self.b_bytes[b[0]])
        while True:
            links.append(a[i] * self.n_b + b[j])
            if end_a == end_b:
                i, j = i + 1, j + 1
                groups.append(",".join(map(str, a[from_i:i])) + self.within + ",".join(map(str, b[from_j:j])))
                if i == len(a) or j == len(b):
                    return groups, links
                from_i, from_j = i, j
                end_a += len(self.a_bytes[a[i]])
                end_b += len(self.b_bytes[b[j]])
            elif end_a < end_b:
                i += 1
                end_a += len(self.a_bytes[a[i]])
            else:
                j += 1
                end_b += len(self.b_bytes[b[j]])

    def _add(self, text: str, a: list[int], b: list[int]) -> int:
        """The number of a walked text; -1 where the tokens' bytes are not a space and the text."""
        raw = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join(self.a_bytes[i] for i in a) != raw or b"".join(self.b_bytes[i] for i in b) != raw:
            return -1
        groups, links = self.merge(a, b)
        self.text.append(self.between.join(groups))
        self.counts.extend((len(a), len(b), len(groups), len(links)))
        self.first.append(len(self.links))
        self.links.extend(links)
        return len(self.text) - 1

    def _learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.units]
        plain = [u for u in new if u and not u[0].isspace() and not u[-1].isspace()]
        for u in new if len(plain) < len(new) else ():
            self.units[u] = -1
        for u, b in zip(plain, self.b.encode(plain, num_threads=1), strict=True):
            self.units[u] = self._add(u, self.a.plain_ids(" " + u), b)

    def align(self, items: list[str]) -> tuple[list[str], np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Per text its groups, its counts (tokens of A, of B, groups, links), its distinct links and how often each occurs."""
        if len(self.units) > MOST_UNITS or len(self.links) > MOST_LINKS:
            self._forget()
        parts = [t.split(" ") for t in items]
        if self.by_unit:
            self._learn(set(chain.from_iterable(parts)))
        at, ends = array("q"), array("q", [0])
        for text, units in zip(items, parts, strict=True):
            own = list(map(self.units.__getitem__, units)) if self.by_unit and text else [-1]
            if min(own) < 0:
                whole = self._add(text, self.a.plain_ids(" " + text), self.b.encode(text)) if text else -1
                own = [whole] if whole >= 0 else []
            at.extend(own)
            ends.append(len(at))
        unit, end = np.frombuffer(at, np.int64) if at else np.empty(0, np.int64), np.frombuffer(ends, np.int64)
        words = [self.between.join(map(self.text.__getitem__, at[i:j])) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        counts = np.frombuffer(self.counts, np.int64).reshape(-1, 4)[unit] if len(unit) else np.empty((0, 4), np.int64)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts, axis=0)])
        total = sums[end[1:]] - sums[end[:-1]]
        pairs, times = self._pairs(unit, counts[:, 3], total[:, 3])
        return words, total, pairs, times

    def _pairs(self, unit: np.ndarray, n: np.ndarray, of_text: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if not len(unit):
            return [np.empty(0, np.int64)] * len(of_text), [np.empty(0, np.int64)] * len(of_text)
        start = np.frombuffer(self.first, np.int64)[unit]
        place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        links = np.frombuffer(self.links, np.int64)[place]
        span = len(self.a_bytes) * self.n_b
        keyed = links + np.repeat(np.arange(len(of_text), dtype=np.int64), of_text) * span
        distinct, times = np.unique(keyed, return_counts=True)
        cut = np.searchsorted(distinct, np.arange(1, len(of_text), dtype=np.int64) * span)
        return np.split(distinct % span, cut), np.split(times, cut)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str, marks: str) -> Aligner:
    return Aligner(a_path, b_path, marks)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, marks: str = MARKS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times`` for every row of ``docs``.

    groups: text of decimal ids joined by commas; the first of ``marks`` parts a group's A ids and
    B ids, the second parts groups: ``a1,a2;b1|a3;b2,b3``, or with ``|;`` ``a1,a2|b1;a3|b2,b3``. pairs: the distinct
    links as ``a_id * (B's vocabulary) + b_id``, ascending; times: how often each occurs.

    Null and empty texts, and those whose joined A or B bytes differ from a space and the text,
    have no tokens: zeros, an empty text and empty arrays. Special tokens' strings are plain
    text. Repeated rows and null ids give a row each; other columns play no part; an empty
    table gives none. A very long text is one row's work.
    """
    a_path, b_path = a_path or default_path(), b_path or default_pieces()
    src = pick(docs, "doc_id", "text")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = aligner(a_path, b_path, marks)
        for b in slices(batches, "text"):
            groups, total, pairs, times = own.align(texts(b.column(1)))
            counts = [pa.array(np.ascontiguousarray(c)) for c in total.T]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(groups, pa.string()), _lists(pairs), _lists(times)], names)

    kinds = ", ".join(f"{n} long" for n in names[1:5])
    id_type = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {id_type}, {kinds}, groups string, pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """``pair, n_docs, best_a, best_b``: in how many rows each pair is linked; whether that is the most of its A id, of its B id.

    The maxima are one row per id of a vocabulary, so they are broadcast.
    """
    counts = materialise(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")), "pairs")
    counts = counts.withColumn("a", F.expr(f"pair div {n_b}")).withColumn("b", F.col("pair") % n_b)
    for side in ("a", "b"):
        most = counts.groupBy(side).agg(F.max("n_docs").alias(f"most_{side}"))
        counts = counts.join(F.broadcast(most), side).withColumn(f"best_{side}", (F.col("n_docs") == F.col(f"most_{side}")).cast("long"))
    return counts.select("pair", "n_docs", "best_a", "best_b")


def digest(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, head: int = HEAD, marks: str = MARKS) -> DataFrame:
    """Per row of ``docs``: its tokens, groups and links, and how common its links are in the corpus.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_b``. A pair's
    count is the number of rows that hold it linked. n_best: links whose count is the highest of
    their A id, ties included (n_best_b: of their B id). count_sum: the sum of the links' counts.
    groups_sha256: of the groups' text, with its ``marks``, in lowercase hex, empty without tokens. For
    odd rows see :func:`align`; repeated rows count each.

    The ``head`` most common pairs are broadcast, so no common pair is ever dealt by its key;
    the rest, which none of is common, meets its counts in a shuffle.
    """
    b_path = b_path or default_pieces()
    n_b = _vocabulary(b_path)
    hashed = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    rows = align(docs, a_path, b_path, marks).select(F.monotonically_increasing_id().alias("row"), "*", hashed.alias("groups_sha256")).drop("groups")
    rows = materialise(rows, "alignment")
    counts = materialise(pair_counts(rows, n_b), "pair-counts")
    bound = head_bound(counts, "n_docs", head)
    common = counts.where(F.col("n_docs") >= bound)
    links = rows.select("row", "times", F.posexplode("pairs").alias("at", "pair")).select("row", "pair", F.col("times")[F.col("at")].alias("n"))
    sums = [F.sum(F.col("n") * F.col(c)).alias(to) for c, to in (("best_a", "n_best"), ("best_b", "n_best_b"), ("n_docs", "count_sum"))]
    near = links.join(F.broadcast(common), "pair").groupBy("row").agg(*sums)
    rare = links.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(counts.where(F.col("n_docs") < bound), "pair").groupBy("row").agg(*sums)
    names = ["n_best", "n_best_b", "count_sum"]
    both = near.unionByName(rare).groupBy("row").agg(*[F.sum(c).alias(c) for c in names])
    found = rows.join(both, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_b")


@lru_cache(maxsize=4)
def _vocabulary(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
