"""Class-based bigram language model with exchange clustering (Brown classes).

Word counts and class bigrams come from all training texts: every pair of tokens side by side
is counted. The most frequent words are clustered by exchange. Every other word, however rare,
then makes an exchange step of its own, distributed over the vocabulary: it goes to the class
that gives the words before and after it the highest likelihood. A text's probability is that of its class transitions times
that of each word in its class, both smoothed. Frequent words are scored where the text is
read; rarer ones, whose table grows with the corpus, meet their counts and classes in a join.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialise, pick, slices, texts

#: Words whose exchange goes on until none moves, classes, words whose counts every task holds. All other words make one step.
CLUSTERED, CLASSES, HEAD = 1024, 48, 1 << 17
EMISSION, LAMBDA = 0.5, 0.1
HOLD = 250_000


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def flat_words(items: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts in order, and how many each text has."""
    lists = list(map(words_of, items))
    return list(chain.from_iterable(lists)), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))


def word_counts(rows: DataFrame) -> DataFrame:
    """``(word, c)`` over all texts; tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return b

        for b in slices(batches, "text", 1_000_000):
            for t in texts(b.column(0)):
                seen.update(words_of(t))
            if len(seen) > HOLD:
                yield out()
        yield out()

    return rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, ``most`` at most, best first.

    A histogram of count magnitudes gives the threshold, so that no step sorts the vocabulary.
    """
    size = F.floor(F.log2("c") * 8)
    histogram = sorted(((r.s, r.n) for r in counts.groupBy(size.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = None, most
    for s, n in histogram:
        if n > room:
            break
        least, room = s, room - n
    if least is None:  # even the most frequent words are too many of one magnitude, or there are none
        return [(bytes(r.word), r.c) for r in counts.orderBy(F.col("c").desc(), "word").limit(most).collect()]
    words, n = (x.to_pylist() for x in counts.where(size >= least).select("word", "c").toArrow().columns)
    return sorted(zip(map(bytes, words), n, strict=True), key=lambda x: (-x[1], x[0]))


class Symbols:
    """Word -> symbol: clustered words first, then one symbol for every other word; the last is the end."""

    def __init__(self, clustered: list[bytes]):
        self.of = {w: i for i, w in enumerate(clustered)}
        self.other = len(clustered)
        self.end = self.other + 1
        self.size = self.end + 1

    def __call__(self, words: list[bytes]) -> Iterator[int]:
        return map(self.of.get, words, repeat(self.other))


def symbol_pairs(rows: DataFrame, clustered: list[bytes]) -> DataFrame:
    """``(pair, n)``: bigrams of symbols, as previous * size + next, over all texts; each starts after an end."""
    shared = rows.sparkSession.sparkContext.broadcast(clustered)  # CLUSTERED words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Symbols(shared.value)
        total = np.zeros(of.size * of.size, dtype=np.int64)
        for b in slices(batches, "text"):
            flat: list[int] = [of.end]
            for t in texts(b.column(0)):
                flat.extend(of(words_of(t)))
                flat.append(of.end)
            s = np.array(flat, dtype=np.int64)
            total += np.bincount(s[:-1] * of.size + s[1:], minlength=len(total))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["pair", "n"])

    return rows.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, n_words: int, classes: int = CLASSES) -> np.ndarray:
    """Class of each symbol: exchange clustering of the first ``n_words``; the others keep a class each.

    Each word in turn goes to the class that gives the class bigrams the highest likelihood,
    until a sweep moves none. A move has to gain more than rounding could give, so this ends.
    """
    size, least = len(pairs), 1e-9 + 1e-12 * float(_h(np.float64(pairs.sum())))
    k = min(classes, n_words)
    of = np.concatenate([np.arange(n_words) % max(k, 1), k + np.arange(size - n_words)]).astype(np.int64)
    total = k + size - n_words
    m = np.zeros((total, total))
    np.add.at(m, (of[:, None], of[None, :]), pairs)
    sums = lambda v: np.bincount(of, weights=v, minlength=total)
    moved = k > 1
    while moved:
        moved = 0
        for w in range(n_words):
            a, self_pairs = of[w], float(pairs[w, w])
            out, into = pairs[w].astype(float), pairs[:, w].astype(float)
            out[w] = into[w] = 0
            row, col = sums(out), sums(into)
            m[a] -= row
            m[:, a] -= col
            m[a, a] -= self_pairs
            right, left = m.sum(axis=1) + col, m.sum(axis=0) + row  # all tokens of a class but this word's
            near = m[:k] + row
            back = m[:, :k].T + col
            own = np.arange(k)
            gain = (_h(near) - _h(m[:k])).sum(axis=1) + (_h(back) - _h(m[:, :k].T)).sum(axis=1)
            cell = m[own, own]
            gain += _h(cell + row[:k] + col[:k] + self_pairs) - _h(near[own, own]) - _h(back[own, own]) + _h(cell)
            n_out, n_in = row.sum() + self_pairs, col.sum() + self_pairs
            gain -= _h(right[:k] + n_out) - _h(right[:k]) + _h(left[:k] + n_in) - _h(left[:k])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + least:
                b = a
            moved += b != a
            of[w] = b
            m[b] += row
            m[:, b] += col
            m[b, b] += self_pairs
    return of


def smooth(m: np.ndarray) -> np.ndarray:
    """Row-wise probabilities from class bigrams: LAMBDA of them follow the classes' own frequencies."""
    tokens, size = m.sum(axis=0), len(m)
    prior = (tokens + 1) / (tokens.sum() + size)
    seen = m.sum(axis=1, keepdims=True)
    return np.where(seen > 0, (1 - LAMBDA) * m / np.maximum(seen, 1), (1 - LAMBDA) * prior) + LAMBDA * prior


def _codes(way: np.ndarray, at: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """The classes before and after the places ``at``: what is added to a class to be its code, and the classes."""
    return [(0, way[at - 1]), (size, way[at + 1])]


def beside_known(rows: DataFrame, head: list[bytes], known: np.ndarray) -> DataFrame:
    """``(at, code, n)``: how often the head's word ``at`` stands beside a word of each known class, or an end.

    ``known`` has the class of each word of ``head``, -1 where it has none yet; words without one are counted. A code
    below size is the class before the word, else that after it plus size, where size is the classes and an end as the last.
    """
    shared = rows.sparkSession.sparkContext.broadcast((head, known))  # HEAD words at most
    size = int(known.max(initial=-1)) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, k = shared.value
        place = {w: i for i, w in enumerate(words)}
        of = np.append(k, -1)
        total = np.zeros(len(words) * 2 * size, dtype=np.int32)
        for b in slices(batches, "text"):
            flat, sizes = flat_words(texts(b.column(0)))
            own = np.fromiter(map(place.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
            way = np.full(len(flat) + len(sizes) + 1, size - 1)
            at = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes) + 1
            way[at] = of[own]
            open_ = (own >= 0) & (of[own] < 0)
            for side, there in _codes(way, at[open_], size):
                cells, n = np.unique((own[open_] * 2 * size + there + side)[there >= 0], return_counts=True)
                total[cells] += n.astype(np.int32)
        cells = np.flatnonzero(total)
        for i in range(0, len(cells), 100_000):
            part = cells[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((part // (2 * size)).astype(np.int32)), pa.array((part % (2 * size)).astype(np.int32)), pa.array(total[part].astype(np.int64))], ["at", "code", "n"])

    return rows.select("text").mapInArrow(run, "at int, code int, n long").groupBy("at", "code").agg(F.sum("n").alias("n"))


def all_pairs(rows: DataFrame, head: list[bytes], known: np.ndarray) -> DataFrame:
    """``(word, mate, found)``: every pair of tokens side by side, by class where the head knows it; found has counts ``n`` per ``code``.

    Two words of the head (or ends): word and mate are null, a code is the first's class * size + the second's. A rarer
    word beside one of the head: word, and codes of :func:`beside_known`. Two rarer words: both, and one count.
    A word or pair has a row per task and more.
    """
    shared = rows.sparkSession.sparkContext.broadcast((head, known))  # HEAD words at most
    size = int(known.max(initial=-1)) + 2  # 2 * size is below 255, for a code is a byte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, k = shared.value
        n_head = len(words)
        place: dict[bytes, int] = defaultdict(lambda: len(place), {w: i for i, w in enumerate(words)})
        of = np.append(k, -1)
        total = np.zeros(size * size, dtype=np.int64)
        held, twos, count = [], [], 0

        def made(word: pa.Array, mate: pa.Array, ends: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            found = pa.StructArray.from_arrays([pa.array(code.astype(np.int32)), pa.array(n)], ["code", "n"])
            return pa.RecordBatch.from_arrays([word, mate, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found)], ["word", "mate", "found"])

        def out() -> pa.RecordBatch:
            named = np.array([None, *list(place)[n_head:]], dtype=object)
            single, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64),) * 2
            double, times = np.unique(np.concatenate(twos), return_counts=True) if twos else (np.empty(0, np.int64),) * 2
            own, first = np.unique(single >> 8, return_index=True)
            word = np.concatenate([own, double >> 32]) - n_head + 1
            mate = np.concatenate([np.zeros(len(own), np.int64), (double & 0xFFFFFFFF) - n_head + 1])
            ends = np.concatenate([first, len(single) + np.arange(len(double) + 1)])
            code = np.concatenate([single & 255, np.full(len(double), -1)])
            for w in named[1:]:
                del place[w]
            return made(pa.array(named[word], pa.binary()), pa.array(named[mate], pa.binary()), ends, code, np.concatenate([n, times]))

        for b in slices(batches, "text", 1_000_000):
            flat, sizes = flat_words(texts(b.column(0)))
            own = np.fromiter(map(place.__getitem__, flat), dtype=np.int64, count=len(flat))
            way = np.full(len(flat) + len(sizes) + 1, size - 1)
            at = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes) + 1
            way[at] = of[np.minimum(own, n_head)]
            both = (way[:-1] >= 0) & (way[1:] >= 0)
            total += np.bincount(way[:-1][both] * size + way[1:][both], minlength=len(total))
            rare = own >= n_head
            for side, there in _codes(way, at[rare], size):
                held.append((own[rare] << 8 | (there + side))[there >= 0])
                count += len(held[-1])
            places = np.flatnonzero(rare)
            first = places[:-1][np.diff(at[places]) == 1]
            twos.append(own[first] << 32 | own[np.minimum(first + 1, len(own) - 1)])
            count += len(first)
            if count > 4 * HOLD or len(place) - n_head > HOLD:
                yield out()
                held, twos, count = [], [], 0
        yield out()
        cells, none = np.flatnonzero(total), pa.nulls(1, pa.binary())
        yield made(none, none, np.array([0, len(cells)]), cells, total[cells])

    return rows.select("text").mapInArrow(run, "word binary, mate binary, found array<struct<code: int, n: long>>")


def best_class(m: np.ndarray, code: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word's neighbours (codes and counts from each of ``starts`` on) the class in which they are likeliest: one exchange step against class bigrams ``m``, whose last class is the end."""
    size = len(m)
    log = np.log(smooth(m))
    spread = np.log(m.sum(axis=0)[: size - 1] + 1)
    worth = np.vstack([log[:, : size - 1], log[: size - 1].T]) - spread / 2  # by code and class
    return np.add.reduceat(n[:, None] * worth[code], starts).argmax(axis=1)


@dataclass
class Model:
    """log10 transitions between classes (the last is the end), tokens and word types per class, the class of words that training lacks, N, V, the end's count."""

    transition: np.ndarray
    tokens: np.ndarray
    types: np.ndarray
    unseen: int
    n: int
    v: int
    ends: int

    @property
    def norm(self) -> np.ndarray:
        """What a class's counts are divided by; one more type than it has where unseen words belong."""
        return self.tokens + EMISSION * self.types

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def emission(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 P(word of count c | its class k); an end is certain in its class."""
        return np.log10((c + EMISSION) / self.norm[k])


def train(rows: DataFrame, counts: DataFrame) -> tuple[Model, DataFrame]:
    """Learn from all rows (text); ``counts`` is their word table. The model, and ``(word, c, k)`` with every word's class.

    The words of the head that aren't clustered choose a class by their clustered neighbours, rarer words by those of the
    head, and once more by all of theirs. Then every pair of tokens side by side counts for the class bigrams.
    """
    spark = rows.sparkSession
    n_docs = rows.count()
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    head = [w for w, _ in frequent(counts, max(HEAD, CLUSTERED))]
    clustered = head[:CLUSTERED]
    symbols = Symbols(clustered)
    found = symbol_pairs(rows, clustered).toArrow()  # (CLUSTERED + 2) squared rows at most
    pairs = np.zeros(symbols.size * symbols.size, dtype=np.int64)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    pairs = pairs.reshape(symbols.size, symbols.size)
    of = exchange(pairs, len(clustered))
    size = int(of[: len(clustered)].max(initial=-1)) + 2
    m = np.zeros((size + 1, size + 1))  # the classes, all other words, the end
    np.add.at(m, (of[:, None], of[None, :]), pairs)
    m = np.delete(np.delete(m, size - 1, 0), size - 1, 1)
    fallback = int(m.sum(axis=0)[:-1].argmax()) if clustered else 0

    def chosen(m: np.ndarray):
        @F.arrow_udf("int")
        def choose(groups: pa.Array) -> pa.Array:
            flat, size = groups.flatten(), groups.value_lengths().to_numpy()
            return pa.array(best_class(m, flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(float), np.cumsum(size) - size) if len(groups) else [], pa.int32())

        return choose

    known = np.concatenate([of[: len(clustered)], np.full(len(head) - len(clustered), -1)])
    if len(head) > len(clustered):
        found = beside_known(rows, head, known).groupBy("at").agg(F.collect_list(F.struct("code", "n")).alias("found"))  # 2 * (CLASSES + 1) codes at most
        own = found.select("at", chosen(m)("found").alias("k")).toArrow()  # HEAD rows at most
        known[len(clustered) :] = fallback
        known[own.column("at").to_numpy()] = own.column("k").to_numpy()
    table = materialise(all_pairs(rows, head, known), "lm-pairs")
    m = np.zeros((size, size))
    for r in table.where("word is null").select(F.explode("found").alias("f")).groupBy("f.code").agg(F.sum("f.n").alias("n")).collect():  # classes squared
        m[divmod(r.code, size)] += r.n
    fixed = spark.createDataFrame(pa.table({"word": pa.array(head, pa.binary()), "k": pa.array(known, pa.int32())}))
    if clustered:
        choose, every = chosen(m.copy()), lambda c: F.flatten(F.collect_list(c)).alias(c)
        first = table.where("word is not null and mate is null").groupBy("word").agg(every("found"))
        first = materialise(first.select("word", "found", choose("found").alias("k")), "lm-first")
        # two rarer words side by side choose again, by one another's first class too
        twos = table.where("mate is not null").select("word", "mate", F.get("found", F.lit(0))["n"].alias("n"))
        code = lambda c: F.array(F.struct(c.cast("int").alias("code"), "n")).alias("more")
        after = twos.join(first.select(F.col("word").alias("mate"), "k"), "mate").select("word", code(F.col("k") + size))
        before = twos.join(first.select("word", "k"), "word").select(F.col("mate").alias("word"), code(F.col("k")))
        more = after.unionAll(before).groupBy("word").agg(every("more"))
        again = first.join(more, "word", "full").where("more is not null")
        none = F.array().cast("array<struct<code: int, n: long>>")
        again = again.select("word", choose(F.concat(F.coalesce("found", none), "more")).alias("_k"))
        moved = materialise(first.join(again, "word", "full").select("word", "found", F.coalesce("_k", "k").alias("k")), "lm-second")
        for r in moved.select("k", F.explode("found").alias("f")).groupBy("k", "f.code").agg(F.sum("f.n").alias("n")).collect():
            m[(r.code, r.k) if r.code < size else (r.k, r.code - size)] += r.n
        fixed = fixed.unionAll(moved.select("word", "k"))
    words = counts.join(fixed, "word", "left").select("word", "c", F.coalesce("k", F.lit(fallback)).alias("k"))
    words = materialise(words, "lm-classes")
    if clustered:
        both = twos.join(words.select("word", F.col("k").alias("a")), "word").join(words.select(F.col("word").alias("mate"), F.col("k").alias("b")), "mate")
        for r in both.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
            m[r.a, r.b] += r.n
    types, singles, tokens = np.zeros(size), np.zeros(size), np.zeros(size)
    for r in words.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("singles")).collect():
        tokens[r.k], types[r.k], singles[r.k] = r.c, r.types, r.singles
    tokens[-1], types[-1] = n_docs, 0
    unseen = int(singles[:-1].argmax()) if size > 1 else 0
    types[unseen] += 1
    model = Model(np.log10(smooth(m)), tokens, types, unseen, (total.n or 0) + n_docs, total.v + (n_docs > 0), n_docs)
    return model, words


PARTS = "doc_id {id}, text_hash long, word binary, mate binary, n long, a int, b int, copies long, n_tokens long, known long, base double, score double"


def parts(docs: DataFrame, model: Model, head: list[tuple[bytes, int, int]]) -> DataFrame:
    """What texts give: a row with all that is known at once (word: a mark of its own), and rows of rarer words.

    A rarer word's row has the classes before and after it, -1 for those of rarer words; for
    each two rarer words side by side there is a row with both.
    """
    src = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    shared = docs.sparkSession.sparkContext.broadcast((model, head))  # HEAD words at most
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = shared.value
        place = {w: i for i, (w, _, _) in enumerate(table)}
        c = np.array([n for _, n, _ in table], dtype=np.float64)
        of = np.array([k for _, _, k in table] + [-1], dtype=np.int64)  # the last for words that aren't here
        base, emission = (m.base(c), m.emission(c, of[:-1])) if len(table) else (np.zeros(0), np.zeros(0))
        last = len(m.tokens) - 1
        end_base = float(m.base(np.array(m.ends, dtype=float)))
        names = ["doc_id", "text_hash", "word", "mate", "n", "a", "b", "copies", "n_tokens", "known", "base", "score"]
        for b in slices(batches, "text", 1_000_000):
            words, sizes = flat_words(texts(b.column(2)))
            docs_here = len(sizes)
            doc = np.repeat(np.arange(docs_here), sizes)
            there = np.fromiter(map(place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            way = np.full(len(words) + docs_here + 1, last)  # an end stands between texts
            at = np.arange(len(words)) + doc + 1
            way[at] = of[there]
            both = (way[:-1] >= 0) & (way[1:] >= 0)
            known = np.flatnonzero(there >= 0)
            total = lambda owner, weights=None: np.bincount(owner, weights, docs_here)
            score = total(np.repeat(np.arange(docs_here), sizes + 1)[both], m.transition[way[:-1][both], way[1:][both]]) + total(doc[known], emission[there[known]])
            # a mark holds a space, which no word does; it differs by text, so that marks are dealt evenly
            marks = [b" " + own.to_bytes(8, "little", signed=True) for own in b.column(1).to_pylist()]
            rare = np.flatnonzero(there < 0)
            two = rare[:-1][(np.diff(rare) == 1) & (doc[rare[:-1]] == doc[rare[1:]])] if len(rare) else rare
            named = [words[j] for j in rare.tolist()]
            rows = len(rare) + len(two)
            filled = lambda x, kind: pa.array(np.concatenate([x, np.zeros(rows, dtype=x.dtype)]), kind)
            spread = lambda x, y, kind: pa.array(np.concatenate([np.zeros(docs_here, dtype=np.int64), x, y]), kind)
            none, one = np.zeros(len(two), dtype=np.int64), np.ones(docs_here, dtype=np.int64)
            take = pa.array(np.concatenate([np.arange(docs_here), doc[rare], doc[two]]))
            columns = [
                pa.array(marks + named + [words[j] for j in two.tolist()], pa.binary()), pa.array([None] * (docs_here + len(rare)) + [words[j + 1] for j in two.tolist()], pa.binary()),
                spread(np.ones(len(rare), dtype=np.int64), np.ones(len(two), dtype=np.int64), pa.int64()), spread(way[at[rare] - 1], none, pa.int32()), spread(way[at[rare] + 1], none, pa.int32()),
                filled(one, pa.int64()), filled(sizes + 1, pa.int64()), filled(total(doc[known]) + (m.ends > 0), pa.int64()), filled(total(doc[known], base[there[known]]) + end_base, pa.float64()), filled(score, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *columns], names)

    return src.mapInArrow(run, PARTS.format(id=id_type))


def _array(values: np.ndarray):
    """A constant array column."""
    return F.split(F.lit(",".join(repr(float(x)) for x in values.ravel())), ",").cast("array<double>")


def score_with(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for every row of ``docs``, by a model and its word table (word, c, k)."""
    size = len(model.tokens)
    step = lambda x, y: F.element_at(_array(model.transition), x * size + y + 1)
    c, k = F.coalesce("c", F.lit(0)), F.coalesce("k", F.lit(model.unseen))
    found = materialise(parts(docs, model, head_of(words)).join(words, "word", "left").drop("word").withColumn("c", c).withColumn("k", k), "lm-parts")  # read twice
    single, n, nothing = F.col("mate").isNull(), F.col("n"), F.lit(0.0)
    base = F.log10((F.col("c") + 0.5) / F.lit(float(model.n + 0.5 * (model.v + 1))))
    own = F.log10(F.col("c") + EMISSION) - F.element_at(_array(np.log10(model.norm)), F.col("k") + 1)
    own += F.when(F.col("a") >= 0, step(F.col("a"), F.col("k"))).otherwise(nothing) + F.when(F.col("b") >= 0, step(F.col("k"), F.col("b"))).otherwise(nothing)
    zero = F.lit(0).cast("long")
    plain = found.where(single).select(
        "doc_id", "text_hash", "copies", "n_tokens", (F.col("known") + F.when(F.col("c") > 0, n).otherwise(zero)).alias("known"),
        (F.col("base") + n * base).alias("base"), (F.col("score") + F.when(n > 0, n * own).otherwise(nothing)).alias("score"),
    )
    mates = found.where(~single).select("doc_id", "text_hash", F.col("mate").alias("word"), "n", F.col("k").alias("a")).join(words.select("word", "k"), "word", "left")
    beside = mates.select("doc_id", "text_hash", zero.alias("copies"), zero.alias("n_tokens"), zero.alias("known"), nothing.alias("base"), (n * step(F.col("a"), k)).alias("score"))
    sums = plain.unionAll(beside).groupBy("doc_id", "text_hash").agg(*(F.sum(x).alias(x) for x in ("copies", "n_tokens", "known", "base", "score")))
    each = lambda x, name: (F.col(x) / F.col("copies")).alias(name)
    whole = lambda x, name: (F.col(x) / F.col("copies")).cast("long").alias(name)
    return sums.select("doc_id", whole("n_tokens", "n_tokens"), whole("known", "n_known"), each("base", "base_score"), each("score", "score"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))


def head_of(words: DataFrame) -> list[tuple[bytes, int, int]]:
    """The most frequent words, HEAD at most, with counts and classes."""
    head = {w: c for w, c in frequent(words, HEAD)}
    if not head:
        return []
    found = words.where(F.col("c") >= min(head.values())).select("word", "c", "k").toArrow()
    return [(bytes(w), c, k) for w, c, k in zip(*(x.to_pylist() for x in found.columns), strict=True) if w in head]


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """Model and word table (word, c, k) of all rows whose crc32(doc_id as text) mod 5 is not 1."""
    rows = pick(docs, "doc_id", "text").where(crc_mod(F.col("doc_id"), 5) != 1).select("text")
    return train(rows, materialise(word_counts(rows), "lm-words"))


def score_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Learns from the rows whose crc32(doc_id as text) mod 5 is not 1 (held_out tells the
    others). Tokens are the words and one end. base_score is the smoothed unigram's log10
    probability, score the class model's. n_known: tokens that training has; the others belong
    to the class that has most words of one occurrence. Null texts are
    empty: one token. Rows that repeat an id and a text are scored once and returned each; null
    ids count as the text ``null``. Other columns play no part. An empty table gives an empty
    result; with nothing to learn from every token is unknown. A row per rarer word of a text
    is shuffled, so no task holds the vocabulary.
    """
    model, words = learn(docs)
    out = score_with(docs, model, words)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
