"""Collocations of two to four words, by hierarchical pair naming.

Frequent words get ids, and texts become sequences of them. A frequent pair of neighbouring
(k-1)-grams gets an id of its own, which takes the pair's place in the sequences: the next
level's sequences, in which neighbours are k-grams that overlap. A name keeps the ids of its
two parents, so the counts of all cuts of a phrase, and all phrases inside it, are found by
joins from level to level; no text is read again.

Names are joined globally. The most common ones, a bounded number, are broadcast and put in
place where the sequences lie. Other words get their ids from a hash of their own text, so that
no sequence is moved for them; the words' table tells whether one of them shares its hash with
another word. Then, and for other pairs always, places meet their names in a shuffle. None of
those is common, so no key of that shuffle is hot.
"""

from __future__ import annotations

import contextlib
import hashlib
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, head_bound, materialise, pick, slices

#: Names that are broadcast: of words, of pairs.
HEAD_WORDS, HEAD_PAIRS = 1 << 17, 1 << 19
#: Bits of the filter of all other names, whatever their number: it spares joins, it decides nothing.
FILTER_BITS = 1 << 26
#: Bits of the hash from which words that aren't broadcast get their ids, 59 at most.
HASH_BITS = 59
#: Counts, and places of sequences, that a task holds before it hands on.
HOLD_COUNTS, HOLD_PLACES = 400_000, 2_000_000
#: Places of a row of sequences, where a piece ends so early; rows of a batch that Python hands on.
ROW_PLACES, BATCH_ROWS = 1 << 14, 1 << 14
#: What is read and handed to Python at once, while sequences are: their rows are long.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "256"}
#: A score is this many times the harmonic-like share a / (l + r).
SCALE = 2_000_000

#: A-Z become a-z, tabs spaces, and all that ends a piece a full stop.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t,;:!?\n\v\f\r", bytes(range(97, 123)) + b" " + b"." * 9)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, and a full stop wherever a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).replace(b".", b" . ").split()


def squeeze(ids: np.ndarray) -> np.ndarray:
    """``ids`` with one zero for each run of zeros."""
    some = ids != 0
    return ids[some | np.concatenate([[True], some[:-1]])] if len(ids) else ids


def _ends(ids: np.ndarray, pending: np.ndarray, most: int) -> list[int]:
    """Where rows of about ``most`` places end: after a zero that stays, so that no pair is cut. pending: zeros that may get an id."""
    stop = ids == 0
    stop[pending] = False
    stops, ends, start = np.flatnonzero(stop) + 1, [], 0
    while len(ids) - start > most:
        i = int(np.searchsorted(stops, start + most, side="right"))  # the last one in reach, else the next
        start = int(stops[i - 1]) if i and stops[i - 1] > start else int(stops[i]) if i < len(stops) else len(ids)
        ends.append(start)
    return ends if ends and ends[-1] == len(ids) else [*ends, len(ids)]


def _batches(columns: list[pa.Array], names: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``most`` rows: the JVM holds each one whole."""
    whole = pa.RecordBatch.from_arrays(columns, names)
    return (whole.slice(i, most) for i in range(0, whole.num_rows, most))


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While what is inside is run, SMALL holds."""
    before = {k: spark.conf.get(k) for k in SMALL}
    try:
        for k, v in SMALL.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _summed(counts: DataFrame, *keys: str) -> DataFrame:
    """Sums of ``n``; tasks add up before they hand on."""
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"))


def _pair_place(left, right):
    """A pair's bit of the filter, as numpy arrays or columns alike; no step passes 63 bits."""
    return (left % 2_147_483_647) * 1_000_003 + (right % 2_147_483_629) * 998_244_353


def _filter(rare: DataFrame | None, place: Column) -> np.ndarray | None:
    """Which bits of FILTER_BITS the names that aren't broadcast take: what has none of them needs no join."""
    if rare is None:
        return None
    at = rare.select(F.pmod(place, F.lit(FILTER_BITS)).alias("at"))
    parts = at.groupBy(F.floor(F.col("at") / 32_768).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32_768).alias("bits")).collect()  # 4 KB each
    out = np.zeros((FILTER_BITS // 32_768, 4096), np.uint8)
    for r in parts:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n``: occurrences of all words in each language; tasks add up first."""
    most = BATCH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                del c[b"."]
                words = sorted(c)
                columns = [pa.array([lang] * len(c), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array([c[w] for w in words], pa.int64())]
                yield from _batches(columns, ["lang", "word", "n"], most)
            seen.clear()

        for b in slices(batches, "text"):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[lang].update(tokens(text))
            if sum(map(len, seen.values())) > HOLD_COUNTS:
                yield from out()
        yield from out()

    return _summed(docs.mapInArrow(run, "lang string, word string, n long"), "lang", "word")


def _named(counts: DataFrame, level: int) -> DataFrame:
    """``counts`` with an id that no other name of any level has, as a table."""
    return materialise(counts.withColumn("id", F.monotonically_increasing_id() * 8 + level), f"names-{level}")


def _key() -> Column:
    """A word of a language as bytes."""
    return F.concat("lang", F.lit("\0"), "word").cast("binary")


def _hash_id(digits, bits: int):
    """The id that the number of an MD5's first 15 hex digits gives, as int or column: a multiple of 8, which no other name's id is."""
    return (digits % (1 << bits) + (1 << 59)) * 8


def _word_names(words: DataFrame, least: int, most: int) -> tuple[DataFrame, bool]:
    """Frequent words with their ids, and whether those that aren't broadcast have theirs from a hash.

    They do unless one of them shares its id with any other word. A word that isn't frequent may get an
    id in a sequence then, by the filter's false positives; no phrase that holds it is frequent.
    """
    often = words.where(F.col("n") >= least)
    bound = head_bound(often, "n", most)
    hashed = _hash_id(F.conv(F.substring(F.md5(_key()), 1, 15), 16, 10).cast("long"), HASH_BITS)
    rest = words.where(F.col("n") < bound).withColumn("id", hashed)
    own = rest.where(F.col("n") >= least).select("id")
    alone = rest.select("id").join(own, "id").count() == own.count()  # each meets itself only
    counted = F.monotonically_increasing_id() * 8 + 1
    return materialise(often.withColumn("id", F.when(F.col("n") < bound, hashed).otherwise(counted) if alone else counted), "names-1"), alone


def _split(names: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The most common names, ``most`` at most, and the others, or none if there are none."""
    bound = head_bound(names, "n", most)
    rare = names.where(F.col("n") < bound)
    return names.where(F.col("n") >= bound), None if rare.isEmpty() else rare


def _set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    at = places % FILTER_BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def encoded(docs: DataFrame, names: DataFrame, most: int = HEAD_WORDS, hashed: bool = False) -> DataFrame:
    """``ids``: sequences of the ids of frequent words, zero where a piece ends or another word stands.

    hashed: the ids of words that aren't broadcast are those of :func:`_word_names`, and are put in place at once.
    """
    head, rare = _split(names, most)
    own: dict[str, dict[bytes, int]] = defaultdict(dict)
    for r in head.select("lang", "word", "id").toLocalIterator():  # ``most`` rows at most
        own[r.lang][r.word.encode()] = r.id
    bits = _filter(rare, F.crc32(_key()))
    shared = docs.sparkSession.sparkContext.broadcast((dict(own), bits))
    rest_too, join, width, row_places = rare is not None, rare is not None and not hashed, HASH_BITS, ROW_PLACES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            by_lang = defaultdict(list)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_lang[lang] += tokens(text)
                by_lang[lang].append(b".")
            for lang, words in by_lang.items():
                known, left = shared.value[0].get(lang, {}), []
                ids = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
                if rest_too:
                    at, start = np.flatnonzero(ids == 0), zlib.crc32(lang.encode() + b"\0")
                    places = np.fromiter((zlib.crc32(words[i], start) for i in at.tolist()), np.int64, len(at))
                    left = [i for i in at[_set(shared.value[1], places)].tolist() if words[i] != b"."]
                    if hashed:
                        prefix = lang.encode() + b"\0"
                        ids[left] = [_hash_id(int(hashlib.md5(prefix + words[i]).hexdigest()[:15], 16), width) for i in left]
                if join:
                    yield _sequence(ids, np.array(left, np.int64), {"lang": pa.array([lang] * len(left), pa.string()), "word": pa.array([words[i].decode() for i in left], pa.string())}, row_places)
                else:
                    yield _sequence(squeeze(ids), None, {"lang": pa.array([], pa.string()), "word": pa.array([], pa.string())}, row_places)

    found = docs.mapInArrow(run, "ids array<long>, rest array<struct<at:int,lang:string,word:string>>")
    return _placed(found, rare if join else None, ["lang", "word"])


def _sequence(ids: np.ndarray, at: np.ndarray | None, names: dict[str, pa.Array], most: int) -> pa.RecordBatch:
    """Rows of ``ids``; rest: the places ``at`` in a row, ascending, to which the names of ``names`` may belong."""
    at = np.zeros(0, np.int64) if at is None else at
    ends = _ends(ids, at, most)
    starts = np.array([0, *ends[:-1]])
    row = np.searchsorted(ends, at, side="right")
    rest = pa.StructArray.from_arrays([pa.array((at - starts[row]).astype(np.int32)), *names.values()], ["at", *names])
    cut = lambda x: pa.array(np.array([0, *x], np.int32))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cut(ends), pa.array(ids)), pa.ListArray.from_arrays(cut(np.searchsorted(at, ends)), rest)], ["ids", "rest"])


def _placed(found: DataFrame, rare: DataFrame | None, on: list[str]) -> DataFrame:
    """The sequences of ``found``, with the rare names of what is left put in their places."""
    if rare is None:
        return materialise(found.select("ids"), "sequences")
    found = materialise(found.withColumn("seq", F.monotonically_increasing_id()), "open-sequences")
    rest = found.select("seq", F.explode("rest").alias("x")).select("seq", "x.*")
    hits = rest.join(rare.select(*on, "id"), on).groupBy("seq").agg(F.collect_list(F.struct("at", "id")).alias("hits"))  # of one slice of texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("ids")[i].values.to_numpy().copy()
                got = b.column("hits")[i].values
                if got is not None and len(got):
                    ids[got.field("at").to_numpy()] = got.field("id").to_numpy()
                ids = squeeze(ids)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], ["ids"])

    out = materialise(found.select("seq", "ids").join(hits, "seq", "left").mapInArrow(run, "ids array<long>"), "sequences")
    discard(found)
    return out


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        column = b.column(b.schema.get_field_index("ids"))
        for i in range(b.num_rows):
            yield column[i].values.to_numpy()


def pair_counts(sequences: DataFrame) -> DataFrame:
    """``left, right, n``: how often two ids stand beside each other."""
    most = BATCH_ROWS

    def count(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.int64))])
        own, code = np.unique(ids, return_inverse=True)
        both = (ids[:-1] != 0) & (ids[1:] != 0)
        keys, n = np.unique(code[:-1][both] * len(own) + code[1:][both], return_counts=True)
        return _batches([pa.array(own[keys // len(own)]), pa.array(own[keys % len(own)]), pa.array(n)], ["left", "right", "n"], most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places = [], 0
        for ids in _arrays(batches):
            held.append(ids)
            places += len(ids)
            if places > HOLD_PLACES:
                yield from count(held)
                held, places = [], 0
        if held:
            yield from count(held)

    return _summed(sequences.mapInArrow(run, "left long, right long, n long"), "left", "right")


class PairTable:
    """Ids of pairs, looked up for whole sequences."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ids: np.ndarray):
        self.own = np.unique(np.concatenate([left, right]))
        keys = np.searchsorted(self.own, left) * len(self.own) + np.searchsorted(self.own, right)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    def find(self, sequence: np.ndarray) -> np.ndarray:
        """For each place but the last the id of the pair that starts there, or 0."""
        out = np.zeros(max(0, len(sequence) - 1), np.int64)
        if not len(self.keys) or not len(out):
            return out
        code = np.minimum(np.searchsorted(self.own, sequence), len(self.own) - 1)
        known = self.own[code] == sequence
        at = np.flatnonzero(known[:-1] & known[1:])
        keys = code[at] * len(self.own) + code[at + 1]
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out[at] = np.where(self.keys[place] == keys, self.ids[place], 0)
        return out


def renamed(sequences: DataFrame, names: DataFrame, most: int = HEAD_PAIRS) -> DataFrame:
    """``ids``: the next level's sequences, in which the id of a frequent pair stands for its left one; zero for other pairs."""
    head, rare = _split(names, most)
    got = head.select("left", "right", "id").toArrow()  # ``most`` rows at most
    place = _pair_place(F.col("left"), F.col("right"))
    bits = _filter(rare, place.bitwiseXOR(F.shiftright(place, 29)))
    shared = sequences.sparkSession.sparkContext.broadcast((tuple(got.column(c).to_numpy() for c in ("left", "right", "id")), bits))
    rest_too, row_places = rare is not None, ROW_PLACES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PairTable(*shared.value[0])
        for ids in _arrays(batches):
            new = table.find(ids)
            if rest_too:
                at = np.flatnonzero((new == 0) & (ids[:-1] != 0) & (ids[1:] != 0))
                places = _pair_place(ids[at], ids[at + 1])
                at = at[_set(shared.value[1], places ^ (places >> 29))]
                yield _sequence(new, at, {"left": pa.array(ids[at]), "right": pa.array(ids[at + 1])}, row_places)
            else:
                yield _sequence(squeeze(new), None, {"left": pa.array([], pa.int64()), "right": pa.array([], pa.int64())}, row_places)

    found = sequences.mapInArrow(run, "ids array<long>, rest array<struct<at:int,left:long,right:long>>")
    return _placed(found, rare, ["left", "right"])


def frequent_phrases(docs: DataFrame, least: int, widest: int, heads: tuple[int, int]) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Phrases of 2 to ``widest`` words that stand ``least`` times or more, the names of each level, and each language's number of words.

    Names have ``id, left, right, n`` (words ``id, lang, word, n``). A phrase has ``id, lang, a``;
    pre and suf: the counts of its first 1, 2, ... words and of what follows these; subs: the
    shorter phrases in it, each with its count.
    """
    docs = pick(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = materialise(word_counts(docs), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    first, hashed = _word_names(words, least, heads[0])
    names = [first]
    sequences = encoded(docs, first, heads[0], hashed)
    none, no_subs = F.array().cast("array<long>"), F.array().cast("array<struct<id: long, a: long>>")
    level = names[0].select("id", "lang", F.col("n").alias("a"), none.alias("pre"), none.alias("suf"), no_subs.alias("subs"))
    out = []
    for k in range(2, widest + 1):
        names.append(_named(pair_counts(sequences).where(F.col("n") >= least), k))
        if k < widest:
            following = renamed(sequences, names[-1], heads[1])
            discard(sequences)
            sequences = following
        left = level.select(F.col("id").alias("left"), "lang", "pre", F.col("a").alias("left_a"), F.col("subs").alias("left_in"))
        right = level.select(F.col("id").alias("right"), "suf", F.col("a").alias("right_a"), F.col("subs").alias("right_in"))
        parents = F.array(*[F.struct(F.col(s).alias("id"), F.col(f"{s}_a").alias("a")) for s in ("left", "right")]) if k > 2 else no_subs
        level = names[-1].join(left, "left").join(right, "right").select(
            "id",
            "lang",
            F.col("n").alias("a"),
            F.concat("pre", F.array("left_a")).alias("pre"),
            F.concat(F.array("right_a"), "suf").alias("suf"),
            F.array_distinct(F.concat("left_in", "right_in", parents)).alias("subs"),
        )
        level = materialise(level, f"phrases-{k}")
        out.append(level)
    discard(sequences)
    return out, names, totals


def spelled(rows: DataFrame, names: list[DataFrame], most: int = 100_000) -> DataFrame:
    """``rows`` (id, k, ...) with ``phrase``: a phrase's names are followed to its words, all rows a level at a time.

    Up to ``most`` rows are broadcast to the names; more are joined by a shuffle.
    """
    few = rows.count() <= most
    at = rows.select("id", "k", F.lit(0).alias("at"), F.col("id").alias("own"))
    found = None
    for k in range(len(names), 1, -1):
        here = at.where(F.col("k") == k).select("own", "at", "id")
        here = here if found is None else here.unionByName(found)
        met = names[k - 1].select("id", "left", "right").join(F.broadcast(here) if few else here, "id")
        parts = F.explode(F.array(F.struct(F.col("at"), F.col("left").alias("id")), F.struct((F.col("at") + 1).alias("at"), F.col("right").alias("id"))))
        found = met.select("own", parts.alias("x")).select("own", "x.at", "x.id").distinct()
    words = names[0].select("id", "word").join(F.broadcast(found) if few else found, "id").groupBy("own").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("ws"))
    texts = words.select(F.col("own").alias("id"), F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("phrase"))
    return rows.join(texts, "id")


def ranked(rows: DataFrame, columns: list[str], top: int) -> DataFrame:
    """Rows of each language's first ``top``, with their rank from 1: by ``columns``, numbers descending and texts ascending.

    Rows are dealt by ranges of the whole order, so a language that holds most of them is
    spread over tasks; a row's rank is its place in its range and what earlier ranges hold.
    """
    kinds = dict(rows.dtypes)
    order = [F.col("lang"), *[F.col(c) if kinds[c] == "string" else F.col(c).desc() for c in columns]]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(placed, "ranges").withColumn("part", F.shiftright("place", 33))
    held = placed.groupBy("lang", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    held = held.select("lang", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    rank = F.col("place") - F.col("first") + F.col("before") + 1
    return placed.join(held.where(F.col("before") < top), ["lang", "part"]).withColumn("rank", rank).where(F.col("rank") <= top).drop("place", "part", "first", "before")


def collocations(docs: DataFrame, least: int = 30, widest: int = 4, covered: int = 80, top: int = 2000, heads: tuple[int, int] = (HEAD_WORDS, HEAD_PAIRS)) -> DataFrame:
    """Each language's strongest phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Texts lose the case of A-Z and are cut into pieces at ``.,;:!?`` and line ends, those into
    words at spaces and tabs. A phrase is of 2 to ``widest`` words and stands ``least`` times or
    more (a) in its language. Of its cuts into two parts, which stand l and r times, that with
    the lowest floor(2000000 * a / (l + r)) counts, of equal ones the shortest first part. A
    phrase goes if a longer one (itself kept or not) that holds it stands at least ``covered``
    hundredths as often. n: all words of the language. Ranks go by score, then a, both
    descending, then by the phrase's bytes; ``top`` rows of a language at most.

    A null language is ``und``, a null text empty; repeated rows count each; doc_id and other
    columns play no part; an empty table gives no rows. Counts are exact, and products are
    decimals. ``heads``: how many names of words and pairs are broadcast; the rest is joined.
    """
    wide = lambda c: c.cast("decimal(20,0)")
    score = lambda l, r: F.call_function("div", wide(F.col("a")) * F.lit(SCALE).cast("decimal(7,0)"), wide(l) + wide(r))
    with _small_batches(docs.sparkSession):
        levels, names, totals = frequent_phrases(docs, least, widest, heads)
    phrases, longer = None, None
    for k, level in enumerate(levels, 2):
        level = level.withColumn("k", F.lit(k))
        own = level.select("a", F.explode("subs").alias("x")).where(wide(F.col("a")) * 100 >= wide(F.col("x.a")) * covered).select("x.id")
        phrases = level if phrases is None else phrases.unionByName(level)
        longer = own if longer is None else longer.unionByName(own)
    cut = F.transform("pre", lambda l, i: F.struct(score(l, F.get("suf", i)).alias("score"), i.alias("k"), l.alias("l"), F.get("suf", i).alias("r")))
    kept = phrases.join(longer.distinct(), "id", "left_anti").select("id", "k", "lang", "a", F.array_min(cut).alias("cut"))
    rated = kept.select("id", "k", "lang", "a", "cut.l", "cut.r", F.col("cut.score").alias("score"))
    # the first by score and count, with all that tie with the last of them; only these are spelled
    rated = materialise(rated, "rated")
    ends = ranked(rated, ["score", "a"], top).where(F.col("rank") == top).select("lang", F.struct("score", "a").alias("end"))
    first = rated.join(ends, "lang", "left").where(F.col("end").isNull() | (F.struct("score", "a") >= F.col("end"))).drop("end")
    best = ranked(spelled(materialise(first, "first"), names), ["score", "a", "phrase"], top).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
