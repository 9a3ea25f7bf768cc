"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint of 64 bits is cut into ``blocks`` blocks. Two fingerprints that differ in at
most ``max_distance`` bits agree on at least ``blocks - max_distance`` whole blocks, so a
table keyed by every choice of that many blocks brings each close pair together (no pair is
lost). Only keys that two different fingerprints share go on; a key shared by many is dealt
into tiles of bounded size, and a tile returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_position, materialise, pick, slices, texts
from .graph import connected_components

TILE = 16_384
CHUNK = 65_536


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Space-joined windows of ``width`` words, repeats included; fewer words: the whole sequence; none: none."""
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (n x k words of 64 bits) have each bit set: k * 64 counts, lowest bit first."""
    total = np.zeros(hashes.shape[1] * 64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[i : i + CHUNK])
        total += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return total


def fingerprint(text: str, width: int) -> int:
    """Unsigned 64-bit SimHash of a text."""
    parts = shingles(words_of(text), width)
    if not parts:
        return 0
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(s, 42) for s in parts), dtype="<u8", count=len(parts))
    bits = bit_counts(hashes.reshape(-1, 1)) * 2 > len(parts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs``; fp is the fingerprint as a signed long. Null text: as empty."""
    src = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, width) for t in texts(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(blocks: int, max_distance: int) -> list[int]:
    """A mask for every choice of ``blocks - max_distance`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(c) for c in combinations(own, blocks - max_distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what distance <= max_distance connects among distinct fingerprints.

    A breadth-first walk that compares each reached one with those not yet reached: as exact
    as all pairs, but it returns fewer links than fingerprints.
    """
    left = np.unique(fps.view(np.uint64))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while left.size > 1:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            p = todo.pop()
            near = np.bitwise_count(left ^ p) <= max_distance
            if near.any():
                got = left[near]
                left = left[~near]
                todo.extend(got)
                a.append(np.full(got.size, p, dtype=np.uint64))
                b.append(got)
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def tiles(keyed: DataFrame, keys: list[str], item: str, tile: int = TILE) -> DataFrame:
    """Rows ``keys, ti, tj, item`` with every two items of a key in some tile together.

    Keys that have one item go. A key of up to ``tile`` items is one tile; a larger one is
    split in chunks by hash and dealt to all pairs of chunks, so no group outgrows a task.
    """
    n = keyed.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    joined = keyed.join(n, keys).withColumn("_t", F.ceil(F.col("_n") / tile).cast("int"))
    chunk = F.pmod(F.xxhash64(item), F.col("_t")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_t") - 1))
    return joined.select(*keys, item, chunk.alias("_c"), other.alias("_o")).select(*keys, F.least("_c", "_o").alias("ti"), F.greatest("_c", "_o").alias("tj"), item)


def close_links(distinct: DataFrame, max_distance: int = 3, blocks: int = 5, tile: int = TILE) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column fp) that connect all close pairs."""
    masks = block_masks(blocks, max_distance)
    key = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)]))
    keyed = distinct.select("fp", key.alias("_key")).select("fp", "_key.k", "_key.v")

    @F.arrow_udf("array<struct<a:long,b:long>>")
    def link(groups: pa.Array) -> pa.Array:
        a, b, ends = [], [], [0]
        flat, at = groups.flatten().to_numpy(), 0
        for n in groups.value_lengths().to_pylist():
            x, y = spanning_links(np.ascontiguousarray(flat[at : at + n]), max_distance)
            a.append(x)
            b.append(y)
            ends.append(ends[-1] + len(x))
            at += n
        cat = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([cat(a), cat(b)], ["a", "b"]))

    dealt = tiles(keyed, ["k", "v"], "fp", tile).groupBy("k", "v", "ti", "tj").agg(F.collect_list("fp").alias("fps"))
    return dealt.select(F.explode(link("fps")).alias("e")).select("e.a", "e.b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, max_distance: int = 3, blocks: int = 5, tile: int = TILE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that is reachable
    by fingerprints that differ in ``max_distance`` bits or fewer, the row's own included.

    Null and empty texts, and texts of white space, have fingerprint zero and link to each
    other. Repeated rows give a row each. A null doc_id gives a row too; it never is a
    component_id while its component has another id. Other columns play no part. An empty
    table gives an empty result.
    """
    fps = materialise(fingerprints(docs, width), "fp")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-distinct")
    comps = connected_components(close_links(distinct, max_distance, blocks, tile))
    rooted = distinct.join(comps, distinct["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = rooted.where("root <> fp").select("root").distinct()
    groups = rooted.join(linked, "root", "left_semi")
    least = groups.join(groups.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    # a table of its own, so that the last join has an exchange on both sides and a fingerprint of many rows can be split
    labels = materialise(distinct.join(least, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "fp-labels")
    return fps.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies at a set similarity, for deduplication: prefix filter, wider fingerprints, exact check.

#: Differing bits a candidate may have: at similarity 0.8 the mean is 19.4 of 128 and the deviation 4.
#: Summed over the binomial a pair has more with probability 1.3e-6 (at worst 6.4e-6 for sets of up to
#: 60 shingles, 2.3e-4 for sets of 5).
COPY_DISTANCE = 40
#: Documents and shingles of one chunk in the exact check.
COPY_CHUNK, COPY_SHINGLES = 4096, 1 << 20
#: A shingle is frequent from this share of all documents; they come last in every prefix, which bears on speed alone.
FREQUENT, FREQUENT_MOST = 1 / 2000, 1 << 20
#: Shingles a task holds before it hands counts on.
HOLD = 2_000_000


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Distinct shingles' hashes, sorted; none for a text without words."""
    h = xxhash.xxh64_intdigest
    parts = shingles(words_of(text), width)
    return np.unique(np.fromiter((h(s, 42) for s in parts), dtype=np.uint64, count=len(parts)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A second hash from the first (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Second hashes, sorted, of the shingles that more than about FREQUENT of all texts hold: 1 / FREQUENT times a text's shingles at most, and FREQUENT_MOST.

    A task counts its texts' shingles and hands on those that reach half that share of what it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            own, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, len(held) * FREQUENT / 2)
            return pa.RecordBatch.from_arrays([pa.array(own[often].view(np.int64)), pa.array(n[often])], ["v", "n"])

        for b in slices(batches, "text"):
            for t in texts(b.column(0)):
                held.append(_mix(shingle_hashes(t, width)))
                size += len(held[-1])
            if size > HOLD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    src = pick(docs, "text")
    least = max(64, int(src.count() * FREQUENT / 2))
    found = src.mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(found.orderBy(F.col("n").desc(), "v").limit(FREQUENT_MOST).toArrow().column("v").to_numpy().view(np.uint64))


def prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in one order of all, the frequent ones among them apart: two sets of a Jaccard similarity of ``similarity`` or more share one of theirs.

    The order: frequent ones last, else by a second hash, which is what is returned.
    """
    n = len(hashes)
    most = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    v = _mix(hashes)
    often = np.zeros(n, dtype=bool)
    if len(frequent) and n:
        often = frequent[np.minimum(np.searchsorted(frequent, v), len(frequent) - 1)] == v
    rare, often = v[~often], v[often]
    if len(rare) >= most:
        return (np.partition(rare, most - 1)[:most] if most else rare[:0]), v[:0]
    return rare, np.sort(often)[: most - len(rare)]


def signature(one: np.ndarray) -> tuple[int, int, int]:
    """A hash of the shingle set and the set's SimHash of 128 bits, as signed longs."""
    if not len(one):
        return 0, 0, 0
    own = int(_mix(one + np.uint64(len(one))).sum(dtype=np.uint64))
    both = np.column_stack([one, _mix(one)])
    bits = np.packbits(bit_counts(both) * 2 > len(one), bitorder="little").view("<u8")
    return _signed(own), _signed(int(bits[0])), _signed(int(bits[1]))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))


def signatures(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, h, node, size, f0, f1, rare, often)`` per row: h is the text's hash, node that of its shingle set; rare and often are the set's prefix."""
    src = pick(docs, "doc_id", "text").select("doc_id", text_hash("text").alias("h"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))  # FREQUENT_MOST hashes at most
    names = ["doc_id", "h", "node", "size", "f0", "f1", "rare", "often"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingle_hashes(t, width) for t in texts(b.column(2))]
            node, f0, f1 = (pa.array(c, pa.int64()) for c in zip(*map(signature, sets), strict=True))
            rare, often = zip(*(prefix(x, similarity, shared.value) for x in sets), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, pa.array(list(map(len, sets)), pa.int64()), f0, f1, _lists(rare), _lists(often)], names)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, h long, node long, size long, f0 long, f1 long, rare array<long>, often array<long>")


def text_hash(text: str):
    """A hash that tells which text a row has; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def near_links(node: np.ndarray, f: np.ndarray, most: int = COPY_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``most`` differing bits connect among nodes with fingerprints ``f`` (n x 2)."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    left = np.arange(len(node))
    while left.size > 1:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            p = todo.pop()
            near = np.bitwise_count(f[left] ^ f[p]).sum(axis=1) <= most
            if near.any():
                got, left = left[near], left[~near]
                todo.extend(got)
                a.append(np.full(got.size, node[p]))
                b.append(node[got])
    if not a:
        return node[:0], node[:0]
    return np.concatenate(a), np.concatenate(b)


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int, most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, int]]:
    """Rows sorted by their first ``n_keys`` columns, in parts of whole groups: the columns, each group's start, and 0.

    A group that has more than ``most`` rows and goes on isn't held: it gives its first row alone and its number of rows.
    """
    held: list[np.ndarray] | None = None
    skipped: tuple | None = None
    count = 0

    def close(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, int]:
        new = np.zeros(len(cols[0]), dtype=bool)
        new[0] = True
        for k in cols[:n_keys]:
            new[1:] |= k[1:] != k[:-1]
        return cols, np.flatnonzero(new), 0

    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if skipped is not None:
            same = np.logical_and.reduce([c == k[0] for c, k in zip(cols[:n_keys], skipped, strict=False)])
            n = int(same.sum())  # sorted: they are the first
            count += n
            if n == len(same):
                continue
            yield list(skipped), np.zeros(1, dtype=np.int64), count
            skipped, cols = None, [c[n:] for c in cols]
        if not len(cols[0]):
            continue
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = close(held)[1][-1]
        if last:
            yield close([c[:last] for c in held])
        held = [c[last:] for c in held]
        if len(held[0]) > most:
            skipped, count, held = tuple(c[:1] for c in held), len(held[0]), None
    if skipped is not None:
        yield list(skipped), np.zeros(1, dtype=np.int64), count
    if held is not None:
        yield close(held)


def _candidates(n_keys: int, most: int):
    """Rows (keys, node, f0, f1), sorted: candidate links ``(a, b, 0)``, and ``(key, 0, n)`` of the first key where n rows outgrow a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, start, n in sorted_groups(batches, n_keys, most):
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array([0]), pa.array([n])], ["a", "b", "n"])
                continue
            node, f = cols[n_keys], np.column_stack(cols[n_keys + 1 :]).view(np.uint64)
            size = np.diff(np.append(start, len(node)))
            two = start[size == 2]
            two = two[(np.bitwise_count(f[two] ^ f[two + 1]).sum(axis=1) <= COPY_DISTANCE)]
            found = [(node[two], node[two + 1])] + [near_links(node[s : s + k], f[s : s + k]) for s, k in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True)]
            pairs = np.unique(np.column_stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.zeros(len(pairs), np.int64))], ["a", "b", "n"])

    return run


def candidate_links(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """``(a, b)``: links that connect the nodes that share a shingle of their prefixes and are close by fingerprint.

    Rare shingles are shuffled as they are. Frequent ones, and rare ones of more than ``tile``
    nodes, are dealt in tiles instead, so that no task holds a key's rows.
    """
    item = ("node", "f0", "f1")
    rare, often = (nodes.select(F.explode(c).alias("v"), *item) for c in ("rare", "often"))
    links = rare.repartition("v").sortWithinPartitions("v", "node").mapInArrow(_candidates(1, tile), "a long, b long, n long")
    links = materialise(links.groupBy("a", "b").agg(F.max("n").alias("n")), "links")
    large = links.where("n > 0").select(F.col("a").alias("v"), "n")
    large = materialise(large.unionAll(often.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")), "large-keys")
    if large.count() <= FREQUENT_MOST:  # a long and a count each
        large = F.broadcast(large)
    t = F.ceil(F.col("n") / tile).cast("int")
    chunk = F.pmod(F.xxhash64("node"), t).cast("int")
    dealt = rare.unionAll(often).join(large, "v").select("v", *item, chunk.alias("c"), F.explode(F.sequence(F.lit(0), t - 1)).alias("o"))
    dealt = dealt.select("v", F.least("c", "o").cast("long").alias("ti"), F.greatest("c", "o").cast("long").alias("tj"), *item)
    keys = ("v", "ti", "tj")
    # a tile is two chunks, of about ``tile`` rows each
    tiled = dealt.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(_candidates(3, 1 << 62), "a long, b long, n long")
    return links.where("n = 0").select("a", "b").unionAll(tiled.select("a", "b"))


def similar_links(node: list[int], items: list[str], width: int, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what a Jaccard similarity of ``similarity`` or more of shingle sets connects.

    An inverted index counts each text's shared shingles with those not yet reached.
    """
    sets = [shingle_hashes(t, width) for t in items]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, term = np.unique(flat, return_inverse=True)
    order = np.argsort(term, kind="stable")
    posting, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(term))]) if len(term) else np.zeros(1, np.int64)
    ends = np.cumsum(size)
    out, reached, todo = [], np.zeros(len(sets), dtype=bool), []
    for first in range(len(sets)):
        if reached[first]:
            continue
        reached[first] = True
        todo = [first]
        while todo and not reached.all():
            i = todo.pop()
            own = term[ends[i] - size[i] : ends[i]]
            if not len(own):
                got = np.flatnonzero((size == 0) & ~reached)
            else:
                shared = np.bincount(np.concatenate([posting[start[t] : start[t + 1]] for t in own.tolist()]), minlength=len(sets))
                got = np.flatnonzero((shared >= similarity * (size[i] + size - shared) - 1e-9) & ~reached)
            reached[got] = True
            todo.extend(got.tolist())
            out.extend((node[i], node[j]) for j in got.tolist())
    return out


def similar_in_groups(rows: DataFrame, keys: list[str], width: int, similarity: float) -> DataFrame:
    """``(a, b)``: links between similar texts of a group, from rows (keys, node, text); a task holds one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        held: dict[int, str] = {}

        def out() -> Iterator[pa.RecordBatch]:
            links = similar_links(list(held), list(held.values()), width, similarity) if len(held) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

        for b in slices(batches, "text"):
            *key, node = (c.to_pylist() for c in b.columns[:-1])
            for k, n, t in zip(zip(*key, strict=True), node, texts(b.column(len(key) + 1)), strict=True):
                if k != own:
                    yield from out()
                    own, held = k, {}
                held[n] = t
        yield from out()

    return rows.select(*keys, "node", "text").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long")


def similar_within(full: DataFrame, width: int, similarity: float, chunk: int = COPY_CHUNK, chunk_shingles: int = COPY_SHINGLES) -> DataFrame:
    """``(node, root)``: components of similar texts within each cluster of ``full`` (cluster, node, size, text).

    A cluster of one chunk is compared whole. A larger one is first cut into chunks that share
    one text, so that each text is sent once and what is dense falls together; then only texts
    outside the cluster's largest component so far are compared with all, in tiles of bounded size.
    """
    many = lambda: F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("size") / chunk_shingles)).cast("long")
    large = materialise(full.groupBy("cluster").agg(many().alias("t")).where("t > 1"), "large-clusters")
    dealt = full.join(large, "cluster", "left").withColumn("c", F.coalesce(F.pmod(F.xxhash64("node"), F.col("t")), F.lit(0)))
    shares = F.when((F.col("node") == F.col("cluster")) & F.col("t").isNotNull(), F.sequence(F.lit(0).cast("long"), F.col("t") - 1)).otherwise(F.array("c"))
    links = similar_in_groups(dealt.select("cluster", F.explode(shares).alias("part"), "node", "text"), ["cluster", "part"], width, similarity)
    first = connected_components(links)
    if large.isEmpty():
        return first
    rest = dealt.where("t is not null").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rest.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("cluster", F.col("main.root").alias("main"))
    rest = rest.join(main, "cluster")
    far = rest.where("root <> main")
    loads = materialise(far.groupBy("cluster").agg(many().alias("far")), "far")
    if loads.isEmpty():
        return first
    rest = rest.join(loads, "cluster")
    oc = F.pmod(F.xxhash64("node", F.lit(1)), F.col("far"))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    tiles = rest.select("cluster", up_to("far").alias("oc"), "c", "node", "text").unionAll(rest.where("root <> main").select("cluster", oc.alias("oc"), up_to("t").alias("c"), "node", "text"))
    second = similar_in_groups(tiles, ["cluster", "oc", "c"], width, similarity)
    return connected_components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(second))


def copy_labels(docs: DataFrame, width: int = 5, similarity: float = 0.8, tile: int = TILE, chunk: int = COPY_CHUNK) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, h, node)`` per row of ``docs``, and ``(node, component_id, best)``: best is the row (no id, doc_id, h) that stands for the node's component."""
    sig = materialise(signatures(docs, width, similarity), "signatures")
    # rows of a node have equal sets, and so equal fingerprints and prefixes
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    nodes = sig.groupBy("node").agg(F.min(own).alias("best"), *(F.first(c).alias(c) for c in ("size", "f0", "f1", "rare", "often")))
    nodes = materialise(nodes, "nodes")
    clusters = connected_components(candidate_links(nodes, tile))
    members = clusters.select("node", F.col("root").alias("cluster")).join(nodes.select("node", "size", "best"), "node")
    members = members.select("cluster", "node", "size", F.col("best.doc_id").alias("_id"), F.col("best.h").alias("_h"))
    text = pick(docs, "doc_id", "text").select("doc_id", text_hash("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    full = text.join(members, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("cluster", "node", "size", "text")
    full = materialise(full, "cluster-texts")  # repeated rows repeat a node, which a group then holds once
    comps = similar_within(full, width, similarity, chunk)
    joined = nodes.select("node", "best").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = materialise(joined, "rooted")
    best = joined.groupBy("root").agg(F.min("best").alias("least"), F.count("*").alias("n")).where("n > 1")
    labels = joined.join(best.select("root", "least"), "root", "left").select("node", F.coalesce("least", "best").alias("best"))
    return sig.select("doc_id", "h", "node"), materialise(labels.select("node", F.col("best.doc_id").alias("component_id"), "best"), "labels")


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, tile: int = TILE, chunk: int = COPY_CHUNK) -> DataFrame:
    """``doc_id, component_id``: a row per row of ``docs``; components of texts whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    Texts with equal sets are one node. Two sets at that similarity share a shingle of their
    prefixes; nodes that do and whose SimHash differs in COPY_DISTANCE bits or fewer are linked
    to clusters, and within a cluster texts are compared exactly. A pair at just 0.8 is missed
    only by the SimHash cut, with the probabilities at COPY_DISTANCE.

    Null and empty texts are one node. Rows count by their text: those that repeat a doc_id
    with several texts have a component each. A null doc_id gives a row too; it is a
    component_id only where no row of the component has an id. Other columns play no part.
    An empty table gives an empty result.
    """
    rows, labels = copy_labels(docs, width, similarity, tile, chunk)
    return rows.join(labels, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_copies`: that with the smallest doc_id.

    Rows without a doc_id give way to those with one. Of rows that repeat the kept row's
    doc_id and text one stays. All columns stay, whatever their names.
    """
    _, labels = copy_labels(docs, width, similarity)
    best = labels.select(F.col("best.doc_id").alias("_id"), F.col("best.h").alias("_h")).distinct()
    plain, at, names = by_position(docs)
    doc_id, h = at["doc_id"], text_hash(at["text"])
    kept = plain.withColumn("_own", h).join(best, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_h")), "left_semi")
    others = [c.name for c in plain.schema if c.name not in (doc_id, at["text"]) and not re.search("map<|variant", c.dataType.simpleString())]  # what can be hashed
    same = Window.partitionBy(doc_id, "_own").orderBy(F.xxhash64(F.lit(0), *others))
    return kept.withColumn("_row", F.row_number().over(same)).where("_row = 1").drop("_row", "_own").toDF(*names)
