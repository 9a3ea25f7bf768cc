from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from tabulon.llm import simhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = SPACE.findall(low)
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, near):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if near(i, j):
                root[find(i)] = find(j)
    out = {}
    for i in range(len(ids)):
        out.setdefault(find(i), []).append(ids[i])
    least = {r: min((x for x in v if x is not None), default=None) for r, v in out.items()}
    return [least[find(i)] for i in range(len(ids))]


def texts_with_copies():
    rng = random.Random(4)
    vocabulary = [f"w{i}é" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 40, 300])))) for i in range(60)]
    rows += [(100 + i, rows[i][1].upper()) for i in range(20)]
    for i in range(20):
        words = rows[3 * i][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, "\t".join(words)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (None, rows[5][1]), (7, rows[7][1])]
    return rows


def test_fingerprints_and_components_equal_brute_force(docs_of):
    rows = texts_with_copies()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = components([i for i, _ in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    for tile in (simhash.TILE, 4):
        got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(rows), tile=tile).collect())
        assert got == sorted((i or -1, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want, strict=True))


def test_chains_of_fingerprints_link_in_tiles(spark):
    rng = random.Random(9)
    fps = []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(40):
            fps.append(f)
            for _ in range(rng.choice([1, 3, 3, 4])):
                f ^= 1 << rng.randrange(64)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = components(list(range(len(fps))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    for tile in (8, 10_000):
        links = simhash.close_links(spark.createDataFrame([(s,) for s in signed], "fp long"), 3, 5, tile).collect()
        place = {s: i for i, s in enumerate(signed)}
        linked = {(place[r.a], place[r.b]) for r in links} | {(place[r.b], place[r.a]) for r in links}
        assert components(list(range(len(fps))), lambda i, j: (i, j) in linked) == want  # noqa: B023


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []
    assert simhash.near_copies(docs_of([])).collect() == []


def test_near_copies_equal_brute_force(docs_of):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(25):
        words = rng.choices(vocabulary, k=rng.choice([3, 60, 200]))
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 1, 6])):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2])):
                own[rng.randrange(len(own))] = "x" + str(rng.random())
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (None, rows[0][1])]
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for _, t in rows]
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = components([i for i, _ in rows], lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs_of(rows)).collect()}
    assert got == {i: c for (i, _), c in zip(rows, want, strict=True)}
    kept = [r[0] for r in simhash.keep_one(docs_of([*rows, rows[1]])).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(want))


def test_bit_counts_over_chunks():
    h = np.random.default_rng(1).integers(0, 1 << 63, size=(simhash.CHUNK + 5, 1), dtype=np.uint64)
    want = [int(((h[:, 0] >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    assert simhash.bit_counts(h).tolist() == want


def test_no_pair_at_the_similarity_is_lost(docs_of):
    rng = random.Random(6)
    rows = []
    for _ in range(400):
        words = [str(rng.random()) for _ in range(120)]
        own = list(words)
        for i in (10, 60):  # ten of 116 shingles change: similarity 0.83
            own[i] = str(rng.random())
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(own))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs_of(rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def near_copies_by_brute_force(rows, width=5, similarity=0.8):
    sets = [set(simhash.shingle_hashes(t or "", width).tolist()) for _, t in rows]
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    return components([i for i, _ in rows], lambda i, j: jaccard(sets[i], sets[j]) >= similarity - 1e-9)


def hot_rows():
    """A group of many near copies, a passage and a short line in most texts, chains, repeated and missing ids."""
    rng = random.Random(12)
    word = lambda: "w" + str(rng.randrange(100_000))
    passage, line = [word() for _ in range(60)], [word() for _ in range(12)]
    rows = []
    for _ in range(120):
        rows.append((len(rows), " ".join([word() for _ in range(rng.choice([5, 10, 15, 30, 80]))] + passage)))
    for _ in range(60):
        rows.append((len(rows), " ".join(line + [word() for _ in range(rng.choice([0, 1, 3]))])))
    main = [word() for _ in range(150)]
    for _ in range(150):
        own = list(main)
        for _ in range(rng.choice([1, 2, 4, 6])):
            own[rng.randrange(150)] = word()
        rows.append((len(rows), " ".join(own)))
    for _ in range(5):
        own = [word() for _ in range(100)]
        for _ in range(8):
            own[rng.randrange(100)] = word()
            own[rng.randrange(100)] = word()
            rows.append((len(rows), " ".join(own)))
    one, two = [word() for _ in range(90)], [word() for _ in range(90)]
    rows += [(1000, " ".join(one)), (1000, " ".join(two)), (1001, " ".join([*one[:-1], "x"])), (1002, " ".join([*two[:-1], "y"]))]
    lone = [word() for _ in range(70)]
    return rows + [(None, " ".join(lone)), (None, " ".join([*lone[:-1], "z"])), (None, " ".join(one)), rows[3], rows[3]]


def test_hot_shingles_repeated_ids_and_tiles(docs_of, monkeypatch):
    rows = hot_rows()
    want = sorted((i or -1, c or -1) for (i, _), c in zip(rows, near_copies_by_brute_force(rows), strict=True))
    # frequent from a tenth of the texts on; tiles and chunks of a few rows
    real = simhash.frequent_shingles
    few = lambda docs, width: np.sort(simhash._mix(np.unique(np.concatenate([simhash.shingle_hashes(rows[i][1], 5) for i in (0, 125, 200)]))))
    for tile, chunk, frequent in ((simhash.TILE, simhash.COPY_CHUNK, real), (16, 20, few)):
        monkeypatch.setattr(simhash, "frequent_shingles", frequent)
        got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_copies(docs_of(rows), tile=tile, chunk=chunk).collect())
        assert got == want


def test_keep_one_judges_rows_by_their_own_text(docs_of):
    rows = hot_rows()
    label = near_copies_by_brute_force(rows)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs_of(rows)).collect()]
    assert len(kept) == len(set(kept))
    texts = dict.fromkeys(t for _, t in rows)
    root = {}
    for (i, t), c in zip(rows, label, strict=True):
        root.setdefault(t, c if c is not None else "lone")
    assert texts.keys() == root.keys()
    ids = [i for i, _ in kept]
    assert ids.count(1000) == 2 and 1001 not in ids and 1002 not in ids and ids.count(None) == 1
    assert sorted({i for i in ids if i not in (None, 1000)}) == sorted({c for c in label if c not in (None, 1000)})


def test_frequent_shingles_are_found(docs_of):
    line = "one line that many of these texts hold"
    rows = [(i, f"{line} {i} " + " ".join(f"u{i}x{j}" for j in range(20))) for i in range(200)]
    own = {" ".join(line.split()[i : i + 5]).encode() for i in range(4)}
    want = sorted(int(simhash._mix(np.array([xxhash.xxh64_intdigest(s, 42)], dtype=np.uint64))[0]) for s in own)
    assert sorted(simhash.frequent_shingles(docs_of(rows), 5).tolist()) == want


def test_sorted_groups_in_any_batches():
    import pyarrow as pa

    keys = np.repeat(np.arange(9), [1, 2, 30, 1, 1, 12, 3, 40, 2])
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(len(keys)))], ["k", "i"])
    for step in (1, 3, 7, 100):
        whole, large = {}, {}
        for cols, start, n in simhash.sorted_groups((rows.slice(i, step) for i in range(0, len(keys), step)), 1, 11):
            if n:
                large[int(cols[0][0])] = n
            else:
                for part in np.split(cols[0], start[1:]):
                    assert int(part[0]) not in whole and (part == part[0]).all()
                    whole[int(part[0])] = len(part)
        assert large.keys() <= {2, 5, 7} and all(large[k] == (keys == k).sum() for k in large)
        assert whole | large == {k: int((keys == k).sum()) for k in range(9)}
        assert large.keys() == {1: {2, 5, 7}, 3: {2, 7}, 7: {2, 7}, 100: set()}[step]  # a group that ends in the batch it began in is whole
