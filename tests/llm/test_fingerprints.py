from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tabulon.llm import fingerprints as fp


def jaccard(a: str, b: str, width: int = 5) -> float:
    def sets(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_word_hashes_do_not_depend_on_place_or_block(monkeypatch):
    text = b"one two  three\tone\n" + b"x" * 50 + b" two"
    words = text.split()
    whole, starts = fp.word_hashes(text)
    assert [text[s:].split()[0] for s in starts] == words
    for a in range(len(words)):
        assert [whole[a] == whole[b] for b in range(len(words))] == [words[a] == words[b] for b in range(len(words))]
    monkeypatch.setattr(fp, "BLOCK", 7)
    again, places = fp.word_hashes(text)
    assert again.tolist() == whole.tolist() and places.tolist() == starts.tolist()


def test_empty_bins_take_the_first_filled_bin_of_their_own_order():
    h = fp.mix(np.arange(9, dtype=np.uint64))
    bins = 64
    own = {int(x) >> 58: int(x) for x in sorted(h.tolist(), reverse=True)}
    turn = fp._places(bins)
    want = [own[i] if i in own else own[min(own, key=lambda j: turn[i, j])] for i in range(bins)]
    assert fp.minima(h, bins).tolist() == want
    assert sorted(turn[5].tolist()) == list(range(bins))


@pytest.mark.parametrize("bits", [4, 8])
def test_likeness_is_near_the_jaccard_similarity(bits):
    rng = random.Random(3)
    for share in (0.0, 0.3, 0.5, 0.8, 1.0):
        off = []
        for _ in range(12):
            words = [str(rng.random()) for _ in range(700)]
            n = int(700 * share)
            other = words[:n] + [str(rng.random()) for _ in range(700 - n)]
            a, b = " ".join(words), " ".join(other)
            x, y = fp.fingerprints_of([a, b], bits=bits)
            off.append(fp.alike(x, y, bits) - jaccard(a, b))
        assert abs(np.mean(off)) < 0.02 and max(map(abs, off)) < 0.09


def test_short_texts_are_unbiased_after_densification():
    rng, off = random.Random(5), []
    for _ in range(300):
        words = [str(rng.random()) for _ in range(16)]
        other = words[:10] + [str(rng.random()) for _ in range(6)]
        a, b = " ".join(words), " ".join(other)
        off.append(fp.alike(*fp.fingerprints_of([a, b])) - jaccard(a, b))
    assert abs(np.mean(off)) < 0.03


def brute(rows):
    """Rows in ascending order of distinct ids -> the query's columns by id, texts compared by their own fingerprints."""
    texts = [t or "" for _, t in rows]
    out = {}
    for i, (key, _) in enumerate(rows):
        t, n = texts[i], texts[(i + 1) % len(rows)]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        x, y, z = (fp.fingerprints_of([s])[0] for s in (t, e, n))
        out[key] = (len(t), hashlib.sha256(e.encode()).hexdigest(), x.hex(), y.hex(), fp.alike(x, y), fp.alike(x, z))
    return out


def test_study_equals_brute_force(spark, sf):
    docs = sf("documents").select("doc_id", "text", "lang")
    want = brute([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    got = {r[0]: tuple(r)[1:] for r in fp.edit_study(docs.repartition(7)).collect()}
    assert got == want
    seen = [(jaccard(r.text, r.text[: len(r.text) - len(r.text) // 2]), want[r.doc_id][4]) for r in docs.collect() if r.text]
    assert all(0 <= x <= 1 for _, x in seen)


def test_study_of_odd_rows(spark, docs_of):
    long = "word " * 60_000
    rows = [(3, "É" * 5), (1, "alpha beta"), (None, None), (2, ""), (5, long), (4, "a b c d e f g h")]
    got = {r.doc_id: r for r in fp.edit_study(docs_of(rows)).collect()}
    order = [(None, None), (1, "alpha beta"), (2, ""), (3, "É" * 5), (4, "a b c d e f g h"), (5, long)]
    want = brute(order)
    assert {k: tuple(v)[1:] for k, v in got.items()} == want
    assert got[None].fingerprint == "" and got[2].near_next == 0.0 and got[5].near_next == 0.0
    assert fp.edit_study(docs_of([])).count() == 0
    one = fp.edit_study(docs_of([(9, "just one text of six words")])).collect()
    assert one[0].near_next == 1.0


def test_repeated_ids_give_a_row_each_and_next_is_among_them(spark, docs_of):
    rows = [(7, f"text number {i % 3} of an id that repeats often") for i in range(40)]
    got = fp.edit_study(docs_of(rows).repartition(5)).collect()
    assert len(got) == 40 and {r.doc_id for r in got} == {7}
    assert len({r.fingerprint for r in got}) == 3
    assert sum(r.near_next == 1.0 for r in got) >= 37  # rows of one text stand together


def test_native_likeness_equals_the_packed_one(spark):
    rng = random.Random(1)
    words = [str(rng.random()) for _ in range(60)]
    items = [" ".join(words[i:]) for i in range(0, 50, 5)] + [""]
    for bits in (4, 8):
        prints = fp.fingerprints_of(items, bits=bits)
        pairs = [(a.hex(), b.hex(), fp.alike(a, b, bits)) for a in prints for b in prints]
        frame = spark.createDataFrame(pairs, "a string, b string, want double")
        rows = frame.select("want", fp.likeness(frame.a, frame.b, bits).alias("got")).collect()
        assert all(abs(r.want - r.got) < 1e-12 for r in rows)


def test_fingerprints_of_a_table(spark, docs_of):
    rows = [(1, "a b c"), (1, "a b c"), (None, "A B C"), (2, None)]
    got = fp.fingerprints(docs_of(rows)).collect()
    by = sorted(((r.doc_id or 0, r.fingerprint) for r in got))
    assert [x for x, _ in by] == [0, 1, 1, 2] and by[0][1] == by[1][1] == by[2][1] != ""
    assert by[3][1] == ""
