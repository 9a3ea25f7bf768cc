from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from tabulon.llm import phrases, queries

PIECE, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, widest=4, covered=80, top=2000):
    """The contract by its own words; rows of (text, lang)."""
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in PIECE.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            total[lang or "und"] += len(w)
            for k in range(1, widest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        own = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in own.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rated = []
        for p, a in own.items():
            if inside[p] and 100 * inside[p] >= covered * a:
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def frame_of(spark, rows):
    clash = [(t, lang, 1, "x", "y") for t, lang in rows]
    return spark.createDataFrame(clash, "text string, lang string, doc_id int, phrase string, other string").withColumnRenamed("other", "TEXT")


def sample(n, seed=1):
    rng, words = random.Random(seed), ["of", "the", "new", "york", "city", "Hall", "a", "big", "é", "B\x1cb", "O'x"]
    stock = ["new york city hall", "the big a", "of the"]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(stock) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))))
            parts.append(rng.choice([" ", ". ", ",", "\n", "\t", "  ", "!\r\n"]))
        texts.append((None if rng.random() < 0.02 else "".join(parts), rng.choice(["en", "de", None, "en"])))
    return texts


@pytest.mark.parametrize("heads", [(phrases.HEAD_WORDS, phrases.HEAD_PAIRS), (3, 4), (0, 0)])
def test_collocations_equal_brute_force(spark, heads):
    rows = sample(400)
    got = rows_of(phrases.collocations(frame_of(spark, rows).repartition(5), least=5, heads=heads))
    want = brute(rows, least=5)
    assert len(want) > 60 and got == want


@pytest.mark.parametrize("bits", [59, 1])
def test_words_that_are_not_broadcast_move_no_sequence(spark, monkeypatch, bits):
    """Unless two of them share a hash, as with one bit they do: then all of them are joined."""
    moved, placed = [], phrases._placed
    monkeypatch.setattr(phrases, "HASH_BITS", bits)
    monkeypatch.setattr(phrases, "_placed", lambda found, rare, on: moved.append((on[-1], rare is not None)) or placed(found, rare, on))
    rows = sample(300, 3)
    got = rows_of(phrases.collocations(frame_of(spark, rows).repartition(3), least=5, heads=(3, 1 << 19)))
    assert got == brute(rows, least=5)
    assert ("word", bits == 1) in moved and len(moved) == 3


@pytest.mark.parametrize("bits,heads", [(59, (3, 4)), (1, (3, 4)), (59, (1 << 17, 1 << 19))])
def test_rows_of_sequences_are_short(spark, monkeypatch, bits, heads):
    """A slice's sequence is cut into rows at the ends of pieces, never inside one, wherever the ids come from."""
    lengths, placed = [], phrases._placed

    def watched(found, rare, on):
        out = placed(found, rare, on)
        lengths.append([len(r.ids) for r in out.collect()])
        return out

    for name, value in (("HASH_BITS", bits), ("ROW_PLACES", 50), ("BATCH_ROWS", 7)):
        monkeypatch.setattr(phrases, name, value, raising=False)
    monkeypatch.setattr(phrases, "_placed", watched)
    rows = [*sample(300, 4), ("new york city of the big a " * 40, "en")]
    got = rows_of(phrases.collocations(frame_of(spark, rows).repartition(3), least=5, heads=heads))
    assert got == brute(rows, least=5)
    assert all(len(n) > 15 and sorted(n)[-2] <= 100 for n in lengths) and max(lengths[0]) > 200


def test_cuts_keep_every_place():
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randint(0, 60_000)
        ids = phrases.np.array([rng.randint(1, 9) if rng.random() > rng.choice([0.0001, 0.3]) else 0 for _ in range(n)], dtype="int64")
        at = phrases.np.array([i for i in phrases.np.flatnonzero(ids == 0).tolist() if rng.random() < 0.5], dtype="int64")
        ends = phrases._ends(ids, at, 1 << 14)
        assert ends[-1] == n and ends == sorted(set(ends)) and all(ids[e - 1] == 0 and e - 1 not in set(at.tolist()) for e in ends[:-1])
        got = phrases._sequence(ids, at, {"left": phrases.pa.array(at), "right": phrases.pa.array(at)}, 1 << 14).to_pylist()
        assert [x for r in got for x in r["ids"]] == ids.tolist()
        assert [s + x["at"] for s, r in zip([0, *ends], got) for x in r["rest"]] == at.tolist() == [x["left"] for r in got for x in r["rest"]]  # noqa: B905


def test_top_and_other_widths(spark):
    rows = sample(300, 2)
    frame = frame_of(spark, rows)
    assert rows_of(phrases.collocations(frame, least=4, top=7)) == brute(rows, 4, top=7)
    assert rows_of(phrases.collocations(frame, least=4, widest=2)) == brute(rows, 4, widest=2)
    assert rows_of(phrases.collocations(frame, least=4, widest=5, covered=50)) == brute(rows, 4, widest=5, covered=50)



def test_long_text_repeats_and_no_rows(spark):
    rows = [("all the same words " * 40_000, "en"), ("", "en"), (None, None), ("x " * 31, None)] * 2
    assert rows_of(phrases.collocations(frame_of(spark, rows))) == brute(rows)
    assert phrases.collocations(frame_of(spark, [])).count() == 0
    assert phrases.collocations(frame_of(spark, [("one two", "en")])).count() == 0


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op12_collocations"])
    columns = [c[0] for c in want.description]
    got = queries.queries()["op12_collocations"](spark, path)
    rows = spark.read.parquet(f"{path}/documents.parquet").select("text", "lang").collect()
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got) == brute([tuple(r) for r in rows]) == sorted(tuple(r[columns.index(c)] for c in got.columns) for r in want.fetchall())
