from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pytest
from tabulon.llm import maxscore, queries, warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.fixture
def pages(spark):
    rows = [(5, "http://a/é x", "<p>one</p>" * 50), (3, None, "<p>one</p>" * 50), (9, "http://b", "<p>one</p>" * 50), (1, "http://c", None), (2, "http://c", ""), (4, "http://d", "ü" * 70_000), (None, "http://e", ""), (7, "http://f", "WARC/1.1\r\n\r\nnested"), (7, "http://f", "WARC/1.1\r\n\r\nnested")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")


def test_round_trip(spark, pages):
    got = sorted(map(tuple, warc.archive_round_trip(pages).collect()), key=str)
    one, none, odd = ("<p>one</p>" * 50).encode(), b"", "ü".encode() * 70_000
    nested = b"WARC/1.1\r\n\r\nnested"
    want = [
        (3, len(one), digest(one), "response", None), (5, len(one), digest(one), "revisit", 3), (9, len(one), digest(one), "revisit", 3), (1, 0, digest(none), "response", None),
        (2, 0, digest(none), "revisit", 1), (None, 0, digest(none), "revisit", 1), (4, len(odd), digest(odd), "response", None), (7, len(nested), digest(nested), "response", None), (7, len(nested), digest(nested), "response", None),
    ]
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_payloads_come_back_and_small_ones_are_responses(spark, pages, tmp_path):
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", least_bytes=100)
    back = warc.read_archives(manifest, payloads=True).collect()
    assert {bytes(r.payload) for r in back if r.page_id in (3, 4, 7)} == {("<p>one</p>" * 50).encode(), "ü".encode() * 70_000, b"WARC/1.1\r\n\r\nnested"}
    assert {r.page_id for r in back if r.record_type == "revisit"} == {5, 9}


def test_dictionary_frame_and_damage(tmp_path):
    samples = [f"<html><body>page {i} {'common words here ' * 20}</body></html>".encode() for i in range(200)]
    import zstandard

    dictionary = zstandard.train_dictionary(4096, samples).as_bytes()
    out = warc.ArchiveWriter(f"{tmp_path}/x.warc.zst", dictionary)
    for i, s in enumerate(samples):
        out.add(warc.record(i, "http://x", s, digest(s)))
    path, n, _ = out.close()
    assert n == 200 and [warc.parse_record(r)["payload"] for r in warc.read_archive(path, chunk=777)] == samples
    with open(path, "rb") as f:
        data = f.read()
    with open(path, "wb") as f:
        f.write(data[:-20])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(path))
    good = warc.record(1, None, b"abc", digest(b"abc"))
    for bad in (good.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def brute_top(rows, every, k):
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in ok if i % every == 0}.items():
        score = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]  # noqa: B905
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(score)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(400)]
    rows += [(1000 + i, list(rows[3][1])) for i in range(15)]  # ties
    rows += [(2000, None), (2100, [1.0, None] + [0.0] * 6), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (None, [1.0] * 8), (2400, [0.5, -0.5]), (2500, [])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string")
    for shard in (37, 4096):
        monkeypatch.setattr(maxscore, "SHARD", shard)
        monkeypatch.setattr(maxscore, "QUERY_BLOCK", 3)
        got = sorted(map(tuple, maxscore.top_k(frame, every=100, k=10).collect()))
        assert got == brute_top(rows, 100, 10)
    assert maxscore.top_k(frame.limit(0)).collect() == []
    assert sorted(map(tuple, maxscore.top_k(frame.where("vec_id < 4")).collect())) == brute_top(rows[:4], 100, 10)


def test_vectors_stay_where_they_lie(spark, monkeypatch):
    """Queries go to the vectors in rounds; no vector is copied for a block of queries, which grew with the square of the table."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 6)) * [1, 1, 0.01, 0.01, 0.01, 0.01]
    rows = [(int(i) % 290, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame([r for r in rows if r[0] % 10 or r[0] > 9], "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(maxscore, "ROUND", 40, raising=False)
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 4)
    monkeypatch.setattr(maxscore, "SHARD", 16)
    top = maxscore.top_k(frame, every=10, k=3)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("MapInArrow") > 2
    assert sorted(map(tuple, top.collect())) == brute_top([r for r in rows if r[0] % 10 or r[0] > 9], 10, 3)


@pytest.mark.parametrize("scale", [30, 5000, 10**8, 2**29])
def test_blocks_of_queries_equal_brute_force(scale):
    """Whatever type holds the sums, and whether terms are pruned or not."""
    rng = np.random.default_rng(scale)
    for case in range(12):
        n, wide = int(rng.integers(2, 150)), int(rng.integers(1, 9))
        m = rng.integers(-scale, scale, size=(n, wide))
        m[:, 1:] //= 1 + 60 * (case % 2)
        ids = rng.integers(0, n, size=n) if case % 3 == 0 else rng.permutation(n)
        own = np.unique(ids[:5])
        q = m[[np.flatnonzero(ids == i)[0] for i in own]]
        block = maxscore.Block(own, q, 4)
        for i in range(0, n, 20):
            block.add(maxscore.Shard(ids[i : i + 20], m[i : i + 20]))
        for at, i in enumerate(own):
            want = sorted((-sum(int(a) * int(b) for a, b in zip(q[at], v, strict=True)), int(j)) for j, v in zip(ids, m, strict=True) if i != j)[:4]
            assert [(-int(s), int(j)) for s, j in zip(block.score[block.at == at], block.found[block.at == at], strict=True)] == want


def test_sql_oracles_agree(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        frame = queries.queries()[name](spark, sf)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(frame.columns)
        assert sorted(map(tuple, frame.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
