from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tabulon.operators import references as ref


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(i, None if rng.random() < 0.1 else rng.randint(-50, 50), None if rng.random() < 0.3 else float(rng.randint(0, 9)), "text") for i in range(200)]
    frame = spark.createDataFrame(rows, "k long, a int, `b c` double, t string").repartition(5)
    return rows, ref.Grid(frame, ["k"], ["a", "b c"])


def members(rows, r, c, h, w):
    return [x for row in rows[max(r, 0) : r + h] for x in row[1:3][c : c + w] if x is not None]


def test_totals_and_extremes_equal_brute_force(spark, table):
    rows, grid = table
    rng = random.Random(3)
    asked = [(i, rng.randint(-2, 220), rng.randint(0, 3), rng.randint(0, 230), rng.randint(1, 3)) for i in range(300)] + [(300, None, 0, 1, 1), (301, 0, 0, 10**9, 1), (302, 0, 0, 200, 2)]
    frame = spark.createDataFrame(asked, "id int, r int, c int, h int, w int").withColumn("area", ref.offset(*map(F.col, "rchw")))
    totals = {x.id: x for x in ref.totals_over(frame, "area", grid).collect()}
    extremes = {x.id: x for x in ref.extremes_over(frame, "area", grid).collect()}
    for i, r, c, h, w in asked:
        t, e = totals[i], extremes[i]
        if r is None or r < 0 or h < 1 or r + h > 1_048_576:
            assert (t["sum"], t["count"], t.err, e.least, e.err) == (None, None, "#REF!", None, "#REF!")
            continue
        own = members(rows, r, c, h, w)
        assert (t["sum"], t["count"], t.err) == (sum(own), len(own), None if own else "#DIV/0!")
        assert t.average == (pytest.approx(sum(own) / len(own)) if own else None)
        assert (e.least, e.greatest, e.err) == (min(own, default=0), max(own, default=0), None)


def test_indirect_reads_texts(spark, table):
    rows, grid = table
    texts = ["A1", " $b$3 ", "AA1", "A0", "A1048577", "B2:A1", "A1:", "1A", "", None, "XFD1", "XFE1", "b200", "A201"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, x string").withColumn("area", ref.indirect(F.col("x")))
    areas = {r.x: r.area for r in frame.collect()}
    assert tuple(areas["B2:A1"])[:4] == (0, 0, 1, 1) and tuple(areas[" $b$3 "])[:4] == (2, 1, 2, 1) and areas["XFD1"].c0 == 16383
    got = {r.x: (r.value, r.err) for r in ref.cell_at(frame, "area", grid).collect()}
    value = lambda r, c: float(rows[r][c] or 0)
    assert got["A1"] == (value(0, 1), None) and got[" $b$3 "] == (value(2, 2), None) and got["b200"] == (value(199, 2), None)
    assert got["AA1"] == got["A201"] == got["XFD1"] == (0.0, None) and got["B2:A1"] == (None, "#VALUE!")
    assert {got[x] for x in ("A0", "A1048577", "A1:", "1A", "", None, "XFE1")} == {(None, "#REF!")}


def test_hlookup(spark, table):
    rows, grid = table
    asked = [(0, "A", 2), (1, "B C", 201), (2, "b c", 202), (3, "q", 2), (4, "a", 1), (5, None, 2), (6, "a", None), (7, "b", 3)]
    frame = spark.createDataFrame(asked, "id int, x string, i int")
    got = {r.id: (r.value, r.err) for r in ref.hlookup(frame, F.col("x"), grid, F.col("i")).collect()}
    assert got[0] == (float(rows[0][1] or 0), None) and got[1] == (float(rows[199][2] or 0), None)
    assert [got[i][1] for i in (2, 3, 4, 5, 6, 7)] == ["#REF!", "#N/A", "#VALUE!", "#N/A", "#VALUE!", "#N/A"]
    near = {r.id: (r.value, r.err) for r in ref.hlookup(frame, F.col("x"), grid, F.col("i"), approximate=True).collect()}
    assert near[7] == (float(rows[1][1] or 0), None) and near[3] == (float(rows[0][2] or 0), None)


def test_an_empty_table_and_ties(spark):
    empty = ref.Grid(spark.createDataFrame([], "k long, a int"), ["k"], ["a"])
    frame = spark.createDataFrame([(0, 3)], "r int, h int").withColumn("area", ref.offset(F.col("r"), F.lit(0), F.col("h")))
    assert ref.totals_over(frame, "area", empty).first()["count"] == 0
    assert ref.extremes_over(frame, "area", empty).first().least == 0.0
    same = ref.numbered(spark.createDataFrame([(1, "x")] * 50, "k long, s string").repartition(4), ["k"])
    assert sorted(r.r for r in same.collect()) == list(range(50))


@pytest.mark.parametrize("size", [1, 31, 32, 33, 1023, 1024, 1025, 2100])
def test_extremes_at_the_ends_of_blocks(spark, size):
    rows = [(i, (i * 7919) % 2003 - 1000) for i in range(size)]
    grid = ref.Grid(spark.createDataFrame(rows, "k long, a int"), ["k"], ["a"])
    ends = sorted({x for x in (0, 1, 31, 32, 33, 63, 64, 1023, 1024, 1025, 2047, 2048, size - 1, size) if 0 <= x <= size})
    asked = [(n, a, b - a) for n, (a, b) in enumerate((a, b) for a in ends for b in ends if a < b)]
    frame = spark.createDataFrame(asked + asked[:3], "id int, r int, h int").withColumn("area", ref.offset(F.col("r"), F.lit(0), F.col("h"), F.lit(1)))
    got = ref.extremes_over(frame, "area", grid).collect()
    assert len(got) == len(asked) + len(asked[:3])
    for x in got:
        own = [v for _, v in rows[x.r : x.r + x.h]]
        assert (x.least, x.greatest) == (min(own), max(own))


def test_grids_of_many_rows_are_not_broadcast(spark, table, monkeypatch):
    monkeypatch.setattr(ref, "SMALL", 10)
    monkeypatch.setattr(ref, "TOP", 0)
    _, grid = table
    frame = spark.range(40).withColumn("area", ref.offset(F.col("id"), F.lit(0), F.lit(40), F.lit(2)))
    for got in (ref.totals_over(frame, "area", grid), ref.extremes_over(frame, "area", grid), ref.cell_at(frame, "area", grid), ref.hlookup(frame, F.lit("a"), grid, F.col("id"))):
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_that_ask_for_no_cell_are_spread(spark, table, monkeypatch):
    monkeypatch.setattr(ref, "SMALL", 10)
    _, grid = table
    frame = spark.range(4000, numPartitions=4).withColumn("area", ref.indirect(F.when(F.col("id") % 4 == 0, "A1").otherwise("none")))
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ref.cell_at(frame, "area", grid).groupBy(F.spark_partition_id()).agg(F.count_if(F.col("err") == "#REF!").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
    assert sum(r.n for r in got) == 3000 and max(r.n for r in got) < 1500
