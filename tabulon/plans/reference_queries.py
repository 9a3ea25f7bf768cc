"""Queries of references that depend on data, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import references as ref

from .queries import _read, query

_ASKING = """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r, o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
 a AS (SELECT o_orderkey, o_custkey % 90 - 3 + o_orderkey % 1000 AS r0, o_orderkey % 2 AS c0, 1 + o_custkey % 300 AS h, 1 + o_custkey % 2 AS w FROM orders)"""


def _grid(spark, d):
    orders = _read(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return ref.Grid(orders, ["o_orderkey"], ["o_custkey", "cents"], scale=0)


def _asking(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return _read(spark, d, "orders").select(k, ref.offset(c % 90 - 3 + k % 1000, k % 2, 1 + c % 300, 1 + c % 2).alias("area"))


@query(_ASKING + """
 SELECT a.o_orderkey, CASE WHEN r0 >= 0 THEN CAST(coalesce(sum(CASE WHEN c0 = 0 THEN o.o_custkey ELSE 0 END + CASE WHEN c0 + w > 1 THEN cents ELSE 0 END), 0) AS DOUBLE) END AS total,
        CASE WHEN r0 >= 0 THEN CAST(count(o.r) * CASE WHEN c0 = 0 AND w = 2 THEN 2 ELSE 1 END AS BIGINT) END AS n, CASE WHEN r0 < 0 THEN '#REF!' WHEN count(o.r) = 0 THEN '#DIV/0!' END AS err
 FROM a LEFT JOIN o ON o.r BETWEEN r0 AND r0 + h - 1 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY a.o_orderkey, r0, c0, w"))
def offset_totals(spark, d):
    out = ref.totals_over(_asking(spark, d), "area", _grid(spark, d))
    return out.select("o_orderkey", F.col("sum").alias("total"), F.col("count").alias("n"), "err")


@query(_ASKING + """
 SELECT a.o_orderkey, CASE WHEN r0 >= 0 THEN CAST(coalesce(min(CASE WHEN c0 = 0 AND w = 2 THEN least(o.o_custkey, cents) WHEN c0 = 0 THEN o.o_custkey ELSE cents END), 0) AS DOUBLE) END AS low,
        CASE WHEN r0 >= 0 THEN CAST(coalesce(max(CASE WHEN c0 = 0 AND w = 2 THEN greatest(o.o_custkey, cents) WHEN c0 = 0 THEN o.o_custkey ELSE cents END), 0) AS DOUBLE) END AS high
 FROM a LEFT JOIN o ON o.r BETWEEN r0 AND r0 + h - 1 GROUP BY a.o_orderkey, r0""")
def offset_extremes(spark, d):
    out = ref.extremes_over(_asking(spark, d), "area", _grid(spark, d))
    return out.select("o_orderkey", F.col("least").alias("low"), F.col("greatest").alias("high"))


@query(_ASKING + """, i AS (SELECT l_orderkey, l_linenumber, l_partkey * 7 % 20000 AS r, l_suppkey % 4 AS k FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN k = 3 THEN NULL ELSE CAST(coalesce(CASE k WHEN 0 THEN o_custkey WHEN 1 THEN cents END, 0) AS DOUBLE) END AS value, CASE WHEN k = 3 THEN '#REF!' END AS err
 FROM i LEFT JOIN o ON o.r = i.r""")
def indirect_cells(spark, d):
    row = (F.col("l_partkey") * 7 % 20_000 + 1).cast("string")
    letter = F.element_at(F.array(F.lit("a"), F.lit("$B$"), F.lit("C"), F.lit("3")), (F.col("l_suppkey") % 4 + 1).cast("int"))
    asking = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ref.indirect(F.concat(letter, row)).alias("area"))
    return ref.cell_at(asking, "area", _grid(spark, d)).drop("area")


@query("""WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, o_orderstatus AS s FROM orders),
               g AS (SELECT m, count(*) FILTER (s = 'F') AS f, count(*) FILTER (s = 'O') AS o, count(*) FILTER (s = 'P') AS p, row_number() OVER (ORDER BY m) + 1 AS i FROM m GROUP BY m),
               a AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN 'x' ELSE o_orderstatus END AS s, 1 + o_custkey % 90 AS i FROM orders)
          SELECT o_orderkey, CASE WHEN a.i >= 2 THEN CAST(CASE a.s WHEN 'F' THEN f WHEN 'O' THEN o WHEN 'P' THEN p END AS DOUBLE) END AS value,
                 CASE WHEN a.i < 2 THEN '#VALUE!' WHEN a.i > (SELECT max(i) FROM g) THEN '#REF!' WHEN a.s = 'x' THEN '#N/A' END AS err FROM a LEFT JOIN g ON g.i = a.i""")
def hlookup_status(spark, d):
    o = _read(spark, d, "orders")
    months = o.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    asking = o.select("o_orderkey", F.when(F.col("o_custkey") % 9 == 0, "x").otherwise(F.lower("o_orderstatus")).alias("s"), (1 + F.col("o_custkey") % 90).alias("i"))
    return ref.hlookup(asking, F.col("s"), ref.Grid(months, ["m"], ["F", "O", "P"]), F.col("i")).drop("s", "i")
