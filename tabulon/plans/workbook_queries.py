"""Queries of workbook summaries, variants and the tables beside the event log, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import augment, summary
from tabulon.operators.recalc import recalculate
from tabulon.operators.table import Table
from tabulon.streaming import store

from .queries import _ms, _read, query


def _books(c):
    """A workbook per customer: a number, and formulas that read it and one another."""
    last = F.when(F.col("c_nationkey") % 2 == 1, F.lit("=A4")).otherwise(F.lit("=A1"))
    inputs = F.array(F.col("c_acctbal").cast("string"), F.lit("=A1+1"), F.lit("=A2*2"), F.lit("=SUM(A2:A3)"), last, F.lit("=1/MAX(0,A1)"))
    return c.select(F.col("c_custkey").alias("workbook_id"), F.lit("S").alias("sheet"), F.posexplode(inputs).alias("r", "input")).withColumn("c", F.lit(0))


@query("""SELECT c_custkey AS workbook_id, 1 AS total, 'S!5:0 #DIV/0! =1/MAX(0,A1)' AS listed FROM customer WHERE c_acctbal <= 0""")
def book_errors(spark, d):
    out = summary.errors_by_book(recalculate(_books(_read(spark, d, "customer"))))
    text = F.transform("errors", lambda e: F.concat(e["sheet"], F.lit("!"), e["r"].cast("string"), F.lit(":"), e["c"].cast("string"), F.lit(" "), e["code"], F.lit(" "), e["formula"]))
    return out.select("workbook_id", "total", F.array_join(text, ", ").alias("listed"))


@query("""SELECT c_custkey AS workbook_id, 5 AS formula_cells, CASE WHEN c_nationkey % 2 = 1 THEN 2 ELSE 3 END AS leaf_formulas, CASE WHEN c_nationkey % 2 = 1 THEN 4 ELSE 3 END AS max_depth,
                 CASE WHEN c_nationkey % 2 = 1 THEN 'S!A2 2, S!A3 1, S!A4 1' ELSE 'S!A2 2, S!A3 1' END AS listed FROM customer""")
def book_dependencies(spark, d):
    out = summary.dependency_summary(_books(_read(spark, d, "customer")))
    return out.select("workbook_id", "formula_cells", "leaf_formulas", "max_depth", F.array_join(F.transform("most_depended_on", lambda x: F.concat(x["at"], F.lit(" "), x["n"].cast("string"))), ", ").alias("listed"))


@query("""SELECT DISTINCT p_type AS value FROM part""")
def filter_menu(spark, d):
    p = _read(spark, d, "part")
    cells = p.select(F.lit("S").alias("sheet"), F.col("p_partkey").cast("int").alias("r"), F.lit(2).alias("c"), F.col("p_type").alias("display"))
    last = p.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    return summary.column_values(cells, "S", (last[0] - 1, 0, last[1], 2), 2)


@query("""SELECT p_partkey AS r, 1 AS c, p_name AS display FROM part WHERE p_partkey BETWEEN 10 AND 59 UNION ALL SELECT p_partkey, 2, p_brand FROM part WHERE p_partkey BETWEEN 10 AND 59""")
def part_viewport(spark, d):
    columns = F.posexplode(F.array(F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type")).alias("c", "display")
    cells = _read(spark, d, "part").select(F.lit("S").alias("sheet"), F.col("p_partkey").alias("r"), columns)
    return summary.viewport(cells, "S", 10, 1, 50, 2).select("r", "c", "display")


@query("""SELECT l_returnflag, CAST(avg(l_extendedprice) - avg(l_quantity) AS DOUBLE) > 0 AS above, round(sum(l_extendedprice) - sum(l_quantity), 2) AS variance FROM lineitem GROUP BY 1""")
def reconciled_totals(spark, d):
    t = Table(_read(spark, d, "lineitem"))
    mean = t.reconcile("l_extendedprice", "l_quantity", "AVERAGE", by=["l_returnflag"]).select("l_returnflag", (F.col("variance") > 0).alias("above"))
    return mean.join(t.reconcile("l_extendedprice", "l_quantity", by=["l_returnflag"]).select("l_returnflag", F.round("variance", 2).alias("variance")), "l_returnflag")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders), l AS (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_orderpriority, o_orderkey) AS p FROM o GROUP BY 1)
          SELECT o_custkey AS workbook_id, o_orderkey AS r, o_orderpriority AS input FROM o UNION ALL SELECT o_custkey, k + i, p FROM l, (SELECT unnest([1, 2]) AS i)""")
def appended_rows(spark, d):
    both = F.posexplode(F.array("o_orderpriority", F.lit("=A1"))).alias("c", "input")
    cells = _read(spark, d, "orders").select(F.col("o_custkey").alias("workbook_id"), F.lit("S").alias("sheet"), F.col("o_orderkey").cast("int").alias("r"), both)
    return augment.append_rows(cells, "S", 2).where("c = 0").select("workbook_id", F.col("r").cast("long").alias("r"), "input")


@query("""SELECT p_partkey AS r, CAST(p_size * 3 AS VARCHAR) AS size, p_brand AS brand, '=B1' AS formula FROM part""")
def scaled_literals(spark, d):
    columns = F.posexplode(F.array(F.col("p_size").cast("string"), "p_brand", F.lit("=B1"))).alias("c", "input")
    p = _read(spark, d, "part")
    cells = p.select(F.lit("S").alias("sheet"), F.col("p_partkey").alias("r"), columns)
    out = augment.scale_literals(cells, "S", (0, 0, 2**31 - 1, 2), 3)
    at = lambda i: F.max(F.when(F.col("c") == i, F.col("input")))
    return out.groupBy("r").agg(at(0).alias("size"), at(1).alias("brand"), at(2).alias("formula"))


@query("""SELECT event_id FROM events WHERE epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-10 10:30:00')""")
def events_since(spark, d):
    return _read(spark, d, "events").where(store.since("2024-01-10T12:30:00+02:00", _ms())).select("event_id")


@query("""WITH c AS (SELECT c_custkey AS actor_id, c_custkey * 10 + i AS id, CASE (c_custkey + i) % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'structural' ELSE 'full' END AS mode, 't' || i AS "at" FROM customer, (SELECT unnest(range(3)) AS i))
          SELECT id, actor_id, mode, "at", (SELECT min(o."at") FROM c o WHERE o.actor_id = c.actor_id AND o.mode = 'off' AND o.id >= c.id) AS revoked_at FROM c""")
def consent_history(spark, d):
    c = _read(spark, d, "customer").select(F.col("c_custkey").alias("actor_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    mode = F.element_at(F.array(F.lit("off"), F.lit("structural"), F.lit("full")), ((F.col("actor_id") + F.col("i")) % 3 + 1).cast("int"))
    c = c.select((F.col("actor_id") * 10 + F.col("i")).alias("id"), "actor_id", mode.alias("mode"), F.concat(F.lit("t"), F.col("i").cast("string")).alias("at"))
    first = c.where("at = 't0'")
    return store.record_consents(store.record_consents(first.withColumn("revoked_at", F.lit(None).cast("string")).limit(0), first), c.where("at <> 't0'"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS actor_id, s_suppkey % 2 AS workbook_id, s_acctbal AS old, CASE s_suppkey % 3 WHEN 0 THEN 'accepted' ELSE 'proposed' END AS status FROM supplier),
          m AS (SELECT s_suppkey AS id, s_nationkey AS actor_id, s_suppkey % 2 AS workbook_id, s_acctbal + 1 AS new FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 2 = 0)
          SELECT s.id, s.actor_id, s.workbook_id, coalesce(new, old) AS minutes, status FROM s LEFT JOIN m ON m.id = s.id WHERE new IS NOT NULL OR s.workbook_id <> 0 OR status <> 'proposed'
          UNION ALL SELECT id + 1000000, actor_id, workbook_id, new, 'proposed' FROM m""")
def upserted_routines(spark, d):
    s = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("actor_id"), (F.col("s_suppkey") % 2).alias("workbook_id"), F.lit("x").alias("summary"), F.lit("{}").alias("body"), F.col("s_acctbal").alias("minutes"), F.lit(3).alias("support"))
    old = s.withColumn("status", F.when(F.col("id") % 3 == 0, "accepted").otherwise("proposed"))
    found = s.where("id % 5 = 0 and id % 2 = 0").withColumn("minutes", F.col("minutes") + 1)
    mined = found.unionAll(found.withColumn("id", F.col("id") + 1_000_000))
    out = store.upsert_routines(old, mined, s.where("workbook_id = 0").select("actor_id", "workbook_id"))
    return out.select("id", "actor_id", "workbook_id", "minutes", "status")


@query("""SELECT o_orderkey AS id, CAST(o_custkey * 3 AS VARCHAR) AS got, CASE WHEN o_orderkey % 7 = 0 THEN 'unsettled' WHEN o_orderkey % 2 = 0 THEN 'match' WHEN o_orderkey % 3 = 0 THEN 'accepted' ELSE 'differs' END AS verdict FROM orders""")
def judged_cases(spark, d):
    from tabulon.operators import parity

    k = F.col("o_orderkey")
    cases = _read(spark, d, "orders").select(
        k.alias("id"), F.lit("=A1*3").alias("formula"), F.when(k % 2 == 0, F.col("o_custkey") * 3).otherwise(-1).cast("string").alias("expect"), F.when(k % 7 == 0, "open").otherwise("known").alias("source"), F.lit("B2").alias("at"),
        F.create_map(F.lit("A1"), F.col("o_custkey").cast("string")).alias("given"), ((k % 2 == 1) & (k % 3 == 0)).alias("known_difference"),
    )
    return parity.outcomes(cases).select("id", "got", "verdict")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS input, 'A' || (event_id % 3 + 1) AS addr FROM events),
          w AS (SELECT *, lag(input) OVER (PARTITION BY user_id, addr ORDER BY event_id) AS was FROM e)
          SELECT user_id AS session, event_id AS seq, addr, nullif(input, '') AS input, coalesce(nullif(was, ''), '') <> input AS changed FROM w""")
def edit_transitions(spark, d):
    from tabulon.streaming import export

    e = _read(spark, d, "events")
    wiped = F.col("event_type") == "error"
    log = e.select(
        F.col("user_id").cast("string").alias("session_id"), F.lit("w").alias("workbook_id"), F.col("event_id").alias("seq"), F.when(wiped, "cell.clear").otherwise("cell.edit").alias("action"),
        F.to_json(F.struct(F.concat(F.lit("a"), (F.col("event_id") % 3 + 1).cast("string")).alias("addr"), F.col("event_type").alias("input"))).alias("payload"), F.struct(F.lit("S").alias("sheet"), F.lit("full").alias("privacy_mode")).alias("context"),
    )
    out = export.transitions(log)
    return out.select(F.col("session_id").cast("long").alias("session"), "seq", "addr", "input", (F.col("pre_state_digest") != F.col("post_state_digest")).alias("changed"))
