"""Queries of the library's own operators over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import lookup, table
from tabulon.operators.table import Table
from tabulon.streaming import events as log

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    from . import function_queries, reference_queries, workbook_queries  # noqa: F401  (they register their own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- formulas: derived columns and aggregates


@query("""SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
          FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1""")
def derived_revenue(spark, d):
    t = Table(_read(spark, d, "lineitem")).where('{l_shipdate}<=DATE(1998,9,2)').derive(net="{l_extendedprice}*(1-{l_discount})")
    return t.summarise({"revenue": "ROUND(SUM({net}),2)"}, by=["l_returnflag"])


@query("""SELECT l_linestatus, round(sum(CASE WHEN l_shipdate <= TIMESTAMP '1998-09-02' AND l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned,
                 round(coalesce(sum(l_quantity) FILTER (l_discount > 0.05), 0), 2) AS discounted
          FROM lineitem GROUP BY 1""")
def sumifs_revenue(spark, d):
    return Table(_read(spark, d, "lineitem")).summarise(
        {"returned": 'ROUND(SUMIFS({l_extendedprice},{l_shipdate},"<=1998-09-02",{l_returnflag},"r"),2)', "discounted": 'ROUND(SUMIF({l_discount},">0.05",{l_quantity}),2)'}, by=["l_linestatus"]
    )


@query("""SELECT CAST(count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) AS DOUBLE) AS big_filled,
                 CAST(count(*) FILTER (o_orderpriority ILIKE '%high') AS DOUBLE) AS high, CAST(count(*) FILTER (o_orderstatus <> 'F') AS DOUBLE) AS unfilled FROM orders""")
def countifs_orders(spark, d):
    return Table(_read(spark, d, "orders")).summarise({"big_filled": 'COUNTIFS({o_orderstatus},"F",{o_totalprice},">100000")', "high": 'COUNTIF({o_orderpriority},"*HIGH")', "unfilled": 'COUNTIF({o_orderstatus},"<>f")'})


@query("""SELECT c_mktsegment, round(avg(c_acctbal) FILTER (c_acctbal > 0), 4) AS positive, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1""")
def averageif_acctbal(spark, d):
    return Table(_read(spark, d, "customer")).summarise({"positive": 'ROUND(AVERAGEIF({c_acctbal},">0"),4)', "mean": 'ROUND(AVERAGEIFS({c_acctbal},{c_acctbal},">-1E9"),4)'}, by=["c_mktsegment"])


@query("""SELECT round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, CAST(count(*) AS DOUBLE) AS n, max(l_quantity) AS hi, min(l_quantity) AS lo,
                 round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp
          FROM lineitem WHERE l_returnflag IN ('R', 'A')""")
def subtotal_visible(spark, d):
    t = Table(_read(spark, d, "lineitem")).hide_unless("l_returnflag", ["R", "A"])
    q = "{l_quantity}"
    return t.summarise({"s": f"ROUND(SUBTOTAL(9,{q}),2)", "a": f"ROUND(SUBTOTAL(101,{q}),6)", "n": f"SUBTOTAL(3,{q})", "hi": f"SUBTOTAL(4,{q})", "lo": f"SUBTOTAL(105,{q})", "sd": f"ROUND(SUBTOTAL(7,{q}),6)", "vp": f"ROUND(SUBTOTAL(11,{q}),6)"})


@query("""SELECT round(quantile_cont(p_retailprice, 0.25), 4) AS q1, round(quantile_cont(p_retailprice, 0.9), 4) AS p90, round(median(p_retailprice), 4) AS mid,
                 round((SELECT p_retailprice FROM part ORDER BY p_retailprice DESC LIMIT 1 OFFSET 2), 4) AS third FROM part""")
def aggregate_quartile(spark, d):
    p = "{p_retailprice}"
    return Table(_read(spark, d, "part")).summarise({"q1": f"ROUND(AGGREGATE(17,6,{p},1),4)", "p90": f"ROUND(AGGREGATE(16,6,{p},0.9),4)", "mid": f"ROUND(AGGREGATE(12,6,{p}),4)", "third": f"ROUND(AGGREGATE(14,6,{p},3),4)"})


@query("""SELECT CAST(count(*) FILTER (l_tax = 0) AS DOUBLE) AS errors, round(avg(l_discount / l_tax) FILTER (l_tax <> 0), 6) AS ratio FROM lineitem""")
def errors_as_values(spark, d):
    t = Table(_read(spark, d, "lineitem"))
    return t.summarise({"errors": 'SUMPRODUCT(IF(ISERROR({l_discount}/{l_tax}),1,0))', "ratio": 'ROUND(AGGREGATE(1,6,{l_discount}/{l_tax}),6)'})


@query("""SELECT l_orderkey, l_linenumber, coalesce(CAST(round(l_discount / nullif(l_tax, 0), 3) AS VARCHAR), 'none') IS NOT NULL AS ok,
                 CASE WHEN l_tax = 0 THEN -1 ELSE round(l_discount / l_tax, 3) END AS ratio,
                 CASE WHEN l_quantity > 40 THEN 'bulk' WHEN l_quantity > 20 THEN 'some' ELSE 'few' END AS size FROM lineitem""")
def logic_columns(spark, d):
    t = Table(_read(spark, d, "lineitem")).derive(ok="NOT(ISERROR({l_quantity}))", ratio="IFERROR(ROUND({l_discount}/{l_tax},3),-1)", size='IFS({l_quantity}>40,"bulk",{l_quantity}>20,"some",TRUE,"few")')
    return t.frame.select("l_orderkey", "l_linenumber", "ok", "ratio", "size")


@query("""SELECT round(sum(l_quantity * l_extendedprice), 2) AS weighted, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) AS price,
                 CAST(count(l_quantity) AS DOUBLE) AS n, round(max(l_extendedprice) - min(l_extendedprice), 2) AS spread, round(stddev_samp(l_discount), 8) AS sd FROM lineitem""")
def sumproduct_price(spark, d):
    q, p = "{l_quantity}", "{l_extendedprice}"
    return Table(_read(spark, d, "lineitem")).summarise({"weighted": f"ROUND(SUMPRODUCT({q},{p}),2)", "price": f"ROUND(SUMPRODUCT({q},{p})/SUM({q}),6)", "n": f"COUNT({q})", "spread": f"ROUND(MAX({p})-MIN({p}),2)", "sd": "ROUND(STDEV({l_discount}),8)"})


@query("""SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS above, c_acctbal = (SELECT max(c_acctbal) FROM customer) AS top FROM customer""")
def whole_column_in_row_formula(spark, d):
    return Table(_read(spark, d, "customer")).derive(above="ROUND({c_acctbal}-AVERAGE({c_acctbal}),4)", top="{c_acctbal}=MAX({c_acctbal})").frame.select("c_custkey", "above", "top")


@query("""SELECT round(median(p_retailprice), 4) AS mid, CAST(count(DISTINCT p_size) AS BIGINT) AS sizes FROM part""")
def median_price(spark, d):
    f = _read(spark, d, "part")
    return Table(f).summarise({"mid": "ROUND(MEDIAN({p_retailprice}),4)"}).join(table.unique_rows(f, ["p_size"], "p_partkey").agg(F.count("*").alias("sizes")))


@query("""SELECT (SELECT l_quantity FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, min(l_orderkey * 10 + l_linenumber) LIMIT 1) AS usual""")
def mode_quantity(spark, d):
    f = _read(spark, d, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return Table(f, position="pos").summarise({"usual": "MODE({l_quantity})"})


@query("""SELECT l_returnflag, l_quantity AS mode FROM (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, min(l_orderkey * 10 + l_linenumber)) AS r
          FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) WHERE r = 1""")
def mode_by_flag(spark, d):
    f = _read(spark, d, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return table.mode_by_group(f, ["l_returnflag"], "l_quantity", "pos")


@query("""SELECT (SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 1 OFFSET 4) AS fifth, (SELECT o_totalprice FROM orders ORDER BY 1 LIMIT 1 OFFSET 2) AS low""")
def large_k(spark, d):
    return Table(_read(spark, d, "orders")).summarise({"fifth": "LARGE({o_totalprice},5)", "low": "SMALL({o_totalprice},3)"})


@query("""SELECT o_orderpriority, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r = 3""")
def large_by_priority(spark, d):
    return table.largest_by_group(_read(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 3)


@query("""SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC) AS rank FROM orders""")
def rank_price(spark, d):
    return table.rank_rows(_read(spark, d, "orders"), "o_totalprice").select("o_orderkey", "rank")


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS running FROM orders""")
def running_total(spark, d):
    out = table.running_total(_read(spark, d, "orders"), "o_orderkey", "o_totalprice")
    return out.select("o_orderkey", F.round("running", 2).alias("running"))


# --- lookups


@query("""SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def vlookup_nation(spark, d):
    out = lookup.exact_lookup(_read(spark, d, "customer"), "c_nationkey", _read(spark, d, "nation"), "n_nationkey", {"nation": "n_name"}, "n_nationkey")
    return out.select("c_custkey", "nation")


@query("""SELECT c_custkey, coalesce(n_name, 'elsewhere') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON c_nationkey = n_nationkey""")
def xlookup_default(spark, d):
    out = lookup.exact_lookup(_read(spark, d, "customer"), "c_nationkey", _read(spark, d, "nation").where("n_regionkey < 2"), "n_nationkey", {"nation": "n_name"}, "n_nationkey", F.lit("elsewhere"))
    return out.select("c_custkey", "nation")


@query("""SELECT o_orderkey, p_partkey AS band FROM orders ASOF LEFT JOIN (SELECT p_retailprice * 150 AS low, max(p_partkey) AS p_partkey FROM part GROUP BY 1) ON o_totalprice >= low""")
def approx_lookup_band(spark, d):
    bands = _read(spark, d, "part").groupBy((F.col("p_retailprice") * 150).alias("at")).agg(F.max("p_partkey").alias("p_partkey"))
    return lookup.approximate_lookup(_read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", bands, "at", {"band": "p_partkey"}).select("o_orderkey", "band")


@query("""SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%d w_dget'""")
def wildcard_search(spark, d):
    return lookup.wildcard_rows(_read(spark, d, "part"), "p_name", "*D w?dget").select("p_partkey", "p_name")


@query("""SELECT (SELECT min(p_partkey) FROM part WHERE p_size = 24) AS exact, (SELECT max(n_nationkey) FROM nation WHERE n_regionkey <= 2) AS below,
                 (SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 ORDER BY o_totalprice, o_orderkey LIMIT 1) AS nearest""")
def match_positions(spark, d):
    a = lookup.match_position(_read(spark, d, "part"), "p_size", 24, "p_partkey").select(F.col("position").alias("exact"))
    b = lookup.match_position(_read(spark, d, "nation"), "n_regionkey", 2, "n_nationkey", 1).select(F.col("position").alias("below"))
    c = lookup.nearest_position(_read(spark, d, "orders"), "o_totalprice", 100000.0, "o_orderkey", 1).select(F.col("position").alias("nearest"))
    return a.join(b).join(c)


@query("""SELECT o_orderkey, change, o_totalprice_before, o_totalprice_after FROM (
            SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_totalprice AS o_totalprice_before, b.o_totalprice AS o_totalprice_after,
                   CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'changed' END AS change
            FROM (SELECT * FROM orders WHERE o_orderkey % 10 <> 3) a FULL JOIN
                 (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 4) b ON a.o_orderkey = b.o_orderkey)
          WHERE change IS NOT NULL""")
def workbook_diff(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    after = o.where("o_orderkey % 10 <> 4").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return lookup.diff(o.where("o_orderkey % 10 <> 3"), after, ["o_orderkey"], ["o_totalprice"])


@query("""SELECT c_custkey, coalesce(n_name, 'none') AS nation, round(c_acctbal / (SELECT count(*) FROM nation), 4) AS per_nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def lookup_formulas(spark, d):
    nation = Table(_read(spark, d, "nation"), position="n_nationkey")
    t = Table(_read(spark, d, "customer"), tables={"Nation": nation})
    t = t.derive(nation='XLOOKUP({c_nationkey},Nation.n_nationkey,Nation.n_name,"none")', per_nation="ROUND({c_acctbal}/ROWS(Nation),4)")
    return t.frame.select("c_custkey", "nation", "per_nation")


@query("""SELECT lower(min(p_type)) AS a0 FROM part GROUP BY lower(p_type)""")
def spill_unique(spark, d):
    return Table(_read(spark, d, "part"), position="p_partkey").spill("UNIQUE(LOWER({p_type}))")


@query("""SELECT o_orderkey AS a0 FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'P'""")
def spill_filter(spark, d):
    out = Table(_read(spark, d, "orders")).spill('FILTER({o_orderkey},AND({o_totalprice}>150000,{o_orderstatus}="P"))')
    return out.select(F.col("a0").cast("long").alias("a0"))


def _customer_values(c):
    from tabulon.operators.recalc import recalculate

    inputs = F.array(F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.lit("=ROUND(A1*2+SUM(A1:A2),2)"), F.lit('=IF(A1<0,"low",UPPER(LEFT(A3,3)))'))
    cells = c.select("c_custkey", F.lit("S").alias("sheet"), F.posexplode(inputs).alias("r", "input")).withColumn("c", F.lit(0))
    out = recalculate(cells, "c_custkey")
    return out.groupBy("c_custkey").agg(F.max(F.when(F.col("r") == 3, F.col("n"))).alias("n"), F.max(F.when(F.col("r") == 4, F.col("s"))).alias("s"))


@query("""SELECT c_custkey, round(c_acctbal * 2 + c_acctbal + c_nationkey, 2) AS n, CASE WHEN c_acctbal < 0 THEN 'low' ELSE upper(left(c_mktsegment, 3)) END AS s FROM customer""")
def workbook_values(spark, d):
    return _customer_values(_read(spark, d, "customer"))


# --- arrays: distinct rows, sorts, series


@query("""SELECT min(p_partkey) AS p_partkey, p_type, p_size FROM part GROUP BY p_type, p_size""")
def unique_types(spark, d):
    return table.unique_rows(_read(spark, d, "part"), ["p_type", "p_size"], "p_partkey")


@query("""SELECT min(p_partkey) AS p_partkey, p_name, p_brand FROM part GROUP BY p_name, p_brand HAVING count(*) = 1""")
def unique_once(spark, d):
    return table.unique_rows(_read(spark, d, "part"), ["p_name", "p_brand"], "p_partkey", exactly_once=True)


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY lower(o_orderstatus), o_totalprice DESC, o_orderkey LIMIT 25""")
def sortby_topk(spark, d):
    return table.top_rows(_read(spark, d, "orders"), [("o_orderstatus", True), ("o_totalprice", False)], 25, "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02""")
def filter_rows(spark, d):
    return Table(_read(spark, d, "lineitem")).where("AND({l_quantity}>45,{l_discount}<2%)").frame.select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT p_partkey, CAST(i // 2 AS BIGINT) AS r, CAST(i % 2 AS BIGINT) AS c, CAST(p_retailprice + i * 0.5 AS DOUBLE) AS value
          FROM (SELECT p_partkey, p_retailprice, unnest(range(2 * (1 + p_size % 4))) AS i FROM part)""")
def sequence_rows(spark, d):
    p = _read(spark, d, "part")
    out = table.sequences(p, ["p_partkey"], 1 + F.col("p_size") % 4, F.lit(2), F.col("p_retailprice"), F.lit(0.5))
    return out.select("p_partkey", "r", "c", "value")


@query("""SELECT o_orderkey, CAST(5 + 2.5 * o_orderkey AS DOUBLE) AS series, [1.0, 4.0, 2.0][1 + o_orderkey % 3]::DOUBLE AS cycle FROM orders""")
def fill_series(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey")
    return table.fill_series(table.fill_series(o, "o_orderkey", [5, 7.5, 10], "series"), "o_orderkey", [1, 4, 2], "cycle")


@query("""SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1 AS duplicate FROM customer""")
def cond_duplicate(spark, d):
    c = _read(spark, d, "customer").withColumn("k", F.concat_ws("|", "c_nationkey", "c_mktsegment"))
    return table.duplicates(c, "k").select("c_custkey", "duplicate")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'red' WHEN c_acctbal > 5000 THEN 'green' END AS colour, CASE WHEN c_acctbal > 8000 THEN 'bold' END AS weight FROM customer""")
def cond_rules(spark, d):
    rules = [("{c_acctbal}<0", {"colour": "red"}), ("{c_acctbal}>8000", {"weight": "bold"}), ("{c_acctbal}>5000", {"colour": "green"})]
    return table.conditional_format(_read(spark, d, "customer"), rules, ["colour", "weight"]).select("c_custkey", "colour", "weight")


@query("""SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS piece FROM (SELECT p_partkey, string_split(p_name, ' ') AS parts, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)""")
def text_split(spark, d):
    return table.text_split(_read(spark, d, "part"), "p_name", [" "], ["p_partkey"])


# --- text


@query("""SELECT p_partkey, upper(left(p_name, 3)) || '-' || right(p_brand, 2) AS code, CAST(length(p_name) AS DOUBLE) AS n, replace(p_name, 'widget', 'gadget') AS other,
                 substr(p_type, 2, 3) AS mid, CASE WHEN strpos(p_name, ' ') > 0 THEN split_part(p_name, ' ', 1) END AS first, CAST(strpos(lower(p_type), 'o') AS DOUBLE) AS o,
                 p_name = lower(p_name) AS plain, repeat('*', CAST(p_size % 5 AS BIGINT)) AS stars FROM part""")
def text_columns(spark, d):
    t = Table(_read(spark, d, "part")).derive(
        code='UPPER(LEFT({p_name},3))&"-"&RIGHT({p_brand},2)', n="LEN({p_name})", other='SUBSTITUTE({p_name},"widget","gadget")', mid="MID({p_type},2,3)", first='TEXTBEFORE({p_name}," ")',
        o='IFERROR(SEARCH("o",{p_type}),0)', plain="EXACT({p_name},LOWER({p_name}))", stars='REPT("*",MOD({p_size},5))',
    )
    return t.frame.select("p_partkey", "code", "n", "other", "mid", "first", "o", "plain", "stars")


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN '00' || p_size ELSE '0' || p_size END AS padded, printf('%.2f', p_retailprice) AS price, CAST(p_size AS VARCHAR) || '.0%' AS share FROM part""")
def text_formats(spark, d):
    t = Table(_read(spark, d, "part")).derive(padded='TEXT({p_size},"000")', price='TEXT({p_retailprice},"0.00")', share='TEXT({p_size}/100,"0.0%")')
    return t.frame.select("p_partkey", "padded", "price", "share")


@query("""SELECT doc_id, replace(text, 'the', 'THE') AS text, contains(text, 'the') AS has FROM documents""")
def find_replace(spark, d):
    f = _read(spark, d, "documents").select("doc_id", "text")
    return Table(f).replace_text("text", "the", "THE").frame.join(
        Table(f, position="doc_id").find("the", ["text"], match_case=True).select("doc_id", F.lit(True).alias("found")), "doc_id", "left"
    ).select("doc_id", "text", F.coalesce("found", F.lit(False)).alias("has"))


# --- dates and finance


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS y, CAST(month(o_orderdate) AS DOUBLE) AS m, CAST(day(o_orderdate) AS DOUBLE) AS d, CAST(dayofweek(o_orderdate) + 1 AS DOUBLE) AS w,
                 CAST(datediff('day', DATE '1899-12-30', last_day(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE))) AS DOUBLE) AS month_end,
                 strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS DOUBLE) AS days,
                 CAST(datediff('day', DATE '1899-12-30', CAST(o_orderdate + INTERVAL 1 MONTH AS DATE)) AS DOUBLE) AS next FROM orders""")
def date_columns(spark, d):
    x = "{o_orderdate}"
    t = Table(_read(spark, d, "orders")).derive(y=f"YEAR({x})", m=f"MONTH({x})", d=f"DAY({x})", w=f"WEEKDAY({x})", month_end=f"EOMONTH({x},1)", iso=f'TEXT({x},"yyyy-mm-dd")', days=f"DAYS(DATE(2000,1,1),{x})", next=f"EDATE({x},1)")
    return t.frame.select("o_orderkey", "y", "m", "d", "w", "month_end", "iso", "days", "next")


@query("""SELECT o_orderkey, CAST((SELECT count(*) FROM range(CAST(o_orderdate AS DATE), DATE '2011-01-01', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6) AS DOUBLE) AS workdays,
                 CAST(date_sub('month', CAST(o_orderdate AS DATE), DATE '2011-06-15') AS DOUBLE) AS months, CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2011-06-15') AS DOUBLE) AS years,
                 round(datediff('day', CAST(o_orderdate AS DATE), DATE '2011-01-01') / 365.0, 8) AS frac FROM orders""")
def date_spans(spark, d):
    x = "{o_orderdate}"
    t = Table(_read(spark, d, "orders")).derive(workdays=f"NETWORKDAYS({x},DATE(2010,12,31))", months=f'DATEDIF({x},DATE(2011,6,15),"M")', years=f'DATEDIF({x},DATE(2011,6,15),"Y")', frac=f"ROUND(YEARFRAC({x},DATE(2011,1,1),3),8)")
    return t.frame.select("o_orderkey", "workdays", "months", "years", "frac")


@query("""SELECT s_suppkey, round(-(s_acctbal * 0.01) / (1 - power(1.01, -24)), 6) AS pmt, round(-s_acctbal * power(1.01, 12), 6) AS fv, round(s_acctbal / 1.05 + 10 / power(1.05, 2), 6) AS npv FROM supplier""")
def finance_columns(spark, d):
    t = Table(_read(spark, d, "supplier")).derive(pmt="ROUND(PMT(0.01,24,{s_acctbal}),6)", fv="ROUND(FV(0.01,12,0,{s_acctbal}),6)", npv="ROUND(NPV(0.05,{s_acctbal},10),6)")
    return t.frame.select("s_suppkey", "pmt", "fv", "npv")


@query("""SELECT o_orderkey, round(o_totalprice, -2) AS hundreds, ceil(o_totalprice / 50) * 50 AS up, floor(o_totalprice / 50) * 50 AS down, CAST(o_custkey % 7 AS DOUBLE) AS rest,
                 round(sqrt(o_totalprice), 6) AS root, trunc(o_totalprice * 10) / 10 AS cut, CAST(gcd(o_custkey, 84) AS DOUBLE) AS common, round(ln(o_totalprice), 8) AS nat FROM orders""")
def math_columns(spark, d):
    x = "{o_totalprice}"
    t = Table(_read(spark, d, "orders")).derive(hundreds=f"ROUND({x},-2)", up=f"CEILING({x},50)", down=f"FLOOR({x},50)", rest="MOD({o_custkey},7)", root=f"ROUND(SQRT({x}),6)", cut=f"TRUNC({x}*10)/10", common="GCD({o_custkey},84)", nat=f"ROUND(LN({x}),8)")
    return t.frame.select("o_orderkey", "hundreds", "up", "down", "rest", "root", "cut", "common", "nat")


# --- event log


def _ms(c: str = "ts"):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1000


_SESSIONS = """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events),
     g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) <= {gap} THEN 0 ELSE 1 END AS new FROM e),
     s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS actor, 's_' || user_id || '_' || min(ms) AS session_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n_events FROM s GROUP BY user_id, k"""


@query(_SESSIONS.format(gap=600_000))
def session_10min(spark, d):
    return log.sessions(_read(spark, d, "events"), "user_id", F.floor(_ms()).cast("long"))


@query(_SESSIONS.format(gap=21_600_000))
def session_6h(spark, d):
    return log.sessions(_read(spark, d, "events"), "user_id", F.floor(_ms()).cast("long"), 21_600_000)


@query("""SELECT event_id, user_id, event_type FROM events""")
def events_dedupe(spark, d):
    e = _read(spark, d, "events").select("event_id", "user_id", "event_type", F.lit(0).alias("arrival"))
    return log.first_of(e.unionAll(e.withColumns({"arrival": F.lit(1), "event_type": F.lit("late")})), "event_id", "arrival").drop("arrival")


_CONSENTS = "SELECT c_custkey AS actor_id, c_custkey * 10 + i AS id, CASE (c_custkey + i) % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'structural' ELSE 'full' END AS mode, CASE WHEN c_custkey % 11 = i THEN 1 END AS revoked FROM customer, (SELECT unnest(range(3)) AS i)"


@query(f"""WITH c AS ({_CONSENTS}), l AS (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY id DESC) AS r FROM c)
           SELECT event_id FROM events WHERE user_id IN (SELECT actor_id FROM l WHERE r = 1 AND mode <> 'off' AND revoked IS NULL)""")
def consent_gate(spark, d):
    c = _read(spark, d, "customer").select(F.col("c_custkey").alias("actor_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    mode = F.element_at(F.array(F.lit("off"), F.lit("structural"), F.lit("full")), ((F.col("actor_id") + F.col("i")) % 3 + 1).cast("int"))
    c = c.select("actor_id", (F.col("actor_id") * 10 + F.col("i")).alias("id"), mode.alias("mode"), F.when(F.col("actor_id") % 11 == F.col("i"), 1).alias("revoked_at"))
    return log.consented(_read(spark, d, "events"), c, "user_id").select("event_id")


@query("""SELECT first, second, count(*) AS n FROM (SELECT event_type AS first, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS second FROM events) WHERE second IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""")
def frequent_bigrams(spark, d):
    return log.frequent_pairs(_read(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], 3)


@query("""SELECT event_id, left(sha256('salt' || chr(31) || props), 16) AS hash, CAST(length(props) AS INTEGER) AS len FROM events""")
def redact_hash(spark, d):
    return _read(spark, d, "events").select("event_id", log.redacted(F.col("props"), "salt").alias("x")).select("event_id", "x.hash", "x.len")


@query("""SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20""")
def recent_topk(spark, d):
    return log.recent(_read(spark, d, "events"), "user_id", 7, [F.col("ts").desc(), F.col("event_id").desc()], 20).select("event_id", "event_type")


def _steps(spark, d):
    return log.session_starts(_read(spark, d, "events"), "user_id", F.floor(_ms()).cast("long"), ["event_id"], 21_600_000)


@query()
def mined_patterns(spark, d):
    from tabulon.streaming import mining

    return mining.mine(_steps(spark, d), ["user_id"], "session_start_ms", "event_type", ["ts", "event_id"])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, ts, epoch_us(ts) // 1000 AS ms FROM events),
     g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) <= 21600000 THEN 0 ELSE 1 END AS new FROM e),
     s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
     o AS (SELECT user_id, k, event_type AS t, lag(event_type) OVER w AS before, row_number() OVER w AS o FROM s WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, event_id)),
     p AS (SELECT user_id, k, [t] AS w, min(o) AS at FROM o GROUP BY user_id, k, t
           UNION ALL
           SELECT p.user_id, p.k, list_append(p.w, o.t), o.o FROM p JOIN o ON o.user_id = p.user_id AND o.k = p.k
           WHERE len(p.w) < 12 AND (o.o = p.at + 1 OR o.o = p.at + 2 AND o.t <> o.before)),
     f AS (SELECT user_id, w, count(*) AS support FROM p WHERE len(w) >= 2 GROUP BY user_id, w HAVING count(*) >= 3)
SELECT user_id, array_to_string(w, '>') AS pattern, support FROM f
WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.user_id = f.user_id AND len(q.w) > len(f.w) AND array_to_string(q.w, '>') || '>' LIKE '%' || array_to_string(f.w, '>%') || '>%')""")
def recurring_patterns(spark, d):
    from tabulon.streaming import mining

    rows = mining.session_rows(_steps(spark, d), ["user_id"], "session_start_ms", "event_type", ["ts", "event_id"])
    found = mining.recurring(rows.withColumn("free", F.transform("tokens", lambda t: F.lit(True))))
    return found.select("key.user_id", F.concat_ws(">", "tokens").alias("pattern"), "support")


@query("""SELECT page_id AS key, 0 AS r, 0 AS c, CAST(page_id AS VARCHAR) AS value FROM pages UNION ALL SELECT page_id, 0, 1, trim(url) FROM pages
          UNION ALL SELECT page_id, 1, 0, 'bytes' FROM pages UNION ALL SELECT page_id, 1, 1, CAST(octet_length(encode(html)) AS VARCHAR) FROM pages""")
def page_tables(spark, d):
    from tabulon.sources.files import page_tables as cells

    # no page of the data holds a table: each gets one of its own, in front of its whole text
    row = lambda *x: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *x), F.lit("</td></tr>"))
    own = row(F.col("page_id").cast("string"), F.replace("url", F.lit("&"), F.lit("&amp;"))), row(F.lit("bytes"), F.octet_length("html").cast("string"))
    return cells(_read(spark, d, "pages").withColumn("html", F.concat(F.lit("<table>"), *own, F.lit("</table>"), "html")), "page_id", "html")
