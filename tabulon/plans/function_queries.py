"""Queries over the driver's tables for the functions that no other query uses, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.evaluate import evaluate
from tabulon.operators.table import Table

from .queries import _read, query

# --- numbers and aggregates


@query("""SELECT o_orderkey, ceil(o_custkey / 8.0 * 10) / 10 AS up, floor(o_custkey / 8.0 * 10) / 10 AS down, CAST(abs(o_custkey - 75) AS DOUBLE) AS size, CAST(floor((o_custkey - 75) / 4.0) AS DOUBLE) AS whole,
                 CAST(o_custkey * o_custkey AS DOUBLE) AS square, floor(o_custkey * 3 / 25.0 + 0.5) * 25 AS near, CAST(sign(o_custkey - 75) AS DOUBLE) AS side, round(exp(o_custkey / 1000000.0), 9) AS e,
                 round(log10(o_totalprice), 8) AS l10, round(log2(o_totalprice), 8) AS l2, CAST(lcm(o_custkey + 1, 12) AS DOUBLE) AS multiple FROM orders""")
def number_functions(spark, d):
    k, x = "{o_custkey}", "{o_totalprice}"
    t = Table(_read(spark, d, "orders")).derive(
        up=f"ROUNDUP({k}/8,1)", down=f"ROUNDDOWN({k}/8,1)", size=f"ABS({k}-75)", whole=f"INT(({k}-75)/4)", square=f"POWER({k},2)", near=f"MROUND({k}*3,25)", side=f"SIGN({k}-75)",
        e=f"ROUND(EXP({k}/1000000),9)", l10=f"ROUND(LOG10({x}),8)", l2=f"ROUND(LOG({x},2),8)", multiple=f"LCM({k}+1,12)",
    )
    return t.frame.select("o_orderkey", "up", "down", "size", "whole", "square", "near", "side", "e", "l10", "l2", "multiple")


@query("""SELECT n_regionkey, CAST(product(n_regionkey + 1) AS DOUBLE) AS power FROM nation GROUP BY 1""")
def product_by_region(spark, d):
    return Table(_read(spark, d, "nation")).summarise({"power": "PRODUCT({n_regionkey}+1)"}, by=["n_regionkey"])


@query("""SELECT source, CAST(count(*) FILTER (lang IS NOT NULL) AS DOUBLE) AS filled, CAST(count(*) FILTER (lang IS NULL OR lang = '') AS DOUBLE) AS blank, CAST(count(n_chars) AS DOUBLE) AS numbers FROM documents GROUP BY 1""")
def counts_of_cells(spark, d):
    return Table(_read(spark, d, "documents")).summarise({"filled": "COUNTA({lang})", "blank": "COUNTBLANK({lang})", "numbers": "COUNT({n_chars})"}, by=["source"])


# --- logic and information


@query("""SELECT doc_id, lang IS NULL AS blank, lang IS NOT NULL AS textual, n_chars IS NOT NULL AS numeric, true AS logical, n_chars > 500 AS gone, n_chars <= 500 AS broken,
                 CAST(CASE WHEN n_chars > 500 THEN -1 ELSE n_chars END AS DOUBLE) AS kept, CAST(CASE WHEN lang IS NULL THEN 1 ELSE 2 END AS DOUBLE) AS kind, n_chars > 900 OR lang = 'en' IS TRUE AS any_of,
                 CAST(n_chars * 2.0 + 1 AS DOUBLE) AS twice, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS chosen, true AS ref, CAST(16.0 AS DOUBLE) AS error_kind FROM documents""")
def information_functions(spark, d):
    n, la = "{n_chars}", "{lang}"
    t = Table(_read(spark, d, "documents")).derive(
        blank=f"ISBLANK({la})", textual=f"ISTEXT({la})", numeric=f"ISNUMBER({n})", logical=f"ISLOGICAL({n}>5)", gone=f"ISNA(IF({n}>500,NA(),1))", broken=f"ISERR(IF({n}>500,NA(),1/0))",
        kept=f"IFNA(IF({n}>500,NA(),{n}),-1)", kind=f"TYPE({la})", any_of=f'OR({n}>900,{la}="en")', twice=f"LET(x,{n}*2,x+1)", chosen='CHOOSE(MOD({doc_id},3)+1,"a","b","c")', ref=f"ISREF({n})", error_kind="TYPE(NA())",
    )
    return t.frame.select("doc_id", "blank", "textual", "numeric", "logical", "gone", "broken", "kept", "kind", "any_of", "twice", "chosen", "ref", "error_kind")


# --- text


@query("""SELECT p_partkey, p_name || '-' || p_brand AS joined, p_type || p_size AS plain, p_name || ',' || p_brand || ',' || p_type AS listed, p_name || ' x' AS trimmed,
                 array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS proper, p_name[1:1] || 'zz' || p_name[5:] AS replaced,
                 CASE WHEN strpos(p_name, 'e') > 0 THEN CAST(strpos(p_name, 'e') AS DOUBLE) ELSE 0 END AS at, p_size + CAST(0.5 AS DOUBLE) AS number, p_size + CAST(0.25 AS DOUBLE) AS local, chr(65 + p_size % 26) AS letter,
                 CAST(ascii(p_brand) AS DOUBLE) AS code, p_name AS clean, split_part(p_name, ' ', 2) AS rest FROM part""")
def more_text_functions(spark, d):
    n = "{p_name}"
    t = Table(_read(spark, d, "part")).derive(
        joined=f'CONCAT({n},"-",{{p_brand}})', plain="CONCATENATE({p_type},{p_size})", listed=f'TEXTJOIN(",",TRUE,{n},"",{{p_brand}},{{p_type}})', trimmed=f'TRIM("  "&{n}&"   x ")', proper=f"PROPER({n})", replaced=f'REPLACE({n},2,3,"zz")',
        at=f'IFERROR(FIND("e",{n}),0)', number='VALUE({p_size}&".5")', local='NUMBERVALUE({p_size}&",25",",",".")', letter="CHAR(65+MOD({p_size},26))", code="CODE({p_brand})", clean=f"CLEAN({n}&CHAR(7))", rest=f'TEXTAFTER({n}," ")',
    )
    return t.frame.select("p_partkey", "joined", "plain", "listed", "trimmed", "proper", "replaced", "at", "number", "local", "letter", "code", "clean", "rest")


# --- dates and times

#: A Wednesday, 2024-05-15 13:30:00 UTC, as the clock of the query below.
NOON_MS = 1_715_779_800_000


@query("""SELECT event_id, CAST(hour(ts) AS DOUBLE) AS h, CAST(minute(ts) AS DOUBLE) AS m, round((event_id % 24) / 24.0 + 90 / 86400.0, 9) AS clock, CAST(second(date_trunc('second', ts + INTERVAL 500 MILLISECOND)) AS DOUBLE) AS s,
                 CAST(45427.0 AS DOUBLE) AS today, CAST(45427.5625 AS DOUBLE) AS now, round((13 * 3600 + 45 * 60 + 30) / 86400.0, 9) AS timed, CAST(36925.0 AS DOUBLE) AS dated FROM events""")
def time_functions(spark, d):
    e = _read(spark, d, "events").withColumn("whole", F.date_trunc("second", F.col("ts") + F.expr("INTERVAL 500 MILLISECOND")))
    t = Table(e, now_ms=NOON_MS).derive(
        h="HOUR({ts})", m="MINUTE({ts})", clock="ROUND(TIME(MOD({event_id},24),1,30),9)", s="SECOND({whole})", today="TODAY()", now="NOW()", timed='ROUND(TIMEVALUE("13:45:30"),9)', dated='DATEVALUE("2001-02-03")',
    )
    return t.frame.select("event_id", "h", "m", "clock", "s", "today", "now", "timed", "dated")


@query("""SELECT o_orderkey, CAST(datediff('day', DATE '1899-12-30', (SELECT max(CAST(x AS DATE)) FROM (SELECT x FROM range(CAST(o_orderdate AS DATE) + 1, CAST(o_orderdate AS DATE) + 30, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6 ORDER BY x LIMIT 10))) AS DOUBLE) AS due FROM orders""")
def workdays_ahead(spark, d):
    return Table(_read(spark, d, "orders")).derive(due="WORKDAY({o_orderdate},10)").frame.select("o_orderkey", "due")


def _mixed(x: str) -> str:
    """One step of splitmix64 in SQL, over unsigned integers of 64 bits."""
    wrap = lambda v: f"CAST(({v}) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    z = wrap(f"({x})::UHUGEINT + 11400714819323198485::UHUGEINT")
    z = wrap(f"xor({z}, {z} >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT")
    z = wrap(f"xor({z}, {z} >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT")
    return f"xor({z}, {z} >> 31)"


_DRAW = lambda salt: f"CAST({_mixed(f'xor({NOON_MS}::UBIGINT, {salt})')} >> 11 AS DOUBLE) / 9007199254740992.0"


@query(f"""WITH r AS MATERIALIZED (SELECT {_DRAW("0::UBIGINT")} AS unit, {_DRAW(f"xor({_mixed('1::UBIGINT')}, 6::UBIGINT)")} AS dice)
          SELECT s_suppkey, unit * s_suppkey AS unit, 1 + floor(dice * 6) AS dice FROM supplier, r""")
def random_functions(spark, d):
    t = Table(_read(spark, d, "supplier"), now_ms=NOON_MS).derive(unit="RAND()*{s_suppkey}", dice="RANDBETWEEN(1,6)")
    return t.frame.select("s_suppkey", "unit", "dice")


# --- positions and places


@query("""SELECT c_custkey, CAST(c_custkey + 1 AS DOUBLE) AS row, CAST(4.0 AS DOUBLE) AS place, CAST((SELECT count(*) FROM (DESCRIBE nation)) AS DOUBLE) AS width,
                 (SELECT n_name FROM nation WHERE n_nationkey = 3) AS third, n_name AS near
          FROM customer ASOF LEFT JOIN nation ON c_acctbal / 100 >= n_nationkey""")
def position_functions(spark, d):
    nation = Table(_read(spark, d, "nation"), position="n_nationkey")
    t = Table(_read(spark, d, "customer"), position="c_custkey", tables={"Nation": nation}).derive(
        row="ROW()", place="COLUMN({c_acctbal})", width="COLUMNS(Nation)", third="INDEX(Nation.n_name,4)", near="LOOKUP({c_acctbal}/100,Nation.n_nationkey,Nation.n_name)",
    )
    return t.frame.select("c_custkey", "row", "place", "width", "third", "near")


@query("""SELECT CAST(p_size AS BIGINT) AS a0 FROM part""")
def sort_sizes(spark, d):
    out = Table(_read(spark, d, "part"), position="p_partkey").spill("SORT({p_size},1,-1)")
    return out.select(F.col("a0").cast("long").alias("a0"))


@query("""SELECT 0 AS r, CAST(p_partkey AS BIGINT) AS c, CAST(p_size * 2 AS DOUBLE) AS value FROM part""")
def transposed_sizes(spark, d):
    out = Table(_read(spark, d, "part"), position="p_partkey").spill("TRANSPOSE({p_size}*2)")
    return out.select("r", F.col("c").cast("long").alias("c"), F.col("value").cast("double").alias("value"))


# --- finance


@query("""SELECT s_suppkey, round(-(s_acctbal + 2000) * (1 - power(1.01, -24)) / 0.01, 4) AS pv, round(ln(1 + (s_acctbal + 2000) * 0.01 / 500) / ln(1.01), 6) AS nper, CAST(0.01 AS DOUBLE) AS rate FROM supplier""")
def more_finance_functions(spark, d):
    x = "({s_acctbal}+2000)"
    t = Table(_read(spark, d, "supplier")).derive(pv=f"ROUND(PV(0.01,24,{x}),4)", nper=f"ROUND(NPER(0.01,-500,0,{x}),6)", rate=f"ROUND(RATE(24,PMT(0.01,24,{x}),{x}),6)")
    return t.frame.select("s_suppkey", "pv", "nper", "rate")


# --- whole workbooks: a small one per row


def books(rows: DataFrame, key: str, grid: list[list[Column | str]], results: dict[str, tuple[int, str]]) -> DataFrame:
    """Values of formulas in a workbook per row: ``grid`` gives the inputs of its lines, ``results`` names cells of its last line (column, kind)."""
    inputs = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), (F.lit(x) if isinstance(x, str) else x.cast("string")).alias("input")) for r, line in enumerate(grid) for c, x in enumerate(line)])
    cells = rows.select(key, F.lit("S").alias("sheet"), F.explode(inputs).alias("x")).select(key, "sheet", "x.r", "x.c", "x.input")
    out = evaluate(cells, key).where(F.col("r") == len(grid) - 1)
    return out.groupBy(key).agg(*[F.max(F.when(F.col("c") == c, F.col(kind))).alias(name) for name, (c, kind) in results.items()])


@query("""SELECT s_suppkey, s_nationkey + CAST(3.0 AS DOUBLE) AS h, s_nationkey + CAST(2.0 AS DOUBLE) AS i, CAST(3.0 AS DOUBLE) AS xm, CAST(30.0 AS DOUBLE) AS lk, CAST(3.0 AS DOUBLE) AS rw, CAST(2.0 AS DOUBLE) AS cl, CAST(4.0 AS DOUBLE) AS cols, CAST(2.0 AS DOUBLE) AS rows, s_nationkey + CAST(2.0 AS DOUBLE) AS off, s_nationkey + CAST(1.0 AS DOUBLE) AS ind, s_nationkey + CAST(4.0 AS DOUBLE) AS hi, s_nationkey + CAST(3.0 AS DOUBLE) AS tr,
                 CAST(s_nationkey AS DOUBLE) AS fil, s_nationkey + CAST(2.0 AS DOUBLE) AS seq, CAST(2.0 AS DOUBLE) AS un, 'b' AS sp, s_nationkey + CAST(4.0 AS DOUBLE) AS by, CAST(2.0 AS DOUBLE) AS m FROM supplier""")
def workbook_lookups(spark, d):
    s, k = _read(spark, d, "supplier"), F.col("s_nationkey")
    formulas = [
        '=HLOOKUP(40,A1:D2,2,FALSE)', "=INDEX(A2:D2,1,3)", "=XMATCH(30,A1:D1)", "=LOOKUP(35,A1:D1)", "=ROW(A3)", "=COLUMN(B1)", "=COLUMNS(A1:D2)", "=ROWS(A1:D2)", "=OFFSET(A1,1,2)", '=INDIRECT("B"&2)+0',
        "=INDEX(SORT(A2:D2,1,-1,TRUE),1,1)+1", "=INDEX(TRANSPOSE(A2:D2),4,1)", "=INDEX(FILTER(A2:D2,A1:D1<15),1,1)", "=INDEX(A2:D2,1,INDEX(SEQUENCE(1,3),1,3))", "=ROWS(UNIQUE(TRANSPOSE(A1:B1)))",
        '=INDEX(TEXTSPLIT("a,b",","),1,2)', "=INDEX(SORTBY(TRANSPOSE(A2:D2),TRANSPOSE(A1:D1),-1),1,1)+1", "=MATCH(20,A1:D1,0)",
    ]
    names = "h i xm lk rw cl cols rows off ind hi tr fil seq un sp by m".split()
    return books(s, "s_suppkey", [["10", "20", "30", "40"], [k, k + 1, k + 2, k + 3], formulas], {n: (i, "s" if n == "sp" else "n") for i, n in enumerate(names)})


@query("""SELECT s_suppkey, round(s_nationkey / 100.0, 6) AS irr, CAST(1 + s_nationkey % 3 AS DOUBLE) AS ranked, CAST(24.0 AS DOUBLE) AS product, CAST(3.0 AS DOUBLE) AS filled, CAST(1.0 AS DOUBLE) AS blank, CAST(4.0 AS DOUBLE) AS top, CAST(1.0 AS DOUBLE) AS low, true AS one FROM supplier""")
def workbook_aggregates(spark, d):
    s, k = _read(spark, d, "supplier"), F.col("s_nationkey")
    formulas = ["=ROUND(IRR(A1:B1),6)", "=RANK(A2,A3:C3,1)", "=PRODUCT(A4:D4)", "=COUNTA(A5:D5)", "=COUNTBLANK(A5:D5)", "=LARGE(A4:D4,1)", "=SMALL(A4:D4,1)", "=EXACT(A5,A5)"]
    names = "irr ranked product filled blank top low".split()
    grid = [["-100", k + 100], [k % 3 + 1], ["1", "2", "3"], ["2", "3", "4", "1"], ["x", "y", "z"], formulas]
    return books(s, "s_suppkey", grid, {n: (i, "n") for i, n in enumerate(names)} | {"one": (7, "b")})
