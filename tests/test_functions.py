from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tabulon.functions.registry import names
from tabulon.functions.values import displayed
from tabulon.operators.table import Table
from tabulon.plans.compiler import Compiler
from tabulon.plans.formula import FormulaError

CASES = [
    ('2^3^2','64'),
    ('-2^2','4'),
    ('0^0','#NUM!'),
    ('MOD(-3,2)','1'),
    ('ROUND(2.675,2)','2.68'),
    ('99999<"a"','TRUE'),
    ('1/0','#DIV/0!'),
    ('"a"&1','a1'),
    ('ROUNDUP(-1.21,1)','-1.3'),
    ('INT(-1.5)','-2'),
    ('PROPER("o\'neil 2nd")',"O'Neil 2Nd"),
('TEXT(1234.5,"#,##0.00")','1,234.50'),
    ('TEXT(0.256,"0.0%")','25.6%'),
    ('TEXT(-3,"0;(0)")','(3)'),
    ('TEXT(45292,"yyyy-mm-dd")','2024-01-01'),
    ('DATE(2024,1,31)','45322'),
    ('EDATE(DATE(2024,1,31),1)','45351'),
    ('EOMONTH("2024-02-10",0)','45351'),
('WEEKDAY(DATE(2024,1,1))','2'),
    ('NETWORKDAYS(DATE(2024,1,1),DATE(2024,1,31))','23'),
    ('WORKDAY(DATE(2024,1,1),10)','45306'),
    ('DATEDIF("2020-02-29","2024-02-28","Y")','3'),
    ('YEARFRAC(DATE(2024,1,1),DATE(2024,7,1),0)','0.5'),
('IFERROR(1/0,"x")','x'),
    ('IF(1>2,"a","b")','b'),
    ('LET(x,3,x*x)','9'),
    ('CHOOSE(2,"a","b")','b'),
    ('SUBSTITUTE("a-b-c","-","+",2)','a-b+c'),
    ('TEXTBEFORE("a-b-c","-",-1)','a-b'),
    ('TEXTAFTER("a-b-c","-")','b-c'),
    ('FIND("b","abc")','2'),
    ('SEARCH("B*","abc")','2'),
('MID("hello",2,3)','ell'),
    ('REPLACE("abcdef",2,3,"X")','aXef'),
    ('VALUE("12%")','0.12'),
    ('NUMBERVALUE("1.234,5",",",".")','1234.5'),
    ('REPT("ab",3)','ababab'),
    ('ROUND(PMT(0.01,12,1000),10)','-88.8487886783'),
    ('ROUND(RATE(12,-88.8487886783416,1000),9)','0.01'),
    ('GCD(12,18)','6'),
    ('LCM(4,6)','12'),
    ('LEN("café")','4'),
    ('TRIM("  a   b ")','a b'),
('HOUR("13:45:10")','13'),
    ('TIMEVALUE("1:30 PM")','0.5625'),
    ('TIME(25,0,0)','0.0416666666666667'),
    ('CEILING(2.1,1)','3'),
    ('FLOOR(-2.5,-2)','-2'),
    ('MROUND(10,3)','9'),
    ('SUM(1,"2",TRUE)','4'),
    ('AND(TRUE,1)','TRUE'),
    ('1+"x"','#VALUE!'),
    ('NOPE(1)','#NAME?'),
    ('0.1+0.2=0.3','TRUE'),
    ('TYPE("a")','2'),
    ('TEXTJOIN("-",TRUE,"a","","b")','a-b'),
    ('AVERAGE(1,2,6)','3'),
    ('MEDIAN(1,5,3,9)','4'),
    ('ISNUMBER({a})','TRUE'),
    ('{a}+1','2'),
    ('{t}&{b}','bTRUE'),
    ('TEXT(45292.75,"h:mm AM/PM")','6:00 PM'),
    ('50%','0.5'),
    ('"x"=IF(TRUE,"X")','TRUE'),
    ('ROUND(NPER(0.01,-100,1000),6)','10.588644'),
    ('DATE(1900,2,29)','60'),
]


def test_formulas_show_what_they_should(spark):
    df = spark.createDataFrame([(1.0, "b", True)], "a double, t string, b boolean")
    c = Compiler(df)
    cols = [displayed(c.compile(t)).alias(f"c{i}") for i, (t, _) in enumerate(CASES)]
    got = list(c.staged.select(*cols).first())
    assert [(t, g) for (t, _), g in zip(CASES, got, strict=True)] == CASES


def test_nulls_are_empty_cells(spark):
    df = spark.createDataFrame([(None, None, None), (2.0, "3", True)], "n double, t string, b boolean")
    c = Compiler(df)
    texts = ["{n}+1", "{t}&\"x\"", "{n}=0", "{t}=\"\"", "ISBLANK({n})", "{n}+{t}", "IF({b},1,2)", "{n}<{t}", "TYPE({t})", "LEN({t})"]
    cols = [displayed(c.compile(t)) for t in texts]
    rows = [list(r) for r in c.staged.select(*cols).collect()]
    assert rows[0] == ["1", "x", "TRUE", "TRUE", "TRUE", "0", "2", "FALSE", "1", "0"]
    assert rows[1] == ["3", "3x", "FALSE", "FALSE", "FALSE", "5", "1", "TRUE", "2", "1"]


def test_aggregates_of_odd_columns(spark):
    df = spark.createDataFrame([(None, "a"), (None, None)], "n double, t string")
    got = Table(df).summarise({k: f"{k}({{n}})" for k in ("SUM", "PRODUCT", "AVERAGE", "MIN", "MAX", "COUNT", "COUNTA", "COUNTBLANK", "MEDIAN", "STDEV", "MODE")} | {"text": "SUM({t})", "filled": "COUNTA({t})"}, errors="display").first()
    assert got.asDict() == {"SUM": "0", "PRODUCT": "0", "AVERAGE": "#DIV/0!", "MIN": "0", "MAX": "0", "COUNT": "0", "COUNTA": "0", "COUNTBLANK": "2", "MEDIAN": "#NUM!", "STDEV": "#DIV/0!", "MODE": "#N/A", "text": "0", "filled": "1"}
    none = Table(df.limit(0)).summarise({"s": "SUM({n})", "a": "AVERAGE({n})"}, errors="display").first()
    assert (none.s, none.a) == ("0", "#DIV/0!")


def test_errors_pass_through_aggregates(spark):
    df = spark.createDataFrame([(1, 4.0, 2.0), (2, 1.0, 0.0), (3, -1.0, 1.0)], "pos int, x double, y double")
    t = Table(df, position="pos")
    got = t.summarise({"all": "SUM({x}/{y})", "good": "AGGREGATE(9,6,{x}/{y})", "first": "SUM(IF({pos}=3,SQRT({x}),{x}/{y}))", "n": "COUNT({x}/{y})"}, errors="display").first()
    assert tuple(got) == ("#DIV/0!", "1", "#DIV/0!", "2")


def test_criteria(spark):
    df = spark.createDataFrame([("apple", 1.0), ("Apricot", None), ("a*b", 3.0), ("", 4.0), (None, 5.0)], "t string, n double")
    want = {'"a*"': 3, '"A?RICOT"': 1, '"a~*b"': 1, '"<>apple"': 4, '""': 1, '"="': 1, '">b"': 0, '"<B"': 4}
    got = Table(df).summarise({f"c{i}": f"COUNTIF({{t}},{c})" for i, c in enumerate(want)}).first()
    assert [int(x) for x in got] == list(want.values())
    numbers = {'">=3"': 3, '"<>3"': 4, "3": 1, '"3"': 1, '"x"': 0}
    got = Table(df).summarise({f"c{i}": f"COUNTIF({{n}},{c})" for i, c in enumerate(numbers)}).first()
    assert [int(x) for x in got] == list(numbers.values())


def test_headers_match_loosely_and_unknown_ones_are_errors(spark):
    df = spark.createDataFrame([(2.0,)], "`Unit Price` double")
    got = Table(df).derive({"a": "{unit_price}*2", "b": "{nothing}"}, errors="display").frame.first()
    assert (got.a, got.b) == ("4", "#REF!")


def test_wrong_arguments_are_refused(spark):
    c = Compiler(spark.range(1))
    with pytest.raises(FormulaError):
        c.compile("MOD(1)")
    assert len(names()) >= 115


def test_clock_is_injected(spark):
    df = spark.range(2)
    a = Table(df, now_ms=1_704_110_400_000).derive(t="TODAY()", r="RAND()", b="RANDBETWEEN(1,6)").frame.collect()
    assert a[0].t == 45292 and a[0].r == a[1].r and 1 <= a[0].b <= 6
    assert a[0].r != Table(df, now_ms=1_704_110_400_001).derive(r="RAND()").frame.first().r


def test_irr(spark):
    df = spark.createDataFrame([(0, -100.0), (1, 60.0), (2, 60.0)], "p int, v double")
    got = Table(df, position="p").derive(r="ROUND(IRR({v}),6)").frame.select(F.max("r")).first()[0]
    assert got == pytest.approx(0.130662)


def test_euclid_takes_as_many_steps_as_numbers_need(spark):
    import math

    fib = [1, 1]
    while fib[-1] < 2**52:
        fib.append(fib[-1] + fib[-2])
    pairs = [*zip(fib, fib[1:], strict=False), (0, 0), (0, 7), (12, 0), (1, 2**52), (2**52, 2**52), (84, 36)]
    t = Table(spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double"))
    got = t.derive(g="GCD({a},{b})").frame.collect()
    assert [(r.a, r.b, r.g) for r in got] == [(a, b, math.gcd(a, b)) for a, b in pairs]
    plan = t.derive(m="LCM({a},{b})").frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and "79, 80" not in plan  # once a row, not 80 steps for each
