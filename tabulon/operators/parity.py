"""Formula cases: a formula over given cells, what it should show, and how settled that is."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.plans import formula as f

from .recalc import recalculate

SCHEMA = "id string, formula string, expect string, source string, at string, given map<string,string>, known_difference boolean, functions array<string>, note string"
_KIND = pa.schema([
    ("id", pa.string()), ("formula", pa.string()), ("expect", pa.string()), ("source", pa.string()), ("at", pa.string()), ("given", pa.map_(pa.string(), pa.string())), ("known_difference", pa.bool_()),
    ("functions", pa.list_(pa.string())), ("note", pa.string()),
])


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of all TOML files of a folder. Two cases of one id, or one without a note, are errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [c for text in b.column(0).to_pylist() for c in tomllib.loads(text).get("case", [])]
            rows = [{"at": "Z1", "known_difference": False, "functions": [], "note": "", **c, "given": list(c.get("given", {}).items())} for c in found]
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in _KIND.names} for r in rows], schema=_KIND)

    cases = spark.read.option("pathGlobFilter", "*.toml").text(path, wholetext=True).mapInArrow(run, SCHEMA)
    bad = cases.groupBy("id").agg(F.count("*").alias("n"), F.bool_or(F.trim("note") == "").alias("bare")).where("n > 1 or bare").orderBy("id").first()
    if bad is not None:
        raise ValueError(f"case {bad.id!r} " + ("occurs twice" if bad.n > 1 else "has no note"))
    return cases


def _place(column: pa.Array) -> pa.Array:
    own, out = column.dictionary_encode(), []
    for t in own.dictionary.to_pylist():
        try:
            at = f.parse_cell(t)
            out.append({"r": at.row, "c": at.col})
        except (f.FormulaError, TypeError, ValueError, AttributeError):
            out.append(None)
    return pa.array(out, pa.struct([("r", pa.int32()), ("c", pa.int32())])).take(own.indices)


def outcomes(cases: DataFrame) -> DataFrame:
    """``cases`` with ``got`` and ``verdict``: match, differs, accepted (a known difference), fixed (known no more) or unsettled (an open case).

    Each case is a workbook of its own. A bad address shows as a failure of its own in ``got``.
    """
    place = F.arrow_udf(_place, "struct<r: int, c: int>")
    cells = cases.select("id", F.explode(F.array_append(F.map_entries(F.coalesce("given", F.create_map().cast("map<string,string>"))), F.struct(F.col("at").alias("key"), F.col("formula").alias("value")))).alias("e"))
    cells = cells.select("id", F.lit("Sheet1").alias("sheet"), place("e.key").alias("p"), F.col("e.value").alias("input")).select("id", "sheet", "p.r", "p.c", "input")
    shown = recalculate(cells.where("r is not null and c is not null"), "id").select("id", "r", "c", "display")
    own = cases.withColumn("_p", place("at"))
    joined = own.join(shown, (own.id == shown.id) & (F.col("_p.r") == shown.r) & (F.col("_p.c") == shown.c), "left").drop(shown.id)
    got = F.coalesce("display", F.concat(F.lit("!bad address "), F.col("at")))
    same = got == F.col("expect")
    known = F.coalesce("known_difference", F.lit(False))
    verdict = F.when(F.col("source") == "open", "unsettled").when(same, F.when(known, "fixed").otherwise("match")).otherwise(F.when(known, "accepted").otherwise("differs"))
    return joined.withColumns({"got": got, "verdict": verdict}).select(*cases.columns, "got", "verdict")


def scorecard(judged: DataFrame) -> DataFrame:
    """One row: ``settled, matched, open, accepted``, and ``functions``: how many functions a settled case names."""
    settled = F.col("verdict") != "unsettled"
    named = judged.where(settled).select(F.explode("functions").alias("f")).agg(F.count_distinct("f").alias("functions"))
    counts = judged.agg(F.count_if(settled).alias("settled"), F.count_if(F.col("verdict") == "match").alias("matched"), F.count_if(~settled).alias("open"), F.count_if(F.col("verdict") == "accepted").alias("accepted"))
    return counts.crossJoin(named)  # one row each
