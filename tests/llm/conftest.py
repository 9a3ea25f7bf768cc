from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def docs_of(spark):
    """A frame of documents with columns that clash by case or repeat; rows (doc_id, text[, lang])."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, 7, "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, fp long, component_id string").withColumnRenamed("source", "Text")

    return make


@pytest.fixture
def sf(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
