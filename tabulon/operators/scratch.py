"""Scratch tables in the cluster's shared folder, where iterations cut their lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tabulon-")


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder in the warehouse, or one of our own if all runs in this process."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        base = _own(app)
    elif not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tabulon"
    return f"{base.rstrip('/')}/{app}"


#: Rows from which on a settled table is not broadcast.
LARGE = 200_000


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table and read it again: what follows survives lost executors without computing ``df`` anew.

    Catalyst takes a table for as large as its compressed files, and would broadcast tables of
    many alike rows that the driver can't hold. So those of LARGE rows or more ask for merge joins.
    """
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out if out.count() < LARGE else out.hint("merge")
