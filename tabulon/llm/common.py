"""What the training-data operators share: column picking, shared scratch tables, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_SCRATCH: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name.

    Other columns may repeat names or differ from the wanted ones by case alone; they are
    renamed by position first, so nothing is ambiguous. Of equal names the first counts.
    """
    cols = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    return plain.select(*[F.col(f"_c{cols.index(n)}").alias(n) for n in names])


def by_position(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``df`` with unambiguous names, the name that stands for each column name, and the names to give back by toDF."""
    names = df.columns
    return df.toDF(*[f"_c{i}" for i in range(len(names))]), {n: f"_c{names.index(n)}" for n in names}, names


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir; where it is unset, one in the warehouse, or of our own if all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tabulon"
    if not base:
        base = _OWN_SCRATCH.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tabulon-"))
    return f"{base.rstrip('/')}/{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends at a table that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice's texts hold about ``most`` bytes (a longer text goes alone)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < n:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n


def steps(count: Column) -> Column:
    """Which power of the fourth root of two a count of 1 or more reaches: fewer than 256 steps for any long."""
    return F.floor(F.log2(count) * 4).cast("int")


def head_bound(counts: DataFrame, column: str, most: int) -> int:
    """The least count, taken by :func:`steps`, that no more than ``most`` rows of ``counts`` reach."""
    per = counts.groupBy(steps(F.col(column)).alias("step")).agg(F.count("*").alias("rows"), F.min(column).alias("least"))
    total, bound = 0, (1 << 63) - 1
    for r in sorted(per.collect(), key=lambda r: -r.step):
        total += r.rows
        if total > most:
            break
        bound = r.least
    return bound
