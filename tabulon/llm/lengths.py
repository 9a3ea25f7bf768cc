"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pick, slices, texts
from .tokens import default_path, encoder

#: Lengths of one block of the two-level sums.
BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``(n_tokens, n_docs)``: how many documents encode to each length.

    Null and empty texts have length 0. Repeated rows count each. Only ``text`` is read. An
    empty table gives an empty histogram. Each task adds up its own lengths first.
    """
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = encoder(path).ids, Counter()
        for b in slices(batches, "text"):
            seen.update(len(ids(t)) // 4 for t in texts(b.column(0)))
            if len(seen) >= 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n"])

    return pick(docs, "text").mapInArrow(run, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """For every length L in the histogram, what a context limit of L tokens means.

    n_docs: documents of just L tokens; docs_over, tokens_over: documents longer than L and
    their tokens; truncated_tokens: the sum of min(length, L) over all documents; lost_tokens:
    the rest; docs_share: share of documents that fit (so the quantile function, read by
    rows). Sums go over blocks of lengths first, so no step sorts all rows in one task. The
    histogram is read twice, so it is written to the shared folder first.
    """
    h = materialise(histogram, "lengths").withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    # one row per block of 1024 lengths: the longest document sets how many there are
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("later_d"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("later_t"), F.sum("bd").over(everything).alias("all_d"), F.sum("bt").over(everything).alias("all_t"))
    longer = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    s = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_d", "all_t",
        (F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("later_d")).alias("docs_over"),
        (F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("later_t")).alias("tokens_over"),
    )
    cut = F.col("all_t") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")
    return s.select(
        "n_tokens", "n_docs", F.col("all_d").alias("total_docs"), F.col("all_t").alias("total_tokens"), "docs_over", "tokens_over",
        cut.alias("truncated_tokens"), (F.col("all_t") - cut).alias("lost_tokens"), ((F.col("all_d") - F.col("docs_over")) / F.col("all_d")).alias("docs_share"),
    )


def truncated_total(totals: DataFrame, limit: int) -> DataFrame:
    """One row ``truncated_tokens`` for any limit, from the suffix sums (no document is read again)."""
    at = totals.where(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("docs_over", "tokens_over", "total_tokens"), "n_tokens").alias("s"))
    first = totals.agg(F.max("total_docs").alias("d"), F.max("total_tokens").alias("t"))
    return at.join(first).select(F.coalesce(F.col("s.total_tokens") - F.col("s.tokens_over") + F.col("s.docs_over") * limit, F.col("d") * limit, F.lit(0)).alias("truncated_tokens"))


def quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, n_tokens)``: the smallest length that at least this share of documents doesn't exceed."""
    cols = [F.min(F.when(F.col("docs_share") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])
    return totals.agg(*cols).select(F.explode(pairs).alias("p")).select("p.share", "p.n_tokens")
