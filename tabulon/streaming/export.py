"""Event logs as records for training: the state before an edit, the edit, the state after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events that change a cell; the others are skipped.
EDITS = ("cell.edit", "cell.clear")


def placeholder(digest: Column, kind: Column) -> Column:
    """What stands for a text that was never received: equal originals stay equal, and numbers numbers."""
    head = F.lower(F.substr(digest, F.lit(1), F.lit(12)))
    seed = F.when(head.rlike("^[0-9a-f]+$"), F.conv(head, 16, 10).cast("long")).otherwise(F.lit(0))
    text = F.concat(F.lit("'v"), F.lpad(F.lower(F.hex(seed % 0xFFFFFF)), 6, "0"))
    return F.when(kind == "number", (seed % 9000 + 1000).cast("string")).when(kind == "bool", F.when(seed % 2 == 0, "TRUE").otherwise("FALSE")).otherwise(text)


def edits(events: DataFrame) -> DataFrame:
    """``session_id, workbook_id, seq, sheet, addr, action, input, privacy_mode``: the events that edit a cell; a cleared cell's input is null."""
    part = lambda path: F.get_json_object("payload", path)
    text = F.when(part("$.input.hash").isNotNull(), placeholder(part("$.input.hash"), part("$.input.type"))).otherwise(part("$.input"))
    typed = F.when((F.col("action") == "cell.edit") & (text != ""), text)
    own = events.where(F.col("action").isin(*EDITS) & part("$.addr").isNotNull())
    return own.select("session_id", "workbook_id", "seq", F.col("context.sheet").alias("sheet"), F.upper(part("$.addr")).alias("addr"), "action", typed.alias("input"), F.col("context.privacy_mode").alias("privacy_mode"))


def transitions(events: DataFrame) -> DataFrame:
    """:func:`edits` with ``pre_state_digest``, ``post_state_digest`` and ``values_synthetic``; each session starts empty.

    A digest is over the sum of the cells' hashes, so that an edit changes it by its own cell's
    alone: two running windows give all states without replaying any. States with the same cells have the same digest.
    """
    own = edits(events)
    cell = lambda text: F.sha2(F.concat_ws("\x1f", "sheet", "addr", text), 256)
    piece = lambda text, i: F.when(text.isNull(), F.lit(0)).otherwise(F.conv(F.substr(cell(text), F.lit(1 + 15 * i), F.lit(15)), 16, 10)).cast("decimal(38,0)")
    before = F.lag("input").over(Window.partitionBy("session_id", "sheet", "addr").orderBy("seq"))
    own = own.withColumn("_was", before)
    own = own.withColumns({"_n": F.col("input").isNotNull().cast("int") - F.col("_was").isNotNull().cast("int"), **{f"_d{i}": piece(F.col("input"), i) - piece(F.col("_was"), i) for i in range(4)}})
    names = ["_n", *(f"_d{i}" for i in range(4))]
    steps = Window.partitionBy("session_id").orderBy("seq")
    digest = lambda w: F.sha2(F.concat_ws("|", *[F.coalesce(F.sum(n).over(w), F.lit(0)).cast("decimal(38,0)").cast("string") for n in names]), 256)
    out = own.withColumns({"pre_state_digest": digest(steps.rowsBetween(Window.unboundedPreceding, -1)), "post_state_digest": digest(steps.rowsBetween(Window.unboundedPreceding, 0))})
    return out.withColumn("values_synthetic", F.coalesce(F.col("privacy_mode") != "full", F.lit(True))).drop("_was", *names)
