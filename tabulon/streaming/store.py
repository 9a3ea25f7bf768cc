"""Tables beside the event log: consent history, proposed routines, exported records."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import MODES

#: A user's verdicts: what has one stays with its workbook.
VERDICTS = ("accepted", "dismissed")


def since(text: str, ts_ms: Column) -> Column:
    """Whether an event is at or after a time, given as epoch milliseconds or in RFC 3339."""
    text = text.strip()
    if re.fullmatch(r"[+-]?\d+", text):
        return ts_ms >= int(text)
    try:
        at = datetime.fromisoformat(text)
    except ValueError as e:
        raise ValueError(f"since={text} is neither RFC 3339 nor epoch milliseconds") from e
    if at.tzinfo is None:
        raise ValueError(f"since={text} has no offset")
    return ts_ms >= (at - datetime.fromtimestamp(0, at.tzinfo)).total_seconds() * 1000


def record_consents(history: DataFrame, choices: DataFrame) -> DataFrame:
    """``history`` (``id, actor_id, mode, at, revoked_at``) with ``choices`` (``id, actor_id, mode, at``) appended.

    Choosing ``off`` withdraws: it revokes what the actor had granted before and itself. A choice of an unknown mode is left out.
    """
    new = choices.where(F.col("mode").isin(*MODES)).select("id", "actor_id", "mode", "at", F.lit(None).cast("string").alias("revoked_at"))
    both = history.select(*new.columns).unionByName(new)
    # from an actor's last choice back: the nearest withdrawal at or after each
    back = Window.partitionBy("actor_id").orderBy(F.col("id").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = both.join(new.where("mode = 'off'").select("id").distinct().withColumn("_new", F.lit(True)), "id", "left")
    at = F.last(F.when(F.col("_new") & (F.col("mode") == "off"), F.col("at")), ignorenulls=True).over(back)
    return fresh.select("id", "actor_id", "mode", "at", F.coalesce("revoked_at", at).alias("revoked_at"))


def upsert_routines(stored: DataFrame, mined: DataFrame, books: DataFrame) -> DataFrame:
    """The routine table after ``books`` (``actor_id, workbook_id``) were mined: ``actor_id, id, workbook_id, summary, body, minutes, support, status``.

    What was mined again is refreshed and keeps its status; what is new is proposed. Proposals of
    the mined workbooks that weren't found again go; verdicts and other workbooks stay.
    """
    keys, fields = ["actor_id", "id"], ["workbook_id", "summary", "body", "minutes", "support"]
    old = stored.select(*keys, F.struct(*fields, "status").alias("_old"))
    new = mined.select(*keys, F.struct(*fields).alias("_new"))
    own = books.select("actor_id", F.col("workbook_id").alias("_book")).distinct().withColumn("_mined", F.lit(True))
    both = old.join(new, keys, "full_outer").withColumn("_book", F.col("_old.workbook_id")).join(own, ["actor_id", "_book"], "left")
    kept = both.where("_new is not null or _mined is null or _old.status <> 'proposed'")
    fresh = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in fields[1:]]
    settled = F.col("_new").isNull() | F.coalesce(F.col("_old.status").isin(*VERDICTS), F.lit(False))
    book = F.when(settled, F.col("_old.workbook_id")).otherwise(F.col("_new.workbook_id"))
    return kept.select(*keys, book.alias("workbook_id"), *fresh, F.coalesce("_old.status", F.lit("proposed")).alias("status"))


def write_dataset(records: DataFrame, path: str, schema: str, consent_checked: bool) -> None:
    """JSON Lines under ``path``/records, and ``path``/manifest: schema, whether consent was checked, records in each session.

    A session lies in one file, in order; a file holds many sessions, as many as Spark's shuffle partitions deal to it.
    """
    records.repartition("session_id").sortWithinPartitions("session_id", "seq").write.mode("overwrite").json(f"{path}/records")
    counts = records.groupBy("session_id").agg(F.count("*").alias("records"))
    counts.select(F.lit(schema).alias("schema"), F.lit(consent_checked).alias("consent_checked"), "session_id", "records").write.mode("overwrite").json(f"{path}/manifest")
