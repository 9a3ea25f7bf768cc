"""The event log: validation, idempotent ingest, consent, sessions, redaction; batch and stream."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Envelope of an event.
SCHEMA = (
    "schema_version int, event_id string, session_id string, actor_id string, workbook_id string, seq bigint, ts_ms bigint, action string, payload string, "
    "context struct<sheet:string,selection:string,privacy_mode:string>, client_version string"
)
SCHEMA_VERSION = 1
#: An idle time of this length, inclusive, stays in a session.
GAP_MS = 600_000
#: Privacy modes from narrow to wide.
MODES = ("off", "structural", "full")


def latest_consent(consents: DataFrame) -> DataFrame:
    """``actor_id, mode``: each actor's last grant that isn't revoked and isn't off."""
    last = consents.groupBy("actor_id").agg(F.max_by(F.struct("mode", "revoked_at"), "id").alias("last"))
    return last.where(F.col("last.revoked_at").isNull() & (F.col("last.mode") != "off")).select("actor_id", F.col("last.mode").alias("mode"))


def reject_reason(actor: Column, actions: list[str], allowed_mode: Column) -> Column:
    """Why an envelope is refused, null if it isn't: the first failing test counts."""
    width = lambda m: F.array_position(F.array(*[F.lit(x) for x in MODES]), m)
    own = F.col("context.privacy_mode")
    return (
        F.when(F.col("actor_id").isNull() | (F.col("actor_id") != actor), "actor")
        .when(allowed_mode.isNull(), "consent")
        .when(own.isNull() | ~own.isin(*MODES) | (width(own) > width(allowed_mode)), "mode")
        .when(F.col("schema_version").isNull() | (F.col("schema_version") != SCHEMA_VERSION), "version")
        .when(F.col("action").isNull() | ~F.col("action").isin(actions), "action")
        .when(F.col("seq").isNull() | (F.col("seq") < 0), "seq")
        .when(F.col("event_id").isNull() | (F.col("event_id") == ""), "event_id")
    )


def validated(events: DataFrame, consents: DataFrame, actions: list[str]) -> DataFrame:
    """``events`` with ``reject_reason``."""
    allowed = latest_consent(consents).select(F.col("actor_id").alias("_actor"), F.col("mode").alias("_mode"))
    joined = events.join(allowed, F.col("actor_id") == F.col("_actor"), "left")
    return joined.withColumn("reject_reason", reject_reason(F.col("actor_id"), actions, F.col("_mode"))).drop("_actor", "_mode")


def first_of(events: DataFrame, key: str, order: str) -> DataFrame:
    """One event per id: the first by arrival."""
    row = F.struct(*[F.col(c) for c in events.columns])
    return events.groupBy(F.col(key).alias("_k")).agg(F.min_by(row, order).alias("_e")).select("_e.*")


def new_events(batch: DataFrame, table: DataFrame, key: str = "event_id") -> DataFrame:
    """A batch's events that the table doesn't have, the first of each id as the batch has them."""
    arrived = first_of(batch.withColumn("_arrived", F.monotonically_increasing_id()), key, "_arrived").drop("_arrived")
    return arrived.join(table.select(key), key, "left_anti")


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, consents_path: str, actions: list[str], trigger: dict | None = None):
    """Append validated, unseen events to a Parquet table; consent is read anew with each batch.

    Dedupe is against the whole table, so late and repeated batches are harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good = validated(batch, spark.read.parquet(consents_path), actions).where("reject_reason is null").drop("reject_reason")
        try:
            table = spark.read.schema(batch.schema).parquet(path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            table = spark.createDataFrame([], batch.schema)
        new_events(good, table).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def consented(events: DataFrame, consents: DataFrame, actor: str = "actor_id") -> DataFrame:
    """Events of actors who consent now."""
    return events.join(latest_consent(consents).select(F.col("actor_id").alias(actor)), actor, "left_semi")


def session_starts(events: DataFrame, actor: str, ts: Column, order: list[str], gap_ms: int = GAP_MS) -> DataFrame:
    """``events`` with ``session_start_ms``: a new session begins after an idle time above the gap."""
    w = Window.partitionBy(actor).orderBy("_ms", *order)
    own = events.withColumn("_ms", ts)
    new = F.col("_ms") - F.lag("_ms").over(w)
    own = own.withColumn("_start", F.when(new.isNull() | (new > gap_ms), F.col("_ms")))
    return own.withColumn("session_start_ms", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start", "_ms")


def sessions(events: DataFrame, actor: str, ts: Column, gap_ms: int = GAP_MS) -> DataFrame:
    """``actor, session_id, start_ms, end_ms, n_events``: sessions with an inclusive gap, whatever the order of arrival.

    ``session_window`` merges sessions by key with partial aggregation; an event at the very end of the gap still merges.
    """
    own = events.select(F.col(actor).alias("actor"), ts.alias("ms"))
    at = F.session_window(F.timestamp_millis("ms"), f"{gap_ms} milliseconds")
    out = own.groupBy("actor", at).agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count("*").alias("n_events"))
    return out.select("actor", F.concat(F.lit("s_"), F.col("actor").cast("string"), F.lit("_"), F.col("start_ms").cast("string")).alias("session_id"), "start_ms", "end_ms", "n_events")


def session_stream(stream: DataFrame, actor: str, ts: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream; events later than the watermark are not counted."""
    own = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return own.groupBy(actor, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select(actor, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def deduplicated_stream(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")


def redacted(text: Column, salt: Column | str) -> Column:
    """What stands for a text under the structural mode: 16 hex digits of a salted SHA-256, its type and length."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.substr(F.sha2(F.concat(salt, F.lit("\x1f"), text), 256), F.lit(1), F.lit(16))
    return F.struct(digest.alias("hash"), F.lit("text").alias("type"), F.char_length(text).alias("len"))


def recent(events: DataFrame, actor: str, value, order: list[Column], n: int) -> DataFrame:
    """The last n events of an actor."""
    return events.where(F.col(actor) == value).orderBy(*order).limit(n)


def frequent_pairs(events: DataFrame, actor: str, action: str, order: list[str], support: int) -> DataFrame:
    """``first, second, n``: adjacent actions of an actor that occur at least ``support`` times."""
    w = Window.partitionBy(actor).orderBy(*order)
    pairs = events.select(F.col(action).alias("first"), F.lead(action).over(w).alias("second")).where("second is not null")
    return pairs.groupBy("first", "second").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON Lines of envelopes: good rows, and malformed lines as text."""
    raw = spark.read.schema(SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    lines = spark.read.text(path)
    bad = lines.where(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).isNull() | ~F.trim("value").startswith("{"))
    return raw.where("_corrupt_record is null").drop("_corrupt_record"), bad


def sampled_navigation(events: DataFrame, action: str = "nav.select", per_second: int = 2) -> DataFrame:
    """All events but navigation above a rate: of a session's second the first ones and, last, the latest stay."""
    second = Window.partitionBy("session_id", F.floor(F.col("ts_ms") / 1000))
    order = Window.partitionBy("session_id", F.floor(F.col("ts_ms") / 1000)).orderBy("ts_ms", "seq")
    nav = events.where(F.col("action") == action).withColumns({"_i": F.row_number().over(order), "_n": F.count("*").over(second)})
    kept = nav.where((F.col("_i") < per_second) | (F.col("_i") == F.col("_n"))).drop("_i", "_n")
    return events.where(F.col("action").isNull() | (F.col("action") != action)).unionByName(kept)


def rate_limited(batches: DataFrame, key: str, ts_ms: str, capacity: int = 120, window_ms: int = 60_000) -> DataFrame:
    """``batches`` with ``allowed``: a token bucket per key, refilled evenly over the window."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts_ms, kind="stable")
        tokens, last, out = float(capacity), None, []
        for t in pdf[ts_ms]:
            if last is not None:
                tokens = min(capacity, tokens + (t - last) * capacity / window_ms)
            last = t
            out.append(tokens >= 1)
            tokens -= out[-1]
        return pdf.assign(allowed=out)

    return batches.groupBy(key).applyInPandas(run, batches.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", allowed boolean")


#: Literals of an unparsed formula are blanked before it is kept.
_LITERALS = r'"(?:[^"]|"")*"'


def token(action: str, payload: dict) -> str | None:
    """An event as a gesture: the action, and a formula's shape with its literals blanked; navigation has none."""
    from tabulon.plans import formula as f

    if action.startswith("nav."):
        return None
    text, at = payload.get("input") or payload.get("formula"), payload.get("addr") or payload.get("at")
    if not isinstance(text, str) or not text.startswith("="):
        return action
    try:
        blank = lambda n: f.Number(0.0) if isinstance(n, f.Number) else f.Text("") if isinstance(n, f.Text) else n
        tree = _mapped(f.parse(text), blank)
        here = f.parse_cell(at) if isinstance(at, str) else f.Cell(*(at["row"], at["col"])) if isinstance(at, dict) else f.Cell(0, 0)
        return f"{action}:{f.shape(tree, here.row, here.col)}"
    except (f.FormulaError, KeyError, TypeError):
        import re

        return f"{action}:{re.sub(_LITERALS, '', text)}"


def _mapped(node, change):
    from tabulon.plans import formula as f

    if isinstance(node, f.Call):
        return f.Call(node.name, tuple(_mapped(a, change) for a in node.args))
    if isinstance(node, f.Unary):
        return f.Unary(node.op, _mapped(node.arg, change))
    if isinstance(node, f.Binary):
        return f.Binary(node.op, _mapped(node.left, change), _mapped(node.right, change))
    return change(node)


def tokens(events: DataFrame) -> DataFrame:
    """``events`` with ``token``; events that are no gesture go."""
    import json

    def run(actions: pa.Array, payloads: pa.Array) -> pa.Array:
        out = []
        for a, p in zip(actions.to_pylist(), payloads.to_pylist(), strict=True):
            try:
                known = json.loads(p or "{}")
            except ValueError:
                known = {}
            out.append(None if a is None else token(a, known if isinstance(known, dict) else {}))
        return pa.array(out, pa.string())

    return events.withColumn("token", F.arrow_udf(run, "string")("action", "payload")).where("token is not null")
