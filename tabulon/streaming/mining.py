"""Repeated gestures: tandem loops within a session, and sequences that recur over sessions with gaps.

A session is a row: its steps in order. Loops are found session by session and added up. Recurring
sequences grow a step at a time for all sessions at once: a join of where each prefix's match ends with
what may come next there, and an aggregation that keeps what enough sessions share.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.scratch import settle

#: Fixed parameters: support, shortest and longest pattern, steps a match may skip.
SUPPORT, SHORTEST, LONGEST, SKIP = 3, 2, 12, 1

_LOOPS = pa.list_(pa.struct([("tokens", pa.list_(pa.string())), ("repeats", pa.int32()), ("start", pa.int32())]))


def primitive(word: tuple[str, ...]) -> bool:
    """Whether a word isn't itself a repetition."""
    n = len(word)
    return not any(n % p == 0 and word == word[:p] * (n // p) for p in range(1, n))


def loops(tokens: list[str], support: int = SUPPORT, shortest: int = SHORTEST, longest: int = LONGEST) -> list[tuple[tuple[str, ...], int, int]]:
    """(word, repeats, start) of the words that a session repeats back to back.

    The longest words are taken first and runs don't overlap. Two repeats are a loop; for a
    word shorter than ``shortest``, ``support`` of them.
    """
    n, taken, found = len(tokens), [False] * len(tokens), []
    for period in range(min(longest, n // 2), 0, -1):
        # same[i]: how many steps from i on equal the step a period later
        same = [0] * (n + 1)
        for i in range(n - period - 1, -1, -1):
            same[i] = same[i + 1] + 1 if tokens[i] == tokens[i + period] else 0
        i = 0
        while i + 2 * period <= n:
            word, repeats = tuple(tokens[i : i + period]), 1 + same[i] // period
            end = i + repeats * period
            if repeats < 2 or any(taken[i:end]) or not primitive(word):
                i += 1
                continue
            taken[i:end] = [True] * (end - i)
            if period >= shortest or repeats >= support:
                found.append((word, repeats, i))
            i = end
    return found


def spans(tokens: list[str], word: list[str], free: list[bool], skip: int = SKIP) -> list[tuple[int, int]]:
    """Matches of a word in a session that don't overlap; up to ``skip`` steps may lie between two of its steps."""
    out, i, n = [], 0, len(tokens)
    while i < n:
        at = i if free[i] and tokens[i] == word[0] else -1
        for t in word[1:] if at >= 0 else ():
            at = next((j for j in range(at + 1, min(n, at + 2 + skip)) if free[j] and tokens[j] == t), -1)
            if at < 0:
                break
        if at >= 0:
            out.append((i, at + 1))
        i = at + 1 if at >= 0 else i + 1
    return out


def session_rows(steps: DataFrame, keys: list[str], session: str, token: str, order: list[str]) -> DataFrame:
    """``key, session, tokens``: a session's steps in order; steps without a token aren't any."""
    step = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.col(token).cast("string").alias("token"))
    rows = steps.where(F.col(token).isNotNull()).groupBy(F.struct(*keys).alias("key"), F.col(session).alias("session"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["token"]).alias("tokens"))


def with_loops(rows: DataFrame, support: int = SUPPORT, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """``rows`` with ``loops`` and ``free``: which steps no loop explains."""

    def run(column: pa.Array) -> pa.Array:
        found = [[{"tokens": list(w), "repeats": k, "start": i} for w, k, i in loops(t, support, shortest, longest)] for t in column.to_pylist()]
        return pa.array(found, _LOOPS)

    kind = "array<struct<tokens: array<string>, repeats: int, start: int>>"
    inside = lambda i: F.exists("loops", lambda x: (i >= x["start"]) & (i < x["start"] + x["repeats"] * F.size(x["tokens"])))
    return rows.withColumn("loops", F.arrow_udf(run, kind)("tokens")).withColumn("free", F.transform("tokens", lambda _, i: ~inside(i)))


def _next(at: Column, skip: int) -> Column:
    """What may follow a match that ends before ``at``: of each token's free steps within reach the first."""
    reach = F.filter(F.slice("steps", at + 1, skip + 1), lambda s: s["free"])
    return F.filter(reach, lambda s, i: F.array_position(F.transform(reach, lambda x: x["token"]), s["token"]) == i + 1)


def _subsequences(word: Column) -> Column:
    """All subsequences of a word; 2 to the power of its length at most, which LONGEST bounds."""
    none = F.array(F.array().cast("array<string>"))
    return F.aggregate(word, none, lambda found, t: F.array_distinct(F.concat(found, F.transform(found, lambda x: F.concat(x, F.array(t))))))


def recurring(rows: DataFrame, support: int = SUPPORT, shortest: int = SHORTEST, longest: int = LONGEST, skip: int = SKIP) -> DataFrame:
    """``key, tokens, support``: sequences that at least ``support`` sessions of a key share, without those within a longer one.

    ``rows``: key, session, tokens, free. A session counts once, by its first match of each step
    in turn. A step that isn't free matches nothing but takes its place.
    """
    steps = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), F.get("free", i).alias("free"), (i + 1).alias("to")))
    rows = rows.select("key", "session", steps.alias("steps"))
    ends = F.explode(F.sequence(F.lit(1), F.size("steps") - 1))
    follow = settle(rows.where(F.size("steps") > 1).select("key", "session", "steps", ends.alias("at")).select("key", "session", "at", _next(F.col("at"), skip).alias("next")), "mining-next")
    first = rows.select("key", "session", F.explode("steps").alias("s")).where("s.free").groupBy("key", "session", "s.token").agg(F.min("s.to").alias("at"))
    grown = first.select("key", "session", F.array("token").alias("tokens"), "at")
    found = None
    for length in range(1, longest + 1):
        grown = settle(grown, "mining-ends")
        shared = settle(grown.groupBy("key", "tokens").agg(F.count("*").alias("support")).where(F.col("support") >= support), "mining-shared")
        found = shared if found is None else found.unionAll(shared)
        if length == longest or shared.isEmpty():
            break
        grown = grown.join(shared.select("key", "tokens"), ["key", "tokens"], "left_semi").join(follow, ["key", "session", "at"])
        grown = grown.select("key", "session", "tokens", F.explode("next").alias("s")).select("key", "session", F.concat("tokens", F.array("s.token")).alias("tokens"), F.col("s.to").alias("at"))
    # a word's beginnings are shared too, so that the words no other begins with stand for all that are longer
    begun = found.where(F.size("tokens") > 1).select("key", F.slice("tokens", 1, F.size("tokens") - 1).alias("tokens"))
    whole = found.where(F.size("tokens") > shortest).join(begun, ["key", "tokens"], "left_anti")
    inner = whole.select("key", F.col("tokens").alias("word"), F.explode(_subsequences(F.col("tokens"))).alias("tokens")).where((F.size("tokens") >= shortest) & (F.size("tokens") < F.size("word")))
    return found.where(F.size("tokens") >= shortest).join(inner.select("key", "tokens").distinct(), ["key", "tokens"], "left_anti")


def _count_spans(rows: DataFrame, patterns: DataFrame, skip: int) -> DataFrame:
    """``patterns`` with ``n_spans``: a pattern meets the sessions that hold its first step."""

    def run(tokens: pa.Array, word: pa.Array, free: pa.Array) -> pa.Array:
        return pa.array([len(spans(t, w, f, skip)) for t, w, f in zip(tokens.to_pylist(), word.to_pylist(), free.to_pylist(), strict=True)], pa.int64())

    held = rows.select("key", F.col("tokens").alias("steps"), "free", F.explode(F.array_distinct("tokens")).alias("first"))
    met = patterns.withColumn("first", F.get("tokens", F.lit(0))).join(held, ["key", "first"])
    return met.withColumn("n", F.arrow_udf(run, "long")("steps", "tokens", "free")).groupBy("key", "tokens", "support").agg(F.sum("n").alias("n_spans"))


def mine(steps: DataFrame, keys: list[str], session: str, token: str, order: list[str], support: int = SUPPORT, shortest: int = SHORTEST, longest: int = LONGEST, skip: int = SKIP) -> DataFrame:
    """``*keys, kind, tokens, support, n_spans``: loops, and what recurs beside them.

    ``keys`` (an actor and a workbook, say) share nothing. A loop's support is how often its word is
    repeated, that of a recurring pattern the number of sessions. What loops explain can't match a
    recurring pattern, and a pattern that restates a loop isn't listed again. No steps, no patterns.
    """
    rows = settle(with_loops(session_rows(steps, keys, session, token, order), support, shortest, longest), "mining-sessions")
    runs = rows.select("key", F.explode("loops").alias("x")).groupBy("key", F.col("x.tokens").alias("tokens"))
    looped = runs.agg(F.sum("x.repeats").alias("support"), F.sum("x.repeats").alias("n_spans"))
    new = recurring(rows, support, shortest, longest, skip).join(looped.select("key", "tokens"), ["key", "tokens"], "left_anti")
    both = looped.withColumn("kind", F.lit("loop")).unionByName(_count_spans(rows, new, skip).withColumn("kind", F.lit("recurring")))
    return both.select("key.*", "kind", "tokens", "support", "n_spans")


def minutes_saved(steps_seconds: Column, occurrences: Column, replay_seconds: float = 1.5, review_seconds: float = 8.0) -> Column:
    """What a routine saves: the gestures' time less the replay's, for each occurrence, less one review; never below 0."""
    each = F.greatest(steps_seconds - F.lit(replay_seconds), F.lit(0.0))
    return F.greatest((each * occurrences - F.lit(review_seconds)) / 60, F.lit(0.0))


def scored(patterns: DataFrame, seconds: DataFrame, default_seconds: float = 3.0) -> DataFrame:
    """``patterns`` of :func:`mine` with ``minutes``: ``seconds`` (token, seconds) says what a gesture takes by hand, ``default_seconds`` stands for others.

    A loop occurs as often as it is repeated, a recurring pattern as often as it is found, at least once in each of its sessions.
    """
    own = [c for c in patterns.columns if c != "n_spans"]
    each = patterns.withColumn("_token", F.explode("tokens")).join(seconds.select(F.col("token").alias("_token"), F.col("seconds").alias("_seconds")), "_token", "left")
    known = each.groupBy(*own, "n_spans").agg(F.sum(F.coalesce("_seconds", F.lit(default_seconds))).alias("_seconds"))
    return known.withColumn("minutes", minutes_saved(F.col("_seconds"), F.greatest("n_spans", "support"))).drop("_seconds")


def ranked(patterns: DataFrame, least_minutes: float = 2.0) -> DataFrame:
    """Patterns (with ``minutes``, ``support``, ``tokens``) worth proposing: those that save enough, the most first."""
    return patterns.where(F.col("minutes") >= least_minutes).orderBy(F.desc("minutes"), F.desc("support"), F.concat_ws(">", "tokens"))
