from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F
from tabulon.operators import cells, lookup, table
from tabulon.plans import formula as f
from tabulon.sources import files
from tabulon.streaming import events as log
from tabulon.streaming import mining


def sheet(spark, inputs, name="S"):
    rows = [(name, c.row, c.col, x) for a, x in inputs.items() for c in [f.parse_cell(a)]]
    return spark.createDataFrame(rows, cells.SCHEMA)


def shown(frame, name="S"):
    return {f.column_letters(r.c) + str(r.r + 1): r.input for r in frame.collect() if r.sheet == name}


def test_structural_edits(spark):
    s = sheet(spark, {"A1": "1", "A5": "=A1+A9", "B2": "=SUM(A1:A5)", "C1": "='x"})
    assert shown(cells.insert(s, "row", "S", 1, 2)) == {"A1": "1", "A7": "=A1+A11", "B4": "=SUM(A1:A7)", "C1": "='x"}
    assert shown(cells.delete(s, "row", "S", 0, 1)) == {"A4": "=#REF!+A8", "B1": "=SUM(A1:A4)"}
    assert shown(cells.delete(cells.insert(s, "col", "S", 0, 3), "col", "S", 0, 3)) == shown(s)
    assert shown(cells.paste(s, "S", (4, 0, 4, 0), (5, 1)))["B6"] == "=B2+B10"
    assert shown(cells.paste(s, "S", (4, 0, 4, 0), (5, 1), cut=True)).get("A5") is None
    assert shown(cells.edit(s, "S", 0, 0, "7"))["A1"] == "7"
    assert shown(cells.merge(s, "S", 0, 0, 4, 1)) == {"A1": "1", "C1": "='x"}
    assert shown(cells.find_replace(s, "a1", "B7"))["A5"] == "=B7+A9"
    two = s.unionByName(sheet(spark, {"A1": "=S!A1*2"}, "T"))
    assert shown(cells.rename_sheet(two, "s", "New One"), "T") == {"A1": "='New One'!A1*2"}
    assert shown(cells.delete_sheet(two, "S"), "T") == {"A1": "=#REF!*2"}


def test_typed_inputs_and_shapes(spark):
    s = sheet(spark, {"A1": "12%", "A2": "'12", "A3": "true", "A4": "#N/A", "A5": "=A1", "A6": "x", "A7": "1e3", "A8": "=A4"})
    got = {r.r: (r.kind, r.n, r.s, r.b, r.err) for r in cells.typed(s).collect()}
    assert got[0] == ("num", 0.12, None, None, None) and got[1] == ("text", None, "12", None, None)
    assert got[2][3] is True and got[3][4] == "#N/A" and got[4][0] == "formula" and got[6][1] == 1000
    shapes = {r["shape"]: (r.n, r.first_r) for r in cells.shapes(s).collect()}
    assert shapes == {"R[-4]C[0]": (2, 4)}


def test_csv_and_workbook(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,,"x, y"\n=A1*2\n=SUM(,"q""r"\n', encoding="utf-8")
    got = {(r.r, r.c): (r.input, r.quarantined) for r in files.read_csv_cells(spark, f"file://{tmp_path}/a.csv").collect()}
    assert got == {(0, 0): ("1", False), (0, 2): ("x, y", False), (1, 0): ("=A1*2", False), (2, 0): ("'=SUM(", True), (2, 1): ('q"r', False)}
    sheets = {"One": {(0, 0): "1", (0, 1): "=A1*2", (2, 0): "a<b & c", (3, 0): "'12", (4, 0): "TRUE", (5, 0): "#N/A"}, "T & 2": {(0, 0): "é"}}
    (tmp_path / "b.xlsx").write_bytes(files.workbook_bytes(sheets))
    back: dict = {}
    for r in files.read_workbooks(spark, f"file://{tmp_path}/b.xlsx").collect():
        back.setdefault(r.sheet, {})[r.r, r.c] = r.input
    assert back == sheets
    wide = spark.createDataFrame([(0, 0, "a"), (0, 1, "b,c"), (2, 1, "z")], "r int, c int, value string")
    files.write_csv_cells(wide, f"file://{tmp_path}/out", 2)
    lines = [x for p in sorted((tmp_path / "out").glob("part*")) for x in p.read_text().splitlines()]
    assert lines == ['a,"b,c"', ",z"]


def test_clipboard(spark):
    rows = [["a", 'q"x'], ["line\nend", "tab\there"]]
    assert files.from_tsv(files.to_tsv(rows)) == rows
    html = "<table><tr><th>a&amp;b<th>c</tr><tr><td>1<br>2</td></tr></table><table><tr><td>no</td></tr></table>"
    assert files.html_table(html) == [["a&b", "c"], ["1\n2", ""]]
    got = files.page_tables(spark.createDataFrame([(1, html), (2, None)], "k long, h string"), "k", "h").collect()
    assert {(r.r, r.c): r.value for r in got} == {(0, 0): "a&b", (0, 1): "c", (1, 0): "1\n2", (1, 1): ""}


def test_ranks_totals_and_lookups_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.choice([1, 2, 2, 5, 9, rng.random() * 100]))) for i in range(500)] + [(500, None)]
    df = spark.createDataFrame(rows, "i int, x double")
    values = [x for _, x in rows if x is not None]
    for up in (True, False):
        got = {r.i: r["rank"] for r in table.rank_rows(df, "x", ascending=up, parts=8).collect()}
        assert got == {i: None if x is None else 1 + sum((v < x) if up else (v > x) for v in values) for i, x in rows}
    total = {r.i: r.running for r in table.running_total(df, "i", "x", parts=8).collect()}
    assert all(abs(total[i] - sum(x or 0 for j, x in rows if j <= i)) < 1e-6 for i, _ in rows)
    dim = spark.createDataFrame([(k, f"b{k}") for k in (2.0, 5.0, 40.0, 60.0)], "k double, name string")
    bands = {r.i: r.band for r in lookup.approximate_lookup(df, "x", dim, "k", {"band": "name"}, parts=8).collect()}
    assert bands == {i: None if x is None or x < 2 else "b" + str(max(k for k in (2.0, 5.0, 40.0, 60.0) if k <= x)) for i, x in rows}
    twice = spark.createDataFrame([(1, "A", 10), (2, "a", 20), (3, "b", None)], "p int, k string, v int")
    found = lookup.exact_lookup(spark.createDataFrame([("a",), ("B",), ("z",), (None,)], "k string"), "k", twice, "k", {"w": "v"}, "p", F.lit(-1)).collect()
    assert {r.k: r.w for r in found} == {"a": 10, "B": None, "z": -1, None: -1}


def test_sort_puts_blanks_last(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "A"), (4, "a")], "p int, t string")
    assert [r.p for r in table.sort_rows(df, [("t", True)], "p").collect()] == [3, 4, 1, 2]
    assert [r.p for r in table.sort_rows(df, [("t", False)], "p").collect()] == [1, 3, 4, 2]


ACTIONS = ["cell.edit", "nav.select"]


def envelope(event_id, actor="u", action="cell.edit", seq=1, mode="structural", version=1):
    return (version, event_id, "s", actor, "w", seq, 1000, action, "{}", ("S", "A1", mode), "c")


def test_validation_order(spark):
    consents = spark.createDataFrame([(1, "u", "full", None), (2, "u", "structural", None), (3, "off", "off", None), (4, "gone", "full", 5)], "id int, actor_id string, mode string, revoked_at int")
    rows = [envelope("1"), envelope("2", "off"), envelope("3", "gone"), envelope("4", mode="full"), envelope("5", action="x"), envelope("6", version=2), envelope("", seq=3), envelope("8", seq=-1), envelope("9", None)]
    got = [r.reject_reason for r in log.validated(spark.createDataFrame(rows, log.SCHEMA), consents, ACTIONS).orderBy("event_id").collect()]
    assert sorted(map(str, got)) == sorted(map(str, ["event_id", None, "consent", "consent", "mode", "action", "version", "seq", "actor"]))


def test_stream_ingest_is_idempotent(spark, tmp_path):
    spark.createDataFrame([(1, "u", "structural", None)], "id int, actor_id string, mode string, revoked_at int").write.parquet(f"{tmp_path}/consents")
    for rows in ([envelope("a"), envelope("a"), envelope("b", "stranger")], [envelope("a"), envelope("c")]):
        spark.createDataFrame(rows, log.SCHEMA).write.mode("append").json(f"{tmp_path}/in")
        q = log.ingest_stream(spark.readStream.schema(log.SCHEMA).json(f"{tmp_path}/in"), f"{tmp_path}/events", f"{tmp_path}/check", f"{tmp_path}/consents", ACTIONS)
        q.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/events").collect()) == ["a", "c"]


def test_session_gap_is_inclusive(spark):
    e = spark.createDataFrame([("u", t) for t in (0, 599_999, 1_199_999, 1_800_000)], "a string, t long")
    got = sorted((r.start_ms, r.end_ms, r.n_events) for r in log.sessions(e, "a", F.col("t")).collect())
    assert got == [(0, 1_199_999, 3), (1_800_000, 1_800_000, 1)]
    starts = sorted(r.session_start_ms for r in log.session_starts(e, "a", F.col("t"), []).collect())
    assert starts == [0, 0, 0, 1_800_000]


def test_streams_of_sessions_and_unique_events(spark, tmp_path):
    e = spark.createDataFrame([(1, "u", 0), (1, "u", 0), (2, "u", 300), (3, "u", 5000)], "id int, a string, s long").select("id", "a", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    e.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")
    q = log.deduplicated_stream(stream, "id", "ts").writeStream.format("memory").queryName("unique_events").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("unique_events").collect()) == [1, 2, 3]
    q = log.session_stream(stream, "a", "ts").writeStream.format("memory").queryName("own_sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert all(r.n_events == 3 for r in spark.table("own_sessions").collect())


def test_planted_patterns(spark):
    """Each case is an actor of its own; actors share nothing."""
    cases = [
        (["select sum bold " * 5 + "x"], [("loop", "select sum bold", 5, 5)]),
        (["open p fill save", "open q fill save", "open r fill save a b"], [("recurring", "open fill save", 3, 3)]),
        (["a b", "a b"], []),
        # a session counts once, and a match ends with its session
        (["x a", "b y a", "b z a", "b"], []),
        # a gap of one step, not of two; what a loop explains keeps its place
        (["a p q b", "a r s b", "a t u b"], []),
        (["a p p p b", "a q q q b", "a r r r b"], [("loop", t, 3, 3) for t in "pqr"]),
        # a b stands within a x b as a subsequence
        (["a x b", "a x b", "a x b"], [("recurring", "a x b", 3, 3)]),
        # two single steps are no loop, two pairs are; equal loops add up
        (["a a", "b c b c", "b c b c b c"], [("loop", "b c", 5, 5)]),
    ]
    rows = [(n, k, i, t) for n, (sessions, _) in enumerate(cases) for k, tokens in enumerate(sessions) for i, t in enumerate(tokens.split())]
    steps = spark.createDataFrame([*rows, (0, 0, 99, None)], "actor int, session long, i long, token string")
    got = mining.mine(steps, ["actor"], "session", "token", ["i"]).collect()
    for n, (_, want) in enumerate(cases):
        assert sorted((r.kind, " ".join(r.tokens), r.support, r.n_spans) for r in got if r.actor == n) == want
    assert mining.mine(steps.where("actor < 0"), ["actor"], "session", "token", ["i"]).collect() == []


def test_recurring_patterns_equal_brute_force(spark):
    """Every word over three letters, matched by its first step after step."""
    rng = random.Random(5)
    sessions = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(7)]

    def holds(tokens, word):
        at = tokens.find(word[0]) + 1
        for t in word[1:] if at else "":
            near = tokens[at : at + 2].find(t)
            if near < 0:
                return False
            at += near + 1
        return at > 0

    inside = lambda a, b: len(a) < len(b) and all(t in it for it in [iter(b)] for t in a)
    words = [w for n in range(2, 8) for w in map("".join, itertools.product("abc", repeat=n))]
    shared = {w: n for w in words if (n := sum(holds(s, w) for s in sessions)) >= 3}
    rows = [("u", k, list(s), [True] * len(s)) for k, s in enumerate(sessions)]
    got = mining.recurring(spark.createDataFrame(rows, "key string, session long, tokens array<string>, free array<boolean>"))
    assert {"".join(r.tokens): r.support for r in got.collect()} == {w: n for w, n in shared.items() if not any(inside(w, v) for v in shared)} != {}


def test_patterns_by_minutes(spark):
    found = spark.createDataFrame([("loop", ["a", "b"], 20, 20), ("recurring", ["a", "c"], 3, 30), ("loop", ["c"], 3, 3)], "kind string, tokens array<string>, support long, n_spans long")
    seconds = spark.createDataFrame([("a", 6.0), ("b", 5.5)], "token string, seconds double")
    got = mining.ranked(mining.scored(found, seconds)).collect()
    assert [(r.tokens, round(r.minutes, 6)) for r in got] == [(["a", "c"], round((7.5 * 30 - 8) / 60, 6)), (["a", "b"], round((10 * 20 - 8) / 60, 6))]


def test_diff_and_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, None)], "k int, v string")
    got = {r.k: r.change for r in lookup.diff(a, b, ["k"], ["v"]).collect()}
    assert got == {2: "changed", 3: "removed", 4: "added"}
    d = spark.createDataFrame([(1, "A"), (2, "a"), (3, None), (4, None), (5, "c")], "k int, v string")
    assert {r.k: r.duplicate for r in table.duplicates(d, "v").collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_lookups_of_named_tables(spark):
    rates = table.Table(spark.createDataFrame([("basic", 120.0, 0), ("plus", 300.0, 1), ("PLUS", 1.0, 2), ("pro", None, 3)], "tier string, owed double, p int"), position="p")
    bands = table.Table(spark.createDataFrame([(0.0, "low", 0), (100.0, "mid", 1), (200.0, "high", 2)], "at double, name string, p int"), position="p")
    df = spark.createDataFrame([(0, "Plus", 150.0), (1, "none", -5.0), (2, "pro", 200.0)], "pos int, tier string, x double")
    t = table.Table(df, position="pos", tables={"Rates": rates, "Bands": bands})
    out = t.derive(
        {"v": "VLOOKUP({tier},Rates,2,FALSE)", "w": 'XLOOKUP({tier},Rates.tier,Rates.owed,"no")', "b": "VLOOKUP({x},Bands,2,TRUE)", "m": "MATCH({tier},Rates.tier,0)", "i": "INDEX(Bands.name,2)", "j": "IFERROR(INDEX(Bands,9,1),0)", "n": "ROWS(Bands)*ROW()", "l": "LOOKUP({x},Bands.at,Bands.name)"},
        errors="display",
    ).frame.orderBy("pos").collect()
    assert [tuple(r[k] for k in "vwbmijnl") for r in out] == [("300", "300", "mid", "2", "mid", "0", "3", "mid"), ("#N/A", "no", "#N/A", "#N/A", "mid", "0", "6", "#N/A"), ("0", "", "high", "4", "mid", "0", "9", "high")]


def test_formulas_that_give_arrays(spark):
    df = spark.createDataFrame([(0, "b", 2.0), (1, "A", 1.0), (2, "a", 3.0), (3, None, 4.0)], "p int, t string, x double")
    t = table.Table(df, position="p")
    column = lambda text: [r[0] for r in t.spill(text).collect()]
    assert column("UNIQUE({t})") == ["b", "A", None]
    assert column("UNIQUE({t},FALSE,TRUE)") == ["b", None]
    assert column("SORT({t})") == ["A", "a", "b", None]
    assert column("SORTBY({t},{x},-1)") == [None, "a", "b", "A"]
    assert sorted(column("FILTER({x}*10,{x}>1)")) == [20.0, 30.0, 40.0]
    assert [tuple(r) for r in t.spill("SEQUENCE(2,2,5)").orderBy("r", "c").collect()] == [(0, 0, 5.0), (0, 1, 6.0), (1, 0, 7.0), (1, 1, 8.0)]
    pieces = t.spill('TEXTSPLIT("x-y-"&{t},"-")').orderBy("_pos", "pos").collect()
    assert [r.piece for r in pieces][:3] == ["x", "y", "b"]


def test_gestures_rates_and_samples(spark):
    rows = [envelope(str(i), action=a, seq=i)[:6] + (100 * i, a, p, ("S", "A1", "full"), "c") for i, (a, p) in enumerate([
        ("cell.edit", '{"input": "=B1*2+\\"x\\"", "addr": "A1"}'), ("cell.edit", '{"input": "=B2*9+\\"yy\\"", "addr": "A2"}'), ("nav.select", "{}"), ("nav.select", "{}"), ("nav.select", "{}"), ("format.apply", None), ("cell.edit", "not json"), ("cell.edit", '{"input": "=SUM(\\"secret\\""}'),
    ])]
    e = spark.createDataFrame(rows, log.SCHEMA)
    got = [r.token for r in log.tokens(e).orderBy("seq").collect()]
    assert got[0] == got[1] == 'cell.edit:R[0]C[1]*0+""' and got[2:] == ["format.apply", "cell.edit", "cell.edit:=SUM("]
    assert sorted(r.seq for r in log.sampled_navigation(e).collect()) == [0, 1, 2, 4, 5, 6, 7]
    b = spark.createDataFrame([("u", t) for t in (0, 1, 2, 45, 90)], "k string, t long")
    assert [r.allowed for r in log.rate_limited(b, "k", "t", capacity=2, window_ms=80).orderBy("t").collect()] == [True, True, False, True, True]
