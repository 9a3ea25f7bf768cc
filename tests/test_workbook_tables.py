from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tabulon.operators import augment, scratch, summary
from tabulon.streaming import store

CELLS = "workbook_id string, sheet string, r int, c int, input string"


def test_dependencies_of_ranges_and_circles(spark):
    chain = [("a", "S", 0, 0, "1")] + [("a", "S", r, 0, f"=A{r}+1") for r in range(1, 5)] + [("a", "T", 0, 0, "=SUM(s!A:A)"), ("a", "T", 1, 0, "=SUM(S!2:3)"), ("a", "T", 2, 0, "=(")]
    circle = [("b", "S", 0, 0, "=A2"), ("b", "S", 1, 0, "=A1"), ("b", "S", 2, 0, "=A1")]
    far = [("c", "S", 5000, 30, "=1"), ("c", "S", 0, 0, "=SUM(A2:ZZ9000)"), ("d", "S", 0, 0, "5")]
    rows = spark.createDataFrame(chain + circle + far, CELLS)
    got = {r.workbook_id: (r.formula_cells, r.leaf_formulas, r.max_depth, [tuple(x) for x in r.most_depended_on]) for r in summary.dependency_summary(rows).collect()}
    assert got["a"] == (7, 3, 5, [("S!A2", 3), ("S!A3", 3), ("S!A4", 2), ("S!A5", 1)])
    assert got["b"] == (3, 1, 1, [("S!A1", 2), ("S!A2", 1)])
    assert got["c"] == (2, 1, 2, [("S!AE5001", 1)])
    assert "d" not in got
    assert summary.dependency_summary(rows.limit(0)).collect() == []
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(*[summary.a1(F.lit(0), F.lit(c)) for c in (0, 25, 26, 701, 702, 16383)]))).collect()] == ["A1", "Z1", "AA1", "ZZ1", "AAA1", "XFD1"]


def test_menus_and_errors(spark):
    cells = spark.createDataFrame([("S", 0, 0, "head"), ("S", 1, 0, "b"), ("S", 2, 0, "B"), ("S", 4, 0, "b"), ("T", 1, 0, "x")], "sheet string, r int, c int, display string")
    assert [r.value for r in summary.column_values(cells, "S", (0, 0, 4, 0), 0).collect()] == ["", "B", "b"]
    assert [r.value for r in summary.column_values(cells, "S", (0, 0, 2, 0), 0).collect()] == ["B", "b"]
    assert [r.value for r in summary.column_values(cells, "S", (5, 0, 9, 0), 0).collect()] == [""]
    wrong = spark.createDataFrame([("w", "S", r, 0, "=1/0", "#DIV/0!") for r in range(40)] + [("w", "S", 50, 0, "1", None)], CELLS + ", err string")
    got = summary.errors_by_book(wrong).first()
    assert (got.total, len(got.errors), got.errors[31].r, got.errors[0].formula) == (40, 32, 31, "=1/0")


def test_variants(spark):
    rows = spark.createDataFrame([("w", "S", 0, 0, "2"), ("w", "S", 3, 0, "1.5"), ("w", "S", 3, 1, "=A1"), ("w", "S", 3, 2, "x"), ("w", "T", 9, 0, "1"), ("v", "T", 0, 0, "1")], CELLS)
    added = augment.append_rows(rows, "S", 2).where("r > 3 and sheet = 'S'").orderBy("r", "c").collect()
    assert [(r.workbook_id, r.r, r.c, r.input) for r in added] == [("w", 4, 0, "1.5"), ("w", 4, 2, "x"), ("w", 5, 0, "1.5"), ("w", 5, 2, "x")]
    assert augment.append_rows(rows, "S", 0).count() == 6
    assert sorted(r.input for r in augment.scale_literals(rows, "S", (1, 0, 9, 9), 2).collect()) == sorted(["2", "3", "=A1", "x", "1", "1"])
    changed = spark.createDataFrame([("t", "S", 0, 0), ("t", "S", 5, 5), ("u", "S", 0, 0)], "task_id string, sheet string, r int, c int")
    areas = spark.createDataFrame([("t", "s", 0, 0, 2, 2), ("t", "S", 0, 0, 0, 0)], "task_id string, sheet string, r0 int, c0 int, r1 int, c1 int")
    assert sorted((r.task_id, r.r) for r in augment.incidental_changes(changed, areas).collect()) == [("t", 5), ("u", 0)]
    variants = spark.createDataFrame([("t",), ("u",), ("n",)], "task_id string")
    graded = spark.createDataFrame([("t", 0, "NoErrors", True), ("u", 0, "NoErrors", True), ("u", 1, "CellNumber", False)], "task_id string, index int, check string, passed boolean")
    kept, rejected = augment.recipe_outcomes(variants, graded)
    assert [r.task_id for r in kept.collect()] == ["t"] and {r.task_id: r.failed for r in rejected.collect()} == {"u": ["CellNumber"], "n": None}


def test_plans_by_shape(spark):
    plans = [(["find", "fill"], ["a", "x"], "Fill the tax column"), (["find", "fill"], ["b", "x"], "fill tax again"), (["find", "fill"], ["a", None], None), (["sort"], [], "sort it")]
    got = summary.plan_shapes(spark.createDataFrame(plans, "shape array<string>, bindings array<string>, instruction string"), 2).collect()
    assert [(r.id, r.support, r.slots, r.keywords) for r in got] == [("find -> fill", 3, [["a", "b"], ["x"]], ["fill", "tax"])]


def test_times_consent_and_records(spark, tmp_path):
    at = spark.createDataFrame([(0,), (1500,), (3000,)], "ms long")
    for text in ("1500", "1970-01-01T00:00:01.5Z", "1970-01-01T02:00:01.500+02:00"):
        assert [r.ms for r in at.where(store.since(text, F.col("ms"))).collect()] == [1500, 3000]
    for text in ("yesterday", "2024-01-01", ""):
        with pytest.raises(ValueError):
            store.since(text, F.col("ms"))
    none = spark.createDataFrame([], "id long, actor_id string, mode string, at string, revoked_at string")
    first = store.record_consents(none, spark.createDataFrame([(1, "u", "full", "a"), (2, "v", "full", "a"), (3, "u", "other", "b")], "id long, actor_id string, mode string, at string"))
    after = store.record_consents(first, spark.createDataFrame([(4, "u", "off", "c"), (5, "u", "full", "d")], "id long, actor_id string, mode string, at string"))
    assert {r.id: r.revoked_at for r in after.collect()} == {1: "c", 2: None, 4: "c", 5: None}
    records = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y"), ("t", 1, "z")], "session_id string, seq int, action string")
    store.write_dataset(records, str(tmp_path / "out"), "v1", True)
    assert spark.read.json(str(tmp_path / "out/records")).count() == 3
    assert {(r.session_id, r.records, r.schema, r.consent_checked) for r in spark.read.json(str(tmp_path / "out/manifest")).collect()} == {("s", 2, "v1", True), ("t", 1, "v1", True)}


def test_states_before_and_after_edits(spark):
    from tabulon.operators.tasks import digest_chain
    from tabulon.streaming import export

    def event(session, seq, action, payload, mode="full"):
        return (session, "w", seq, action, payload, ("S", mode))

    log = [
        event("s", 0, "cell.edit", '{"addr": "A1", "input": "x"}'), event("s", 1, "nav.select", "{}"), event("s", 2, "cell.edit", '{"addr": "B1", "input": 2}'), event("s", 3, "cell.edit", '{"addr": "a1", "input": "y"}'),
        event("s", 4, "cell.clear", '{"addr": "B1"}'), event("s", 5, "cell.edit", '{"addr": "A1", "input": "x"}'), event("t", 0, "cell.edit", '{"addr": "A1", "input": {"hash": "00000000ffff", "type": "number"}}', "structural"),
        event("t", 1, "cell.edit", '{"addr": "A1", "input": {"hash": "zz", "type": "text"}}', "structural"), event("t", 2, "cell.clear", '{"addr": "A1"}', "structural"), event("t", 3, "cell.edit", None),
    ]
    out = export.transitions(spark.createDataFrame(log, "session_id string, workbook_id string, seq long, action string, payload string, context struct<sheet:string,privacy_mode:string>"))
    rows = {(r.session_id, r.seq): r for r in out.collect()}
    assert sorted(rows) == [("s", 0), ("s", 2), ("s", 3), ("s", 4), ("s", 5), ("t", 0), ("t", 1), ("t", 2)]
    assert digest_chain(out).collect() == []
    assert rows["s", 5].post_state_digest == rows["s", 0].post_state_digest and rows["t", 2].post_state_digest == rows["s", 0].pre_state_digest == rows["t", 0].pre_state_digest
    assert len({rows["s", k].post_state_digest for k in (0, 2, 3, 4)}) == 4
    assert [rows["t", k].input for k in range(3)] == [str(0xFFFF % 9000 + 1000), "'v000000", None] and rows["t", 0].values_synthetic and not rows["s", 0].values_synthetic


def test_cases_of_formulas(spark, tmp_path):
    from tabulon.operators import parity

    (tmp_path / "a.toml").write_text('[[case]]\nid = "one"\nformula = "=A1+1"\nexpect = "3"\nsource = "known"\nfunctions = ["SUM"]\nnote = "n"\n[case.given]\nA1 = "2"\n')
    (tmp_path / "b.toml").write_text('[[case]]\nid = "two"\nformula = "=1/0"\nexpect = "0"\nsource = "spec"\nknown_difference = true\nnote = "n"\n[[case]]\nid = "three"\nformula = "=2"\nexpect = "2"\nsource = "open"\nat = "?"\nnote = "n"\n')
    judged = parity.outcomes(parity.load_cases(spark, str(tmp_path)))
    assert {r.id: (r.got, r.verdict) for r in judged.collect()} == {"one": ("3", "match"), "two": ("#DIV/0!", "accepted"), "three": ("!bad address ?", "unsettled")}
    assert parity.scorecard(judged).first().asDict() == {"settled": 2, "matched": 1, "open": 1, "accepted": 1, "functions": 1}
    (tmp_path / "c.toml").write_text('[[case]]\nid = "one"\nformula = "=1"\nexpect = "1"\nsource = "known"\nnote = "n"\n')
    with pytest.raises(ValueError, match="twice"):
        parity.load_cases(spark, str(tmp_path))


def test_summaries_of_many_books_broadcast_nothing(spark, monkeypatch):
    monkeypatch.setattr(scratch, "LARGE", 1)
    rows = spark.createDataFrame([(f"b{i}", "S", r, 0, x) for i in range(9) for r, x in enumerate(("1", "=A1+1", "=SUM(A1:A2)"))], CELLS)
    got = summary.dependency_summary(rows)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.formula_cells, r.leaf_formulas, r.max_depth) for r in got.collect()} == {(2, 1, 2)} and got.count() == 9
