from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from tabulon.llm import packing, simhash
from tabulon.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, docs = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{root}/{name}")
        out.append(spark.read.parquet(f"{root}/{name}"))
    return out


def ids(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_dedup", "decontamination", "packing"]
    for s in stages[1:-1]:
        assert s.columns == stages[0].columns


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    kept, before = ids(stages[1]), ids(stages[0])
    toxic = [i for i in before if labels.get(i) == 1]
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i not in kept for i in toxic) >= 0.6 * len(toxic)


def test_language_stage_keeps_texts_with_letters(stages):
    assert ids(stages[2]) == {r.doc_id for r in stages[1].collect() if re.search(r"[^\W\d_]", r.text or "")}


def test_one_document_of_each_group_stays(stages):
    rows = stages[2].collect()
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in rows}
    order = sorted(sets)
    root = {i: i for i in order}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in order:
        for j in order:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert ids(stages[3]) == {find(i) for i in order}


def test_contaminated_documents_go(spark, stages):
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    bench = [plain(r.text) for r in table(spark, SF, "benchmark").collect()]
    texts = {r.doc_id: plain(r.text) for r in stages[3].collect()}
    leaked = {i for i, t in texts.items() if any(b in t for b in bench)}
    kept = ids(stages[4])
    assert not leaked & kept
    assert texts.keys() - leaked <= kept


def test_packing_covers_what_is_left(spark, stages):
    want = defaultdict(int)
    for p in packing.pack(stages[4]).collect():
        want[p.doc_id] += p.length
    got = defaultdict(int)
    for p in stages[5].collect():
        got[p.doc_id] += p.length
    assert got == want and got.keys() == ids(stages[4])


def test_run_returns_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()


def test_stages_take_odd_tables(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "The thing and the other"), (3, "The thing and the other"), (3, "The thing and the other"), (4, "12 34")]
    for name, stage in corpus_pipeline.STAGES:
        odd = docs_of(rows)
        got = stage(spark, odd, SF)
        if name != "packing":
            assert got.columns == odd.columns
            assert len(got.collect()) <= 6
        assert stage(spark, docs_of([]), SF).collect() == []


def test_language_stage_rejects_what_no_language_knows(spark, docs_of, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in sf("documents").collect()]
    odd = [(9000, "qxzvkj wqxj zzkqv", None), (9001, "x", None), (9002, "Привет мир как дела", None), (9003, "12 34", None)]
    got = ids(corpus_pipeline.drop_unidentified(spark, docs_of(rows + odd), SF))
    assert got == {r[0] for r in rows if re.search(r"[^\W\d_]", r[1] or "")}
    unlabelled = [(i, t, None) for i, t, _ in rows + odd]
    assert ids(corpus_pipeline.drop_unidentified(spark, docs_of(unlabelled), SF)) == {r[0] for r in unlabelled}


def test_nothing_learned_keeps_all(spark, docs_of, tmp_path):
    docs = docs_of([(1, "some words", "en"), (None, None), (1, "some words", "en"), (2, "")])
    only_toxic = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    only_toxic.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 4
    assert corpus_pipeline.drop_toxic(spark, docs_of([]), str(tmp_path)).count() == 0
