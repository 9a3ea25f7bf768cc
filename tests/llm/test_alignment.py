from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from tabulon.llm import alignment as al
from tabulon.llm.tokens import _byte_of, default_path

TEXTS = [
    "plain words, and more words.\nA new line; \"quoted\" it's 12345 99",
    "two  spaces", " leads", "trails ", "tab\tinside and a hard space", "line \n with spaces about it", "x\n\ny z",
    "<|endoftext|> and <s> </s> <unk> <0x41> are plain", "▁ stands for a space", "Straße été 漢字 \U0001f600 emoji",
    "näive ﬁ ligature", "\x00 nul and \x1c control\x1c x", "a", " ", "", None, "long " * 9000, "é x́y", "　wide", "ends in tab\t",
]


def brute(items):
    """The contract by its own words, with the libraries alone and byte offsets as sets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, of = Tokenizer.from_file(default_path()), _byte_of()
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=al.default_pieces())
    rows = []
    for t in items:
        raw = (" " + (t or "")).encode()
        a, b = (a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        a_raw = [bytes(of[c] for c in a_lib.id_to_token(i)) for i in a]
        b_raw = [bytes([i - b_lib.piece_to_id("<0x00>")]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            rows.append((0, 0, 0, Counter(), ""))
            continue
        spans = []
        for parts in (a_raw, b_raw):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, links, j0 = [], Counter(), 0
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            groups.append(";".join(",".join(str(i) for i, (s, e) in zip(ids, own, strict=True) if lo <= s and e <= hi) for ids, own in zip((a, b), spans, strict=True))) if len(raw) < 2000 else groups.append("")
        for x, (s, e) in zip(a, spans[0], strict=True):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j][0] < e:
                links[x, b[j]] += 1
                j += 1
        sha = hashlib.sha256("|".join(groups).encode()).hexdigest() if len(raw) < 2000 else None
        rows.append((len(a), len(b), len(ends), links, sha))
    count = Counter(p for r in rows for p in r[3])
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(na, nb, g, sum(k.values()), sum(n for p, n in k.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in k.items()), sha) for na, nb, g, k, sha in rows]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:6] == w[:6] and (w[6] is None or g[6] == w[6])


@pytest.mark.parametrize("head", [0, 40, al.HEAD])
def test_digest_equals_brute_force(spark, docs_of, head):
    items = TEXTS + TEXTS[:3]
    got = al.digest(docs_of(list(enumerate(items))), head=head).orderBy("doc_id").collect()
    same([tuple(r)[1:8] for r in got], brute(items))


def test_digest_of_documents(spark, sf):
    rows = sf("documents").select("doc_id", "text").where("length(text) < 1800").orderBy("doc_id").collect()
    got = al.digest(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    same([tuple(r)[1:8] for r in got], brute([r.text for r in rows]))


def test_units_forgotten_change_nothing(monkeypatch):
    own = al.Aligner(default_path(), al.default_pieces())
    want = own.align(["a b c d", "b  c", "d a"])
    monkeypatch.setattr(al, "MOST_UNITS", 1)
    for text, groups in zip(["a b c d", "b  c", "d a"], want[0], strict=True):
        assert own.align([text])[0] == [groups]


def test_null_ids_repeated_rows_and_no_rows(spark, docs_of):
    got = al.digest(docs_of([(None, "x y"), (1, "x y"), (1, "x y"), (2, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_a) for r in got) == [(0, 2), (1, 2), (1, 2), (2, 0)]
    assert {r.count_sum for r in got if r.n_a} == {6}
    assert al.digest(docs_of([])).count() == 0


def test_query_has_the_marks_of_its_contract(spark, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    from tabulon.llm import queries

    # digits are single tokens of B, and inside a long word A and B may end together only at its end
    text = "12345 apples and pseudopolynomial x"
    a_lib, b_lib = Tokenizer.from_file(default_path()), sentencepiece.SentencePieceProcessor(model_file=al.default_pieces())
    own = al.Aligner(default_path(), al.default_pieces())
    a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
    ends = [[sum(len(size[i]) for i in ids[: n + 1]) for n in range(len(ids))] for ids, size in ((a, own.a_bytes), (b, own.b_bytes))]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        to_i, to_j = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
        i, j = to_i, to_j
    assert len(groups) > 2 and any("," in g for g in groups)
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.groups_sha256 for r in queries.op11_alignment(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(";".join(groups).encode()).hexdigest(), 2: ""}
