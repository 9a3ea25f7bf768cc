from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tabulon.llm import brownlm, decontaminate, langid, lengths, licences, packing, toxicity
from tabulon.llm.tokens import default_path, encoder


def mod(doc_id, n):
    return zlib.crc32(str(doc_id if doc_id is not None else "null").encode()) % n


# --- licences

def brute_licence(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = []
    for phrase, label in licences.BASE_PHRASES:
        p = phrase.split()
        at += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licence_base_equals_brute_force(docs_of, sf):
    rows = [(r.doc_id, r.text) for r in sf("documents").collect()]
    rows += [(5000, None), (5001, ""), (5002, "MIT License. GNU General-Public/License; mit\nlicense MIT é license"), (5003, "mit license " * 5000), (5002, "Apache  License"), (None, "xmit license mit licenses")]
    rows.append((5004, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"))
    rows.append((5005, "All rights reserved. Licensed under CC BY-NC 4.0. free of charge, granted permission hereby"))
    got = licences.scan(docs_of(rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:3])
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted([(i, *brute_licence(t)) for i, t in rows], key=key)
    own = {r.doc_id: r for r in got}
    assert own[5004].labels == "mit" and own[5004].base_labels == "" and 0.75 <= own[5004].score <= 1
    assert own[5005].labels == "cc-by-nc,proprietary"
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licences.scan(docs_of([])).collect() == []


def test_licence_labels_equal_brute_force(docs_of):
    rng = random.Random(5)
    found, filler = licences.templates(), ["software", "the", "license", "public", "foo", "permission", "any"]
    rows = []
    for i in range(240):
        words = rng.choices(filler, k=rng.randrange(30))
        for t in rng.sample(found, rng.randrange(3)):
            part = [w.decode() if rng.random() > 0.08 else rng.choice(filler) for w in t.words]
            words += part[rng.choice([0, 0, 0, 3]) :] + rng.choices(filler, k=rng.randrange(4))
        rows.append((i, " ".join(words)))
    rows.append((999, " ".join("all rights reserved mit license" for _ in range(20_000))))

    def labels(words):
        out = {}
        for t in found:
            for s in range(-len(t.words), len(words) if not t.base else 0):
                k = s + t.key_at
                if k < 0 or tuple(words[k : k + len(t.key)]) != t.key:
                    continue
                same = sum(0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(t.words)) / len(t.words)
                if same >= 0.75:
                    out[t.label] = max(out.get(t.label, 0), same)
        return out

    for r in licences.scan(docs_of(rows)).collect():
        if r.doc_id == 999:
            assert (r.n_base, r.labels) == (20_000, "mit,proprietary")
            continue
        words = licences.words_of(rows[r.doc_id][1])
        want = labels(words)
        assert set(filter(None, r.labels.split(","))) == want.keys() | set(filter(None, r.base_labels.split(",")))
        assert r.score == (1.0 if r.n_base else max(want.values(), default=0.0))


# --- language ID

def test_predictions_equal_brute_force(docs_of, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in sf("documents").collect()]

    def grams(text):
        raw = re.sub("[\t\n\r\x0b\x0c]", " ", (text or "").lower()).encode()
        raw = b"  " + raw + b"  "
        ok = lambda w: all(c == 32 or 97 <= c <= 122 or c >= 128 for c in w) and w != b"    "
        return [raw[i : i + 4] for i in range(len(raw) - 3) if ok(raw[i : i + 4])]

    counts = defaultdict(Counter)
    for i, t, la in rows:
        if la is not None and mod(i, 3) != 1:
            counts[la].update(grams(t))
    share = {la: {w: n / c.total() for w, n in c.items()} for la, c in counts.items()}
    top = Counter()
    for c in share.values():
        for w, p in c.items():
            top[w] = max(top[w], p)
    knows = {la: {w for w, p in share[la].items() if p >= 0.25 * top[w] and c[w] >= 2} for la, c in counts.items()}
    got = {r.doc_id: r for r in langid.identify(docs_of(rows)).collect()}
    close = 0
    for i, t, _ in rows:
        g = grams(t)
        part = {la: sum(w in k for w in g) / max(len(g), 1) for la, k in knows.items()}
        first, second = sorted(part.values(), reverse=True)[:2]
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
        elif first - second > 1e-3:  # the filter has a few false positives
            close += 1
            assert part[got[i].lang_pred] == first
            assert got[i].score == pytest.approx(0.5 + 0.5 * (first - second) / first, abs=2e-3)
    assert close > 0.9 * len(rows)


def test_language_held_out_accuracy_and_edges(docs_of, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in sf("documents").collect()]
    edges = [(9000, None, "en"), (9001, "", "en"), (9002, "123 !?", "fr"), (9003, "le " * 200_000, None), (None, "The thing and the other", None), (0, rows[0][1], rows[0][2])]
    got = langid.identify(docs_of(rows + edges)).collect()
    assert len(got) == len(rows) + len(edges)
    assert all(r.held_out == (mod(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (9000, 9001, 9002)] == ["und"] * 3
    held = [(by[i], lang) for i, _, lang in rows if mod(i, 3) == 1]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert langid.identify(docs_of([])).collect() == []
    assert [r.lang_pred for r in langid.identify(docs_of([(1, "abc", None)])).collect()] == ["und"]


def test_language_windows_do_not_cross_texts():
    both, n = langid.windows(["ab cd", "", "efg 1 hi"])
    alone = [langid.windows([t])[0] for t in ("ab cd", "", "efg 1 hi")]
    assert n.tolist() == [len(a) for a in alone]
    assert both.tolist() == np.concatenate(alone).tolist()


# --- packing and lengths

def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path()).encode(text or "", add_special_tokens=False).ids


ODD = ["naïve Ünïcode 你好 🙂 x\x1cy", "a  b\n\n\n c\t<|endoftext|> 's 'S don't", " line sep ½ ǅ", "", "x" * 5000, "1234567 ,,,,;; ''"]


def test_encoder_equals_the_library(sf):
    ids = encoder(default_path()).ids
    for t in [r.text for r in sf("documents").limit(60).collect()] + ODD:
        assert np.frombuffer(ids(t), "<u4").tolist() == ids_of(t)


def test_packing_round_trip(docs_of, sf):
    rows = [(r.doc_id, r.text) for r in sf("documents").collect()] + [(7000 + i, t) for i, t in enumerate(ODD)] + [(8000, None), (None, "none")]
    pieces = packing.pack(docs_of(rows)).collect()
    tokens = {i: [*ids_of(t), 0] for i, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        own = tokens[p.doc_id][p.start : p.start + p.length]
        assert p.length > 0 and zlib.crc32(np.array(own, "<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(tokens[p.doc_id])
    assert by_doc.keys() == tokens.keys()
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(tokens[i])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(docs_of([])).collect() == []
    twice = packing.pack(docs_of([(1, "one two"), (1, "one two")])).collect()
    assert sum(p.length for p in twice) == 2 * (len(ids_of("one two")) + 1)


def test_hilbert_neighbours_and_bijection():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert_key(grid, bits=3)
    assert sorted(key.tolist()) == list(range(512))
    along = grid[np.argsort(key)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_length_sums_equal_brute_force(docs_of):
    rows = [(i, "word " * n) for i, n in enumerate([0, 1, 1, 3, 700, 1500, 1500, 4000])] + [(90, None), (91, "é你 好")]
    sizes = [len(ids_of(t)) for _, t in rows]
    histogram = lengths.length_histogram(docs_of(rows))
    totals = lengths.context_totals(histogram).cache()
    for r in totals.collect():
        limit = r.n_tokens
        assert r.n_docs == sizes.count(limit) and r.total_docs == len(sizes) and r.total_tokens == sum(sizes)
        assert r.docs_over == sum(s > limit for s in sizes) and r.tokens_over == sum(s for s in sizes if s > limit)
        assert r.truncated_tokens == sum(min(s, limit) for s in sizes) and r.lost_tokens == sum(max(0, s - limit) for s in sizes)
        assert r.docs_share == pytest.approx(np.mean([s <= limit for s in sizes]))
    assert {r.n_tokens for r in totals.collect()} == set(sizes)
    for limit in (0, 2, 1000, 10**6):
        assert lengths.truncated_total(totals, limit).first()[0] == sum(min(s, limit) for s in sizes)
    half = {r.share: r.n_tokens for r in lengths.quantiles(totals, [0.5, 1.0]).collect()}
    assert half == {0.5: sorted(sizes)[len(sizes) // 2 - 1], 1.0: max(sizes)}
    assert lengths.context_totals(lengths.length_histogram(docs_of([]))).collect() == []


# --- decontamination

ITEM = "Sarah Connor walks 12 km every morning before the market opens and then Sarah Connor sells 12 baskets of fruit to her neighbours"


def test_decontamination_cases(spark, docs_of):
    bench = spark.createDataFrame([(1, "In the town " + ITEM), (2, "which of these seven rivers flows north through desert"), (3, "too short"), (4, None), (1, "In the town " + ITEM)], "item_id long, text string")
    other = ITEM.replace("Sarah Connor", "Maria Lopez").replace("12", "31")
    rows = [
        (1, "bla bla. In the town " + ITEM + " more words"), (2, "Noise here, in the town " + other), (3, "In the town " + ITEM.replace("Sarah Connor sells", "Peter Green sells")),
        (4, "a clean text about nothing that anyone would test 12 km"), (5, None), (6, ""), (7, "So WHICH of these\nseven rivers flows: north, through desert?"),
        (1, "bla bla. In the town " + ITEM + " more words"), (None, "In the town " + ITEM), (8, "12 km 13 km 14 km 15 km 16 km 17 km 18 km 19 km 20 km 21 km"),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(docs_of(rows), bench).collect()}
    assert got.keys() == {(1, 1), (2, 1), (3, 1), (None, 1), (7, 2)}
    assert got[1, 1].exact and not got[2, 1].exact
    assert got[1, 1].matched_tokens == 26 and got[2, 1].matched_tokens == 22 > got[3, 1].matched_tokens
    left = decontaminate.decontaminate(docs_of(rows), bench)
    assert left.columns == docs_of([]).columns
    assert sorted(r[0] for r in left.collect() if r[0]) == [4, 5, 6, 8]
    assert decontaminate.contamination(docs_of([]), bench).collect() == []
    assert decontaminate.contamination(docs_of(rows), bench.limit(0)).collect() == []


def test_every_item_has_a_window(spark, docs_of):
    items = [
        "Evaluate 12 * 7 + 5 - 3 * 2 + 44 / 11.", "What Is The Capital Of France And Of Germany In Western Europe?", "Which planet is largest: Jupiter, Saturn, Uranus, Neptune, Mars, Venus, Mercury, Pluto?",
        "Der Hund des Nachbarn jagt die Katze der Tante durch den Garten von Onkel Paul", "中国的首都是哪一座城市并且它有多少人口", "Who wrote Hamlet?", "name the 3 largest seas",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"Some words come first, then {t} And more words follow") for i, t in enumerate(items)] + [(20, "我们今天去公园散步然后回家"), (21, "Evaluate 12 * 8 + 5"), (22, "Who wrote it?"), (23, "Now name the 5 largest seas")]
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs_of(rows), bench).collect()} == {(i, i) for i in range(len(items))} | {(23, 6)}


def test_inconsistent_slots_break_a_run():
    hits = [(0, 3, ["a"], ["x"]), (1, 3, ["a"], ["x"]), (2, 3, ["b"], ["x"]), (3, 3, ["b"], ["x"])]
    assert decontaminate.longest_run(hits)[0] == 4
    assert decontaminate.longest_run([(0, 3, ["a", "b"], ["x", "x"])])[0] == 0


def test_tokens_equal_the_pattern():
    rng = random.Random(2)
    alphabet = "aZé’'1290.,:!?。\n -_\u0130ßКпα中ไ𠀀😀Ⅷ²"
    items = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(400)] + ["", "x" * 5000, "It's 3.5 km, isn’t it? 'Twas 12:30... 1,2,x"]
    t = decontaminate.Tokens(items)
    want = [[w.lower() for w in decontaminate.TOKEN.findall(x) if w[0] not in ".!?。！？\n"] for x in items]
    assert [[t.raw(i) for i in range(a, b)] for a, b in zip(t.first, t.first[1:], strict=False)] == want
    code = {}
    for i, w in enumerate(w for x in want for w in x):
        assert code.setdefault(w, int(t.own[i])) == int(t.own[i])
    assert len(set(code.values())) == len(code)
    assert len(decontaminate.Tokens([])) == len(decontaminate.Tokens([""])) == 0


def one_to_one(pairs):
    return len(set(pairs)) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_longest_run_equals_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        at = sorted(rng.sample(range(14), rng.randrange(1, 9)))
        hits = [(p, 3, [rng.choice("ab") for _ in range(k)], [rng.choice("xy") for _ in range(k)]) for p in at for k in [rng.randrange(3)]]
        best = (0, 0, False)
        for i in range(len(hits)):
            for j in range(i, len(hits)):
                part = hits[i : j + 1]
                pairs = [p for h in part for p in zip(h[2], h[3], strict=True)]
                whole = all(b[0] <= a[0] + 3 for a, b in zip(part, part[1:], strict=False))
                if whole and one_to_one(pairs) and part[-1][0] + 3 - part[0][0] > best[0]:
                    best = (part[-1][0] + 3 - part[0][0], part[0][0], all(x == y for x, y in pairs))
        assert decontaminate.longest_run(hits)[0] == best[0]
    # five windows whose first and last contradict each other, and ten tokens from the second on
    hits = [(0, 8, ["1"], ["x"]), (1, 8, ["2"], ["y"]), (2, 8, ["2"], ["y"]), (3, 8, ["3"], ["x"])]
    assert decontaminate.longest_run(hits) == (10, 0, False)
    assert decontaminate.longest_run([hits[0], (1, 8, [], []), (2, 8, ["2"], ["x"]), (3, 8, [], []), (4, 8, [], [])]) == (11, 1, False)


def brute_contamination(docs, bench, window=8, run=10, literals=5):
    """Over lower-case words, numbers, capitalised names and full stops, with units and names as the operator has them."""
    lower = {w for t in bench.values() for w in re.findall("[A-Za-z]+", t) if w.islower()}

    def tokens(text):
        out, start, number = [], True, False
        for w in re.findall(r"[A-Za-z]+|\d+|\.", text):
            if w == ".":
                start, number = True, False
                continue
            low = w.lower()
            unit = low in decontaminate.UNITS
            name = not unit and w[0].isupper()
            kind = "<num>" if w.isdigit() else "<unit>" if unit and number else "<name>" if name and not start else low
            out.append((kind, "<name>" if name and low not in lower else kind, low))
            start, number = False, w.isdigit()
        return out

    found = {}
    for d, text in docs:
        ours = tokens(text)
        for b, item in bench.items():
            theirs = tokens(item)
            n, need = min(window, len(theirs)), min(run, len(theirs))
            best = (0, False, 0)
            for diagonal in range(-len(theirs), len(ours)):
                ok, reading = [], {}
                for i in range(len(theirs) - n + 1):
                    if diagonal + i < 0 or diagonal + i + n > len(ours):
                        continue
                    x, y = ours[diagonal + i : diagonal + i + n], theirs[i : i + n]
                    enough = [n >= literals and sum(t[r] == t[2] for t in y) >= min(literals, n - 1) and [t[r] for t in x] == [t[r] for t in y] for r in (0, 1)]
                    if [t[2] for t in x] == [t[2] for t in y] or any(enough):
                        ok.append(diagonal + i)
                        reading[ok[-1]] = int(enough == [False, True] and [t[2] for t in x] != [t[2] for t in y])
                for i, start in enumerate(ok):
                    for j in range(i, len(ok)):
                        end = ok[j] + n
                        if j > i and ok[j] > ok[j - 1] + n:
                            break
                        pairs = {(ours[p][2], theirs[p - diagonal][2]) for q in ok[i : j + 1] for p in range(q, q + n) if ours[p][reading[q]].startswith("<")}
                        if one_to_one(list(pairs)):
                            best = max(best, (end - start, all(x == y for x, y in pairs), -start))
            if best[0] >= need:
                found[d, b] = (best[0], len(theirs), -best[2], best[1])
    return found


def test_contamination_equals_brute_force(spark, docs_of):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "ko", "ri", "lu", "te") for b in ("mo", "sa", "ni", "pex")]
    names = ["Anna", "Boris", "Clara", "Dmitri"]

    def token():
        x = rng.random()
        return rng.choice(names) if x < 0.12 else str(rng.randrange(1, 5)) if x < 0.24 else "km" if x < 0.27 else rng.choice(words)

    def other(text):
        swap = dict(zip(names, rng.sample(names, 4), strict=True)) | {str(i): str(rng.randrange(1, 5)) for i in range(1, 5)}
        return " ".join(swap.get(w.rstrip("."), w) if not w.endswith(".") else w for w in text.split())

    def sentence(k):
        text = " ".join(token() for _ in range(k))
        return text[0].upper() + text[1:] + "."

    bench = {i: " ".join(sentence(rng.choice([4, 9, 15])) for _ in range(rng.choice([1, 1, 2, 3]))) for i in range(25)}
    bench |= {25: "Anna has 3 apples and gives 4 to the girl", 26: "name the 3 largest seas", 27: "Compute 12 34 5 7 9"}
    docs = []
    for i in range(150):
        item = rng.choice(list(bench.values()))
        w = item.split()
        a, b = sorted(rng.sample(range(len(w) + 1), 2))
        part = " ".join(w if i % 3 else w[a:b])
        docs.append((i, f"{sentence(6)} {other(part) if i % 2 else part} {sentence(5)}"))
    docs += [(200, "Boris has 2 apples and gives 9 to the girl"), (201, "so compute 12 34 5 7 9 now"), (202, "Name the 8 largest seas")]
    got = decontaminate.contamination(docs_of(docs), spark.createDataFrame(list(bench.items()), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.matched_tokens, r.item_tokens, r.start_token, r.exact) for r in got} == brute_contamination(docs, bench)
    assert len(got) > 60 and {(200, 25), (201, 27), (202, 26)} <= {(r.doc_id, r.item_id) for r in got}


def test_rows_are_judged_by_their_own_text(spark, docs_of):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(1, "x. " + ITEM), (1, "clean words alone"), (None, "y. " + ITEM), (None, "clean too"), (2, None)]
    left = [(r[0], r[1]) for r in decontaminate.decontaminate(docs_of(rows), bench).collect()]
    assert sorted(left, key=str) == sorted([(1, "clean words alone"), (None, "clean too"), (2, None)], key=str)


def test_very_long_text(spark, docs_of):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    long = "lorem ipsum dolor " * 200_000
    assert [r.start_token for r in decontaminate.contamination(docs_of([(1, long + ITEM + " " + long)]), bench).collect()] == [600_000]


def test_whole_items_are_found(sf):
    docs, bench = sf("documents").collect(), sf("benchmark").collect()
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {(d.doc_id, b.item_id) for b in bench for d in docs if plain(b.text) in plain(d.text)}
    assert want <= {(r.doc_id, r.item_id) for r in decontaminate.contamination(sf("documents"), sf("benchmark")).collect()}


# --- toxicity

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_brute_force():
    rng = np.random.default_rng(2)
    lexicon = ["idiot", "worthless", "scum", "trash*", "pathetic", "wort*"]
    words = ["idiots", "1diot", "idot", "worthles", "wrthles", "scums", "trashy", "tras", "pathétic", "", "worthy", "x" * 90]
    words += ["".join(rng.choice(list("idotscumwrhle"), size=n)) for n in rng.integers(1, 11, size=1500)]
    got = toxicity.Automaton(lexicon).match(words)
    for w, g in zip(words, got.tolist(), strict=True):
        hits = [(0 if t.endswith("*") else distance(w, t), i) for i, t in enumerate(lexicon) if (w.startswith(t[:-1]) if t.endswith("*") else distance(w, t) <= toxicity.edits(t))]
        best = min(hits, default=None)
        assert g == (-1 if best is None else best[1] * 4 + best[0]), w


def test_toxicity_held_out_and_edges(spark, docs_of):
    rng = np.random.default_rng(3)
    vocabulary = [f"wo{chr(97 + i % 26)}d{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words, toxic = list(rng.choice(vocabulary, size=40)), int(i % 5 == 0)
        for w in rng.choice(["horrible", "disgusting", "stupid"], size=3) if toxic else []:
            w = w if rng.random() < 0.7 else w[:3] + "x" + w[4:]
            words.insert(int(rng.integers(40)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    rows += [(7000, None), (7001, ""), (7002, "disgusting stupid horrible " * 3000), (None, "stupid"), (7002, "horrible stupid disgusting")]
    labels += [(3, None, None), (None, 1, 1), (3, 1, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs_of(rows), lab).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (mod(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels[:600]}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.doc_id in truth and r.held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[7000].predicted == by[7001].predicted == 0 and by[7002].predicted == 1
    assert toxicity.score_toxicity(docs_of([]), lab).collect() == []
    assert len({r.score for r in toxicity.score_toxicity(docs_of(rows[:9]), lab.limit(0)).collect()}) == 1


def test_terms_are_chosen_over_all_texts(spark):
    rng = random.Random(7)
    rows = [(" ".join(rng.choices(["plain", "words", "here", "often"], k=6) + (["vile"] if t and rng.random() < 0.4 else [])), t) for t in rng.choices([0, 1], [9, 1], k=12_000)]
    rows += [("plain words with rareslur", 1)] * 9
    n1 = sum(t for _, t in rows)
    toxic, clean = Counter(), Counter()
    for text, t in rows:
        (toxic if t else clean).update(toxicity.terms_of(text))
    counts = toxicity.term_counts(spark.createDataFrame(rows, "text string, toxic int"))
    assert {r.term: (r.n1, r.n0) for r in counts.collect()} == {t: (toxic[t], clean[t]) for t in toxic | clean}
    got = {r.term for r in toxicity.telling(counts, n1, len(rows) - n1).collect()}
    # a term in less than a hundredth of the toxic texts counts, for it is never in clean ones
    assert 0 < toxic["rareslur"] < 0.01 * n1 and {"vile", "rareslur"} <= got and "plain" not in got
    x, y = np.array([[0.0], [1.0], [1.0], [0.0]]), np.array([0.0, 1.0, 0.0, 1.0])
    assert np.allclose(toxicity.fit(x, y, np.array([3.0, 2, 1, 1])), toxicity.fit(np.repeat(x, [3, 2, 1, 1], axis=0), np.repeat(y, [3, 2, 1, 1])))


def test_quotation_weighs_less():
    model = toxicity.Model(["idiot"], np.array([3.0]))
    plain, quoted = model.features(["you are an idiot my friend", 'he said "you are an idiot" to me'])
    names = toxicity.FEATURES
    assert plain[names.index("exact")] > 0 == plain[names.index("quoted")]
    assert quoted[names.index("quoted")] > 0 == quoted[names.index("exact")]


def _features(model, text):
    """A text's features by comparing each word with every term, without automaton or memory."""
    n = toxicity.FEATURES
    out, terms, last, places = dict.fromkeys(n, 0.0), set(), -(10**9), list(re.finditer(r"\w+", text.lower()))
    hits = 0
    for place, m in enumerate(places):
        w = m.group()
        if not 3 < len(w) <= 2 * toxicity.LONGEST:
            continue
        near = [(0 if t.endswith("*") else distance(w, t), i) for i, t in enumerate(model.lexicon) if (w.startswith(t[:-1]) if t.endswith("*") else abs(len(w) - len(t)) <= 2 and distance(w, t) <= toxicity.edits(t))]
        if not near:
            continue
        e, t = min(near)
        out["misspelled" if e else "exact"] += model.weight[t]
        if not e:
            out["near"] += place - last <= toxicity.NEAR_WORDS
        terms.add(t)
        hits, last = hits + 1, place
    if hits:
        out["density"], out["distinct"] = 1000 * hits / len(places), len(terms)
    return [np.log1p(out[x]) for x in n]


def test_toxicity_query_equals_brute_force_and_finds_misspelt_rare_terms(spark, docs_of):
    rng = random.Random(11)
    stock = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9))) for _ in range(300)]
    rare = ["scumbaggery", "wretchedly", "imbecilic", "degenerate", "vermin"]
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 3 == 0
        own = rng.choices(stock, k=12) + (["horrible"] if toxic and i % 2 else []) + ([rare[i // 30 % 5]] if toxic and i % 30 == 0 else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    wrong = ["scumbagery", "wretchdly", "imbecillic", "degenerte", "vermn", "horible"]
    planted = [(10_000 + i, " ".join([*rng.choices(stock, k=5), w])) for i, w in enumerate(wrong)]
    docs, lab = docs_of(rows + planted), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(toxicity.training_rows(docs, lab))
    n1 = sum(t for i, t in labels if mod(i, 5))
    rarest = [w for w in rare if sum(w in t.split() for i, t in rows if mod(i, 5)) < 0.03 * n1]  # a rule by share would drop these
    assert rarest and set(rare) <= {t.rstrip("*") for t in model.lexicon}
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, lab).collect()}
    for i, t in rows[:150] + planted:
        x = _features(model, t)
        assert np.allclose(model.features([t])[0], x)
        assert abs(got[i] - 1 / (1 + np.exp(-(model.coefficients[0] + np.dot(x, model.coefficients[1:]))))) < 1e-9
    found = [model.features([t])[0][toxicity.FEATURES.index("misspelled")] > 0 for _, t in planted]
    assert sum(found) >= 0.9 * len(found)


# --- language model

def test_language_model_equals_brute_force(docs_of, sf):
    rows = [(r.doc_id, r.text) for r in sf("documents").limit(80).collect()] + [(9000, None), (9001, ""), (9002, "Ab\x0bcd ab"), (9002, "Ab\x0bcd ab"), (None, "x y z")]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t in rows}
    c = Counter()
    for i, _ in rows:
        if mod(i, 5) != 1:
            c.update([*words[i], None])
    n, v = sum(c.values()), len(c)
    for head in (brownlm.HEAD, 50):
        keep, brownlm.HEAD = brownlm.HEAD, head
        got = brownlm.score_texts(docs_of(rows)).collect()
        brownlm.HEAD = keep
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
        for r in got:
            own = [*words[r.doc_id], None]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(c[w] > 0 for w in own), n, mod(r.doc_id, 5) == 1)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
            assert r.score < 0
    total = lambda f: sum(getattr(r, f) for r in got)
    assert total("score") > total("base_score")
    assert brownlm.score_texts(docs_of([])).collect() == []


def test_scores_equal_brute_force_and_classes_are_a_distribution(docs_of, sf, monkeypatch):
    monkeypatch.setattr(brownlm, "CLUSTERED", 40)
    monkeypatch.setattr(brownlm, "CLASSES", 6)
    rows = [(r.doc_id, r.text) for r in sf("documents").limit(80).collect()] + [(9000, None), (9001, ""), (9002, "never seen words here"), (9003, "never seen " * 3000)]
    for head in (100, 2):
        monkeypatch.setattr(brownlm, "HEAD", head)
        model, table = brownlm.learn(docs_of(rows))
        words = {bytes(r.word): (r.c, r.k) for r in table.collect()}
        size = len(model.tokens)
        assert np.allclose((10**model.transition).sum(axis=1), 1) and model.transition.shape == (size, size)
        mass = np.zeros(size)
        for c, k in words.values():
            mass[k] += 10 ** float(model.emission(np.array(float(c)), np.array(k)))
        mass[model.unseen] += 0.5 / model.norm[model.unseen]
        assert np.allclose(mass[:-1][mass[:-1] > 0], 1)
        assert len({k for _, k in words.values()}) > 3
        got = {r.doc_id: r for r in brownlm.score_with(docs_of(rows), model, table).collect()}
        for i, t in rows:
            own = [words.get(w, (0, model.unseen)) for w in brownlm.words_of(t or "")]
            way = [size - 1, *(k for _, k in own), size - 1]
            want = sum(model.transition[a, b] for a, b in zip(way, way[1:], strict=False))
            want += sum(math.log10((c + 0.5) / model.norm[k]) for c, k in own)
            assert got[i].score == pytest.approx(want)


def test_class_bigrams_count_every_pair(docs_of, sf, monkeypatch):
    monkeypatch.setattr(brownlm, "CLUSTERED", 40)
    monkeypatch.setattr(brownlm, "CLASSES", 6)
    rows = [(r.doc_id, r.text) for r in sf("documents").limit(80).collect()] + [(9000, None), (9001, ""), (9003, "odd pair " * 300 + "odd"), (9004, "lone"), (9005, "only here")]
    for head in (200, 40):
        monkeypatch.setattr(brownlm, "HEAD", head)
        model, table = brownlm.learn(docs_of(rows))
        of = {bytes(r.word): r.k for r in table.collect()}
        size = len(model.tokens)
        m = np.zeros((size, size))
        for i, t in rows:
            if mod(i, 5) != 1:
                way = [size - 1, *map(of.get, brownlm.words_of(t or "")), size - 1]
                np.add.at(m, (way[:-1], way[1:]), 1)
        assert np.allclose(model.transition, np.log10(brownlm.smooth(m)))
        assert np.allclose(model.tokens, m.sum(axis=0))


def test_every_word_takes_its_neighbours_class(docs_of, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(brownlm, "CLUSTERED", 20)
    monkeypatch.setattr(brownlm, "CLASSES", 2)
    # words of two kinds alternate; rare ones of either kind stand where their kind does
    kinds = [[f"{c}{i}" for i in range(10)] for c in "pq"]
    rare = [[f"r{c}{i}" for i in range(150)] for c in "pq"]
    rows = []
    for i in range(300):
        line = [rng.choice(kinds[j % 2]) for j in range(40)]
        line[10], line[21] = rng.choice(rare[0]), rng.choice(rare[1])
        rows.append((i, " ".join(line)))
    _, table = brownlm.learn(docs_of(rows))
    of = {bytes(r.word).decode(): r.k for r in table.collect()}
    assert {of[w] for w in kinds[0]} == {of[w] for w in rare[0] if w in of} != {of[w] for w in kinds[1]} == {of[w] for w in rare[1] if w in of}


def test_exchange_goes_on_until_no_move_raises_the_likelihood():
    def likelihood(of, pairs):
        m = np.zeros((of.max() + 1,) * 2)
        np.add.at(m, (of[:, None], of[None, :]), pairs)
        h = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return h(m) - h(m.sum(0)) - h(m.sum(1))

    for seed in range(4):
        rng = np.random.default_rng(seed)
        pairs = rng.poisson(rng.gamma(0.3, 3, (32, 32)))
        found = brownlm.exchange(pairs, 30, classes=5)
        best = likelihood(found, pairs)
        for w in range(30):
            for k in range(5):
                other = found.copy()
                other[w] = k
                assert likelihood(other, pairs) <= best + 1e-6


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(8)
    truth = np.arange(40) % 4
    pairs = rng.poisson(np.where((truth[:, None] + 1) % 4 == truth[None, :], 30, 1)).astype(np.int64)

    def likelihood(of):
        m = np.zeros((of.max() + 1,) * 2)
        np.add.at(m, (of[:, None], of[None, :]), pairs)
        h = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return h(m) - h(m.sum(0)) - h(m.sum(1))

    found = brownlm.exchange(pairs, 40, classes=4)
    assert likelihood(found) >= likelihood(rng.permutation(truth))
    assert len({(a, b) for a, b in zip(truth.tolist(), found.tolist(), strict=True)}) == 4
