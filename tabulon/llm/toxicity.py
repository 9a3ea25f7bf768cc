"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

The lexicon is learned: words and word beginnings that labelled toxic texts hold far more
often than clean ones. Its trie is intersected with Levenshtein automata (how many edits a
word may have grows with its length), as one deterministic automaton that is built where
texts lead it, and that runs over all distinct words of a batch at once. Each hit is then
weighed by its context: quoted, or near other hits. A logistic regression over a text's
hits gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, materialise, pick, slices, texts

#: A bound of the model, not of the data: labelled rows of each kind that the regression sees.
FIT_ROWS = 10_000
#: How many times likelier a term is among toxic texts, and its support there: so many texts and this share of them,
#: or a log-likelihood ratio against the same rate in both kinds (30: one term in 20 million by chance).
LIFT, LEAST, SUPPORT, SIGNIFICANT = 8.0, 2, 0.01, 30.0
STEMS, LONGEST = (4, 5, 6, 7), 24
MOST_STATES = 250_000
#: Words whose match a task remembers.
MOST_WORDS = 600_000
WINDOW_CHARS, NEAR_WORDS = 80, 25

_WORD = re.compile(r"\w+")
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"


def terms_of(text: str) -> set[str]:
    """A text's distinct words of 4 to LONGEST characters, and its words' beginnings (with a star)."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= 4}
    stems = {w[:k] for w in words for k in STEMS if len(w) >= k}
    return {w for w in words if len(w) <= LONGEST} | {s + "*" for s in stems}


def edits(word: str) -> int:
    """How many edits a term forgives: beginnings and short words none, from five letters one, from eight two."""
    return 0 if word.endswith("*") or len(word) < 5 else 1 if len(word) < 8 else 2


class Automaton:
    """The lexicon's trie with Levenshtein automata over it, made deterministic as words ask for it.

    A state is a set of (trie node, edits so far) with the best beginning seen; the least
    edits of a node are kept. Transitions are found once and kept in a table.
    """

    def __init__(self, lexicon: list[str]):
        self.lexicon, n = lexicon, len(lexicon)
        alphabet = sorted({c for term in lexicon for c in term.removesuffix("*")})
        self.letters = len(alphabet) + 1  # class 0: any other character
        self.classes = np.zeros(0x110000, dtype=np.uint8 if self.letters < 256 else np.uint16)
        number = {c: i + 1 for i, c in enumerate(alphabet)}
        for c, i in number.items():
            self.classes[ord(c)] = i
        child: list[dict[int, int]] = [{}]
        self.none = n  # no term
        allowed, ends, stars = [0], [[n, n, n]], [n]
        for t, term in enumerate(lexicon):
            most, at = edits(term), 0
            allowed[0] = max(allowed[0], most)
            for c in term.removesuffix("*"):
                if number[c] not in child[at]:
                    child[at][number[c]] = len(child)
                    child.append({})
                    allowed.append(0)
                    ends.append([n, n, n])
                    stars.append(n)
                at = child[at][number[c]]
                allowed[at] = max(allowed[at], most)
            for e in range(most + 1):
                ends[at][e] = min(ends[at][e], t)
            if term.endswith("*"):
                stars[at] = min(stars[at], t)
        self.allowed, self.stars = np.array(allowed), np.array(stars)
        self.ends = np.array(ends)  # a node's first term, by edits so far
        self.child_at = np.cumsum([0, *map(len, child)])
        self.child_label = np.array([c for x in child for c in x], dtype=np.int64)
        self.child_to = np.array([to for x in child for to in x.values()], dtype=np.int64)
        self._reset()

    def _reset(self) -> None:
        self.states: list[bytes] = []  # (node * 4 + edits) in order, and the first beginning seen
        self.number: dict[bytes, int] = {}
        self.table = np.full((1024, self.letters), -1, dtype=np.int32)
        self.found = np.full(1024, -1, dtype=np.int32)  # term * 4 + edits, or -1
        nothing = np.empty(0, np.int64)
        self._intern(1, nothing, nothing, nothing, np.array([self.none]))  # the dead state is 0
        self.table[0] = 0
        self.start = int(self._intern(1, *self._skip(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)), np.array([self.none]))[0])

    def _children(self, pair: np.ndarray, node: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = self.child_at[node + 1] - self.child_at[node]
        at = np.repeat(self.child_at[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(pair, n), self.child_to[at], np.repeat(e, n), self.child_label[at]

    def _least(self, pair: np.ndarray, node: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each pair's nodes that may have as many edits, in order, each with its least edits."""
        fits = e <= self.allowed[node]
        keys = np.sort((pair[fits] * len(self.allowed) + node[fits]) * 4 + e[fits])
        keys = keys[np.concatenate([[True], keys[1:] >> 2 != keys[:-1] >> 2])] if len(keys) else keys
        return (keys >> 2) // len(self.allowed), (keys >> 2) % len(self.allowed), keys & 3

    def _skip(self, pair: np.ndarray, node: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds what leaving out letters of a term reaches."""
        for _ in range(int(self.allowed[0])):
            p, to, d, _label = self._children(pair, node, e)
            pair, node, e = self._least(np.concatenate([pair, p]), np.concatenate([node, to]), np.concatenate([e, d + 1]))
        return pair, node, e

    def _intern(self, k: int, pair: np.ndarray, node: np.ndarray, e: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """The numbers of ``k`` states; new ones get their best match."""
        size = self.none + 1
        best = np.where(stem < self.none, stem, 3 * size)
        end = self.ends[node, e]
        some = end < self.none
        np.minimum.at(best, pair[some], e[some] * size + end[some])
        cut = np.searchsorted(pair, np.arange(k + 1)) * 4
        packed, stems = (node * 4 + e).astype("<i4").tobytes(), stem.astype("<i4").tobytes()
        out = np.empty(k, np.int32)
        for i in range(k):
            key = packed[cut[i] : cut[i + 1]] + stems[4 * i : 4 * i + 4]
            own = self.number.get(key)
            if own is None:
                own = self.number[key] = len(self.states)
                self.states.append(key)
                if own >= len(self.table):
                    self.table = np.vstack([self.table, np.full_like(self.table, -1)])
                    self.found = np.concatenate([self.found, np.full_like(self.found, -1)])
                if best[i] < 3 * size:
                    self.found[own] = best[i] % size * 4 + best[i] // size
            out[i] = own
        return out

    def _steps(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Where each state leads with each letter."""
        own = [self.states[s] for s in states.tolist()]
        stem = np.frombuffer(b"".join(x[-4:] for x in own), "<i4").astype(np.int64)
        flat = np.frombuffer(b"".join(x[:-4] for x in own), "<i4").astype(np.int64)
        pair, node, e = np.repeat(np.arange(len(own)), [len(x) // 4 - 1 for x in own]), flat >> 2, flat & 3
        p, to, d, label = self._children(pair, node, e)
        # a letter too many; a letter that is the term's or another
        reached = self._least(np.concatenate([pair, p]), np.concatenate([node, to]), np.concatenate([e + 1, d + (label != letters[p])]))
        pair, node, e = self._skip(*reached)
        np.minimum.at(stem, pair[e == 0], self.stars[node[e == 0]])
        return self._intern(len(own), pair, node, e, stem)

    def match(self, words: list[str]) -> np.ndarray:
        """For each word term * 4 + edits of its best match, or -1."""
        out = np.full(len(words), -1, dtype=np.int32)
        if not words or not self.lexicon:
            return out
        if len(self.states) > MOST_STATES:
            self._reset()
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(-sizes, kind="stable")
        code = self.classes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        first = np.cumsum(sizes) - sizes
        first, sizes = first[order], sizes[order]
        state = np.full(len(words), self.start, dtype=np.int64)
        n, at = len(words), 0
        live = np.arange(n)
        while True:
            while n and sizes[n - 1] <= at:
                n -= 1
            live = live[live < n]
            if not len(live):
                break
            s, c = state[live], code[first[live] + at].astype(np.int64)
            to = self.table[s, c]
            new = to < 0
            if new.any():
                asked = np.unique(s[new] * self.letters + c[new])
                for i in range(0, len(asked), 4096):
                    a, b = np.divmod(asked[i : i + 4096], self.letters)
                    to = self._steps(a, b)
                    self.table[a, b] = to
                to = self.table[s, c]
            state[live] = to
            live = live[to > 0]
            at += 1
        out[order] = self.found[state]
        return out


FEATURES = ("exact", "misspelled", "quoted", "near", "density", "distinct")


@dataclass
class Model:
    """lexicon with weights (log lift) and the regression's coefficients."""

    lexicon: list[str]
    weight: np.ndarray
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))
    _automaton: Automaton | None = None
    _seen: dict[str, int] = field(default_factory=dict)

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weight": self.weight, "coefficients": self.coefficients, "_automaton": None, "_seen": {}}

    @property
    def automaton(self) -> Automaton:
        if self._automaton is None:
            self._automaton = Automaton(self.lexicon)
        return self._automaton

    def matches(self, words: set[str]) -> dict[str, int]:
        """The words with a match; a worker walks the automaton once for each word it meets."""
        if len(self._seen) > MOST_WORDS:
            self._seen.clear()
        new = sorted(words - self._seen.keys())
        self._seen.update(zip(new, self.automaton.match(new).tolist(), strict=True))
        return {w: found for w in words if (found := self._seen[w]) >= 0}

    def features(self, items: list[str]) -> np.ndarray:
        lower = [t.lower() for t in items]
        words = [_WORD.findall(t) for t in lower]
        hit = self.matches({w for ws in words for w in ws if 3 < len(w) <= 2 * LONGEST})
        out = np.zeros((len(items), len(FEATURES)))
        for i, ws in enumerate(words):
            if hit and not hit.keys().isdisjoint(ws):
                out[i] = self._weigh(lower[i], len(ws), hit)
        return out

    def _weigh(self, text: str, n_words: int, hit: dict[str, int]) -> list[float]:
        exact = misspelled = quoted = near = 0.0
        terms, last, n = set(), -(10**9), 0
        for place, m in enumerate(_WORD.finditer(text)):
            found = hit.get(m.group())
            if found is None:
                continue
            term, e = divmod(found, 4)
            w = float(self.weight[term])
            before, after = text[max(0, m.start() - WINDOW_CHARS) : m.start()], text[m.end() : m.end() + WINDOW_CHARS]
            opened = max((before.rfind(c) for c in _OPEN), default=-1)
            if opened >= 0 and before.count('"') % 2 | (before[opened] != '"') and any(c in after for c in _CLOSE):
                quoted += w
            elif e:
                misspelled += w
            else:
                exact += w
                near += place - last <= NEAR_WORDS
            terms.add(term)
            last, n = place, n + 1
        return [math.log1p(exact), math.log1p(misspelled), math.log1p(quoted), math.log1p(near), math.log1p(1000 * n / n_words), math.log1p(len(terms))]

    def score(self, items: list[str]) -> np.ndarray:
        z = self.coefficients[0] + self.features(items) @ self.coefficients[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def term_counts(rows: DataFrame) -> DataFrame:
    """``(term, n1, n0)``: in how many toxic and clean texts each term stands; tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for i, c in enumerate(seen):
                n, none = pa.array(list(c.values()), pa.int64()), pa.array([0] * len(c), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *((none, n) if i == 0 else (n, none))], ["term", "n1", "n0"])
                c.clear()

        for b in slices(batches, "text"):
            for t, toxic in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                seen[toxic].update(terms_of(t))
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield from out()
        yield from out()

    return rows.select("text", "toxic").mapInArrow(run, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def telling(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """The rows of ``counts`` whose terms have LIFT and support among the ``n1`` toxic texts."""
    lift = ((F.col("n1") + 0.5) / (n1 + 1)) / ((F.col("n0") + 0.5) / (n0 + 1))
    part = lambda k, n, p: k * F.log(F.greatest(k / n, F.lit(1e-300)) / p) + (n - k) * F.log(F.greatest(1 - k / n, F.lit(1e-300)) / (1 - p))
    both = F.least((F.col("n1") + F.col("n0")) / (n1 + n0), F.lit(1 - 1e-12))
    ratio = 2 * (part(F.col("n1"), F.lit(n1), both) + part(F.col("n0"), F.lit(n0), both))
    return counts.where((F.col("n1") >= LEAST) & (lift >= LIFT) & ((F.col("n1") >= math.ceil(SUPPORT * n1)) | (ratio >= SIGNIFICANT)))


def choose(toxic: dict[str, int], clean: dict[str, int], n1: int, n0: int) -> tuple[list[str], list[float]]:
    """The lexicon: terms of high lift, best first, without those a longer term stands for."""
    rated = []
    for t, n in toxic.items():
        lift = ((n + 0.5) / (n1 + 1)) / ((clean.get(t, 0) + 0.5) / (n0 + 1))
        if lift >= LIFT:
            rated.append((-n * math.log(lift), t, math.log(lift)))
    longer: dict[str, int] = defaultdict(int)
    for _, t, _ in rated:
        bare = t.removesuffix("*")
        for k in STEMS:
            if k < len(bare) or k == len(bare) and t == bare:
                longer[bare[:k] + "*"] = max(longer[bare[:k] + "*"], toxic[t])
    kept = [x for x in sorted(rated) if not x[1].endswith("*") or longer[x[1]] < 0.95 * toxic[x[1]]]
    return [t for _, t, _ in kept], [w for _, _, w in kept]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Logistic regression with an intercept, by Newton's method; a row counts ``weight`` times."""
    w = np.ones(len(x)) if weight is None else weight
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (w * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic``: labelled documents whose crc32(doc_id as text) mod 5 is not 0. Of several labels of an id the greatest counts."""
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # hashed by task whatever the labels' size: their table grows with the corpus, and one plan holds at every size
    known = known.where(crc_mod(F.col("doc_id"), 5) != 0).hint("shuffle_hash")
    return pick(docs, "doc_id", "text").where(crc_mod(F.col("doc_id"), 5) != 0).join(known, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")


def train(rows: DataFrame) -> Model:
    """Learn from all rows (doc_id, text, toxic); the regression sees about FIT_ROWS of each kind, chosen by hash and weighted back."""
    rows = materialise(rows, "toxic-train")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        model = Model([], np.zeros(0))
        model.coefficients[0] = math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else -5.0
        return model
    found = telling(term_counts(rows), n1, n0).collect()  # the lexicon's candidates: what passes both tests
    lexicon, weights = choose({r.term: r.n1 for r in found}, {r.term: r.n0 for r in found}, n1, n0)
    model = Model(lexicon, np.array(weights))
    share = {k: min(1.0, FIT_ROWS / n[k]) for k in (0, 1)}
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(chance < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = shared.value.features(texts(b.column(0)))
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c) for c in x.T)], ["y", *FEATURES])

    seen = sample.select("text", "toxic").mapInArrow(run, "y int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()
    discard(rows)
    if seen.num_rows:
        y = seen.column("y").to_numpy().astype(float)
        model.coefficients = fit(np.column_stack([seen.column(f).to_numpy() for f in FEATURES]), y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return model


def scorer(docs: DataFrame, model: Model):
    """A column function text -> score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon: toxic texts' telling terms

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        parts = [shared.value.score(texts(b.column(0))) for b in slices([pa.RecordBatch.from_arrays([column], ["text"])], "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from :func:`training_rows` alone; a score sees nothing but the text. held_out:
    crc32(doc_id as text) mod 5 is 0. predicted is 1 from a score of 0.5. Null and empty
    texts score as a text without a hit. Repeated rows give a row each, null ids count as the
    text ``null`` and have no label, other columns play no part. Without labels of both
    kinds the score is one prior for all. An empty table gives an empty result.
    """
    score = scorer(docs, train(training_rows(docs, labels)))
    out = pick(docs, "doc_id", "text").select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
