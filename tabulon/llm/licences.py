"""Licence scans by a positional index of rare words.

Every licence template is a word sequence with a mandatory key phrase. The index has postings
word -> (template, place) for the two words of each key phrase that are rarest over the corpus.
A file's indexed words are looked up, rarest first: where the postings of both words agree on
a start, the key phrase is verified whole, and then the template's words are compared.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, texts

#: Phrases that always count, whole, with their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices in common use: label, mandatory key phrase, words.
NOTICES = (
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "under the apache license", "licensed under the apache license version 2 0"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa", "licensed under cc by sa 4 0"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("agpl", "gnu affero general public license", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("bsl", "boost software license", "distributed under the boost software license version 1 0"),
    ("zlib", "in no event will the authors be held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc0", "copyright and related and neighboring rights", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("postgresql", "without fee and without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("artistic", "artistic license", "licensed under the artistic license 2 0"),
    ("gfdl", "gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
)

#: Bytes that aren't part of a word become spaces; A-Z become a-z; all from 0x80 stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key: tuple[bytes, ...]
    base: bool

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words) - n + 1) if self.words[i : i + n] == self.key)


def templates() -> list[Template]:
    split = lambda s: tuple(s.encode().split())
    out = [Template(label, split(p), split(p), True) for p, label in BASE_PHRASES]
    return out + [Template(label, split(w), split(k), False) for label, k, w in NOTICES]


class Index:
    """Postings word -> (template, place, the key phrase's next rarest word, its place), for each template's rarest key word."""

    def __init__(self, found: list[Template], frequency: dict[bytes, int], docs: int):
        self.templates = found
        self.postings: dict[bytes, list[tuple[int, int, bytes, int]]] = defaultdict(list)
        self.idf = {w: math.log((docs + 1) / (frequency.get(w, 0) + 0.5)) for x in found for w in x.key}
        for t, x in enumerate(found):
            places = sorted(range(x.key_at, x.key_at + len(x.key)), key=lambda i: (-self.idf[x.words[i]], i))
            first, other = places[0], places[min(1, len(places) - 1)]
            self.postings[x.words[first]].append((t, first, x.words[other], other))

    def starts(self, words: list[bytes]) -> Iterator[tuple[Template, int]]:
        """Templates with the starts on which the postings of their two rarest key words agree and their key phrase stands whole."""
        at: dict[bytes, list[int]] = defaultdict(list)
        known, n = self.postings, len(words)
        for i in [i for i, w in enumerate(words) if w in known]:
            at[words[i]].append(i)
        for w in sorted(at, key=lambda w: -self.idf[w]):
            for t, place, other, there in known[w]:
                x = self.templates[t]
                for s in (p - place for p in at[w]):
                    k = s + x.key_at
                    if 0 <= s + there < n and words[s + there] == other and k >= 0 and tuple(words[k : k + len(x.key)]) == x.key:
                        yield x, s

    def scan(self, words: list[bytes], coverage: float = 0.75) -> tuple[list[tuple[str, int]], dict[str, float]]:
        """Base places (label, start), and the method's labels with their best coverage."""
        base, labels = [], {}
        for x, s in self.starts(words):
            if x.base:
                base.append((x.label, s))
                continue
            same = sum(0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(x.words)) / len(x.words)
            if same >= coverage:
                labels[x.label] = max(labels.get(x.label, 0.0), same)
        return base, labels


def document_frequency(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many texts each template word stands, over all texts (a row per template word reaches the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in slices(batches, "text"):
            for t in texts(b.column(0)):
                seen.update(vocabulary.intersection(words_of(t)))
            seen[b""] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = pick(docs, "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in rows}
    return counts, counts.pop(b"", 0)


def scan(docs: DataFrame, coverage: float = 0.75) -> DataFrame:
    """A row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    n_base counts the places where a base phrase stands; first_word and last_word are their
    least and greatest starts (null if none). base_labels are theirs, labels the method's
    too: distinct, sorted, comma-joined, empty if none. score: 1 for a base phrase, else the
    best share of a notice's words found in place. A notice counts if its key phrase stands
    whole and ``coverage`` of its words match around it.

    Null and empty texts have no words. Repeated rows give a row each, null ids stay null,
    other columns play no part, an empty table gives an empty result.
    """
    found = templates()
    frequency, n = document_frequency(docs, {w for t in found for w in t.key})
    index = Index(found, frequency, n)
    src = pick(docs, "doc_id", "text")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def row(text: str) -> tuple:
        words = words_of(text)
        base, labels = index.scan(words, coverage)
        own, at = {x for x, _ in base}, [s for _, s in base]
        score = 1.0 if base else max(labels.values(), default=0.0)
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels.keys())), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            cols = zip(*map(row, texts(b.column(1))), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
