"""Byte-level BPE ids of whole texts.

The vocabulary file is one of the ``tokenizers`` library. Where its merges are ranked by id,
as byte-level vocabularies of this kind are, ``tiktoken`` gives the same ids from it faster and
in less memory; other vocabularies, and texts with characters on which the two libraries'
letter classes might differ, are encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np

#: Pre-tokenisation of byte-level vocabularies of this kind (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which every library agrees about letters, numbers and white space.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in a vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``ids(text)``: the ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.special, self.ranked = path, (), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec.get("added_tokens", ()))
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
        vocab = model.get("vocab", {})
        byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if byte_level and isinstance(vocab, dict) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import tiktoken

            of = _byte_of()
            ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.ranked = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def library(self):
        """The library's tokenizer, to which special tokens' strings are plain text."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.encode_special_tokens = True
        return own

    def plain_ids(self, text: str) -> list[int]:
        """The ids of a text in which special tokens' strings are plain text."""
        if self.ranked and _PLAIN.fullmatch(text):
            return self.ranked(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        if self.ranked and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.ranked(text), dtype="<u4").tobytes()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
