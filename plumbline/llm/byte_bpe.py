"""Byte-level BPE ids of whole texts, fast enough for a corpus: repeated words are encoded once per worker.

Ids equal those of the tokenizers library with the same file.  Cutting a text at
single blanks and line feeds never cuts one of its pre-split words, so the ids of
such a chunk depend on the chunk alone; texts with other blanks go through the
encoder whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

MOST_CHUNKS = 250_000
#: Fixed value: how byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MARKS = tuple(".,;:!?")
_ODD = re.compile(r"\s\s|\A\s|\s\Z")


def letters_of_bytes() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself and the others as the letters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class _Chunks(dict):
    """Ids of chunks as bytes, in front of which ``lead`` stands; forgets all when full."""

    def __init__(self, lead: str, encode):
        super().__init__()
        self.lead, self.encode = lead, encode
        self.marks = {mark: _packed(encode(mark)) for mark in _MARKS}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MOST_CHUNKS:
            self.clear()
        if chunk[-1:] in _MARKS and chunk[-2:-1].isalnum():  # splitting parts a mark from the letter or number before it
            ids = self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            ids = _packed(self.encode(chunk if chunk[:1] == "\n" else self.lead + chunk))
        self[chunk] = ids
        return ids


class ByteEncoder:
    """``specials``: whether the file's special tokens, written out in a text, count as those tokens."""

    def __init__(self, path: str, specials: bool = True):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters = letters_of_bytes()
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in told["model"]["vocab"].items() if word not in added}
        self._encode = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._later = _Chunks(" ", self._encode)
        self._added = {k: _packed([v]) for k, v in added.items()} if specials else {}
        self._split = re.compile("(" + "|".join(map(re.escape, self._added)) + ")") if self._added else None

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return _packed(self._encode(text))
        first, *later = text.replace("\n", " \n").split(" ")
        return _packed(self._encode(first)) + b"".join(map(self._later.__getitem__, later))

    def packed_ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._split is None or not any(s in text for s in self._added):
            return self._plain(text)
        return b"".join(self._added.get(part) or self._plain(part) for part in self._split.split(text))


@lru_cache(maxsize=2)
def encoder(path: str, specials: bool = True) -> ByteEncoder:
    return ByteEncoder(path, specials)
