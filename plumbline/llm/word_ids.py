"""Ids of whole texts for vocabularies with word ends, a batch at a time.

Blanks and line feeds never lie inside a pre-split word, and a mark behind a letter or
number begins a word, so a text's ids are those of its chunks between them.  Arrow
splits a batch and finds its different chunks, only chunks not met before are encoded
by the tokenizers library, and ids are gathered by index.  A chunk of Latin letters is
one pre-split word, so it goes to the library's merging at once.  Texts that name a
special token are encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from plumbline.llm.byte_bpe import letters_of_bytes

MOST_CHUNKS = 400_000
_MARK = r"(\pL|\pN)([.,;:!?])"
_LETTERS = re.compile(r"[a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_ENDS = re.compile(r"[.!?]+[\"')\]]*")


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one behind the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


class WordIds:
    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        suffix = told["model"].get("end_of_word_suffix") or ""
        self._lower = "Lowercase" in json.dumps(told["normalizer"])
        self._bytewise = self._lower and "ByteLevel" in json.dumps(told["pre_tokenizer"])
        self._letter = {b: letter for letter, b in letters_of_bytes().items()}
        vocab = self._tokenizer.get_vocab()
        #: By id: whether a sentence ends behind the token.
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for word, i in vocab.items() if word.endswith(suffix) and _ENDS.fullmatch(word.removesuffix(suffix))]] = True
        self._forget()

    def _forget(self) -> None:
        self._slots: dict[str, int] = {"": 0}
        self._flat, self._starts, self._lengths = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        merged, letters, found, others = self._tokenizer.model.tokenize, _LETTERS.fullmatch, [], []
        for at, chunk in enumerate(chunks):
            if self._bytewise and letters(chunk):
                word = chunk if chunk.isascii() else chunk.lower().encode().decode("latin-1").translate(self._letter)
                found.append([t.id for t in merged(word)])
            else:
                found.append([])
                others.append(at)
        for at, told in zip(others, self._tokenizer.encode_batch_fast([chunks[at] for at in others], add_special_tokens=False)):
            found[at] = told.ids
        return found

    def _learn(self, chunks: list[str]) -> None:
        found = self._encoded(chunks)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        more = np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(lengths.sum()))
        self._slots.update(zip(chunks, range(len(self._slots), len(self._slots) + len(chunks))))
        self._starts = np.concatenate([self._starts, len(self._flat) + np.cumsum(lengths) - lengths])
        self._lengths = np.concatenate([self._lengths, lengths])
        self._flat = np.concatenate([self._flat, more])

    def _names_special(self, text: str) -> bool:
        return any(s in text for s in self._special) or self._lower and any(s in text.lower() for s in self._special)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, one text behind the other, and how many each has."""
        whole = {k for k, text in enumerate(texts) if self._names_special(text)}
        plain = pa.array(["" if k in whole else text for k, text in enumerate(texts)], pa.large_string())
        if self._lower:
            plain = pc.ascii_lower(plain)
        parts = pc.split_pattern(pc.replace_substring(pc.replace_substring_regex(plain, _MARK, r"\1 \2"), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self._slots) + len(chunks) > MOST_CHUNKS:
            self._forget()
        places = list(map(self._slots.get, chunks))
        unknown = [c for c, place in zip(chunks, places) if place is None]
        if unknown:
            self._learn(unknown)
            places = list(map(self._slots.get, chunks))
        slots = np.array(places, dtype=np.int64)[coded.indices.to_numpy()]
        sizes = self._lengths[slots]
        ids = gathered(self._flat, self._starts[slots], sizes)
        edges = np.concatenate([[0], np.cumsum(sizes)])[parts.offsets.to_numpy()]
        lengths = np.diff(edges)
        if whole:
            cut = np.split(ids, edges[1:-1])
            for k in whole:
                cut[k] = np.array(self._tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype="<u4")
                lengths[k] = len(cut[k])
            ids = np.concatenate(cut)
        return ids, lengths


@lru_cache(maxsize=1)
def encoder(path: str) -> WordIds:
    return WordIds(path)
