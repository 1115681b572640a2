"""BPE encoding and decoding through a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that merging
produces.  It is built merge by merge: the gadget of a merge (a, b) lets every state
that reads a also read ab, which leads where b led, and gives the reading of a
a state of its own that no longer reads b.  The state after a token therefore depends on the token alone,
and differs from the state that it was copied from by the readings taken away
since; only those are stored, with the merge at which a copy was made.  A step
looks through the copies once and is then kept in a table.

A string has one accepted path.  Encoding follows it by the longest label that a
step allows and turns back where a prefix cannot go on; a place left that way is
never entered again, as only one path leads there.  Decoding emits the labels of the arcs.

Edge cases: null and empty texts give no tokens.  Ids are only carried; repeated
rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from plumbline.llm.byte_bpe import letters_of_bytes

MOST_CHUNKS, MOST_STEPS = 400_000, 2_000_000
_NEVER = 1 << 62
#: Chunks of ASCII and Latin letters that composing leaves as they are, and how such a chunk, in lower case, splits.
_SIMPLE = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\u017f]+|[0-9]|[^a-z\xc0-\u017f0-9]+")


class Automaton:
    """Compiled from ``vocab`` (label to id) and ``merges`` (pairs of labels, in order)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.word_end = word_end
        self.labels = {i: label for label, i in vocab.items()}
        #: (a, b) -> the merge whose gadget takes the reading of b from the state after a.
        self.taken: dict[tuple[int, int], int] = {}
        #: token -> (token whose state it was copied from, merge of the copy).
        self.copied: dict[int, tuple[int, int]] = {}
        #: token -> (token whose arcs it goes along with, merge since when).
        self.along: dict[int, tuple[int, int]] = {}
        made = {vocab[a + b] for a, b in merges}
        arcs = {i for i in vocab.values() if i not in made}
        for at, (a, b) in enumerate(merges):
            one, two, both = vocab[a], vocab[b], vocab[a + b]
            if both in arcs or one not in arcs or two not in arcs or not self._reads(one, two):
                continue  # no path reads a and then b any more
            arcs.add(both)
            self.along[both] = (one, at)
            self.copied[both] = (two, at)
            self.taken[one, two] = at
        self.vocab = {label: i for label, i in vocab.items() if i in arcs}
        self.longest = max(len(label.removesuffix(word_end)) for label in self.vocab)
        self.steps: dict[tuple[int, int], bool] = {}

    def _reads(self, state: int, token: int) -> bool:
        """Whether the state after token ``state`` still reads ``token`` when all gadgets are in."""
        before = _NEVER
        while True:
            arc, until = token, _NEVER
            while True:
                at = self.taken.get((state, arc))
                if at is not None and at < before and at <= until:
                    return False
                if arc not in self.along:
                    break
                arc, until = self.along[arc]
            if state not in self.copied:
                return True
            state, before = self.copied[state]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a pre-split word, written in the vocabulary's letters."""
        vocab, n = self.vocab, len(word)
        path, begins, at, length, dead = [], [], 0, min(n, self.longest), set()
        while at < n:
            while length:
                end = at + length
                token = vocab.get(word[at:end] if end < n else word[at:] + self.word_end)
                if token is not None and end not in dead and (not path or self._step(path[-1], token)):
                    break
                length -= 1
            if length:
                path.append(token)
                begins.append(at)
                at, length = end, min(n - end, self.longest)
            elif path:
                dead.add(at)
                path.pop()
                before = begins.pop()
                at, length = before, at - before - 1
            else:
                raise ValueError(f"no path for {word!r}")
        return path

    def _step(self, state: int, token: int) -> bool:
        fits = self.steps.get((state, token))
        if fits is None:
            if len(self.steps) >= MOST_STEPS:
                self.steps.clear()
            fits = self.steps[state, token] = self._reads(state, token)
        return fits


class WordEncoder(dict):
    """Whole texts; keeps what the chunks between blanks give and forgets all when full."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        self.automaton = Automaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.labels = self.automaton.labels | {i: label for label, i in self.added.items()}
        self._specials = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        splitter = Tokenizer.from_file(path)
        self._letters = {b: letter for letter, b in letters_of_bytes().items()}
        self._normalizer, self._splitter = splitter.normalizer, splitter.pre_tokenizer

    def __missing__(self, chunk: str) -> tuple[int, str, str]:
        """How many ids a chunk has, the ids as decimal text, and their labels."""
        if len(self) >= MOST_CHUNKS:
            self.clear()
        automaton = self.automaton
        ids = [i for word in self._words(chunk) for i in automaton.encode_word(word)]
        self[chunk] = found = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        return found

    def _words(self, chunk: str) -> list[str]:
        """The chunk's words in the vocabulary's letters."""
        if not _SIMPLE.fullmatch(chunk):
            return [word for word, _ in self._splitter.pre_tokenize_str(self._normalizer.normalize_str(chunk))]
        words = _WORDS.findall(chunk.lower())
        return words if chunk.isascii() else [w.encode().decode("latin-1").translate(self._letters) for w in words]

    def chunks(self, text: str) -> list[tuple[int, str, str]]:
        """What the chunks of ``text`` that give tokens have; blanks and line feeds never lie inside a word."""
        if not any(s in text for s in self.added):
            return [got for got in map(self.__getitem__, filter(None, text.replace("\n", " ").split(" "))) if got[0]]
        out = []
        for part in self._specials.split(text):
            out += [(1, str(self.added[part]), part)] if part in self.added else self.chunks(part)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.chunks(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(path: str) -> Column:
    """A column function from texts to arrays of ids."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([encoder(path).encode(t or "") for t in batch], dtype=object)
    return run


def decode(path: str) -> Column:
    """A column function from arrays of ids to texts; a null array gives an empty text."""
    @F.pandas_udf(T.StringType())
    def run(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in ids:
            yield pd.Series([encoder(path).decode([] if row is None else list(row)) for row in batch], dtype=object)
    return run


def _sha256(parts: Iterator[str]) -> str:
    return hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_tokens``, and digests of its ids and of what they decode to."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    @F.pandas_udf(T.StructType(fields))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                found = encoder(path).chunks(text or "")
                rows.append((sum(c[0] for c in found), _sha256(c[1] for c in found), _sha256(c[2] for c in found)))
            yield pd.DataFrame(rows, columns=[f.name for f in fields])

    return docs.select(docs[id_col].alias("id"), run(docs[text]).alias("r")).select(F.col("id").alias(id_col), "r.*")
