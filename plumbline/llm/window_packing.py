"""Packing of documents, in their order, into windows cut by dynamic programming.

The ids of a task's documents form one stream, with a separator behind each document.
Windows of at most ``capacity`` ids may be cut behind a document for nothing, behind a
sentence for a small penalty, and inside a sentence of over ``longest`` ids for a larger
one.  A window is padded to the capacity unless it is as long as a power of two.
The cheapest cuts come from one pass over the possible ones: a monotone queue
holds the best begins of padded windows, and the begins a power of two before are looked up.

The stream is planned a segment at a time.  The last windows of a segment are planned
again with the next one, so a task holds one segment and pads at most where it ends.
No row is shuffled, and a lost task is simply run again.

Edge cases: null and empty texts are one separator.  Null and repeated ids and rows are
packed like any others.  A text longer than a window goes over several, however long it is.
Ties are cut for the longest last window.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.word_ids import encoder

CAPACITY, SEPARATOR = 2048, 1
#: In ids of padding: a cut behind a sentence, a cut inside one, and a window as such.
SENTENCE, INSIDE, WINDOW = 2.0, 24.0, 16.0
LONGEST, SEGMENT, BATCH_CHARS = 128, 400_000, 4_000_000


def possible_cuts(documents: np.ndarray, sentences: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, from 0 on, and what each cut costs.  ``documents`` and ``sentences`` are sorted end positions."""
    ends = np.union1d(np.concatenate([[0], documents]), sentences)
    gaps = np.diff(ends)
    more = [np.arange(ends[k] + longest, ends[k + 1], longest) for k in np.flatnonzero(gaps > longest)]
    inside = np.concatenate(more) if more else ends[:0]
    places = np.union1d(ends, inside)
    costs = np.full(len(places), SENTENCE)
    costs[np.isin(places, inside, assume_unique=True)] = INSIDE
    costs[np.isin(places, documents)] = 0.0
    costs[0] = 0.0
    return places, costs


def windows(places: np.ndarray, costs: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The chosen ends of windows over ``places`` (the last one always is): least padding plus penalties."""
    n = len(places)
    ends, begins = [], []
    for power in range((capacity - 1).bit_length()):
        wanted = places - (1 << power)
        at = np.searchsorted(places, wanted)
        at[at == n] = 0
        ends.append(np.flatnonzero(places[at] == wanted))
        begins.append(at[ends[-1]])
    # the begins a power of two before each place, by place and power
    end = np.concatenate([*ends, [n]])
    order = np.argsort(end, kind="stable")
    exact_end, exact_begin, e = end[order].tolist(), np.concatenate([*begins, [0]])[order].tolist(), 0
    where, price = places.tolist(), costs.tolist()
    least, back = [0.0] * n, [0] * n
    queue, ranks, head = [0], [float(where[0])], 0  # ranks never fall along the queue
    for j in range(1, n):
        here = where[j]
        while where[queue[head]] < here - capacity:
            head += 1
        begin = queue[head]
        best = ranks[head] + capacity - here
        while exact_end[e] == j:
            i = exact_begin[e]
            if least[i] < best or least[i] == best and i < begin:
                best, begin = least[i], i
            e += 1
        best += price[j] + WINDOW
        least[j], back[j] = best, begin
        rank = best + here
        while len(ranks) > head and ranks[-1] > rank:
            ranks.pop()
            queue.pop()
        queue.append(j)
        ranks.append(rank)
    chosen, j = [], n - 1
    while j:
        chosen.append(where[j])
        j = back[j]
    return np.array(chosen[::-1], dtype=np.int64)


class _Stream:
    """One task's documents on their way into windows."""

    def __init__(self, path: str, capacity: int, separator: int, with_ids: bool, first: int):
        self.words, self.capacity, self.separator, self.with_ids = encoder(path), capacity, separator, with_ids
        self.ids = np.zeros(0, dtype="<u4")
        #: Of each document in hand: its end and begin in the stream (a begin may lie before it) and its row.
        self.ends, self.begins = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.keys: pa.Array | None = None
        self.sequence = first

    def add(self, keys: pa.Array, texts: list[str]) -> None:
        plain, lengths = self.words.encode(texts)
        ends = np.cumsum(lengths + 1)
        ids = np.full(len(plain) + len(texts), self.separator, dtype="<u4")
        inside = np.ones(len(ids), dtype=bool)
        inside[ends - 1] = False
        ids[inside] = plain
        held = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, held + ends])
        self.begins = np.concatenate([self.begins, held + ends - lengths - 1])
        self.keys = keys if self.keys is None else pa.concat_arrays([self.keys, keys])

    def cut(self, last: bool) -> pa.RecordBatch | None:
        """Pieces of the windows that are settled; the rest stays in hand."""
        sentences = np.flatnonzero(self.words.closes[np.minimum(self.ids, len(self.words.closes) - 1)]) + 1
        chosen = windows(*possible_cuts(self.ends, sentences, min(LONGEST, max(1, self.capacity // 8))), self.capacity)
        if not last:
            chosen = chosen[chosen <= len(self.ids) - 4 * self.capacity]
        if not len(chosen):
            return None
        done = int(chosen[-1])
        edges = np.union1d(self.ends[self.ends < done], chosen)
        starts = np.concatenate([[0], edges[:-1]])
        doc, window = np.searchsorted(self.ends, starts, side="right"), np.searchsorted(chosen, starts, side="right")
        raw = memoryview(self.ids.tobytes())
        parts = [raw[4 * a:4 * b] for a, b in zip(starts.tolist(), edges.tolist())]
        columns = {
            "id": self.keys.take(pa.array(doc)), "start": pa.array(starts - self.begins[doc]), "length": pa.array(edges - starts),
            "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()), "doc_tokens": pa.array((self.ends - self.begins)[doc]),
            "sequence_id": pa.array(self.sequence + window), "offset": pa.array(starts - np.concatenate([[0], chosen])[window])}
        if self.with_ids:
            columns["ids"] = pa.array(map(bytes, parts), pa.binary())
        self.sequence += len(chosen)
        left = int(np.searchsorted(self.ends, done, side="right"))
        self.ids, self.keys = self.ids[done:], self.keys[left:]
        self.ends, self.begins = self.ends[left:] - done, self.begins[left:] - done
        return pa.record_batch(list(columns.values()), list(columns))


def _packed(path: str, capacity: int, separator: int, with_ids: bool, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(path, capacity, separator, with_ids, TaskContext.get().partitionId() << 40)
        for batch in batches:
            keys, texts, at = batch.column("id"), batch.column("text").to_pylist(), 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= BATCH_CHARS):
                    chars += len(texts[to])
                    to += 1
                stream.add(keys[at:to], texts[at:to])
                at = to
                if len(stream.ids) >= max(segment, 16 * capacity) and (settled := stream.cut(last=False)) is not None:
                    yield settled
        if len(stream.ids):
            yield stream.cut(last=True)
    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, separator: int = SEPARATOR,
         with_ids: bool = False, segment: int = SEGMENT) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, and its ``ids`` if asked for."""
    narrow = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    fields = [narrow.schema["id"], *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    return narrow.mapInArrow(_packed(path, capacity, separator, with_ids, segment), T.StructType(fields)).withColumnRenamed("id", id_col)
