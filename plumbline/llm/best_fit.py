"""Best-fit packing of documents into sequences, planned over the histogram of lengths.

Documents become token ids with a separator behind; one that is longer than a
sequence is cut into full pieces, with what is over as its first piece.  Only the
counts of the lengths, at most ``capacity`` numbers, reach the driver.  Best fit
over counts, longest first, gives runs of equal slots; a piece takes the slot at
its rank among the pieces of its length.  Ranks are counted in blocks of pieces, so
no length is gathered in one task.

Edge cases: null and empty texts are one separator.  Null ids and repeated rows are
packed like any others.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.byte_bpe import encoder
from plumbline.session import materialise

CAPACITY = 2048
BLOCKS, BLOCK_ROWS = 256, 1_000_000
_PIECE = T.ArrayType(T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())]))


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    first = length if length <= capacity else length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def _pieces(path: str, capacity: int, separator: int, with_ids: bool) -> Column:
    end = np.array([separator], dtype="<u4").tobytes()

    @F.pandas_udf(_PIECE)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = encoder(path)
        for batch in texts:
            out = []
            for text in batch:
                ids = words.packed_ids(text or "") + end
                parts = [(k, s, n, ids[4 * s:4 * (s + n)]) for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity))]
                out.append([{"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(b), "ids": b if with_ids else None} for k, s, n, b in parts])
            yield pd.Series(out, dtype=object)
    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Runs of slots: pieces of ``length`` from rank ``rank`` on go, ``each`` to a sequence, to sequences from ``sequence`` on, from ``offset`` on."""
    left: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences) with that room
    rooms: list[int] = []
    runs, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in left:
                insort(rooms, room)
            left.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        count, rank = counts[length], 0
        while count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = left[room].pop()
                if not left[room]:
                    del left[room], rooms[at]
            else:
                room, first = capacity, opened
                n = -(-count // (capacity // length))
                opened += n
            each = room // length
            full = min(n, count // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                count, rank = count - full * each, rank + full * each
            rest = n - full
            if rest and count and count < each:
                runs.append((length, rank, first + full, count, capacity - room))
                put(room - count * length, first + full, 1)
                rank, count, full, rest = rank + count, 0, full + 1, rest - 1
            put(room, first + full, rest)
    return pd.DataFrame(runs, columns=["length", "rank", "sequence", "each", "offset"], dtype="int64")


def _slots(runs: pd.DataFrame):
    runs = runs.sort_values(["length", "rank"])
    keys = runs["length"].to_numpy() << 48 | runs["rank"].to_numpy()
    first, each, offset, rank = (runs[c].to_numpy() for c in ("sequence", "each", "offset", "rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, own = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 48 | own, side="right") - 1
            place = own - rank[at]
            slots = {"sequence_id": first[at] + place // each[at], "offset": offset[at] + place % each[at] * length}
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *map(pa.array, slots.values())], names=[*kept, *slots])
    return run


def _ranked(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``pieces`` with their rank among those of their length, and the number of each length."""
    blocks = max(BLOCKS, pieces.count() // BLOCK_ROWS)
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)))
    sizes = blocked.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("id", "piece", "ids_crc32"))
    ranked = blocked.withColumn("inside", inside).join(starts, ["length", "block"])
    return ranked.withColumn("rank", F.col("before") + F.col("inside") - 1).drop("block", "before", "inside"), counts


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, separator: int = 0,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and its ``ids`` if asked for."""
    made = docs.select(docs[id_col].alias("id"), F.inline(_pieces(path, capacity, separator, with_ids)(docs[text])))
    pieces = materialise(made if with_ids else made.drop("ids"), "pieces")
    ranked, counts = _ranked(pieces)
    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = ranked.select(*[f.name for f in fields], "rank").mapInArrow(_slots(plan(counts, capacity)), schema)
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves (``sequence_id``, ``ids``) from ``pack(..., with_ids=True)``; each holds at most one capacity of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate(
        "parts", F.lit(b""), lambda out, p: F.concat(out, p["ids"])).alias("ids"))
