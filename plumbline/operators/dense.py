"""Nearest passages by cosine for many questions: exactly over a grid of blocks, or over the cells of an inverted file.

Passages and questions are dealt into blocks of about ``block`` rows; every block of
questions meets every block of passages as one group of bounded size, which keeps
its own best ``k`` per question.  Best lists merge, so the shuffle behind carries candidates
and not (questions x passages) rows, and nothing goes through the driver.

The inverted file has the same groups, but passages lie in the cell of their nearest
centre and a question asks only its nearest cells, as many as a sample needed for ``RECALL``.  Scores are exact; what may be
missed is a passage in a cell that was not asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_DIGITS = 6
#: Questions scored at once inside a group.
SLICE = 256
#: Rows of a block; vectors that centres are fitted on (at most), centres, rounds of fitting, recall that the sample must show.
BLOCK, SAMPLE, CENTRES, ROUNDS, RECALL = 4096, 8192, 64, 8, 0.95


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows of length one; a vector of zeros stays."""
    if not len(column):
        return np.zeros((0, 0))
    flat = pc.list_flatten(column).cast(pa.float64())
    matrix = flat.to_numpy(zero_copy_only=False) if isinstance(flat, pa.Array) else flat.to_numpy()
    matrix = matrix.reshape(len(column), -1)
    sizes = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(sizes == 0, 1, sizes)


def ranked(scores: DataFrame, k: int, key: str = "qid") -> DataFrame:
    """Best ``k`` per question with a 0-based rank; ties by document id."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), F.asc("doc_id")))
    return scores.withColumn("rank", place).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def best_places(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best ``k`` of every row, best first; ties by ``ids`` of the columns."""
    rows, columns = [], []
    for q, row in enumerate(scores):
        near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if k < len(row) else np.arange(len(row))
        near = near[np.lexsort((ids[near], -row[near]))][:k]
        rows.append(np.full(len(near), q))
        columns.append(near)
    return np.concatenate(rows), np.concatenate(columns)


def _best(k: int):
    """The best ``k`` passages of a block for each question of a block, a slice of the questions at a time."""
    def run(passages: pa.Table, questions: pa.Table) -> pa.Table:
        names, asked = passages.column("doc_id"), questions.column("qid")
        if not len(names) or not len(asked):
            return pa.table({"qid": asked.slice(0, 0), "doc_id": names.slice(0, 0), "score": pa.array([], pa.float64())})
        ids, across, down = names.to_numpy(), unit_rows(passages.column("v")).T, unit_rows(questions.column("v"))
        parts = []
        for at in range(0, len(down), SLICE):
            scores = np.round(down[at:at + SLICE] @ across, SCORE_DIGITS)
            rows, columns = best_places(scores, ids, k)
            parts.append(pa.table({"qid": asked.take(pa.array(rows + at)), "doc_id": names.take(pa.array(columns)), "score": pa.array(scores[rows, columns])}))
        return pa.concat_tables(parts)
    return run


def _met(passages: DataFrame, questions: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``passages`` (doc_id, v) and ``questions`` (qid, v) that share ``keys`` -> the best of every group, merged."""
    schema = T.StructType([questions.schema["qid"], passages.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return ranked(passages.groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInArrow(_best(k), schema), k)


def _blocks(rows: int, block: int) -> int:
    return max(1, -(-rows // block))


def _dealt(key: str, parts: Column) -> Column:
    """A place among ``parts``; the vector helps where ids repeat."""
    return F.pmod(F.xxhash64(key, "v"), parts)


def _each(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1))


def exact_topk(vectors: DataFrame, questions: DataFrame, k: int, doc_id: str = "doc_id", qid: str = "qid", embedding: str = "embedding", *, block: int = BLOCK) -> DataFrame:
    """qid, doc_id, score, rank by cosine, exactly.  Two counts size the grid."""
    passages = vectors.select(vectors[doc_id].alias("doc_id"), vectors[embedding].alias("v"))
    asked = questions.select(questions[qid].alias("qid"), questions[embedding].alias("v"))
    across, down = (F.lit(_blocks(df.count(), block)).cast("bigint") for df in (passages, asked))
    return _met(passages.withColumn("p", _dealt("doc_id", across)).withColumn("q", _each(down)),
                asked.withColumn("q", _dealt("qid", down)).withColumn("p", _each(across)), ["p", "q"], k)


def fitted_cells(vectors: DataFrame, k: int, embedding: str = "embedding", *, centres: int = CENTRES, sample: int = SAMPLE, recall: float = RECALL) -> tuple[np.ndarray, int]:
    """Centres and how many cells a question must ask, both from a bounded sample of ``vectors``.

    Centres come from spherical k-means.  Every 32nd vector of the sample asks for its ``k`` nearest in
    the sample, and the least number of cells that hold ``recall`` of these is taken; among all vectors
    the nearest lie closer than in a sample, so that figure errs on the safe side.
    """
    taken = vectors.select(vectors[embedding].alias("v")).orderBy(F.xxhash64("v")).limit(sample).toArrow()
    rows = unit_rows(taken.column("v"))
    if not len(rows):
        return rows, 1
    found = rows[np.linspace(0, len(rows) - 1, min(centres, len(rows))).astype(int)]
    for _ in range(ROUNDS):
        nearest = np.argmax(rows @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, rows)
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(sizes > 0, sums / np.where(sizes > 0, sizes, 1), found)
    asked = rows[::32]
    cells, order = np.argmax(rows @ found.T, axis=1), np.argsort(-(asked @ found.T), axis=1, kind="stable")
    near = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :k]
    turn = np.argsort(order, axis=1)[np.arange(len(asked))[:, None], cells[near]]  # when each neighbour's cell is asked
    reached = np.cumsum(np.bincount(turn.ravel(), minlength=len(found))) / turn.size
    return found, int(np.searchsorted(reached, recall)) + 1


def _nearest_cells(centres: np.ndarray, n: int, key: T.StructField):
    def run(batches):
        for batch in batches:
            if len(batch) and len(centres):
                near = np.argsort(-(unit_rows(batch.column("v")) @ centres.T), axis=1, kind="stable")[:, :n]
                rows = pa.array(np.repeat(np.arange(len(batch)), near.shape[1]))
                yield pa.record_batch([batch.column(key.name).take(rows), batch.column("v").take(rows), pa.array(near.ravel().astype(np.int32))], [key.name, "v", "cell"])
    return run


def probed_topk(vectors: DataFrame, questions: DataFrame, k: int, doc_id: str = "doc_id", qid: str = "qid", embedding: str = "embedding", *,
                cells: tuple[np.ndarray, int] | None = None, block: int = BLOCK) -> DataFrame:
    """qid, doc_id, score, rank by cosine among the passages of each question's nearest cells.

    Every passage is indexed; ``cells`` (centres, and how many a question asks) default to ``fitted_cells(vectors, k)``.
    A cell that holds many rows is several blocks, so no group grows with the data.
    """
    middle, probes = cells or fitted_cells(vectors, k, embedding)

    def placed(df: DataFrame, n: int) -> DataFrame:
        key = df.schema.fields[0]
        return df.mapInArrow(_nearest_cells(middle, n, key), T.StructType([key, df.schema["v"], T.StructField("cell", T.IntegerType())]))

    passages = placed(vectors.select(vectors[doc_id].alias("doc_id"), vectors[embedding].alias("v")), 1)
    asked = placed(questions.select(questions[qid].alias("qid"), questions[embedding].alias("v")), probes)
    def blocks(df: DataFrame) -> Column:
        """How many blocks a cell takes: one number per centre."""
        held = {r["cell"]: _blocks(r["n"], block) for r in df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        return F.get(F.array(*[F.lit(held.get(c, 0)).cast("bigint") for c in range(max(1, len(middle)))]), F.col("cell"))

    across, down = blocks(passages), blocks(asked)
    both = (across > 0) & (down > 0)
    left = passages.where(both).withColumn("p", _dealt("doc_id", across)).withColumn("q", _each(down))
    right = asked.where(both).withColumn("q", _dealt("qid", down)).withColumn("p", _each(across))
    return _met(left, right, ["cell", "p", "q"], k)
