"""Whitening of embeddings by a bidiagonal qd solver.

Entries become integers, and every different integer vector counts once in the fit.
Tasks reduce their centred rows to triangles by blockwise QR, and triangles meet a
few at a time until one is left, as wide as a vector.  Householder reflections make
it bidiagonal, dqds finds its singular values to high relative accuracy, and
twisted factorisations of the shifted matrix give the directions.

Edge cases: a null vector, or one that holds a null, NaN or infinite entry, is
dropped, from the fit and from the result.  Shorter vectors count as if zeros
followed.  Null and repeated ids are only carried; repeated vectors are fitted once
and returned for each row.  Vectors of fewer entries than ``components`` give as many
components as they have entries.  A component without variance has ``explained`` 0
and a null ``whitened``.  ``deviation`` is null where it exceeds a long.  A table
without vectors that stay gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import materialise

SCALE, COMPONENTS, FAN_IN = 256, 4, 16
_EPS = np.finfo(float).eps
_ROWS = "row array<double>"


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal, and the orthogonal w with ``r.T @ r = w @ b.T @ b @ w.T``."""
    a, d = np.array(r, float), r.shape[1]
    w = np.eye(d)
    for k in range(d):
        _reflect(a[k:, k:], a[k:, k])
        if k < d - 2:
            _reflect(a[k:, k + 1:].T, a[k, k + 1:], w[:, k + 1:].T)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _reflect(a: np.ndarray, x: np.ndarray, *more: np.ndarray) -> None:
    """Apply to the rows of ``a`` and ``more`` the reflection that leaves only the first entry of ``x``."""
    v = x.copy()
    norm = np.linalg.norm(v)
    if not norm or not v[1:].any():
        return
    v[0] += np.copysign(norm, v[0])
    v /= np.linalg.norm(v)
    for m in (a, *more):
        m -= np.outer(2 * v, v @ m)


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential step; the last number is the least of its inner values, below zero if the shift was too large."""
    qs, es, d = [], [], q[0] - shift
    least = d
    for i, ei in enumerate(e):
        now = d + ei
        qs.append(now)
        if now:
            ratio = q[i + 1] / now
            es.append(ei * ratio)
            d = d * ratio - shift
        else:  # a zero value splits off here
            es.append(0.0)
            d = q[i + 1] - shift
        least = min(least, d)
    qs.append(d)
    return qs, es, least


def _pair(q1: float, e1: float, q2: float) -> tuple[float, float]:
    """The two values of a 2 by 2 part."""
    larger = (q1 + e1 + q2 + np.sqrt((q1 - q2) ** 2 + e1 * (2 * (q1 + q2) + e1))) / 2
    return (larger, q1 * (q2 / larger)) if larger else (0.0, 0.0)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> list[float]:
    """Squares of the singular values of an upper bidiagonal matrix, falling."""
    parts, found = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)], []
    while parts:
        q, e, shifted = parts.pop()
        while q:
            cut = next((i for i in reversed(range(len(e))) if e[i] <= _EPS ** 2 * (shifted + min(q[i], q[i + 1]))), None)
            if cut is not None:
                parts.append((q[:cut + 1], e[:cut], shifted))
                q, e = q[cut + 1:], e[cut + 1:]
            if len(q) <= 2:
                found += [shifted + x for x in (_pair(q[0], e[0], q[1]) if e else q)]
                break
            if 1.5 * q[0] < q[-1]:  # the smallest values are found at the end
                q, e = q[::-1], e[::-1]
            shift = 0.98 * _pair(q[-2], e[-1], q[-1])[1] if min(q) > 0 else 0.0
            qs, es, least = _qd_step(q, e, shift)
            while least < 0:
                shift = shift / 4 if shift > 1e-3 * q[-1] else 0.0
                qs, es, least = _qd_step(q, e, shift)
            q, e, shifted = qs, es, shifted + shift
    return sorted(found, reverse=True)


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of ``b.T @ b - value`` from the top and from the bottom, and where they meet: multipliers down, up, and each twist's pivot."""
    n, tiny = len(a), np.finfo(float).tiny
    squares, steps, cross = a * a, b * b, a[:-1] * b
    down, up, s, p = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    s[0], p[-1] = -value, squares[-1] - value
    for i in range(n - 1):
        pivot = s[i] + squares[i] or tiny
        down[i] = cross[i] / pivot
        s[i + 1] = steps[i] * (s[i] / pivot) - value
    for i in range(n - 2, -1, -1):
        pivot = p[i + 1] + steps[i] or tiny
        up[i] = cross[i] / pivot
        p[i] = p[i + 1] * (squares[i] / pivot) - value
    return down, up, s + p + value


def _direction(a: np.ndarray, b: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    """The unit vector of ``value``, from the twist of smallest pivot; ``others`` are those found for values close by."""
    down, up, pivots = _twisted(a, b, value)
    best, kept = None, -1.0
    for at in np.argsort(np.abs(pivots), kind="stable")[:2 + 4 * len(others)]:
        z = np.zeros(len(a))
        z[at] = 1.0
        for i in range(at - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(at, len(a) - 1):
            z[i + 1] = -up[i] * z[i]
        z /= np.linalg.norm(z)
        for _ in range(2):
            for other in others:
                z = z - other * (other @ z)
        left = np.linalg.norm(z)
        if left > kept:
            best, kept = z / (left or 1.0), left
        if kept > 0.5:
            break
    return best


def components_of(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Variances (falling), their unit directions as columns, and the whole variance, of ``n`` rows whose triangle is ``r``."""
    a, b, w = bidiagonal(r)
    edges = [0, *(i + 1 for i in range(len(b)) if abs(b[i]) <= _EPS * min(abs(a[i]), abs(a[i + 1]))), len(a)]
    blocks = [(a[x:y], b[x:y - 1], x) for x, y in zip(edges, edges[1:])]
    ranked = sorted(((value, k) for k, (x, y, _) in enumerate(blocks) for value in dqds(x, y)), key=lambda v: (-v[0], v[1]))
    none = _EPS ** 2 * len(a) ** 2 * max(n, 1) * (ranked[0][0] if ranked else 0.0)
    values, columns, near = [], [], {}
    for value, k in ranked[:most]:
        x, y, first = blocks[k]
        close = [z for other, z in near.get(k, []) if other - value <= 1e-3 * other]
        z = _direction(x, y, value, close)
        near.setdefault(k, []).append((value, z))
        full = w[:, first:first + len(z)] @ z
        columns.append(full / np.linalg.norm(full) * np.copysign(1.0, full[np.argmax(np.abs(full))]))
        values.append(value / n if value > none else 0.0)
    return np.array(values), np.array(columns).reshape(-1, len(a)).T, sum(v for v, _ in ranked) / n


@dataclass(frozen=True)
class Whitening:
    """``n`` different vectors, their exact sums, and what whitens a vector: ``(x - sums / n) @ turned``."""

    n: int
    sums: tuple[int, ...]
    variances: np.ndarray
    turned: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * entry)``, null for a vector that is null or holds a null, NaN or infinite entry."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(whole, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


def _table(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        if len(batch):
            x = _table(batch, "x")
            small = np.abs(x.astype(float)).max(initial=0.0) < 2 ** 40
            own = (x if small else x.astype(object)).sum(axis=0)
            n, total = n + len(x), [int(v) for v in own] if total is None else [t + int(v) for t, v in zip(total, own)]
    if n:
        told = pa.array([str(v) for v in [n, *total]])
        yield pa.record_batch([pa.array(range(-1, len(total)), pa.int32()), told], ["at", "part"])


def _triangles(mean: np.ndarray | None):
    """QR of the rows of a partition, block by block; those of the vectors are centred first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if len(batch):
                rows = _table(batch, "x") - mean if mean is not None else _table(batch, "row")
                r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
        if r is not None:
            yield pa.record_batch([pa.array(list(r), pa.list_(pa.float64()))], ["row"])
    return run


def _products(model: Whitening):
    """Sums of the whitened values and of their products, by partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.turned.shape[1]
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            if len(batch):
                y = np.column_stack([np.ones(len(batch)), (_table(batch, "x") - model.mean) @ model.turned])
                total += y.T @ y
        yield pa.record_batch([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "part"])
    return run


def _triangle(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    parts = fit.rdd.getNumPartitions()
    rows = fit.mapInArrow(_triangles(mean), _ROWS)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        rows = rows.repartition(parts).mapInArrow(_triangles(None), _ROWS)
    r = np.array([row["row"] for row in rows.toLocalIterator()])
    return np.vstack([r, np.zeros((max(0, len(mean) - len(r)), len(mean)))])


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the rows of ``fit`` (``x``, each vector once); sums, one triangle and a few products reach the driver."""
    sums = fit.mapInArrow(_sums, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    told = {r["at"]: int(r["s"]) for r in sums.collect()}
    if not told or len(told) == 1:
        return None
    n, totals = told.pop(-1), tuple(told[i] for i in range(len(told)))
    mean = np.array([s / n for s in totals])
    variances, directions, whole = components_of(_triangle(fit, mean), n, components)
    lasting = variances > 0
    turned = directions[:, lasting] / np.sqrt(variances[lasting])
    model = Whitening(n, totals, variances, turned, variances / whole if whole else variances)
    k = turned.shape[1] + 1
    parts = fit.mapInArrow(_products(model), "at int, part double").groupBy("at").agg(F.sum("part").alias("s")).collect()
    products = np.zeros(k * k)
    products[[r["at"] for r in parts]] = [r["s"] / n for r in parts]
    second = products.reshape(k, k)
    off = second[1:, 1:] - np.outer(second[0, 1:], second[0, 1:]) - np.eye(k - 1)
    return Whitening(n, totals, variances, turned, model.explained, float(np.abs(off).max(initial=0.0)))


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    largest = n * float(np.abs(x.astype(float)).max(initial=0.0)) + max(map(abs, sums))
    if x.shape[1] * largest * largest < 2 ** 62:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v < 2 ** 63 else None for v in exact]


def _whitened(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for batch in batches:
            if not len(batch):
                continue
            x = _table(batch, "x")
            y = np.full((len(x), k), np.nan)
            y[:, model.variances > 0] = (x - model.mean) @ model.turned
            rows = np.repeat(np.arange(len(x)), k)
            far = pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(pa.array(rows))
            yield pa.record_batch([
                batch.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), model.n)), far, pa.array(y.ravel(), from_pandas=True),
                pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(rows), model.identity_error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", *, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per row of ``vectors`` that stays and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    kept = vectors.select(vectors[id_col].alias("id"), integers(vectors[vector], scale).alias("x")).where(F.col("x").isNotNull())
    width = kept.agg(F.max(F.size("x")).alias("w")).first()["w"] or 0
    even = kept.select("id", F.when(F.size("x") == width, F.col("x")).otherwise(
        F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), width - F.size("x")))).alias("x"))
    model = fit_whitening(materialise(even.groupBy("x").agg(F.count(F.lit(1)).alias("rows")), "different-vectors"), components)
    fields = [T.StructField("id", kept.schema["id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
              T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
              T.StructField("identity_error", T.DoubleType())]
    schema = T.StructType(fields)
    found = even.mapInArrow(_whitened(model), schema) if model else vectors.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("id", id_col)
