"""Whitening against numpy's own eigenvectors, and its solvers against numpy's singular values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import qd_whitening, queries

FIELDS = "vec_id long, embedding array<float>"


def expected(rows, k=4):
    """(id, vector) rows -> n, deviations by vector, variances, whitened values by vector (of either sign), explained."""
    ints = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for _, v in rows]
    x = np.array(sorted(set(ints)), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    mean = np.array([s / n for s in sums], dtype=float)
    c = x.astype(float) - mean
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, [int(((n * np.array(v, dtype=object) - sums) ** 2).sum()) for v in ints], values, (np.array(ints, float) - mean) @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def check(found, rows):
    n, far, _, white, explained = expected(rows)
    at = {r[0]: k for k, r in enumerate(rows)}
    got = np.zeros(white.shape)
    assert len(found) == white.size
    for r in found:
        k, c = at[r["vec_id"]], r["component"] - 1
        got[k, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == far[k] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9)
    signs = np.sign((got * white).sum(axis=0))
    assert np.allclose(got * signs, white, atol=1e-7)


def test_query_against_numpy(spark, data_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data_dir}/embeddings.parquet").collect()]
    check(queries.op13_qd_whitening(spark, data_dir).collect(), rows)


def test_rows_left_out_and_repeated_vectors(spark):
    dice = np.random.default_rng(4)
    good = [(k, (dice.normal(size=6) * range(1, 7)).tolist()) for k in range(40)]
    good += [(100 + k, good[0][1]) for k in range(30)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(good + bad, FIELDS).withColumn("x", F.lit(1)).withColumn("id", F.lit("a")).repartition(5)
    check(qd_whitening.whiten(df).collect(), good)


def test_short_vectors_and_missing_variance(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0]), (3, [-1.0, 2.0]), (4, [-1.0])]
    found = qd_whitening.whiten(spark.createDataFrame(rows, FIELDS)).collect()
    assert len(found) == 8 and all(r["identity_error"] < 1e-12 and abs(abs(r["whitened"]) - 1) < 1e-12 for r in found)
    flat = qd_whitening.whiten(spark.createDataFrame([(1, [0.5, -0.0, 1.0]), (2, [0.5, 0.0, 1.0]), (3, [0.5, 0.0, 2.0])], FIELDS)).collect()
    assert {r["n"] for r in flat} == {2}
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True}
    assert {r["explained"] for r in flat} == {1.0, 0.0}
    assert qd_whitening.whiten(spark.createDataFrame([(1, None)], FIELDS)).collect() == []
    assert [(r["component"], r["whitened"], r["explained"]) for r in qd_whitening.whiten(spark.createDataFrame([(1, [2.0])], FIELDS)).collect()] == [(1, None, 0.0)]
    assert qd_whitening.whiten(spark.createDataFrame([(1, [])], FIELDS)).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(2 ** 28 * k), 1.0]) for k in range(4)] + [(9, [2.0 ** 40, -3.0])]
    found = qd_whitening.whiten(spark.createDataFrame(rows, FIELDS)).collect()
    _, far, *_ = expected(rows)
    assert {r["vec_id"]: r["deviation"] for r in found} == {k: f if f < 2 ** 63 else None for (k, _), f in zip(rows, far)}


@pytest.mark.parametrize("d", [1, 2, 3, 10, 60])
def test_solvers(d):
    dice = np.random.default_rng(d)
    for spread in (np.ones(d), 10.0 ** -np.linspace(0, 14, d), np.r_[np.full(d // 2, 7.0), np.ones(d - d // 2)]):
        q = np.linalg.qr(dice.normal(size=(d, d)))[0]
        r = np.linalg.qr(np.diag(spread) @ q, mode="r")
        a, b, w = qd_whitening.bidiagonal(r)
        upper = np.diag(a) + np.diag(b, 1)
        assert np.allclose(w @ upper.T @ upper @ w.T, r.T @ r, atol=1e-12 * spread.max() ** 2)
        assert np.allclose(qd_whitening.dqds(a, b), np.linalg.svd(upper, compute_uv=False) ** 2, rtol=1e-9, atol=1e-26)
        values, directions, whole = qd_whitening.components_of(r, 3, 4)
        assert np.allclose(directions.T @ directions, np.eye(min(4, d)), atol=1e-11)
        assert np.allclose(r.T @ r / 3 @ directions, directions * values, atol=1e-11)
        assert whole == pytest.approx((spread ** 2).sum() / 3)
