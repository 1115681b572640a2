"""Block-wise operators against plain Python, with one key holding most rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import sequences, usage
from plumbline.plans.registry import spread

KEYS = ["hot"] * 6 + ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    data = [(rng.choice(KEYS), i, start + timedelta(seconds=rng.randrange(0, 200_000)), rng.randrange(0, 50)) for i in range(1_500)]
    return data, spark.createDataFrame(data, "k string, id long, t timestamp, v long")


def test_order_breaks(rows):
    data, df = rows
    got = {r["k"]: (r["n_values"], r["n_falls"]) for r in sequences.order_breaks(df, ["k"], F.date_trunc("hour", "t"), ["t", "id"], "v").collect()}
    series = defaultdict(list)
    for k, i, t, v in sorted(data, key=lambda r: (r[2], r[1])):
        series[k].append(v)
    assert got == {k: (len(vs), sum(b < a for a, b in zip(vs, vs[1:]))) for k, vs in series.items()}


def test_next_in_key(rows):
    data, df = rows
    got = {r["id"]: r["n"] for r in sequences.next_in_key(df, ["k"], F.date_trunc("hour", "t"), ["t", "id"], "id", "n").collect()}
    series = defaultdict(list)
    for k, i, t, v in sorted(data, key=lambda r: (r[2], r[1])):
        series[k].append(i)
    want = {a: b for ids in series.values() for a, b in zip(ids, ids[1:] + [None])}
    assert got == want


@pytest.mark.parametrize("buckets", [1, 8])
def test_top_with_remainder(rows, buckets):
    data, df = rows
    groups = df.groupBy("k", F.col("v").cast("string").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("f"))
    got = {(r["k"], r["pos"]): (r["row"]["m"] if r["row"] else None, r["total_n"], r["members"])
           for r in sequences.top_with_remainder(groups, ["k"], "m", [F.desc("n"), F.asc("f")], ["n"], 5, buckets).collect()}
    counts = defaultdict(lambda: defaultdict(lambda: [0, 10**9]))
    for k, i, t, v in data:
        cell = counts[k][str(v)]
        cell[0] += 1
        cell[1] = min(cell[1], i)
    want = {}
    for k, members in counts.items():
        order = sorted(members.items(), key=lambda m: (-m[1][0], m[1][1]))
        for pos, (m, (n, _)) in enumerate(order[:5], start=1):
            want[(k, pos)] = (m, n, 1)
        if order[5:]:
            want[(k, 6)] = (None, sum(n for _, (n, _) in order[5:]), len(order) - 5)
    assert got == want


@pytest.mark.parametrize("limit", [0, 1, 700, 5_000])
def test_keep_newest(rows, limit):
    data, df = rows
    got = {r["id"] for r in usage.keep_newest(df, limit, "t", "id").collect()}
    assert got == {i for _, i, _, _ in sorted(data, key=lambda r: (r[2], r[1]), reverse=True)[:limit]}


def test_keep_newest_when_all_share_one_instant(spark):
    df = spark.range(1_000).select("id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("t"))
    assert {r["id"] for r in usage.keep_newest(df, 10, "t", "id").collect()} == set(range(990, 1_000))


def test_evict_least_recent(rows):
    data, df = rows
    got = {r["id"] for r in usage.evict_least_recent(df, 9_999, "t", "v", "id").collect()}
    total, want = 0, set()
    for _, i, _, v in sorted(data, key=lambda r: (r[2], r[1]), reverse=True):
        total += v
        if total > 9_999:
            break
        want.add(i)
    assert got == want


def test_percentiles(spark):
    five = spark.createDataFrame([(float(v),) for v in (100, 200, 300, 400, 5000)], "v double")
    assert tuple(usage.exact_percentiles(five, F.col("v"), (50, 95)).first()) == (300.0, 5000.0)
    rng = random.Random(3)
    values = [rng.uniform(-10, 1_000) for _ in range(777)]
    many = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values)
    want = tuple(ordered[max(1, -(-p * len(values) // 100)) - 1] for p in (1, 50, 95, 99, 100))
    assert tuple(usage.exact_percentiles(many, F.col("v"), (1, 50, 95, 99, 100)).first()) == want


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], usage.METRICS_SCHEMA)
    row = usage.summary(empty).first()
    assert row["total"] == 0 and row["p50"] == 0.0 and row["prompt_tokens"] == 0


def test_cache_rules(spark):
    fetched = spark.createDataFrame([
        ("r", "m1", None, True, 10, 1, "2026-01-01"), ("r", "m2", None, True, 11, 1, "2026-01-02"), ("r", "m3", None, False, 12, 1, "2026-01-03"),
        ("s", "", "x", True, 5, 1, "2026-01-01"), ("t", None, None, True, 5, 1, "2026-01-01"),
    ], "resource_id string, last_modified string, metadata_modified string, complete boolean, bytes long, parser_version int, cached_at string")
    records = usage.store_records(fetched)
    assert {r["resource_id"]: r["key"]["value"] for r in records.collect()} == {"r": "m2", "s": "x"}
    asked = spark.createDataFrame([("r", "m2", None), ("s", None, "x"), ("t", None, None), ("r", "m1", None)], "resource_id string, last_modified string, metadata_modified string")
    now = F.lit("2026-01-10").cast("timestamp")
    assert sorted(tuple(r) for r in usage.lookup(asked, records, now, 1).collect()) == [("r", False), ("r", True), ("s", True), ("t", False)]
    assert not any(r["hit"] for r in usage.lookup(asked, records, now, 2).collect())
    assert not any(r["hit"] for r in usage.lookup(asked, records, now, 1, ttl_s=60).collect())
    log = spark.createDataFrame([("r", "2026-02-01")], "resource_id string, accessed_at string")
    assert {r["resource_id"]: r["last_accessed"] for r in usage.touch(records, log).collect()} == {"r": "2026-02-01", "s": "2026-01-01"}


def test_spread_keeps_large_inputs(spark):
    many = spark.range(100).repartition(16)
    assert spread(many) is many
