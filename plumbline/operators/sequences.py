"""Ordered work inside one key without putting the whole key into one task.

A key may hold a third of all rows, so a window over the key alone would sort a
third of the data in one task.  These operators work in two steps: inside
(key, block), where a block is a fixed slice of the ordering column, and then
over one summary row per (key, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_breaks(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], value: str) -> DataFrame:
    """Per key: pairs of neighbours compared and how often the value fell.

    ``block`` must be non-decreasing in ``order``.
    """
    inner = W.partitionBy(*keys, "_block").orderBy(*order)
    position = F.struct(*order)
    blocks = (
        df.withColumn("_block", block)
        .withColumn("_before", F.lag(value).over(inner))
        .groupBy(*keys, "_block")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col(value) < F.col("_before")).alias("_falls"),
            F.min(F.struct(position.alias("p"), F.col(value).alias("v"))).alias("_first"),
            F.max(F.struct(position.alias("p"), F.col(value).alias("v"))).alias("_last"),
        )
    )
    outer = W.partitionBy(*keys).orderBy("_block")
    return (
        blocks.withColumn("_carry", F.lag("_last").over(outer))
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("n_values"),
            (F.sum("_falls") + F.count_if(F.col("_first.v") < F.col("_carry.v"))).alias("n_falls"),
        )
    )


def block_offsets(df: DataFrame, keys: Sequence[str], block: Column, amount: Column, descending: bool = False) -> DataFrame:
    """Sum of ``amount`` in all earlier blocks of the key: keys, _block, offset, total."""
    sums = df.groupBy(*keys, block.alias("_block")).agg(amount.alias("_amount"))
    by = F.desc("_block") if descending else F.asc("_block")
    before = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(
        *keys, "_block",
        F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("offset"),
        F.sum("_amount").over(W.partitionBy(*keys)).alias("total"),
        F.col("_amount").alias("block_amount"),
    )


def next_in_key(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], take: str, out: str) -> DataFrame:
    """The following row's ``take`` within the key, across block borders."""
    inner = W.partitionBy(*keys, "_block").orderBy(*order)
    blocked = df.withColumn("_block", block)
    firsts = blocked.groupBy(*keys, "_block").agg(
        F.min(F.struct(*order, F.col(take).alias("_take"))).alias("_first")
    )
    upcoming = firsts.select(
        *keys, "_block", F.lead("_first._take").over(W.partitionBy(*keys).orderBy("_block")).alias("_next_block")
    )
    inside = blocked.withColumn("_next", F.lead(take).over(inner)).withColumn("_is_last", F.lead(F.lit(1)).over(inner).isNull())
    return (
        inside.join(upcoming, [*keys, "_block"])
        .withColumn(out, F.when(F.col("_is_last"), F.col("_next_block")).otherwise(F.col("_next")))
        .drop("_block", "_next", "_is_last", "_next_block")
    )


def top_with_remainder(
    groups: DataFrame,
    keys: Sequence[str],
    member: str,
    order: Sequence[Column],
    sums: Sequence[str],
    n: int,
    buckets: int = 64,
    ends: Sequence[str] = (),
) -> DataFrame:
    """The first ``n`` members of every key, and one remainder row for the rest.

    Columns in ``sums`` are added up, of those in ``ends`` the least and the largest are kept.

    ``groups`` has one row per (key, member).  Ranking happens first inside
    (key, hash bucket of the member); what falls past ``n`` there can never be
    in the top and is summed at once.  Only ``buckets * (n + 1)`` rows per key
    reach the final ranking.
    """
    keys = list(keys)
    if n < 1:
        raise ValueError("n must be at least 1")
    local = W.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = groups.withColumn("_bucket", F.pmod(F.xxhash64(member), F.lit(buckets))).withColumn(
        "_rank", F.row_number().over(local)
    )
    names = [c for c in groups.columns if c not in keys]
    kept = F.col("_rank") <= n
    reduced = ranked.groupBy(*keys, "_bucket", F.when(kept, F.col("_rank")).alias("_slot")).agg(
        F.count(F.lit(1)).alias("_members"),
        *[F.sum(c).alias(f"_sum_{c}") for c in sums], *[f(c).alias(f"_{n}_{c}") for c in ends for n, f in (("low", F.min), ("high", F.max))],
        F.first(F.when(kept, F.struct(*names)), ignorenulls=True).alias("_row"),
    )
    flat = reduced.select(*keys, "_members", *[f"_sum_{c}" for c in sums], *[f"_{e}_{c}" for c in ends for e in ("low", "high")], "_row", *[F.col(f"_row.{c}").alias(c) for c in names])
    final = W.partitionBy(*keys).orderBy(F.col("_row").isNull(), *order)
    placed = flat.withColumn("_place", F.row_number().over(final))
    top = F.col("_row").isNotNull() & (F.col("_place") <= n)
    return (
        placed.groupBy(*keys, F.when(top, F.col("_place")).alias("pos"))
        .agg(
            F.sum("_members").alias("members"),
            *[F.sum(f"_sum_{c}").alias(f"total_{c}") for c in sums],
            *[f(f"_{e}_{c}").alias(f"{e}_{c}") for c in ends for e, f in (("low", F.min), ("high", F.max))],
            F.first(F.when(top, F.struct(*names)), ignorenulls=True).alias("row"),
        )
        .withColumn("is_remainder", F.col("pos").isNull())
        .withColumn("pos", F.coalesce("pos", F.lit(n + 1)))
    )
