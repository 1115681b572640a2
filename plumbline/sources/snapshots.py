"""Idempotent upserts as new snapshots, and appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise


def latest_per_key(batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last written row of every key; combines on the map side."""
    key = list(key)
    rest = [c for c in batch.columns if c not in key]
    return batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")


def upsert(target: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Target rows not in the batch, plus the batch's last row per key.

    The batch's last rows are written first: the planner then knows their size
    and leaves the target where it lies when they are few.
    """
    key = list(key)
    newest = materialise(latest_per_key(batch, key, order), "newest")
    return target.join(newest.select(*key), key, "left_anti").unionByName(newest.select(*target.columns))


def changes(target: DataFrame, incoming: DataFrame, key: str, signature: str) -> DataFrame:
    """What an incoming full copy changes: added, changed, removed or same."""
    old = target.select(key, F.col(signature).alias("_old"))
    new = incoming.select(key, F.col(signature).alias("_new"))
    return old.join(new, key, "full_outer").select(
        key,
        F.when(F.col("_old").isNull(), F.lit("added"))
        .when(F.col("_new").isNull(), F.lit("removed"))
        .when(F.col("_old") != F.col("_new"), F.lit("changed"))
        .otherwise(F.lit("same")).alias("change"),
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def orphans(resources: DataFrame, datasets: DataFrame) -> DataFrame:
    """Resources whose dataset is missing; must be empty."""
    return resources.join(datasets.select(F.col("id").alias("dataset_id")), "dataset_id", "left_anti")
