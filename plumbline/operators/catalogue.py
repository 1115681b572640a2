"""Browse, resource choice and lookups over datasets and resources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import vocab, web
from plumbline.functions.text import strip


def is_readable(fmt: Column) -> Column:
    return F.coalesce(F.upper(strip(fmt)).isin(*vocab.READABLE_FORMATS), F.lit(False))


def eligible_resources(resources: DataFrame) -> DataFrame:
    return resources.filter(
        F.col("is_tabular") & is_readable(F.col("format")) & (F.col("state").isNull() | (F.col("state") == "active"))
    )


def resource_order() -> list[Column]:
    """Store first, CSV before JSON, then position and size (missing last), then id."""
    return [
        F.desc("datastore_active"),
        F.when(F.upper(strip(F.col("format"))) == "CSV", 0).otherwise(1).asc(),
        F.asc_nulls_last("position"), F.asc_nulls_last("size"), F.asc("id"),
    ]


def best_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows of every key; each partition keeps only ``k`` per key before the shuffle."""
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= k).drop("_rn")


def best_resources(resources: DataFrame) -> DataFrame:
    """The one resource a dataset is read through."""
    return best_per_key(eligible_resources(resources), ["dataset_id"], resource_order()).withColumn(
        "access_path", F.when(F.col("datastore_active"), F.lit("datastore")).otherwise(F.lit("download"))
    )


def tabular_datasets(datasets: DataFrame, resources: DataFrame) -> DataFrame:
    """Datasets with something readable, the same rule as the resource choice."""
    return datasets.join(eligible_resources(resources).select(F.col("dataset_id").alias("id")), "id", "left_semi")


def browse_filter(datasets: DataFrame, publisher: str | None = None, theme: str | None = None) -> DataFrame:
    if publisher is not None:
        datasets = datasets.filter(F.col("org_title") == publisher)
    if theme is not None:
        datasets = datasets.filter(F.array_contains(F.transform("theme", web.theme_code), theme))
    return datasets


def list_publishers(datasets: DataFrame, resources: DataFrame) -> DataFrame:
    return (
        tabular_datasets(datasets, resources)
        .filter(strip(F.col("org_title")) != "")
        .groupBy("org_title").agg(F.count(F.lit(1)).alias("dataset_count"))
        .withColumn("kind", web.publisher_kind(F.col("org_title")))
        .orderBy(F.desc("dataset_count"), "org_title")
    )


def list_themes(datasets: DataFrame, resources: DataFrame) -> DataFrame:
    return (
        tabular_datasets(datasets, resources)
        .select(F.explode("theme").alias("uri"))
        .select(web.theme_code(F.col("uri")).alias("code")).filter(F.col("code").isNotNull())
        .groupBy("code").agg(F.count(F.lit(1)).alias("dataset_count"))
        .withColumn("label", web.theme_label(F.col("code")))
        .orderBy(F.desc("dataset_count"), "code")
    )


def offered_formats(resources: DataFrame) -> DataFrame:
    """Distinct formats per dataset, as an ordered list."""
    fmt = F.upper(strip(F.col("format")))
    return (
        resources.filter(fmt != "").groupBy("dataset_id")
        .agg(F.array_sort(F.collect_set(fmt)).alias("formats"))
    )


def list_datasets(
    datasets: DataFrame, resources: DataFrame, publisher: str | None = None, theme: str | None = None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page, newest first; formats and resource are joined for that page only."""
    page = (
        browse_filter(tabular_datasets(datasets, resources), publisher, theme)
        .select("id", "title", "org_title", "last_updated")
        .orderBy(F.desc("last_updated"), "id").offset(max(0, offset)).limit(max(0, limit))
    )
    wanted = F.broadcast(page.select(F.col("id").alias("dataset_id")))  # at most one page
    mine = resources.join(wanted, "dataset_id", "left_semi")
    return (
        page.join(offered_formats(mine).withColumnRenamed("dataset_id", "id"), "id", "left")
        .join(best_resources(mine).select(F.col("dataset_id").alias("id"), F.col("id").alias("resource_id")), "id", "left")
        .select(
            "id", F.coalesce(F.nullif("title", F.lit("")), "id").alias("title"),
            F.coalesce("org_title", F.lit("")).alias("publisher"), "last_updated", "formats", "resource_id",
        )
        .orderBy(F.desc("last_updated"), "id")
    )


def count_datasets(datasets: DataFrame, resources: DataFrame, publisher: str | None = None, theme: str | None = None) -> DataFrame:
    return browse_filter(tabular_datasets(datasets, resources), publisher, theme).agg(F.count(F.lit(1)).alias("n"))


def with_provenance(rows: DataFrame, datasets: DataFrame) -> DataFrame:
    """Title, publisher and update date of each row's dataset; blank when unknown."""
    known = datasets.select(
        F.col("id").alias("dataset_id"), F.col("title").alias("dataset_title"),
        F.col("org_title").alias("publisher"), "last_updated",
    )
    return rows.join(known, "dataset_id", "left")


def lookup_resources(ids: DataFrame, resources: DataFrame) -> DataFrame:
    """Resources named by id; a miss is a typed error, not a lost row."""
    found = resources.withColumnRenamed("id", "resource_id").withColumn("_hit", F.lit(True))
    return ids.join(found, "resource_id", "left").withColumn(
        "error_kind", F.when(F.col("_hit").isNull(), F.lit("unsupported"))
    ).drop("_hit")
