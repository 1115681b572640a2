"""Catalogue pages as landed JSON, normalised to datasets and resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.text import strip

RESOURCE_RAW = (
    "struct<id:string,name:string,description:string,format:string,mimetype:string,mimetype_inner:string,url:string,"
    "size:string,datastore_active:boolean,position:int,last_modified:string,metadata_modified:string,state:string>"
)
PACKAGE_RAW = (
    "struct<id:string,name:string,type:string,state:string,title:string,notes:string,"
    "title_translated:struct<en:string>,notes_translated:struct<en:string>,"
    "organization:struct<name:string,title:string>,license_id:string,license_title:string,frequency:string,"
    "language_options:array<string>,theme:array<string>,tags:array<struct<name:string>>,"
    "temporal_coverage:array<struct<start:string,end:string>>,spatial_coverage:array<struct<text:string>>,"
    f"metadata_created:string,metadata_modified:string,resources:array<{RESOURCE_RAW}>>"
)
PAGE_SCHEMA = f"count long, results array<{PACKAGE_RAW}>"


def read_packages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed pages ``{count, results: [...]}``, one row per package."""
    reader = spark.readStream if stream else spark.read
    pages = reader.schema(PAGE_SCHEMA).option("multiLine", "true").json(path)
    return pages.select(F.explode("results").alias("p")).select("p.*")


def search_text(title: Column, title_en: Column, tags: Column, notes: Column, notes_en: Column) -> Column:
    """Titles and tags first, long descriptions last; empty parts left out."""
    parts = [title, title_en, F.array_join(tags, " "), notes, notes_en]
    return F.concat_ws("\n", *[F.nullif(strip(p), F.lit("")) for p in parts])


def active_packages(packages: DataFrame) -> DataFrame:
    return packages.filter((F.col("type") == "dataset") & (F.col("state") == "active"))


def normalise_datasets(packages: DataFrame, harvested_at: Column) -> DataFrame:
    empty = F.array().cast("array<string>")
    tags = F.coalesce(F.transform("tags", lambda t: t["name"]), empty)
    return active_packages(packages).select(
        "id", "name", "title", F.col("title_translated.en").alias("title_en"), "notes",
        F.col("notes_translated.en").alias("notes_en"),
        F.col("organization.name").alias("org_name"), F.col("organization.title").alias("org_title"),
        "license_id", "license_title", "frequency",
        F.coalesce("language_options", empty).alias("language_options"), F.coalesce("theme", empty).alias("theme"),
        F.coalesce(F.array_size("resources"), F.lit(0)).alias("num_resources"), tags.alias("tags"),
        F.get("temporal_coverage", F.lit(0))["start"].alias("temporal_start"),
        F.get("temporal_coverage", F.lit(0))["end"].alias("temporal_end"),
        F.get("spatial_coverage", F.lit(0))["text"].alias("spatial_text"),
        "metadata_created", F.col("metadata_modified").alias("last_updated"), "state",
        harvested_at.alias("harvested_at"),
        search_text(F.col("title"), F.col("title_translated.en"), tags, F.col("notes"), F.col("notes_translated.en")).alias("search_text"),
    )


def normalise_resources(packages: DataFrame) -> DataFrame:
    raw = active_packages(packages).select(F.col("id").alias("dataset_id"), F.explode("resources").alias("r"))
    size = strip(F.col("r.size"))
    return raw.select(
        F.col("r.id").alias("id"), "dataset_id", F.col("r.name").alias("name"), F.col("r.description").alias("description"),
        F.col("r.format").alias("format"),
        F.coalesce(F.nullif(F.col("r.mimetype"), F.lit("")), F.col("r.mimetype_inner")).alias("mimetype"),
        F.col("r.url").alias("url"), F.when(size.rlike("^[0-9]+$"), size.try_cast("long")).alias("size"),
        F.coalesce(F.col("r.datastore_active"), F.lit(False)).alias("datastore_active"),
        F.col("r.position").alias("position"), F.col("r.last_modified").alias("last_modified"),
        F.col("r.metadata_modified").alias("metadata_modified"), F.col("r.state").alias("state"),
        is_tabular(F.col("r.format")).alias("is_tabular"),
    )


def is_tabular(fmt: Column) -> Column:
    return F.upper(strip(F.coalesce(fmt, F.lit("")))).isin(*vocab.TABULAR_FORMATS)


def harvest_counts(packages: DataFrame) -> DataFrame:
    """seen, skipped, datasets and resources of one harvest, in one pass."""
    kept = F.coalesce((F.col("type") == "dataset") & (F.col("state") == "active"), F.lit(False))
    return packages.agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(~kept).alias("skipped"), F.count_if(kept).alias("datasets"),
        F.coalesce(F.sum(F.when(kept, F.coalesce(F.array_size("resources"), F.lit(0)))), F.lit(0)).alias("resources"),
    )
