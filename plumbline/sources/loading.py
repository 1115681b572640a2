"""Resources with landed payloads to tables and cells, whatever the payload is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.sizes import broadcast_if_small
from plumbline.session import materialise
from plumbline.sources import payloads


@dataclass(frozen=True)
class LoadedTables:
    """tables: rid, row_count, complete, incomplete_reason, header_trusted, error - cells, columns."""

    tables: DataFrame
    cells: DataFrame

    @property
    def columns(self) -> DataFrame:
        return payloads.source_types(self.cells)


def load_tables(resources: DataFrame, landed: DataFrame, max_rows: int | None = None) -> LoadedTables:
    """Join resources with their payloads and read each by its actual kind.

    ``resources``: id, format - ``landed``: rid, content, body_complete.  A resource
    without a payload is ``unavailable``; a body that is no table is ``malformed``.
    """
    # a body's kind is told where the body lies; only ids and kinds meet the resources
    told = landed.withColumn("kind", payloads.payload_kind(F.col("content")))
    arrived = told.select("rid", "body_complete", "kind", F.col("content").isNotNull().alias("arrived"))
    met = resources.select(F.col("id").alias("rid"), "format").join(arrived, "rid", "left")
    lost = ~F.coalesce("arrived", F.lit(False))
    why = F.when(lost, F.lit("no payload landed")).otherwise(payloads.kind_error(F.col("kind"), F.col("format")))
    as_json = (F.col("kind") == "json") | F.coalesce(F.upper(F.trim("format")) == "JSON", F.lit(False))
    verdicts = materialise(met.select("rid", "body_complete", "kind", lost.alias("lost"), why.alias("refused"), as_json.alias("as_json")), "kinds")
    readable = verdicts.filter("refused is null")
    text_files = readable.filter("not as_json")
    # bodies are parsed by their kind, without a shuffle; the few that are declared to be JSON and look otherwise are told apart by id
    declared = broadcast_if_small(materialise(readable.filter("kind = 'csv'").groupBy("rid").agg(
        F.bool_or("as_json").alias("as_json"), F.bool_and("as_json").alias("only_json")).filter("as_json"), "declared"))
    bodies = told.join(declared, "rid", "left")
    parsed = materialise(payloads.parse_delimited(bodies.filter("kind = 'csv' and not coalesce(only_json, false)"), max_rows), "parsed")
    records = materialise(payloads.parse_records(bodies.filter("kind = 'json' or kind = 'csv' and as_json"), max_rows), "records")
    delimited = payloads.payload_tables(parsed, text_files).select(
        "rid", "row_count", "complete", "incomplete_reason", "header_trusted", "error_kind", "error_detail")
    json_counts = records.groupBy("rid").agg(
        F.count("row_idx").alias("row_count"), F.max("truncated").alias("truncated"), F.bool_or(F.col("error_kind").isNotNull()).alias("bad"))
    reason = F.when(F.col("truncated"), F.lit("row_cap")).when(~F.col("body_complete"), F.lit("byte_cap"))
    json_tables = json_counts.join(readable.select("rid", "body_complete"), "rid").withColumn(
        "error_kind", F.when(F.col("bad") | (F.col("row_count") == 0), F.lit("malformed"))).select(
        "rid", "row_count", F.when(F.col("error_kind").isNull(), reason.isNull()).alias("complete"),
        F.when(F.col("error_kind").isNull(), reason).alias("incomplete_reason"), F.lit(True).alias("header_trusted"), "error_kind",
        F.when(F.col("error_kind").isNotNull(), F.lit("JSON payload holds no single list of records")).alias("error_detail"))
    refused = verdicts.filter("refused is not null").select(
        "rid", F.lit(0).cast("long").alias("row_count"), F.lit(None).cast("boolean").alias("complete"), F.lit(None).cast("string").alias("incomplete_reason"),
        F.lit(None).cast("boolean").alias("header_trusted"),
        F.when(F.col("lost"), F.lit("unavailable")).otherwise(F.lit("malformed")).alias("error_kind"), F.col("refused").alias("error_detail"))
    tables = delimited.unionByName(json_tables).unionByName(refused)
    good = tables.filter("error_kind is null").select("rid")
    header = payloads.record_header(records)
    cells = payloads.payload_cells(parsed).select("rid", "row_idx", F.col("col_idx").cast("long").alias("col_idx"), "col_name", "cell").unionByName(
        payloads.record_cells(records, header).select("rid", "row_idx", F.col("col_idx").cast("long").alias("col_idx"), "col_name", "cell"))
    return LoadedTables(tables, cells.join(good, "rid", "left_semi"))


def tables_for_plans(plans: DataFrame, tables: DataFrame, datasets: DataFrame) -> DataFrame:
    """Matched plans with their table and provenance; a missing table is an error row."""
    known = datasets.select(F.col("id").alias("dataset_id"), F.col("org_title").alias("publisher"), "last_updated")
    found = tables.withColumnRenamed("rid", "resource_id").withColumn("_hit", F.lit(True))
    return (
        plans.filter("status = 'matched'").join(found, "resource_id", "left").join(known, "dataset_id", "left")
        .withColumn("error_kind", F.coalesce("error_kind", F.when(F.col("_hit").isNull(), F.lit("unavailable")))).drop("_hit")
    )


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions: qid, question, lang, expected_id, one JSON object per line."""
    return spark.read.schema("qid string, question string, lang string, expected_id string").json(path)
