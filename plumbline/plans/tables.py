"""From cells to facts, for all tables at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.text import safe_label
from plumbline.operators import coercion, facts, roles
from plumbline.operators.cells import assemble_rows
from plumbline.session import materialise


@dataclass(frozen=True)
class TableAnalysis:
    """Everything known about the columns of each table, and its bound rows."""

    tables: DataFrame
    cells: DataFrame
    profile: DataFrame
    values: DataFrame
    roles: DataFrame
    bindings: DataFrame
    rows: DataFrame


def analyse_tables(cells: DataFrame, tables: DataFrame, write: bool = True) -> TableAnalysis:
    """Profile, classify and bind the columns of every table.

    ``tables``: rid, title, complete, header_trusted.  Distinct cells, values,
    roles, bindings and assembled rows each feed several consumers; with ``write``
    they are written once to the shared folder and read from there.  Cells
    themselves are typed only for the columns an answer needs.
    """
    keep = materialise if write else (lambda df, name: df)
    distinct = keep(coercion.distinct_cells(cells), "distinct")
    profile = keep(coercion.column_profile(distinct), "profile")
    values = keep(roles.value_counts(coercion.typed_cells(distinct, profile)), "values")
    column_roles = keep(roles.column_roles(cells, profile, values, tables, keep), "roles")
    bound = keep(roles.bindings(column_roles), "bindings")
    slots = roles.slots(bound)
    needed = cells.join(slots.select("rid", "col_idx"), ["rid", "col_idx"], "left_semi")
    rows = assemble_rows(coercion.typed_cells(needed, profile), slots).select(
        "rid", "row_idx", "moment", "label", "value",
        F.array_join(
            F.concat(F.transform("series_cells", lambda s: s["text"]), F.array_compact(F.array(F.col("label")))), " · "
        ).alias("identity"),
    )
    return TableAnalysis(tables, cells, profile, values, column_roles, bound, keep(rows, "rows"))


def _rows_for(analysis: TableAnalysis, operation: str) -> DataFrame:
    chosen = analysis.bindings.filter(F.col("operation") == operation).select("rid")
    return analysis.rows.join(chosen, "rid")


def table_facts(analysis: TableAnalysis, language: str = "en") -> DataFrame:
    """rid, operation, pos, label, value, unit, n_used, n, basis, is_remainder, omitted."""
    lang = F.lit(language)
    bound = analysis.bindings.select("rid", "measure", "dimension", "unit", "operation")

    def grouped(operation: str) -> DataFrame:
        out = facts.grouped_facts(_rows_for(analysis, operation), operation, language=lang)
        return out.join(bound, "rid").select(
            "rid", "operation", "pos", "label", F.col("value").cast("decimal(38,12)").alias("value"),
            F.when(F.lit(operation == "sum"), F.col("unit")).alias("unit"), "n_used", "n",
            F.when(F.col("is_remainder"), facts.remainder_basis(lang, operation, F.col("omitted"))).otherwise(
                facts.basis_text(lang, F.lit(operation), F.col("measure") if operation == "sum" else F.col("dimension"), F.col("n_used"))
            ).alias("basis"),
            "is_remainder", F.col("omitted").cast("long").alias("omitted"), "label_key",
        )

    ends = facts.series_ends(facts.time_series(_rows_for(analysis, "none")))
    both = F.explode(F.array(
        F.struct(F.lit(1).alias("pos"), F.col("first_dim").alias("dim"), F.col("first_value").alias("value")),
        F.struct(F.lit(2).alias("pos"), F.col("last_dim").alias("dim"), F.col("last_value").alias("value")),
    ))
    series = ends.select("rid", "n_used", both.alias("e")).join(bound, "rid").select(
        "rid", "operation", "e.pos", F.col("e.dim").cast("string").alias("label"), "e.value", "unit", "n_used",
        F.lit(1).cast("long").alias("n"),
        facts.basis_text(lang, F.lit("none"), F.col("measure"), F.col("n_used")).alias("basis"),
        F.lit(False).alias("is_remainder"), F.lit(0).cast("long").alias("omitted"),
    )
    latest = facts.latest_of_cumulative(_rows_for(analysis, "latest")).join(bound, "rid").select(
        "rid", "operation", F.lit(1).alias("pos"), F.col("measure").alias("label"),
        F.col("value").cast("decimal(38,12)").alias("value"), "unit", "n_used", F.col("n_used").alias("n"),
        facts.latest_basis(lang, F.col("measure"), F.col("as_of"), F.col("n_used")).alias("basis"),
        F.lit(False).alias("is_remainder"), F.lit(0).cast("long").alias("omitted"),
    )
    return grouped("sum").unionByName(grouped("count")).unionByName(series, allowMissingColumns=True).unionByName(latest, allowMissingColumns=True)


def table_series(analysis: TableAnalysis, fact_rows: DataFrame) -> DataFrame:
    """Chart points of every table: rid, series, dim, value, pos."""
    bars = fact_rows.filter(F.col("operation").isin("sum", "count")).select(
        "rid", F.lit("").alias("series"), F.col("label").alias("dim"), "value", F.col("pos").cast("long").alias("pos"),
        F.concat(F.when(F.col("is_remainder"), F.lit("r")).otherwise(F.lit("k")), F.coalesce("label_key", F.lit(""))).alias("key"),
    )
    bound = analysis.bindings.select("rid", "measure")
    lines = facts.time_series(_rows_for(analysis, "none")).join(bound, "rid").select(
        "rid", F.when(F.col("series") == "—", F.col("measure")).otherwise(F.col("series")).alias("series"),
        F.col("dim").cast("string").alias("dim"), "value", F.lit(None).cast("long").alias("pos"), F.col("dim").cast("string").alias("key"),
    )
    last = facts.latest_values(_rows_for(analysis, "latest")).select(
        "rid", F.lit("").alias("series"), safe_label(F.col("label")).alias("dim"), "value", F.lit(None).cast("long").alias("pos"),
        F.col("label").alias("key"),
    )
    return bars.unionByName(lines).unionByName(last)


def fact_headers(analysis: TableAnalysis, fact_rows: DataFrame) -> DataFrame:
    """One row per table: operation, what it rests on and what limits it."""
    counted = fact_rows.groupBy("rid").agg(
        F.count(F.lit(1)).alias("n_facts"),
        F.max(F.when(~F.col("is_remainder"), F.col("n_used"))).alias("fact_basis"),
        F.max("omitted").alias("omitted"),
    )
    dupes = facts.series_duplicates(_rows_for(analysis, "none")).select("rid", "n_series", "duplicates", F.col("n_used").alias("series_points"))
    totals = facts.stated_totals(_rows_for(analysis, "sum"))
    merged = roles.merged_variants(analysis.values, analysis.bindings).groupBy("rid").agg(
        F.count(F.lit(1)).alias("merged_spellings")
    )
    partial = analysis.tables.filter(~F.col("complete")).select("rid")
    cut = facts.categorical_truncation(analysis.rows.join(partial, "rid")).select("rid", "categorical_truncation")
    flagged = analysis.profile.groupBy("rid").agg(F.sum("flagged_count").alias("flagged_cells"))
    out = (
        analysis.bindings.join(analysis.tables, "rid")
        .join(counted, "rid", "left").join(dupes, "rid", "left").join(totals, "rid", "left")
        .join(merged, "rid", "left").join(cut, "rid", "left").join(flagged, "rid", "left")
    )
    duplicated = F.coalesce(F.col("duplicates"), F.lit(0)) > 0
    operation = F.when(duplicated, F.lit("listing")).otherwise(F.col("operation"))
    timed = operation.isin("none", "latest")
    has_facts = F.col("n_facts").isNotNull() | (F.col("series_points") > 0) | (operation == "listing")
    aggregated = operation.isin("sum", "count")
    return out.select(
        "rid", operation.alias("operation"), F.coalesce(has_facts, F.lit(False)).alias("has_facts"),
        F.when(operation == "listing", F.coalesce("series_points", "n_rows"))
        .otherwise(F.coalesce("fact_basis", "series_points")).alias("row_basis"),
        "n_rows", "dimension", "temporal", "measure", "measure_role", "unit", "scale_hint", "forbidden_ops",
        "observed_from", "observed_to",
        F.coalesce("omitted", F.lit(0)).alias("omitted"),
        F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.coalesce("n_series", F.lit(0)).alias("n_series"),
        "stated_label", "stated_total", "total_confirmed",
        F.coalesce("merged_spellings", F.lit(0)).alias("merged_spellings"),
        (timed & ~F.col("complete")).alias("truncated_range"),
        F.coalesce(F.col("categorical_truncation") & aggregated, F.lit(False)).alias("categorical_truncation"),
        (~F.col("complete") & (operation == "sum") & F.col("non_negative")).alias("is_lower_bound"),
        F.coalesce("flagged_cells", F.lit(0)).alias("flagged_cells"),
        "complete", "header_trusted", "title",
    )


def unpivot_measures(analysis: TableAnalysis) -> DataFrame:
    """Measures side by side turned into rows: rid, row_idx, label, measure, value.

    For tables with a label, no time axis and at least two measures.
    """
    wide = analysis.bindings.filter(
        F.col("temporal_idx").isNull() & F.col("dimension_idx").isNotNull() & (F.col("measures") >= 2)).select("rid")
    measures = analysis.roles.filter(F.col("role") == "measure").select("rid", "col_idx")
    labels = analysis.rows.join(wide, "rid").select("rid", "row_idx", "label")
    typed = coercion.typed_cells(analysis.cells.join(measures.join(wide, "rid"), ["rid", "col_idx"], "left_semi"), analysis.profile)
    return (
        typed.join(labels, ["rid", "row_idx"])
        .select("rid", "row_idx", "label", F.col("col_name").alias("measure"), F.col("number").alias("value"))
    )
