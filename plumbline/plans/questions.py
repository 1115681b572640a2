"""Facts per question: the rows it asked for, the aggregate it asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import group_key
from plumbline.operators import facts
from plumbline.plans import answers
from plumbline.plans.tables import TableAnalysis
from plumbline.session import materialise

REQUESTABLE = ("sum", "count", "avg", "min", "max")


def requested_operations(plans: DataFrame, bindings: DataFrame) -> DataFrame:
    """qid, rid, params and the operation: the one asked for, where it is allowed.

    A time axis keeps its own operation; a forbidden or unknown aggregate falls
    back to what the table supports.
    """
    asked = plans.filter("status = 'matched'").select("qid", F.col("resource_id").alias("rid"), "params")
    wanted = F.col("params.aggregation")
    grouped = F.col("operation").isin("sum", "count") & F.col("dimension_idx").isNotNull()
    has_measure = F.col("measure_role") == "measure"
    allowed = (wanted == "count") | (wanted.isin("sum", "avg", "min", "max") & has_measure & ~F.array_contains("forbidden_ops", wanted))
    return asked.join(bindings, "rid").withColumn(
        "operation", F.when(grouped & F.coalesce(allowed, F.lit(False)), wanted).otherwise(F.col("operation")))


def question_rows(operations: DataFrame, analysis: TableAnalysis) -> DataFrame:
    """Bound rows of each question after its period and region.

    A region is looked for in the column that holds it, whichever that is.  A
    request that the table cannot serve is not applied; ``answers.unbound_params`` reports it.
    """
    unbound = answers.unbound_params(operations.select("qid", "rid", "params"), analysis.bindings, analysis.values, analysis.roles)
    asked = operations.select("qid", "rid", "params", F.col("operation").alias("op")).join(unbound.select("qid", "unbound", "region_column"), "qid")
    timed = ~F.array_contains("unbound", "date")
    wanted = asked.select(
        "qid", "rid", "op", F.when(timed, F.col("params.date_from").try_cast("date")).alias("date_from"),
        F.when(timed, F.col("params.date_to").try_cast("date")).alias("date_to"),
        "region_column", F.when(F.col("region_column").isNotNull(), group_key(F.col("params.region"))).alias("region"))
    everywhere = analysis.rows.join(wanted.filter("region is null"), "rid")
    places = wanted.filter("region is not null")
    held = analysis.cells.select("rid", "row_idx", F.col("col_name").alias("region_column"), group_key(F.col("cell")).alias("region")).join(
        places, ["rid", "region_column", "region"])
    somewhere = analysis.rows.join(held, ["rid", "row_idx"])
    rows = facts.apply_period(everywhere.unionByName(somewhere.select(*everywhere.columns)), F.col("date_from"), F.col("date_to"))
    return rows.drop("date_from", "date_to", "region_column", "region")


def question_facts(plans: DataFrame, analysis: TableAnalysis) -> DataFrame:
    """qid, operation, pos, label, value, n, n_used, is_remainder, omitted.

    A limit asked for cuts what is shown, after aggregation, and never the rows
    the figures rest on.  A question whose rows are all filtered away has no
    facts, which is a refusal and not a zero.
    """
    operations = requested_operations(plans, analysis.bindings)
    rows = materialise(question_rows(operations, analysis), "question_rows")
    out = None
    for operation in REQUESTABLE:
        part = facts.grouped_facts(rows.filter(F.col("op") == operation), operation, keys=["qid"]).select(
            "qid", F.lit(operation).alias("operation"), F.col("pos").cast("long").alias("pos"), "label", F.col("value").cast("decimal(38,12)").alias("value"),
            "n", "n_used", "is_remainder", F.col("omitted").cast("long").alias("omitted"))
        out = part if out is None else out.unionByName(part)
    latest = facts.latest_of_cumulative(rows.filter("op = 'latest'"), keys=["qid"]).join(operations.select("qid", "measure"), "qid").select(
        "qid", F.lit("latest").alias("operation"), F.lit(1).cast("long").alias("pos"), F.col("measure").alias("label"), F.col("value").cast("decimal(38,12)").alias("value"),
        F.col("n_used").alias("n"), "n_used", F.lit(False).alias("is_remainder"), F.lit(0).cast("long").alias("omitted"))
    ends = facts.series_ends(facts.time_series(rows.filter("op = 'none'"), keys=["qid"]), keys=["qid"])
    both = F.explode(F.array(
        F.struct(F.lit(1).cast("long").alias("pos"), F.col("first_dim").alias("d"), F.col("first_value").alias("v")),
        F.struct(F.lit(2).cast("long").alias("pos"), F.col("last_dim").alias("d"), F.col("last_value").alias("v"))))
    series = ends.select("qid", "n_used", both.alias("e")).select(
        "qid", F.lit("none").alias("operation"), "e.pos", F.col("e.d").cast("string").alias("label"), F.col("e.v").cast("decimal(38,12)").alias("value"),
        F.lit(1).cast("long").alias("n"), "n_used", F.lit(False).alias("is_remainder"), F.lit(0).cast("long").alias("omitted"))
    limits = operations.select("qid", F.col("params.limit").alias("_limit"))
    return (
        out.unionByName(latest).unionByName(series).join(limits, "qid")
        .filter(F.col("_limit").isNull() | (F.col("pos") <= F.col("_limit"))).drop("_limit")
    )
