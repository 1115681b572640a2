"""Guarded aggregation: only figures the data supports.

Input rows are keyed by one or more columns (``rid`` for tables, ``qid`` for
questions) with ``row_idx, label, value, moment``.  Every first aggregate is by
(key, label key, spelling) and combines on the map side, so a key that holds a
third of all rows is reduced before anything is grouped by the key alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.text import fold, fold_literals, group_key, safe_label
from plumbline.operators.sizes import broadcast_if_small
from plumbline.operators.sequences import block_offsets, top_with_remainder

RID = ("rid",)
ROW_BLOCK = 1_000_000


def is_total_label(label: Column, labels=vocab.TOTAL_ROW_LABELS) -> Column:
    return fold(label).isin(*fold_literals(labels)) if labels else F.lit(False)


def is_residual_label(label: Column, labels=vocab.RESIDUAL_ROW_LABELS) -> Column:
    return fold(label).isin(*fold_literals(labels))


def label_groups(
    rows: DataFrame, keys: Sequence[str] = RID, with_value: bool = True, total_labels=vocab.TOTAL_ROW_LABELS
) -> DataFrame:
    """One row per (key, label key): total, count, commonest spelling, first row.

    The label key is worked out once per distinct spelling, not once per row.
    """
    keys = list(keys)
    if with_value:
        # rows without a value drop out after the first aggregate, so a computed
        # value is worked out once and not a second time in a filter
        counted = F.count("value")
        first = F.min(F.when(F.col("value").isNotNull(), F.col("row_idx")))
        measures = [F.sum("value").alias("_sum"), F.min("value").alias("_min"), F.max("value").alias("_max")]
    else:
        counted, first, measures = F.count(F.lit(1)), F.min("row_idx"), []
    spelled = (
        rows.filter(F.col("label").isNotNull())
        .groupBy(*keys, "label").agg(counted.alias("_n"), first.alias("_first"), *measures)
        # tied to the count, so that the label test stays above the aggregate
        .filter(F.when(F.col("_n") > 0, ~is_total_label(F.col("label"), total_labels)).otherwise(False))
    )
    spelled = spelled.withColumn("label_key", group_key(F.col("label")))
    merged = [F.sum("_sum").alias("total"), F.min("_min").alias("min_value"), F.max("_max").alias("max_value")] if with_value else []
    return spelled.groupBy(*keys, "label_key").agg(
        F.sum("_n").alias("n"),
        F.min("_first").alias("first_row"),
        F.max_by("label", F.struct("_n", (-F.col("_first")).alias("f"))).alias("label"),
        F.count(F.lit(1)).alias("spellings"),
        *merged,
    )


def stated_totals(rows: DataFrame, keys: Sequence[str] = RID, tolerance: str = vocab.TOTAL_TOLERANCE, total_labels=vocab.TOTAL_ROW_LABELS) -> DataFrame:
    """Totals the publisher wrote as a row, and whether the figures confirm them.

    ``confirmed`` means within the tolerance of the sum of all other rows.
    """
    keys = list(keys)
    spelled = rows.groupBy(*keys, "label").agg(F.sum("value").alias("_sum"))
    flagged = F.coalesce(is_total_label(F.col("label"), total_labels), F.lit(False))
    others = spelled.groupBy(*keys).agg(
        F.sum(F.when(~flagged, F.col("_sum"))).alias("others"), F.max(flagged).alias("has_total")
    ).filter("has_total")
    total_rows = rows.filter(flagged & F.col("value").isNotNull()).select(*keys, "row_idx", "label", "value")
    near = (F.col("others") != 0) & (F.abs(F.col("value") - F.col("others")) <= F.abs(F.col("others")) * F.lit(tolerance).cast("decimal(3,2)"))
    joined = total_rows.join(others, keys).withColumn("near", near)
    best = joined.groupBy(*keys).agg(
        F.max("near").alias("confirmed"),
        F.min_by(F.struct("label", "value"), F.struct((~F.col("near")).alias("far"), "row_idx")).alias("t"),
        F.max("others").alias("sum_of_others"),
    )
    return best.select(
        *keys, safe_label(F.col("t.label")).alias("stated_label"), F.col("t.value").alias("stated_total"),
        "sum_of_others", F.coalesce("confirmed", F.lit(False)).alias("total_confirmed"),
    )


def basis_text(language: Column, operation: Column, column: Column, used: Column) -> Column:
    """How a figure was derived, in the answer's language."""
    greek = (
        F.when(operation == "sum", F.lit("άθροισμα")).when(operation == "count", F.lit("πλήθος γραμμών"))
        .when(operation == "avg", F.lit("μέσος όρος")).when(operation == "none", F.lit("τιμή όπως δημοσιεύτηκε"))
        .otherwise(operation)
    )
    english = (
        F.when(operation == "sum", F.lit("sum")).when(operation == "count", F.lit("row count"))
        .when(operation == "avg", F.lit("mean")).when(operation == "none", F.lit("value as published"))
        .otherwise(operation)
    )
    return F.when(
        language == "el", F.format_string("%s του «%s» σε %s γραμμές", greek, column, used.cast("string"))
    ).otherwise(F.format_string("%s of '%s' over %s rows", english, column, used.cast("string")))


def remainder_basis(language: Column, operation: str, members: Column) -> Column:
    count = members.cast("string")
    if operation == "count":
        greek = F.format_string("πλήθος στις υπόλοιπες %s κατηγορίες", count)
        english = F.format_string("count across the remaining %s categories", count)
    else:
        greek = F.format_string("άθροισμα των υπόλοιπων %s κατηγοριών", count)
        english = F.format_string("sum of the remaining %s categories", count)
    return F.when(language == "el", greek).otherwise(english)


def grouped_facts(
    rows: DataFrame,
    operation: str = "sum",
    keys: Sequence[str] = RID,
    n: int = vocab.MAX_CATEGORIES,
    language: Column | None = None,
    scale: int | None = None,
) -> DataFrame:
    """Top categories plus a remainder that states what it hides.

    ``operation``: sum, count, avg, min or max.  The remainder of avg, min and
    max is the same statistic over the hidden rows.
    """
    keys = list(keys)
    language = F.lit("en") if language is None else language
    counting = operation == "count"
    groups = label_groups(rows, keys, with_value=not counting)
    if counting:
        groups = groups.withColumns({"total": F.col("n"), "fact": F.col("n")})
    elif operation == "sum":
        groups = groups.withColumn("fact", F.col("total"))
    elif operation == "avg":
        groups = groups.withColumn("fact", _mean(F.col("total"), F.col("n"), scale))
    else:
        groups = groups.withColumn("fact", F.col("min_value" if operation == "min" else "max_value"))
    order = [F.desc("fact"), F.asc("first_row")]
    ranked = top_with_remainder(
        groups.select(*keys, "label_key", "label", "fact", "total", "n", "first_row", "spellings"),
        keys, "label_key", order, ["total", "n", "spellings"], n, ends=["fact"],
    )
    used = F.sum("total_n").over(W.partitionBy(*keys))
    if operation in ("min", "max"):
        rest = F.col("low_fact" if operation == "min" else "high_fact")
    elif operation == "avg":
        rest = _mean(F.col("total_total"), F.col("total_n"), scale)
    else:
        rest = F.col("total_total")
    value = F.when(F.col("is_remainder"), rest).otherwise(F.col("row.fact"))
    other = F.when(language == "el", F.lit("Λοιπά")).otherwise(F.lit("Other"))
    return ranked.select(
        *keys,
        "pos",
        F.when(F.col("is_remainder"), other).otherwise(safe_label(F.col("row.label"))).alias("label"),
        value.alias("value"),
        F.col("total_n").alias("n"),
        F.when(F.col("is_remainder"), F.col("members")).otherwise(used).alias("n_used"),
        F.when(F.col("is_remainder"), F.col("members")).otherwise(F.lit(0)).alias("omitted"),
        "is_remainder",
        F.col("total_spellings").alias("spellings"),
        F.when(~F.col("is_remainder"), F.col("row.label_key")).alias("label_key"),
    )


def _mean(total: Column, n: Column, scale: int | None) -> Column:
    mean = total / n.cast("decimal(18,0)")
    return mean if scale is None else F.bround(mean, scale)


def time_series(rows: DataFrame, keys: Sequence[str] = RID, identity: str = "identity") -> DataFrame:
    """Ordered series per identity, unless any period occurs twice in one series.

    A key with duplicates yields no points; :func:`series_duplicates` reports it.
    """
    keys = list(keys)
    points = rows.filter(F.col("moment").isNotNull() & F.col("value").isNotNull())
    dupes = series_duplicates(points, keys, identity).filter("duplicates = 0").select(*keys, "n_series")
    # a key may hold a third of all points, so they are not shuffled by it unless there are very many keys
    return points.join(broadcast_if_small(dupes), keys).select(
        *keys, safe_label(F.col(identity), None).alias("series"),
        F.col("moment").alias("dim"), "value", "n_series",
    )


def series_duplicates(rows: DataFrame, keys: Sequence[str] = RID, identity: str = "identity") -> DataFrame:
    """Per key: points, series and observations beyond one per (series, period)."""
    keys = list(keys)
    per_moment = (
        rows.filter(F.col("moment").isNotNull() & F.col("value").isNotNull())
        .groupBy(*keys, identity, "moment").agg(F.count(F.lit(1)).alias("_n"))
    )
    per_series = per_moment.groupBy(*keys, identity).agg(
        F.sum("_n").alias("_points"), F.count(F.lit(1)).alias("_moments")
    )
    return per_series.groupBy(*keys).agg(
        F.sum("_points").alias("n_used"), F.count(F.lit(1)).alias("n_series"),
        (F.sum("_points") - F.sum("_moments")).alias("duplicates"),
    )


def series_ends(points: DataFrame, keys: Sequence[str] = RID) -> DataFrame:
    """First and last figure of a key that holds a single series."""
    keys = list(keys)
    return points.filter("n_series = 1").groupBy(*keys).agg(
        F.min("dim").alias("first_dim"), F.min_by("value", F.struct("dim", "value")).alias("first_value"),
        F.max("dim").alias("last_dim"), F.max_by("value", F.struct("dim", "value")).alias("last_value"),
        F.count(F.lit(1)).alias("n_used"),
    )


def latest_values(rows: DataFrame, keys: Sequence[str] = RID) -> DataFrame:
    """Each label's value at its own latest moment (first published on ties)."""
    keys = list(keys)
    return (
        rows.filter(F.col("moment").isNotNull() & F.col("value").isNotNull())
        .groupBy(*keys, F.coalesce("label", F.lit("None")).alias("label"))
        .agg(
            F.max("moment").alias("moment"),
            F.max_by("value", F.struct("moment", (-F.col("row_idx")).alias("r"))).alias("value"),
        )
    )


def latest_of_cumulative(rows: DataFrame, keys: Sequence[str] = RID) -> DataFrame:
    """A running total reduced to its latest values, summed over the labels."""
    keys = list(keys)
    return latest_values(rows, keys).groupBy(*keys).agg(
        F.sum("value").alias("value"), F.max("moment").alias("as_of"), F.min("moment").alias("min_as_of"),
        F.count(F.lit(1)).alias("n_used"),
    )


def latest_basis(language: Column, measure: Column, as_of: Column, areas: Column) -> Column:
    day, count = as_of.cast("string"), areas.cast("string")
    return F.when(
        language == "el", F.format_string("τιμή του «%s» στις %s, αθροισμένη σε %s περιοχές", measure, day, count)
    ).otherwise(F.format_string("value of '%s' at %s, summed over %s areas", measure, day, count))


def categorical_truncation(rows: DataFrame, keys: Sequence[str] = RID, block: int = ROW_BLOCK) -> DataFrame:
    """Keys whose first and last tenth of rows share no category.

    Positions come from per-block counts, so only blocks that touch a tenth are
    numbered row by row, each block on its own.
    """
    keys = list(keys)
    labelled = rows.filter(F.col("label").isNotNull()).select(*keys, "row_idx", "label")
    offsets = block_offsets(labelled, keys, F.floor(F.col("row_idx") / block), F.count(F.lit(1))).filter("total >= 20")
    width = F.greatest(F.floor(F.col("total") / 10), F.lit(1))
    touching = offsets.withColumn("width", width).filter(
        (F.col("offset") < F.col("width")) | (F.col("offset") + F.col("block_amount") > F.col("total") - F.col("width"))
    )
    numbered = (
        labelled.withColumn("_block", F.floor(F.col("row_idx") / block))
        .join(touching, [*keys, "_block"])
        .withColumn("_pos", F.col("offset") + F.row_number().over(W.partitionBy(*keys, "_block").orderBy("row_idx")))
    )
    ends = (
        numbered.withColumn("head", F.col("_pos") <= F.col("width"))
        .withColumn("tail", F.col("_pos") > F.col("total") - F.col("width"))
        .filter("head or tail")
        .groupBy(*keys, "label").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
        .groupBy(*keys, group_key(F.col("label")).alias("label_key"))
        .agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    )
    return ends.groupBy(*keys).agg(
        F.count_if("head").alias("head_categories"), F.count_if("tail").alias("tail_categories"),
        (F.count_if(F.col("head") & F.col("tail")) == 0).alias("categorical_truncation"),
    )


def apply_period(rows: DataFrame, date_from: Column, date_to: Column) -> DataFrame:
    """Keep the rows of the period a question asked for; a null end leaves that side open."""
    return rows.filter(
        (date_from.isNull() | F.coalesce(F.col("moment") >= date_from, F.lit(False)))
        & (date_to.isNull() | F.coalesce(F.col("moment") <= date_to, F.lit(False))))


def apply_intent(rows: DataFrame, date_from: Column, date_to: Column, region: Column) -> DataFrame:
    """Keep the rows of a period and of one label; null intent keeps everything."""
    return apply_period(rows, date_from, date_to).filter(
        region.isNull() | F.coalesce(group_key(F.col("label")) == group_key(region), F.lit(False)))
