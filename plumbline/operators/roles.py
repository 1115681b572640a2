"""What each column means, and how a table's columns are bound together.

Everything is an aggregate over typed cells.  The shuffles are: one by
(table, column, value) for exact distinct counts, one by (table, column) over
its reduced rows, and small ones over column-level rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.functions.text import fold, fold_literals, group_key
from plumbline.operators.coercion import typed_cells
from plumbline.operators.sequences import order_breaks

ROW_BLOCK = 1_000_000
#: Of so many rows one is looked at before all are.
FEW = 256


def value_counts(typed: DataFrame) -> DataFrame:
    """One row per (table, column, distinct value).

    Takes typed cells, or typed :func:`~plumbline.operators.coercion.distinct_cells`,
    whose ``n`` then weighs the counts.
    """
    n = F.col("n") if "n" in typed.columns else F.lit(1)
    return (
        typed.filter(F.col("text_value").isNotNull())
        .groupBy("rid", "col_idx", "kind", "text_value")
        .agg(
            F.sum(n).alias("n"),
            F.min("row_idx").alias("first_row"),
            F.max("number").alias("number"),
            F.min((F.col("number") == F.col("row_idx") + 1) & (n == 1)).alias("dense"),
        )
    )


def column_stats(values: DataFrame) -> DataFrame:
    """One row per column with at least one value."""
    number, bare = F.col("number"), F.replace(F.col("text_value"), F.lit("_"), F.lit(""))
    upper = ((F.upper(bare) == bare) & (F.lower(bare) != bare)) | F.col("text_value").rlike("^[0-9]+$")
    day = F.when(F.col("kind") == "temporal", F.col("text_value").cast("date"))
    return values.groupBy("rid", "col_idx").agg(
        F.count(F.lit(1)).alias("distinct_count"),
        F.min("dense").alias("dense"),
        F.min(number == F.floor(number)).alias("integral"),
        F.min(number.between(1900, 2100)).alias("year_range"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
        F.max(F.length("text_value")).alias("max_len"),
        F.sum(F.when(upper, F.col("n")).otherwise(0)).alias("upper_count"),
        F.min(day).alias("min_date"),
        F.max(day).alias("max_date"),
    )


def constant_columns(values: DataFrame, stats: DataFrame) -> DataFrame:
    """Columns that hold one value only, with that value."""
    single = stats.filter(F.col("distinct_count") == 1).select("rid", "col_idx")
    return values.join(single, ["rid", "col_idx"]).select("rid", "col_idx", F.col("text_value").alias("value"))


def row_totals(cells: DataFrame, profile: DataFrame, slots: int = 32) -> DataFrame:
    """Numeric columns equal to the sum of the other numeric columns in every complete row, of which there must be three.

    The numbers of a row meet in fixed places of a hash aggregate in tables of up to ``slots`` numeric
    columns, in a list in wider ones.  The largest width reaches the driver.
    """
    numeric = profile.filter(F.col("kind") == "decimal").select(
        "rid", "col_idx", "kind", "comma_decimal", "day_rule",
        F.count(F.lit(1)).over(W.partitionBy("rid")).alias("width"), F.row_number().over(W.partitionBy("rid").orderBy("col_idx")).alias("slot"))
    columns = numeric.filter(F.col("width") >= 3)
    widest = columns.agg(F.max("width")).first()[0] or 3

    def checks(cells: DataFrame, columns: DataFrame) -> DataFrame:
        found = _totals_in_slots(cells, columns.filter(F.col("width") <= slots), min(widest, slots))
        return found if widest <= slots else found.unionByName(_totals_in_lists(cells, columns.filter(F.col("width") > slots)))

    # one row that does not add up is enough, so a few rows tell which tables need not be read whole
    refuted = checks(cells.filter(F.pmod(F.xxhash64("row_idx"), F.lit(FEW)) == 0), columns).filter(~F.col("all_equal"))
    open_tables = columns.join(refuted.select("rid", "col_idx"), ["rid", "col_idx"], "left_anti").select("rid").distinct()
    return checks(cells, columns.join(open_tables, "rid", "left_semi")).filter((F.col("checked") >= 3) & F.col("all_equal")).select(
        "rid", "col_idx", F.lit(True).alias("is_row_total"))


def _row_numbers(cells: DataFrame, columns: DataFrame) -> DataFrame:
    taken = cells.join(columns.select("rid", "col_idx"), ["rid", "col_idx"], "left_semi")
    return typed_cells(taken, columns).select("rid", "row_idx", "col_idx", "number")


def _totals_in_slots(cells: DataFrame, columns: DataFrame, slots: int) -> DataFrame:
    numbers = _row_numbers(cells, columns).join(columns.select("rid", "col_idx", "width", "slot"), ["rid", "col_idx"])
    rows = numbers.groupBy("rid", "row_idx").agg(
        F.sum("number").alias("row_sum"), F.count("number").alias("filled"), F.max("width").alias("width"),
        *[F.max(F.when(F.col("slot") == i, F.col("number"))).alias(f"n{i}") for i in range(1, slots + 1)]).filter(F.col("filled") == F.col("width"))
    checked = rows.groupBy("rid").agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.min(F.col(f"n{i}") == F.col("row_sum") - F.col(f"n{i}")).alias(f"e{i}") for i in range(1, slots + 1)])
    equal = checked.select("rid", "checked", F.posexplode(F.array(*[F.col(f"e{i}") for i in range(1, slots + 1)])).alias("place", "all_equal"))
    return equal.select("rid", (F.col("place") + 1).alias("slot"), "checked", "all_equal").join(
        columns.select("rid", "slot", "col_idx"), ["rid", "slot"]).select("rid", "col_idx", "checked", "all_equal")


def _totals_in_lists(cells: DataFrame, columns: DataFrame) -> DataFrame:
    rows = (
        _row_numbers(cells, columns).groupBy("rid", "row_idx")
        .agg(F.sum("number").alias("row_sum"), F.count("number").alias("filled"),
             F.collect_list(F.struct("col_idx", "number")).alias("numbers"))  # one row's numbers
        .join(columns.select("rid", "width").distinct(), "rid").filter(F.col("filled") == F.col("width"))
    )
    return (
        rows.select("rid", "row_sum", F.explode("numbers").alias("c"))
        .groupBy("rid", "c.col_idx")
        .agg(F.count(F.lit(1)).alias("checked"), F.min(F.col("c.number") == F.col("row_sum") - F.col("c.number")).alias("all_equal"))
        .select("rid", "col_idx", "checked", "all_equal")
    )


def _first_roles(profile: DataFrame, stats: DataFrame, totals: DataFrame, tables: DataFrame | None) -> DataFrame:
    columns = profile.join(stats, ["rid", "col_idx"], "left").join(totals, ["rid", "col_idx"], "left")
    if tables is not None:
        columns = columns.join(tables.select("rid", F.col("title")), "rid", "left")
    else:
        columns = columns.withColumn("title", F.lit(None).cast("string"))
    columns = columns.withColumns({
        "name_key": fold(F.col("col_name")),
        "title_key": fold(F.coalesce("title", F.lit(""))),
        "distinct_count": F.coalesce("distinct_count", F.lit(0)),
        "numeric_columns": F.count_if(F.col("kind") == "decimal").over(W.partitionBy("rid")),
    })
    decimal, text = F.col("kind") == "decimal", F.col("kind") == "text"
    name = F.col("name_key")
    id_name = name.isin(*fold_literals(vocab.IDENTIFIER_NAMES))
    id_suffix = F.lit(False)
    for suffix in fold_literals(vocab.IDENTIFIER_SUFFIXES):
        id_suffix = id_suffix | name.endswith(suffix)
    dense = F.col("dense") & (F.col("non_null") == F.col("n_rows")) & (F.col("distinct_count") == F.col("n_rows"))
    identifier = F.when(
        decimal & (F.col("non_null") > 0), dense | (F.col("integral") & (id_name | id_suffix))
    ).otherwise(id_name & text)
    code = (
        text & (F.col("non_null") > 0) & (F.col("max_len") <= vocab.CODE_MAX_LEN)
        & (F.col("distinct_count") <= F.col("non_null") * vocab.CODE_REPEAT_RATIO)
        & (F.col("upper_count") >= vocab.CODE_UPPER_SHARE * F.col("non_null"))
    )
    index = name.rlike(vocab.INDEX_NAME) | (F.col("title_key").rlike(vocab.INDEX_NAME) & (F.col("numeric_columns") == 1))
    cumulative_name = name.rlike(vocab.CUMULATIVE_NAME)
    role = (
        F.when(F.coalesce(identifier, F.lit(False)), F.lit("identifier"))
        .when(F.col("kind") == "temporal", F.lit("temporal"))
        .when(decimal & name.rlike(vocab.YEAR_NAME) & F.col("integral") & F.col("year_range"), F.lit("dimension"))
        .when(F.coalesce(code, F.lit(False)), F.lit("code"))
        .when(~decimal, F.lit("dimension"))
        .when(F.col("sentinel_count") > F.col("n_rows") * vocab.SENTINEL_RATIO, F.lit("unknown"))
        .when(index, F.lit("index"))
        .when(F.coalesce(F.col("is_row_total"), F.lit(False)), F.lit("row_total"))
        .when(cumulative_name, F.lit("unknown"))
        .otherwise(F.lit("measure"))
    )
    return columns.withColumns({"role": role, "cumulative_name": cumulative_name & decimal}).drop(
        "title", "name_key", "title_key", "is_row_total"
    )


def _axes(columns: DataFrame) -> DataFrame:
    """Time axis and grouping column of every table."""
    label = F.col("role").isin("dimension", "code") & (F.col("non_null") > 0) & (F.col("distinct_count") > 1)
    scored = F.struct("distinct_count", "col_name", "col_idx")
    fitting = F.max(F.when(label & (F.col("distinct_count") <= vocab.MAX_CATEGORIES), scored))
    smallest = F.min(F.when(label, scored))
    axis = F.min(F.when(F.col("role") == "temporal", F.struct((-F.col("distinct_count")).alias("d"), "col_idx", "col_name", "min_date", "max_date")))
    return columns.groupBy("rid").agg(axis.alias("axis"), F.coalesce(fitting, smallest).alias("dim")).select(
        "rid",
        F.col("axis.col_idx").alias("temporal_idx"), F.col("axis.col_name").alias("temporal"),
        F.col("axis.min_date").alias("observed_from"), F.col("axis.max_date").alias("observed_to"),
        F.col("dim.col_idx").alias("dimension_idx"), F.col("dim.col_name").alias("dimension"),
    )


def cumulative_checks(cells: DataFrame, profile: DataFrame, candidates: DataFrame, axes: DataFrame, keep=None) -> DataFrame:
    """Whether values of the candidate columns never fall over time in any group.

    ``candidates``: rid, col_idx.  Only the columns that take part, in tables with
    a candidate and a time axis, are read and typed.
    """
    keep = keep or (lambda df, name: df)
    wanted = axes.join(candidates.select("rid").distinct(), "rid").filter(F.col("temporal_idx").isNotNull())
    parts = (
        wanted.select("rid", F.col("temporal_idx").alias("col_idx"), F.lit("moment").alias("slot"))
        .unionByName(wanted.filter("dimension_idx is not null").select("rid", F.col("dimension_idx").alias("col_idx"), F.lit("grp").alias("slot")))
        .unionByName(candidates.join(wanted.select("rid"), "rid").select("rid", "col_idx", F.lit("value").alias("slot")))
    )
    typed = keep(typed_cells(cells.join(parts.select("rid", "col_idx"), ["rid", "col_idx"], "left_semi"), profile).join(parts, ["rid", "col_idx"]), "cumulative")
    context = typed.filter(F.col("slot") != "value").groupBy("rid", "row_idx").agg(
        F.max(F.when(F.col("slot") == "moment", F.col("date_value"))).alias("moment"),
        F.max(F.when(F.col("slot") == "grp", F.col("text_value"))).alias("grp"),
    ).filter(F.col("moment").isNotNull())
    observed = (
        typed.filter((F.col("slot") == "value") & F.col("number").isNotNull())
        .select("rid", "col_idx", "row_idx", F.col("number").alias("value"))
        .join(context, ["rid", "row_idx"])
    )
    breaks = order_breaks(
        observed, ["rid", "col_idx", "grp"], F.struct("moment", F.floor(F.col("row_idx") / ROW_BLOCK).alias("part")), ["moment", "row_idx"], "value"
    )
    return breaks.groupBy("rid", "col_idx").agg((F.sum("n_falls") == 0).alias("monotonic"))


def column_roles(cells: DataFrame, profile: DataFrame, values: DataFrame, tables: DataFrame | None = None, keep=None) -> DataFrame:
    """One role per column; ``tables`` may bring rid, title."""
    keep = keep or (lambda df, name: df)
    first = keep(_first_roles(profile, column_stats(values), row_totals(cells, profile), tables), "first_roles")
    axes = _axes(first)
    candidates = first.filter((F.col("role") == "unknown") & F.col("cumulative_name")).select("rid", "col_idx")
    checks = cumulative_checks(cells, profile, candidates, axes, keep)
    has_axis = axes.select("rid", F.col("temporal_idx").isNotNull().alias("has_axis"))
    resolved = F.when(
        (F.col("role") == "unknown") & F.col("cumulative_name") & F.col("has_axis"),
        F.when(F.col("monotonic"), F.lit("running_cumulative")).otherwise(F.lit("measure")),
    ).otherwise(F.col("role"))
    return (
        first.join(has_axis, "rid").join(checks, ["rid", "col_idx"], "left")
        .withColumn("role", resolved)
        .drop("monotonic", "has_axis", "cumulative_name", "numeric_columns")
    )


def bindings(roles: DataFrame) -> DataFrame:
    """One row per table: axes, measure to report, allowed operations, operation."""
    axes = _axes(roles)
    priority = (
        F.when(F.col("role") == "measure", 0).when(F.col("role") == "index", 1)
        .when(F.col("role") == "running_cumulative", 2).when(F.col("role") == "row_total", 3)
    )
    pick = F.min(F.when(priority.isNotNull(), F.struct(
        priority.alias("p"), (-F.col("non_null")).alias("c"), "col_idx", "col_name", "role", "unit",
        "scale", "scale_hint", "min_value",
    )))
    is_measure = F.col("role") == "measure"
    counts = roles.groupBy("rid").agg(
        F.max("n_rows").alias("n_rows"),
        F.count_if(is_measure).alias("measures"),
        F.count_if(is_measure & (F.col("unit") == "%")).alias("percent_measures"),
        pick.alias("m"),
        F.array_sort(F.collect_list(F.when(
            F.col("role").isin("dimension", "code") & (F.col("distinct_count") != 1), F.struct("col_idx", "col_name")
        ))).alias("labels"),
    )
    bound = counts.join(axes, "rid").select(
        "rid", "n_rows", "measures",
        "temporal_idx", "temporal", "observed_from", "observed_to", "dimension_idx", "dimension",
        F.col("m.col_idx").alias("measure_idx"), F.col("m.col_name").alias("measure"),
        F.col("m.role").alias("measure_role"), F.col("m.unit").alias("unit"),
        F.col("m.scale").alias("scale"), F.col("m.scale_hint").alias("scale_hint"),
        (F.col("m.min_value") >= 0).alias("non_negative"),
        F.when((F.col("measures") == 0) | (F.col("percent_measures") > 0), F.array(F.lit("sum"), F.lit("avg")))
        .otherwise(F.array().cast("array<string>")).alias("forbidden_ops"),
        F.filter("labels", lambda s: F.coalesce(s["col_idx"] != F.col("dimension_idx"), F.lit(True))).alias("series_key"),
    )
    return bound.withColumn("operation", choose_operation())


def choose_operation():
    """Operation by fixed precedence; a forbidden sum falls back to counting."""
    timed = F.col("temporal_idx").isNotNull() & F.col("measure_idx").isNotNull()
    return (
        F.when(timed & (F.col("measure_role") == "running_cumulative"), F.lit("latest"))
        .when(timed & F.col("measure_role").isin("index", "measure"), F.lit("none"))
        .when(
            F.col("dimension_idx").isNotNull() & (F.col("measure_role") == "measure")
            & ~F.array_contains("forbidden_ops", "sum"),
            F.lit("sum"),
        )
        .when(F.col("dimension_idx").isNotNull(), F.lit("count"))
        .otherwise(F.lit("listing"))
    )


def slots(bound: DataFrame) -> DataFrame:
    """The columns each table's facts need: rid, col_idx, slot."""
    parts = [
        F.array(F.struct(F.lit("moment").alias("slot"), F.col("temporal_idx").alias("col_idx"))),
        F.array(F.struct(F.lit("label").alias("slot"), F.col("dimension_idx").alias("col_idx"))),
        F.array(F.struct(F.lit("measure").alias("slot"), F.col("measure_idx").alias("col_idx"))),
        F.transform("series_key", lambda s: F.struct(F.lit("series").alias("slot"), s["col_idx"].alias("col_idx"))),
    ]
    return (
        bound.select("rid", F.explode(F.concat(*parts)).alias("s"))
        .select("rid", "s.slot", "s.col_idx").filter(F.col("col_idx").isNotNull())
    )


def merged_variants(values: DataFrame, bound: DataFrame) -> DataFrame:
    """Label spellings that fall together: rid, label_key, spelling, n."""
    labels = values.join(
        bound.filter(F.col("dimension_idx").isNotNull()).select("rid", F.col("dimension_idx").alias("col_idx")),
        ["rid", "col_idx"],
    ).select("rid", group_key(F.col("text_value")).alias("label_key"), F.col("text_value").alias("spelling"), "n")
    several = labels.groupBy("rid", "label_key").agg(F.count(F.lit(1)).alias("spellings")).filter("spellings > 1")
    return labels.join(several, ["rid", "label_key"]).select("rid", "label_key", "spelling", "n", "spellings")
