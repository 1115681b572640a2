"""Whole-column type decisions: a column converts completely or stays text.

Pass 1 (:func:`column_profile`) reads every cell once and reduces it to flags and
counters, all of them fixed-width, so the map side combines them in a hash
aggregate and one small row per column is shuffled.  Pass 2 (:func:`typed_cells`)
projects the agreed reading.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import dates, numbers, vocab
from plumbline.functions.text import strip

MAX_SCALE = numbers.CELL_DECIMAL.scale
MAX_INTEGER_DIGITS = numbers.CELL_DECIMAL.precision - MAX_SCALE
KEYS = ["rid", "col_idx", "col_name"]


def _prepared(cells: DataFrame, sentinels) -> DataFrame:
    """Cell facts, each worked out once and named before the next step uses it."""
    text, plain, simple = F.col("text"), F.col("plain"), F.col("simple")
    keep = [*KEYS, "row_idx", *(["n"] if "n" in cells.columns else [])]
    stripped = cells.select(*keep, strip(F.col("cell")).alias("text")).withColumn("simple", numbers.is_simple(text))
    marked = stripped.select(
        *keep, "text", "simple",
        (text.isNull() | (text == "")).alias("is_null"),
        numbers.is_sentinel(text, sentinels).alias("is_sentinel"),
        F.when(simple, F.lit(False)).otherwise(numbers.has_flag(text)).alias("flagged"),
    )
    body = F.when(F.col("flagged"), numbers.without_flag(text)).otherwise(text)
    present = marked.select(
        *keep, "text", "simple", "is_null", "is_sentinel", "flagged",
        F.when(~F.col("is_null") & ~F.col("is_sentinel"), body).alias("body"),
    )
    plain_text = present.withColumn("plain", F.when(~simple, numbers.ascii_number(F.col("body"))))
    return plain_text.select(
        *keep, "text", "is_null", "is_sentinel", "flagged", "body",
        F.when(simple, F.col("body")).otherwise(numbers.bare_number(plain)).alias("bare"),
        F.when(simple, F.lit(0)).otherwise(numbers.unit_code(plain)).alias("unit"),
    )


def distinct_cells(cells: DataFrame) -> DataFrame:
    """One row per (table, column, written text) with its count and first row.

    Published columns repeat themselves; parsing each spelling once instead of
    each cell is what keeps the later steps small.
    """
    return cells.groupBy(*KEYS, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("row_idx"))


def _likeness(cell: Column, sentinels) -> Column:
    """A text that a profile reads as it reads ``cell``: a column of numerals or of words has few of them.

    In a numeral that does not begin with 0 any digit counts for any other, but one digit may be a truth value and
    four may be a year.  ASCII words without digits, longer than every word that means something, are only text.
    """
    longest = max(len(w) for w in (*sentinels, *vocab.TRUE_WORDS, *vocab.FALSE_WORDS))
    like = F.when(cell.rlike("^[A-Za-z][A-Za-z -]{%d,}[A-Za-z]\\z" % longest), F.lit("x" * (longest + 2))).otherwise(cell)
    if any(re.fullmatch("[+-]?[1-9][0-9.,]+%?", w) for w in sentinels):
        return like
    numeral = cell.rlike("^[+-]?[1-9][0-9.,]+%?\\z") & (F.length(cell) != 4)
    return F.when(numeral, F.translate(cell, "023456789", "1" * 9)).otherwise(like)


def alike_cells(cells: DataFrame, sentinels=vocab.SENTINELS) -> DataFrame:
    """What :func:`column_profile` needs of cells: one row per (table, column, likeness) with its count and first row.

    Spellings that a profile cannot tell apart meet on the map side, so keys and prices are not shuffled one by one.
    """
    return distinct_cells(cells.withColumn("cell", _likeness(F.col("cell"), sentinels)))


def column_profile(cells: DataFrame, sentinels=vocab.SENTINELS, max_digits: int = vocab.DECIMAL_DIGITS) -> DataFrame:
    """One row per column: counts, the agreed reading and the resulting kind.

    Takes cells, or :func:`distinct_cells` or :func:`alike_cells`, whose ``n`` then weighs the counts.
    """
    weighted = "n" in cells.columns
    body, bare, reading = F.col("body"), F.col("bare"), F.col("reading")
    read = _prepared(cells, sentinels).withColumn("reading", numbers.classify(bare))
    dated = (reading == "unparseable") & body.rlike("^[0-9]")
    shaped = read.withColumns({
        "numeric": reading != "unparseable",
        "slashed": F.when(dated, dates.is_slashed(body)),
        # cells that read as numbers can only be bare years among dates
        "plain_date": F.when(dated | body.rlike("^[0-9]{4}$"), dates.unslashed_date(body).isNotNull()),
    })
    slashed, numeric = F.col("slashed"), F.col("numeric")
    first, second = dates.slashed_parts(body)
    fraction = reading.isin("comma_decimal", "point_decimal", "ambiguous")
    facts = shaped.select(
        *KEYS, "row_idx", *(["n"] if weighted else []), "is_null", "is_sentinel", "flagged", "unit", "reading", "plain_date", "slashed",
        body.isNotNull().alias("present"),
        F.when(numeric, numbers.digit_count(bare)).alias("digits"),
        F.when(numeric & fraction, numbers.digits_after(bare, ".")).otherwise(0).alias("ps"),
        F.when(numeric & fraction, numbers.digits_after(bare, ",")).otherwise(0).alias("cs"),
        F.when(slashed, first).alias("d1"), F.when(slashed, second).alias("d2"),
        F.when(slashed, dates.slashed_date(body, True).isNotNull()).alias("day_first_date"),
        F.when(slashed, dates.slashed_date(body, False).isNotNull()).alias("month_first_date"),
        F.when(F.length(body) <= 5, F.lower(body).isin(*vocab.TRUE_WORDS, *vocab.FALSE_WORDS)).alias("truth"),
    )

    def number_of(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)) if weighted else F.count_if(condition)

    def any_of(condition: Column) -> Column:
        return F.coalesce(F.max(condition), F.lit(False))

    def all_present(condition: Column) -> Column:
        return F.coalesce(F.min(F.when(F.col("present"), F.coalesce(condition, F.lit(False)))), F.lit(False))

    counted = facts.groupBy(*KEYS).agg(
        number_of(F.lit(True)).alias("n_rows"),
        number_of(F.col("is_null")).alias("null_count"),
        number_of(F.col("is_sentinel")).alias("sentinel_count"),
        number_of(F.col("present")).alias("non_null"),
        number_of(F.col("present") & F.col("flagged")).alias("flagged_count"),
        any_of(F.col("reading") == "unparseable").alias("has_other"),
        any_of(F.col("reading") == "comma_decimal").alias("has_comma"),
        any_of(F.col("reading") == "point_decimal").alias("has_point"),
        any_of(F.col("reading") == "ambiguous").alias("has_ambiguous"),
        F.coalesce(F.max("digits"), F.lit(0)).alias("digits"),
        F.max("ps").alias("point_scale"),
        F.max("cs").alias("comma_scale"),
        F.coalesce(F.max(F.col("digits") - F.col("ps")), F.lit(0)).alias("point_digits"),
        F.coalesce(F.max(F.col("digits") - F.col("cs")), F.lit(0)).alias("comma_digits"),
        # first unit seen, in row order, packed into one number
        F.min(F.when(F.col("unit") > 0, F.col("row_idx") * 8 + F.col("unit"))).alias("unit_pack"),
        any_of(F.col("slashed")).alias("has_slashed"),
        any_of(F.col("d1") > 12).alias("first_over_12"),
        any_of(F.col("d2") > 12).alias("second_over_12"),
        all_present(F.col("plain_date")).alias("plain_ok"),
        all_present(F.col("plain_date") | F.col("day_first_date")).alias("day_first_ok"),
        all_present(F.col("plain_date") | F.col("month_first_date")).alias("month_first_ok"),
        all_present(F.col("truth")).alias("truth_ok"),
    )
    comma = F.col("has_comma")
    agreed = (
        ~F.col("has_other") & ~(comma & F.col("has_point"))
        & (comma | F.col("has_point") | ~F.col("has_ambiguous"))
        & (F.col("digits") <= max_digits)
    )
    scale = F.when(comma, F.col("comma_scale")).otherwise(F.col("point_scale"))
    fits = (scale <= MAX_SCALE) & (
        F.when(comma, F.col("comma_digits")).otherwise(F.col("point_digits")) <= MAX_INTEGER_DIGITS
    )
    day_rule = (
        F.when(~F.col("has_slashed"), F.lit("none"))
        .when(F.col("first_over_12"), F.lit("day_first"))
        .when(F.col("second_over_12"), F.lit("month_first"))
        .otherwise(F.lit("ambiguous"))
    )
    dated = (
        F.when(day_rule == "none", F.col("plain_ok"))
        .when(day_rule == "day_first", F.col("day_first_ok"))
        .when(day_rule == "month_first", F.col("month_first_ok"))
        .otherwise(F.lit(False))
    )
    kind = (
        F.when(F.col("non_null") == 0, F.lit("text"))
        .when(agreed & fits, F.lit("decimal"))
        .when(agreed, F.lit("text"))
        .when(dated, F.lit("temporal"))
        .when(F.col("truth_ok"), F.lit("boolean"))
        .otherwise(F.lit("text"))
    )
    is_decimal = kind == "decimal"
    return counted.select(
        *KEYS, "n_rows", "null_count", "sentinel_count", "non_null", "flagged_count",
        kind.alias("kind"),
        F.when(is_decimal, comma).alias("comma_decimal"),
        F.when(is_decimal, scale).alias("scale"),
        F.when(is_decimal, numbers.unit_name(F.pmod("unit_pack", F.lit(8)))).alias("unit"),
        F.when(kind == "temporal", day_rule).alias("day_rule"),
        numbers.scale_hint(F.col("col_name")).alias("scale_hint"),
        F.when((F.col("non_null") > 0) & agreed & ~fits, F.lit("unsupported_scale")).alias("error_kind"),
    )


def typed_cells(cells: DataFrame, profile: DataFrame, sentinels=vocab.SENTINELS) -> DataFrame:
    """Every cell under its column's agreed reading.

    ``text_value`` is the canonical text of the value in every kind (what labels
    and distinct counts are made of).  The profile holds one row per column; the
    join strategy is chosen from its size at run time.
    """
    agreed = profile.select("rid", "col_idx", "kind", "comma_decimal", "day_rule")
    kind, body, bare = F.col("kind"), F.col("body"), F.col("bare")
    joined = _prepared(cells, sentinels).join(agreed, ["rid", "col_idx"])
    weight = ["n"] if "n" in cells.columns else []
    values = joined.select(
        "rid", "row_idx", *weight, "col_idx", "col_name", "kind",
        (F.col("flagged") & body.isNotNull() & (kind != "text")).alias("flagged"),
        F.when(
            kind == "decimal",
            F.when(F.col("comma_decimal"), numbers.number_text(bare, True)).otherwise(numbers.number_text(bare, False)),
        ).alias("number_text"),
        F.when(
            kind == "temporal",
            F.when(F.col("day_rule") == "none", dates.unslashed_date(body))
            .when(~dates.is_slashed(body), dates.unslashed_date(body))
            .when(F.col("day_rule") == "day_first", dates.slashed_date(body, True))
            .otherwise(dates.slashed_date(body, False)),
        ).alias("date_value"),
        F.when((kind == "boolean") & body.isNotNull(), F.lower(body).isin(*vocab.TRUE_WORDS)).alias("truth"),
        F.when((kind == "text") & body.isNotNull(), F.col("text")).alias("words"),
    )
    return values.select(
        "rid", "row_idx", *weight, "col_idx", "col_name", "kind", "flagged",
        numbers.to_decimal(F.col("number_text")).alias("number"),
        "date_value", "truth",
        F.coalesce(
            numbers.canonical_decimal(F.col("number_text")),
            F.col("date_value").cast("string"),
            F.initcap(F.col("truth").cast("string")),
            F.col("words"),
        ).alias("text_value"),
    )


def with_agreed_number(df: DataFrame, profile: DataFrame, column: str, out: str, sentinels=vocab.SENTINELS) -> DataFrame:
    """Number of a wide table's text column under its agreed reading.

    The reading is one scalar subquery, so the table itself is not joined, and
    rows are not filtered: a cell without a value gives null.
    """
    verdict = profile.filter(F.col("col_name") == column).select(
        F.when(F.col("kind") == "decimal", F.when(F.col("comma_decimal"), F.lit(",")).otherwise(F.lit(".")))
    ).scalar()
    text, plain, bare = F.col("_text"), F.col("_plain"), F.col("_bare")
    staged = df.withColumn("_text", strip(F.col(column))).withColumn("_separator", verdict)
    staged = staged.withColumn("_plain", numbers.ascii_number(
        F.when(numbers.has_flag(text), numbers.without_flag(text)).when(~numbers.is_sentinel(text, sentinels), text)))
    staged = staged.withColumn("_bare", numbers.bare_number(plain))
    read = F.when(F.col("_separator") == ",", numbers.number_text(bare, True)).when(
        F.col("_separator") == ".", numbers.number_text(bare, False))
    return staged.withColumn(out, numbers.to_decimal(F.nullif(read, F.lit("")))).drop("_text", "_separator", "_plain", "_bare")
