"""Dates as published, staleness and period overlap.

Cells are expected without surrounding white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import vocab

SLASHED = "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
QUARTER = "^[0-9]{4}[-/]?[Qq][1-4]$"


def is_slashed(text: Column) -> Column:
    return text.rlike(SLASHED)


def slashed_parts(text: Column) -> tuple[Column, Column]:
    """First and second component of ``a/b/yyyy`` (only for that shape)."""
    return (
        F.substring_index(text, "/", 1).try_cast("int"),
        F.substring_index(F.substring_index(text, "/", 2), "/", -1).try_cast("int"),
    )


def unslashed_date(text: Column) -> Column:
    """Date or period start of every shape that needs no day/month agreement.

    The written date counts: a time zone never moves it to another day.
    """
    return F.when(
        text.rlike("^[0-9]{4}-[0-9]{2}(-[0-9]{2}($|[T ][0-9]{2}:[0-9]{2})|$)"), F.substring(text, 1, 10).try_cast("date")
    ).when(
        text.rlike("^(19[0-9]{2}|20[0-9]{2}|2100)$"), text.try_cast("date")
    ).when(
        text.rlike(QUARTER),
        F.concat(
            F.substring(text, 1, 4), F.lit("-"), F.lpad(((F.substring(text, -1, 1).try_cast("int") - 1) * 3 + 1).cast("string"), 2, "0")
        ).try_cast("date"),
    )


def slashed_date(text: Column, day_first: bool) -> Column:
    """Date of ``a/b/yyyy`` under one order (only for that shape)."""
    first = F.lpad(F.substring_index(text, "/", 1), 2, "0")
    second = F.lpad(F.substring_index(F.substring_index(text, "/", 2), "/", -1), 2, "0")
    day, month = (first, second) if day_first else (second, first)
    return F.concat_ws("-", F.substring_index(text, "/", -1), month, day).try_cast("date")


def age_days(last_updated: Column, today: Column) -> Column:
    """Days since an ISO timestamp; null when it cannot be read."""
    readable = last_updated.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}($|[T ][0-9]{2}(:[0-9]{2}){0,2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$)")
    return F.when(readable, F.datediff(today, F.substring(last_updated, 1, 10).try_cast("date")))


def staleness_step(days: Column, bounds=vocab.STALE_DAYS) -> Column:
    """0 unknown, 1 fresh, 2 recent, 3 ageing, 4 abandoned."""
    fresh, recent, ageing = bounds
    return (
        F.when(days.isNull(), 0).when(days < fresh, 1).when(days < recent, 2)
        .when(days < ageing, 3).otherwise(4)
    )


def staleness_text(days: Column, language: Column, bounds=vocab.STALE_DAYS) -> Column:
    step = staleness_step(days, bounds)
    years = F.floor(days / 365).cast("string")
    greek = (
        F.when(step == 0, F.lit("άγνωστη ενημέρωση"))
        .when(step == 1, F.lit("ενημερώθηκε τον τελευταίο μήνα"))
        .when(step == 2, F.lit("ενημερώθηκε μέσα στον τελευταίο χρόνο"))
        .when(step == 3, F.concat(F.lit("δεν έχει ενημερωθεί εδώ και "), years, F.lit(" χρόνια")))
        .otherwise(F.concat(F.lit("δεν έχει ενημερωθεί εδώ και "), years, F.lit(" χρόνια — πιθανώς ανενεργό")))
    )
    english = (
        F.when(step == 0, F.lit("update date unknown"))
        .when(step == 1, F.lit("updated within the last month"))
        .when(step == 2, F.lit("updated within the last year"))
        .when(step == 3, F.concat(F.lit("not updated for "), years, F.lit(" years")))
        .otherwise(F.concat(F.lit("not updated for "), years, F.lit(" years — possibly abandoned")))
    )
    return F.when(language == "el", greek).otherwise(english)


def range_overlap(start: Column, end: Column, date_from: Column, date_to: Column) -> Column:
    """Requested period against the observed one: ``none``, ``partial`` or ``full``."""
    return (
        F.when(start.isNull() | (date_from.isNull() & date_to.isNull()), F.lit("full"))
        .when(F.coalesce(date_to < start, F.lit(False)) | F.coalesce(date_from > end, F.lit(False)), F.lit("none"))
        .when(F.coalesce(date_from > start, F.lit(False)) | F.coalesce(date_to < end, F.lit(False)), F.lit("partial"))
        .otherwise(F.lit("full"))
    )
