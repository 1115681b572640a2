"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six characters that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def narrow(docs: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under the operator's own names; whatever else ``docs`` carries cannot clash."""
    return docs.select(*[(docs[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it.

    Catalyst may copy a projected expression into every place that names it; a
    lambda's argument is a value.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone; every other character stays."""
    return F.translate(text, UPPER, LOWER)
