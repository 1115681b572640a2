"""Reading and writing numbers as published: separators, units, flags, scales."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import vocab
from plumbline.functions.text import fold, fold_literal, strip

CELL_DECIMAL = T.DecimalType(38, 12)
UNITS = ("%", "€", "$", "£")


def is_null_cell(cell: Column) -> Column:
    """Null or white space only."""
    return cell.isNull() | (strip(cell) == "")


def is_sentinel(text: Column, sentinels=vocab.SENTINELS) -> Column:
    """A marker that means 'no data', never a value (``text`` is stripped)."""
    return F.coalesce(F.lower(text).isin(*sorted({w.casefold() for w in sentinels})), F.lit(False))


FLAGS = "".join(sorted(set(vocab.OBSERVATION_FLAGS)))
FLAGGED = f"^(?s:(.*?[0-9]))[ \\t]+([{FLAGS}{FLAGS.upper()}])$"


def has_flag(text: Column) -> Column:
    """A stripped cell that ends in a one-letter observation flag: ``86,6 p``."""
    return F.coalesce(text.rlike(FLAGGED), F.lit(False))


def without_flag(text: Column) -> Column:
    return F.regexp_extract(text, FLAGGED, 1)


def flag_of(text: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(text, FLAGGED, 2), F.lit("")))


@lru_cache(maxsize=None)
def _digit_table() -> tuple[str, str]:
    """Compatibility forms of ASCII characters and all decimal digits, to ASCII."""
    source, target = [], []
    for point in range(0x80, sys.maxunicode + 1):
        ch = chr(point)
        if unicodedata.category(ch) == "Nd":
            plain = str(unicodedata.digit(ch))
        else:
            plain = unicodedata.normalize("NFKC", ch)
        if len(plain) == 1 and plain.isascii() and plain != " ":
            source.append(ch)
            target.append(plain)
    return "".join(source), "".join(target)


BLANKS = "\u0020\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SIMPLE = "^[0-9.,+-]+$"


def is_simple(text: Column) -> Column:
    """Nothing but digits, separators and signs: no cleaning needed."""
    return F.coalesce(text.rlike(SIMPLE), F.lit(False))


def ascii_number(text: Column) -> Column:
    """A stripped cell in plain characters, without any blanks."""
    source, target = _digit_table()
    return F.translate(text, source + BLANKS, target)


def bare_number(plain: Column) -> Column:
    """The numeral of an :func:`ascii_number`: no unit, accounting negatives signed."""
    noisy = F.regexp_replace(F.translate(plain, "%€$£", ""), "(?i)EUR$", "")
    return F.regexp_replace(noisy, "^\\((.*)\\)$", "-$1")


def unit_code(plain: Column) -> Column:
    """0 none, 1 %, 2 €, 3 $, 4 £."""
    return (
        F.when(plain.rlike("(?i)EUR[%€$£]*$"), 2)
        .when(F.contains(plain, F.lit("£")), 4)
        .when(F.contains(plain, F.lit("$")), 3)
        .when(F.contains(plain, F.lit("€")), 2)
        .when(F.contains(plain, F.lit("%")), 1)
        .otherwise(0)
    )


def unit_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for index, name in enumerate(UNITS, start=1):
        out = F.when(code == index, F.lit(name)).otherwise(out)
    return out


def classify(bare: Column) -> Column:
    """How one numeral reads on its own: which separator it proves, if any.

    ``grouped`` has only group marks; ``unparseable`` is no number under any reading.
    """
    comma, point = F.contains(bare, F.lit(",")), F.contains(bare, F.lit("."))
    return (
        F.when(bare.rlike("^[+-]?[0-9]+$"), F.lit("integer"))
        .when(~bare.rlike("^[+-]?[.,]*[0-9][0-9.,]*$"), F.lit("unparseable"))
        .when(
            comma & point,
            F.when(bare.rlike("^[^,]*,[^.,]*$"), F.lit("comma_decimal"))
            .when(bare.rlike("^[^.]*\\.[^.,]*$"), F.lit("point_decimal"))
            .otherwise(F.lit("unparseable")),
        )
        .when(bare.rlike("[.,].*[.,]"), F.lit("grouped"))
        .when(bare.rlike("[.,][0-9]{3}$"), F.lit("ambiguous"))
        .when(comma, F.lit("comma_decimal"))
        .otherwise(F.lit("point_decimal"))
    )


def number_text(bare: Column, comma_decimal: bool) -> Column:
    """Plain decimal text under one reading; repeated separators are group marks."""
    read = F.translate(bare, ",.", ".") if comma_decimal else F.translate(bare, ",", "")
    only_groups = bare.rlike("^[^,]*\\.[^,]*\\.[^,]*$|^[^.]*,[^.]*,[^.]*$")
    return F.when(only_groups, F.translate(bare, ".,", "")).otherwise(read)


def digit_count(bare: Column) -> Column:
    """Digits of a numeral without leading zeros."""
    return F.length(F.ltrim(F.translate(bare, "+-.,", ""), F.lit("0")))


def digits_after(bare: Column, mark: str) -> Column:
    """Digits behind the decimal mark; 0 when it does not occur."""
    return F.when(F.contains(bare, F.lit(mark)), F.length(bare) - F.instr(bare, mark)).otherwise(0)


def to_decimal(text: Column) -> Column:
    return text.try_cast(CELL_DECIMAL)


def canonical_decimal(text: Column) -> Column:
    """Text that is equal for equally written values (trailing zeros are kept)."""
    out = F.regexp_replace(text, "^\\+", "")
    out = F.regexp_replace(out, "^(-?)0+(?=[0-9])", "$1")
    out = F.regexp_replace(out, "^(-?)\\.", "$10.")
    return F.regexp_replace(out, "\\.$", "")


def scale_hint(name: Column) -> Column:
    """Scale declared in a column name; values are never rescaled."""
    folded = fold(name)
    return F.coalesce(*[
        F.when(F.contains(folded, F.lit(fold_literal(needle))), F.lit(label))
        for needle, label in vocab.SCALE_HINTS
    ])


def format_number(value: Column, language: Column) -> Column:
    """Group digits and drop trailing zeros, in the reader's separators."""
    text = F.call_function("format_number", value, F.lit("#,##0.############"))
    text = F.when(text == "-0", F.lit("0")).otherwise(text)
    return F.when(language == "el", F.translate(text, ",.", ".,")).otherwise(text)


def figure_value(token: Column, language: Column) -> Column:
    """Numeric value of a figure written in a language; null when it is no number."""
    text = F.regexp_replace(F.regexp_replace(strip(token), "[.,]+$", ""), "^\\++", "")
    plain = F.when(language == "el", F.translate(text, ",.", ".")).otherwise(
        F.replace(text, F.lit(","), F.lit(""))
    )
    good = plain.rlike("^-?([0-9]{1,26}(\\.[0-9]{0,12})?|\\.[0-9]{1,12})$")
    return F.when(good, plain).try_cast(CELL_DECIMAL)
