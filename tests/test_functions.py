"""Column functions on literals with exact expected values."""

import unicodedata
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import dates, numbers, text, web


def column(spark, values, build):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(build(F.col("v")).alias("o")).collect()]


def python_fold(value):
    greek = any("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" for c in value)
    if greek:
        value = value.translate(str.maketrans("ABEZHIKMNOPTXY", "ΑΒΕΖΗΙΚΜΝΟΡΤΧΥ"))
    out = "".join(c for c in unicodedata.normalize("NFD", value) if not unicodedata.combining(c))
    out = unicodedata.normalize("NFC", out).replace("ς", "σ").replace("Σ", "σ")
    return " ".join(out.split()).casefold()


SAMPLES = [
    "ΑΤΤΙΚΗ", "Αττική", "ATTIKH", "ΑΤΤΙΚH", "Straße  ﬁn", "ΟΔΥΣΣΕΥΣ", "Ένα  δύο", "BASE_PER",
    "Ångström", "Ǆ", "ΐΰ", "ᾳ", "й", "naïve café", "İstanbul", "ﬃ ŉ", "", "  x  ", "Ωμέγα ς",
]


def test_fold_matches_the_unicode_definition(spark):
    assert column(spark, SAMPLES, text.fold) == [python_fold(s) for s in SAMPLES]


def test_group_key_merges_look_alike_spellings(spark):
    assert len(set(column(spark, ["ΑΤΤΙΚΗ", "Αττική", "ATTIKH"], text.group_key))) == 1


def test_search_tokens(spark):
    got = column(spark, ["Πυρκαγιές, 2023 — fire_risk!", "  ", None], text.search_tokens)
    assert got == [["πυρκαγιες", "2023", "fire", "risk"], [], None]


@pytest.mark.parametrize("sentence,expected", [
    ("Πόσα σχολεία υπάρχουν;", "el"),
    ("posa sxoleia yparxoun stin ellada", "greeklish"),
    ("which schools are there", "en"),
    ("the xora", "en"),
    ("", "en"),
])
def test_language(spark, sentence, expected):
    assert column(spark, [sentence], text.detect_language) == [expected]


def test_transliteration(spark):
    got = column(spark, ["psari", "theos", "tzatziki ths", "Ou!", "123"], text.transliterate_greeklish)
    assert got == ["ψαρι", "θεος", "τζατζικι θς", "ου!", "123"]


def test_safe_label(spark):
    got = column(spark, [
        "a\nb", "see http://evil.example/x", "<b>bold</b> x", "me@x.example.org", "   ", "x" * 200,
    ], text.safe_label)
    assert got[:5] == ["a b", "see evil.example/x", "bold x", "—", "—"]
    assert got[5] == "x" * 119 + "…"


def test_null_and_sentinel_cells(spark):
    values = [None, "", "  ", "0", ":", "Δ/Υ", "N/A", "c", "cc"]
    assert column(spark, values, numbers.is_null_cell) == [True, True, True] + [False] * 6
    assert column(spark, values, numbers.is_sentinel) == [False] * 4 + [True] * 4 + [False]


def bare(cell):
    return numbers.bare_number(numbers.ascii_number(cell))


@pytest.mark.parametrize("cell,kind", [
    ("86,6", "comma_decimal"), ("86.6", "point_decimal"), ("93", "integer"), ("1,234", "ambiguous"),
    ("1.234,56", "comma_decimal"), ("1,234.56", "point_decimal"), ("1.234.567", "grouped"),
    ("nan", "unparseable"), ("inf", "unparseable"), ("1e5", "unparseable"), ("(5)", "integer"),
    ("45,3%", "comma_decimal"), ("€ 5", "integer"), ("5 EUR", "integer"), ("٣", "integer"), ("+", "unparseable"), (",", "unparseable"), ("1.2.3,4,5", "unparseable"), ("1,234,567.8", "point_decimal"),
    ("1\u00a0234,5", "comma_decimal"),
])
def test_classify(spark, cell, kind):
    assert column(spark, [cell], lambda c: numbers.classify(bare(c))) == [kind]


def test_units(spark):
    got = column(spark, ["45,3%", "€5", "5 EUR", "5", "£1"], lambda c: numbers.unit_name(numbers.unit_code(numbers.ascii_number(c))))
    assert got == ["%", "€", "€", None, "£"]


@pytest.mark.parametrize("cell,comma,expected", [
    ("1.234,56", True, "1234.56"), ("1,234.56", False, "1234.56"), ("(5,5)", True, "-5.5"),
    ("1.234.567", False, "1234567"), ("007", False, "7"), ("1,234", True, "1.234"), ("1.234.567", True, "1234567"),
    ("1.5", False, "1.5"), ("1,5", True, "1.5"), ("1,234,567.5", False, "1234567.5"),
])
def test_number_text(spark, cell, comma, expected):
    read = lambda c: numbers.to_decimal(numbers.number_text(bare(c), comma))
    assert column(spark, [cell], read) == [None if expected is None else Decimal(expected)]


def test_flags(spark):
    values = ["86,6 p", "86,6", "12 x", "abc p"]
    assert column(spark, values, numbers.has_flag) == [True, False, False, False]
    assert column(spark, values, numbers.without_flag)[0] == "86,6"
    assert column(spark, values, numbers.flag_of) == ["p", None, None, None]


def test_format_number(spark):
    frame = spark.createDataFrame([(Decimal("1234.50"),), (Decimal("-7"),), (Decimal("1000000"),)], "v decimal(38,12)")
    rows = frame.select(
        numbers.format_number(F.col("v"), F.lit("el")).alias("el"), numbers.format_number(F.col("v"), F.lit("en")).alias("en")
    ).collect()
    assert [tuple(r) for r in rows] == [("1.234,5", "1,234.5"), ("-7", "-7"), ("1.000.000", "1,000,000")]


def test_scale_hint(spark):
    assert column(spark, ["Δαπάνες (σε χιλιάδες ευρώ)", "Amount (millions)", "x"], numbers.scale_hint) == [
        "χιλιάδες", "millions", None]


def test_unslashed_dates(spark):
    got = column(spark, [
        "2010-01", "2023-12-05T00:30:00+03:00", "2023-02-30", "2020-Q3", "2020Q1", "1999", "1800", "13/07/2026", "x",
        "2024-05-06", "2024-13", "2024-05-06x", "2101", "2024-1",
    ], dates.unslashed_date)
    assert got == [
        date(2010, 1, 1), date(2023, 12, 5), None, date(2020, 7, 1), date(2020, 1, 1), date(1999, 1, 1), None, None,
        None, date(2024, 5, 6), None, None, None, None]


def test_slashed_dates(spark):
    assert column(spark, ["13/07/2026", "07/13/2026"], lambda c: dates.slashed_date(c, True)) == [date(2026, 7, 13), None]
    assert column(spark, ["13/07/2026", "07/13/2026"], lambda c: dates.slashed_date(c, False)) == [None, date(2026, 7, 13)]


@pytest.mark.parametrize("date_from,date_to,expected", [
    ("2024-01-01", None, "none"), (None, "2015-01-01", "none"), ("2017-01-01", "2024-01-01", "partial"),
    (None, None, "full"), ("2016-01-01", "2018-12-31", "full"),
])
def test_overlap(spark, date_from, date_to, expected):
    frame = spark.createDataFrame([("2016-01-01", "2018-12-31", date_from, date_to)], "s string, e string, f string, t string")
    assert frame.select(dates.range_overlap(F.col("s"), F.col("e"), F.col("f"), F.col("t"))).first()[0] == expected


def test_staleness(spark):
    frame = spark.createDataFrame([("2026-01-01T10:00:00",), ("2025-06-01",), ("2024-01-01",), ("2010-01-01",), (None,), ("x",)], "u string")
    days = dates.age_days(F.col("u"), F.lit("2026-01-15").cast("date"))
    got = [tuple(r) for r in frame.select(dates.staleness_step(days), dates.staleness_text(days, F.lit("en"))).collect()]
    assert [g[0] for g in got] == [1, 2, 3, 4, 0, 0]
    assert got[2][1] == "not updated for 2 years"
    assert got[3][1].endswith("possibly abandoned")


def test_url_rules(spark):
    urls = ["https://data.example.org/x", "http://a.example.org:80/", "ftp://x/", "", None, "https:///p",
            "https://u:p@Other.example.com/x"]
    got = column(spark, urls, lambda c: web.url_verdict(c, "example.org", False, False))
    assert got == ["ok", "plain_http", "scheme", "no_url", "no_url", "no_host", "off_portal"]
    assert column(spark, ["https://x/?a=1&sig=abc&token=t#f"], web.redact_secrets) == ["https://x/?a=1&sig=REDACTED&token=REDACTED"]


def test_publisher_and_theme(spark):
    assert column(spark, ["Δήμος Αθηναίων", "Περιφέρεια Κρήτης", "Υπουργείο Υγείας", "ELSTAT", None], web.publisher_kind) == [
        "municipality", "region", "ministry", "national", "national"]
    assert column(spark, ["http://x/data-theme/ENVI", "http://x/ENVI//", "", "HEAL"], web.theme_code) == ["ENVI", "ENVI", None, "HEAL"]
    assert column(spark, ["ENVI", "ZZZ"], web.theme_label) == ["Environment", "ZZZ"]
