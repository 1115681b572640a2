"""The claim guard: false texts fall, faithful ones pass."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import claims

FACTS = [("sums", "ΣΥΡΙΑ", "40000", 4), ("sums", "ΑΦΓΑΝΙΣΤΑΝ", "26011", 4), ("sums", "ΑΙΓΥΠΤΟΣ", "7547", 4),
         ("index", "2010-01", "86.6", 6)]
HEADERS = [
    ("sums", "sum", True, False, False, 0, 1, 3, 4, None, "όλες οι 4 γραμμές", None, None),
    ("index", "none", False, True, False, 0, 1, 6, 6, None, "6 γραμμές", "2010-01-01", "2016-06-01"),
]
REJECTED = {
    "invented figure": ("sums", "Κατατέθηκαν 55.000 αιτήσεις από τη Συρία."),
    "rounded figure": ("sums", "Περίπου 7.500 αιτήσεις από την Αίγυπτο."),
    "wrong label": ("sums", "Η Αίγυπτος έχει 40.000 αιτήσεις."),
    "number word": ("sums", "Κατατέθηκαν πολλές χιλιάδες αιτήσεις."),
    "half": ("sums", "Περίπου οι μισές αφορούν τη Συρία."),
    "trend": ("index", "Φαίνεται καθαρή άνοδος και ανοδική πορεία."),
    "stable": ("index", "Η τιμή μένει σταθερή."),
    "superlative": ("index", "Το 2016 έχει την υψηλότερη τιμή."),
    "foreign year": ("sums", "Για το 2026 μετρήθηκαν 40.000 αιτήσεις."),
    "share": ("sums", "Η Συρία έχει το 40%."),
    "link": ("sums", "Δείτε https://bad.example/x για τις 40.000."),
    "token": ("sums", "Αιτήσεις 40.000 <|end|>"),
    "tag": ("sums", "Αιτήσεις 40.000 <img src=x>"),
    "markdown": ("sums", "Δείτε [αυτό](x) για τις 40.000."),
    "empty": ("sums", "   "),
    "long": ("sums", "α " * 700),
}
ACCEPTED = {
    "figure": ("sums", "Από τη Συρία ήρθαν 40.000 αιτήσεις."),
    "two figures": ("sums", "Συρία 40.000 αιτήσεις, Αίγυπτος 7.547."),
    "code": ("index", "Η σειρά BTE36 δίνεται όπως δημοσιεύτηκε."),
    "decimal": ("index", "Η τιμή 86,6 δίνεται όπως δημοσιεύτηκε, 2010 έως 2016."),
    "words only": ("sums", "Τα στοιχεία δίνονται όπως δημοσιεύτηκαν."),
    "rows": ("sums", "Με βάση 4 γραμμές."),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    facts = spark.createDataFrame(FACTS, "answer_id string, label string, v string, n_used long").withColumn("value", F.col("v").cast("decimal(38,12)"))
    headers = spark.createDataFrame(
        HEADERS, "answer_id string, operation string, complete boolean, truncated_range boolean, categorical_truncation boolean, omitted long,"
        "n_series long, n_points long, row_basis long, stated_total string, row_coverage string, observed_from string, observed_to string",
    ).withColumn("stated_total", F.col("stated_total").cast("decimal(38,12)"))
    rows = [(name, answer, text, "el", None) for name, (answer, text) in {**REJECTED, **ACCEPTED}.items()]
    texts = spark.createDataFrame(rows, "text_id string, answer_id string, text string, language string, limitation string")
    return {r["text_id"]: r.asDict() for r in claims.check_texts(texts, facts, headers).collect()}


@pytest.mark.parametrize("name", list(REJECTED))
def test_rejected(verdicts, name):
    assert not verdicts[name]["ok"], verdicts[name]


@pytest.mark.parametrize("name", list(ACCEPTED))
def test_accepted(verdicts, name):
    assert verdicts[name]["ok"], verdicts[name]


def test_reasons(verdicts):
    assert verdicts["wrong label"]["reason"] == "figure attached to a category it does not belong to"
    assert verdicts["invented figure"]["rejected"] == ["55.000"]
    assert verdicts["superlative"]["rejected"] == ["υψηλοτερ"]


def test_limitation_must_be_repeated(spark):
    licensed = spark.createDataFrame([("a", True, True)], "answer_id string, superlative_ok boolean, trend_ok boolean")
    said = "Only part of the data was retrieved."
    texts = spark.createDataFrame([(1, "a", "Nothing else. " + said, "en", said), (2, "a", "Nothing else.", "en", said)],
                                  "text_id int, answer_id string, text string, language string, limitation string")
    got = {r["text_id"]: r["text_reason"] for r in claims.text_rules(texts, licensed).collect()}
    assert got == {1: None, 2: "stated limitation omitted from the answer"}


def test_colon_option(spark):
    facts = spark.createDataFrame([("a", "Syria", Decimal(5)), ("a", "Egypt", Decimal(7))], "answer_id string, label string, value decimal(38,12)")
    texts = spark.createDataFrame([(1, "a", "Syria: 7", "en")], "text_id int, answer_id string, text string, language string")
    assert claims.mislabelled_figures(texts, facts).count() == 0
    assert claims.mislabelled_figures(texts, facts, split_colon=False).count() == 1
