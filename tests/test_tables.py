"""Table semantics: roles, bindings, facts and what limits them."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.operators import coercion, facts, roles
from plumbline.plans import tables as plan
from tests.table_fixtures import TABLES, cells_of, table_rows


@pytest.fixture(scope="module")
def analysis(spark):
    return plan.analyse_tables(cells_of(spark, TABLES), table_rows(spark, TABLES, incomplete=("index", "truncated")))


@pytest.fixture(scope="module")
def fact_rows(analysis):
    return [r.asDict() for r in plan.table_facts(analysis).orderBy("rid", "pos").collect()]


@pytest.fixture(scope="module")
def headers(analysis):
    return {r["rid"]: r.asDict() for r in plan.fact_headers(analysis, plan.table_facts(analysis)).collect()}


def roles_of(analysis, rid):
    return {r["col_name"]: r["role"] for r in analysis.roles.filter(F.col("rid") == rid).collect()}


def test_roles(analysis):
    assert roles_of(analysis, "asylum") == {"UPEKOOTETA": "dimension", "ARIThMOS AITEMATON": "measure"}
    vaccination = roles_of(analysis, "vaccination")
    assert vaccination["totalvaccinations"] == "running_cumulative"
    assert vaccination["daydiff"] == "measure"
    assert vaccination["areaid"] == "identifier"
    assert vaccination["referencedate"] == "temporal"
    assert roles_of(analysis, "cumulative_no_time")["totalvaccinations"] == "unknown"
    index = roles_of(analysis, "index")
    assert index["OBS_VALUE"] == "index" and index["TIME_PERIOD"] == "temporal" and index["BASE_PER"] == "dimension"
    assert roles_of(analysis, "row_totals")["both"] == "row_total"


def test_grouped_sum_leaves_the_stated_total_apart(fact_rows, headers):
    rows = [r for r in fact_rows if r["rid"] == "asylum"]
    assert sum(r["value"] for r in rows) == 73687
    assert [r["label"] for r in rows] == ["Συρία", "Αφγανιστάν", "Αίγυπτος", "Ιράκ"]
    assert headers["asylum"]["stated_total"] == 73687 and headers["asylum"]["total_confirmed"]
    assert rows[0]["basis"] == "sum of 'ARIThMOS AITEMATON' over 4 rows"


def test_latest_of_cumulative(fact_rows):
    rows = [r for r in fact_rows if r["rid"] == "cumulative_only"]
    assert [(r["operation"], r["value"], r["n_used"]) for r in rows] == [("latest", 340, 2)]


def test_series(analysis, headers):
    points = plan.table_series(analysis, plan.table_facts(analysis)).filter("rid = 'index'").orderBy("series", "dim").collect()
    assert len(points) == 6 and len({p["series"] for p in points}) == 2
    assert points[0]["dim"] == "2010-01-01" and points[0]["value"] == Decimal("86.6")
    assert headers["index"]["truncated_range"] and headers["index"]["n_series"] == 2


def test_duplicates_refuse(headers, fact_rows):
    assert headers["duplicate_period"]["operation"] == "listing"
    assert headers["duplicate_period"]["duplicates"] == 1
    assert not [r for r in fact_rows if r["rid"] == "duplicate_period"]


def test_spelling_variants(fact_rows, headers):
    rows = [r for r in fact_rows if r["rid"] == "spellings"]
    assert [(r["label"], r["value"]) for r in rows] == [("ΑΤΤΙΚΗ", 18)]
    assert headers["spellings"]["merged_spellings"] == 3


def test_top_n_and_remainder(fact_rows, headers):
    rows = [r for r in fact_rows if r["rid"] == "top_n"]
    assert len(rows) == 26
    assert rows[-1]["is_remainder"] and rows[-1]["label"] == "Other" and rows[-1]["n_used"] == 15
    assert rows[-1]["value"] == sum(100 - i for i in range(25, 40))
    assert headers["top_n"]["omitted"] == 15


def test_percent_is_never_summed(analysis, fact_rows):
    bound = analysis.bindings.filter("rid = 'percent'").first()
    assert set(bound["forbidden_ops"]) == {"sum", "avg"} and bound["unit"] == "%"
    assert {r["operation"] for r in fact_rows if r["rid"] == "percent"} == {"count"}


def test_constant_columns(analysis):
    found = roles.constant_columns(analysis.values, roles.column_stats(analysis.values))
    got = {(r["rid"], r["col_idx"], r["value"]) for r in found.collect()}
    assert ("index", 0, "M") in got and ("index", 2, "2015") in got


def test_categorical_truncation(headers):
    assert headers["truncated"]["categorical_truncation"]
    assert headers["truncated"]["is_lower_bound"]
    assert not headers["asylum"]["categorical_truncation"]


def test_truncation_across_blocks(spark):
    rows = spark.createDataFrame([("t", i, f"P{i // 10}") for i in range(40)], "rid string, row_idx long, label string")
    for block in (3, 7, 1000):
        assert facts.categorical_truncation(rows, block=block).first()["categorical_truncation"]
    mixed = spark.createDataFrame([("t", i, f"P{i % 4}") for i in range(40)], "rid string, row_idx long, label string")
    assert not facts.categorical_truncation(mixed, block=7).first()["categorical_truncation"]


def test_unpivot(analysis):
    got = plan.unpivot_measures(analysis).filter("rid = 'row_totals'").collect()
    assert {r["measure"] for r in got} == {"men", "women"} and len(got) == 10


COERCE = {
    "comma": (["86,6", "93", "91,3"], "decimal", "86.6"),
    "el": (["1.234,56"], "decimal", "1234.56"),
    "en": (["1,234.56"], "decimal", "1234.56"),
    "ambiguous": (["1,234", "5,678"], "text", "1,234"),
    "resolved": (["1,234", "86,6"], "decimal", "1.234"),
    "mixed": (["1,5", "2.5"], "text", "1,5"),
    "nan": (["1", "2", "NaN"], "text", "1"),
    "inf": (["1", "inf"], "text", "1"),
    "long": (["1" * 40], "text", "1" * 40),
    "exponent": (["1e999999999"], "text", "1e999999999"),
    "nulls": (["1", "", "3"], "decimal", "1"),
    "sentinels": (["1", "2", ":", "Δ/Υ", "N/A"], "decimal", "1"),
    "flags": (["86,6 p", "90,1"], "decimal", "86.6"),
    "percent": (["45,3%"], "decimal", "45.3"),
    "months": (["2010-01", "2010-02"], "temporal", "2010-01-01"),
    "day_first": (["13/07/2026", "01/02/2026"], "temporal", "2026-07-13"),
    "day_unknown": (["05/06/2026", "01/02/2026"], "text", "05/06/2026"),
    "zone": (["2023-12-05T00:30:00+03:00"], "temporal", "2023-12-05"),
    "bools": (["ναι", "όχι", "Yes"], "boolean", "True"),
    "groups": (["1.234.567", "2.000.000"], "decimal", "1234567"),
    "empty": ([None, ""], "text", None),
    "years": (["2019", "2020"], "decimal", "2019"),
    "mixed_dates": (["2019", "2020-05"], "temporal", "2019-01-01"),
}


@pytest.fixture(scope="module")
def coerced(spark):
    cells = cells_of(spark, {rid: [{"c": v} for v in values] for rid, (values, _, _) in COERCE.items()})
    profile = coercion.column_profile(cells)
    typed = coercion.typed_cells(cells, profile)
    return (
        {r["rid"]: r.asDict() for r in profile.collect()},
        {(r["rid"], r["row_idx"]): r.asDict() for r in typed.collect()},
    )


@pytest.mark.parametrize("rid", list(COERCE))
def test_coercion(coerced, rid):
    profile, typed = coerced
    _, kind, first = COERCE[rid]
    assert profile[rid]["kind"] == kind
    assert typed[(rid, 0)]["text_value"] == first


def test_coercion_counts(coerced):
    profile, typed = coerced
    assert profile["nulls"]["null_count"] == 1
    assert (profile["sentinels"]["sentinel_count"], profile["sentinels"]["null_count"]) == (3, 0)
    assert typed[("flags", 0)]["flagged"] and not typed[("flags", 1)]["flagged"]
    assert profile["percent"]["unit"] == "%"


def test_results_do_not_depend_on_partitioning(spark, fact_rows):
    cells = cells_of(spark, TABLES).repartition(7, "row_idx")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        again = plan.analyse_tables(cells, table_rows(spark, TABLES, incomplete=("index", "truncated")))
        got = [r.asDict() for r in plan.table_facts(again).orderBy("rid", "pos").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == fact_rows


ALIKE = {
    **{rid: values for rid, (values, _, _) in COERCE.items()},
    "keys": [str(10_000 + 7 * i) for i in range(300)],
    "prices": [f"{i % 90 + 1}.{100 + i:03},{i % 97:02}" for i in range(300)],
    "shares": [f"{i + 10},5%" for i in range(80)],
    "words": [a + " " + b for a in ("lavender", "chocolate", "EUR") for b in ("of the spring meadows", "and of the old forest EUR")],
    "leading": ["007", "0,50", "12,50", "+9,5", "-10,25"],
    "one": ["7", "1"], "truths": ["1", "0"], "not_truths": ["7", "0", "yes"],
    "year_feed": ["2010\n", "1999 "], "no_year": ["9999", "2020-05"], "year": ["2100", "2020-05"],
    "scales": ["1,5", "123.456.789,123456789012", "99999999999999999999999999999,5"], "broken": ["1,2.3,4", "12"],
}


def test_alike_cells_have_the_profile_of_their_cells(spark):
    cells = cells_of(spark, {rid: [{"c": v} for v in values] for rid, values in ALIKE.items()})
    for sentinels in (vocab.SENTINELS, (*vocab.SENTINELS, "-1111", "2222")):
        rows = lambda df: sorted(map(str, coercion.column_profile(df, sentinels).collect()))
        assert rows(coercion.alike_cells(cells, sentinels)) == rows(cells)
    kinds = dict(coercion.alike_cells(cells).groupBy("rid").count().collect())
    assert kinds["keys"] == 1 and kinds["prices"] <= 2 and kinds["words"] == 1
