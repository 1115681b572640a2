"""Plans, answers, catalogue choice and the driver contract."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from plumbline.functions.text import output_language
from plumbline.operators import catalogue
from plumbline.plans import answers
from plumbline.plans import tables as plan
from plumbline.sources import snapshots
from tests.table_fixtures import TABLES, cells_of, table_rows
from tools.check import TABLES as DRIVER_TABLES
from tools.check import rows_of


def test_best_resource(spark):
    rows = [
        ("r1", "d1", "JSON", True, 0, 5, None, True), ("r2", "d1", "CSV", True, 3, None, "active", True), ("r3", "d1", "CSV", False, 0, 1, None, True),
        ("r4", "d2", "CSV", False, None, 1, None, True), ("r5", "d2", "csv ", False, 2, None, None, True), ("r6", "d2", "CSV", False, 2, 9, None, True),
        ("r7", "d3", "XLS", True, 0, 1, None, True), ("r8", "d4", "CSV", True, 0, 1, "deleted", True),
    ]
    frame = spark.createDataFrame(rows, "id string, dataset_id string, format string, datastore_active boolean, position int, size long, state string, is_tabular boolean")
    got = {r["dataset_id"]: (r["id"], r["access_path"]) for r in catalogue.best_resources(frame).collect()}
    assert got == {"d1": ("r2", "datastore"), "d2": ("r6", "download")}


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    batch = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1)], "id long, v string, seq int")
    once = snapshots.upsert(target, batch, ["id"], ["seq"])
    twice = snapshots.upsert(once, batch, ["id"], ["seq"])
    want = [(1, "a"), (2, "new"), (3, "c")]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, twice.collect())) == want


def test_params(spark):
    raw = ['{"date_from":"2020-01-01","date_to":"2019-01-01","aggregation":"SUM","limit":5}', '{"date_from":"2020-02-30","region":" X ","limit":-1,"metrics":["a"," "]}',
           '{"aggregation":"median","limit":99999}', "not json", None]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = [r["p"].asDict() for r in frame.orderBy("i").select(answers.valid_params(F.col("r")).alias("p")).collect()]
    assert got[0]["date_from"] is None and got[0]["date_to"] is None and got[0]["aggregation"] == "sum" and got[0]["limit"] == 5
    assert got[1]["date_from"] is None and got[1]["region"] == "X" and got[1]["limit"] is None and got[1]["metrics"] == ["a"]
    assert got[2]["aggregation"] is None and got[2]["limit"] == 32_000
    assert got[3]["limit"] is None and got[4]["metrics"] == []


def test_output_language(spark):
    frame = spark.createDataFrame([("el",), ("greeklish",), ("en",)], "l string")
    assert [r[0] for r in frame.select(output_language(F.col("l"))).collect()] == ["el", "el", "en"]


@pytest.fixture(scope="module")
def answered(spark):
    """Every fixture table asked about directly, end to end."""
    analysis = plan.analyse_tables(cells_of(spark, TABLES), table_rows(spark, TABLES, incomplete=("index",), untrusted=("percent",)))
    facts = plan.table_facts(analysis)
    headers = plan.fact_headers(analysis, facts)
    asked = [(rid, rid, None, None, None) for rid in TABLES] + [
        ("late", "index", "2024-01-01", None, None), ("partly", "index", "2010-02-01", "2024-01-01", None),
        ("undated", "top_n", "2010-01-01", None, None), ("region", "spellings", None, None, "Αττικη"), ("nowhere", "spellings", None, None, "Κρήτη")]
    params = F.struct(
        F.col("f").alias("date_from"), F.col("t").alias("date_to"), F.col("r").alias("region"), F.array().cast("array<string>").alias("metrics"),
        F.lit(None).cast("string").alias("aggregation"), F.lit(None).cast("string").alias("group_by"), F.lit(None).cast("long").alias("limit"))
    plans = spark.createDataFrame(asked, "qid string, resource_id string, f string, t string, r string").select(
        "qid", "resource_id", F.lit("which").alias("question"), F.lit("en").alias("language"), F.lit("matched").alias("status"), F.lit("d").alias("dataset_id"),
        F.lit("T").alias("dataset_title"), params.alias("params"))
    unbound = answers.unbound_params(plans.withColumnRenamed("resource_id", "rid"), analysis.bindings, analysis.values, analysis.roles)
    errors = spark.createDataFrame([("asylum_bad", "malformed")], "resource_id string, error_kind string")
    none = F.array().cast("array<string>")
    context = plans.select("qid", F.lit("P").alias("publisher"), none.alias("formats"), none.alias("near_misses"))
    rows = answers.answer_rows(plans, headers, unbound, errors, context)
    foot = rows.withColumns({"last_updated": F.lit("2026-01-01"), "source_url": F.lit("https://x.example/?sig=1"), "row_count": F.col("n_rows"),
                             "upstream_total": F.lit(None).cast("long")})
    told = foot.withColumn("footer", answers.footer(F.col("answer_language"), F.lit("2026-01-10").cast("date"), "https://c.example/"))
    told = told.join(answers.top_figures(facts).withColumnRenamed("rid", "resource_id"), "resource_id", "left")
    told = told.withColumn("text", answers.answer_text(F.col("answer_language")))
    return {r["qid"]: r.asDict() for r in told.collect()}


def test_statuses(answered):
    assert answered["asylum"]["answer_status"] == "answered"
    assert answered["cumulative_only"]["answer_status"] == "partial"
    assert answered["duplicate_period"]["answer_status"] == "partial"
    assert answered["index"]["answer_status"] == "partial"
    assert answered["late"]["answer_status"] == "refused" and answered["late"]["refusal_shape"] == "matched_but_refused"
    assert "2010-01-01 to 2010-03-01" in answered["late"]["refusal_reason"]


def test_caveats(answered):
    assert answered["index"]["caveats"][0] == "The retrieved data covers only 2010-01-01 to 2010-03-01."
    assert "The requested period is only partly covered (2010-01-01–2010-03-01)." in answered["partly"]["caveats"]
    assert answered["spellings"]["caveats"] == ["Spelling variants of the same category were merged."]
    assert answered["top_n"]["caveats"] == ["The largest categories are shown; 15 others were grouped."]
    assert answered["percent"]["caveats"][0].startswith("The file's headers are unreliable")
    assert "this dataset is not broken down by time" in answered["undated"]["caveats"]
    assert "The 'date' filter could not be applied to this dataset." in answered["undated"]["caveats"]
    assert answered["region"]["unbound"] == [] and answered["nowhere"]["unbound"] == ["region"]


def test_texts(answered):
    assert answered["asylum"]["text"] == (
        "Across 4 rows, the largest categories are — Συρία: 40,000, Αφγανιστάν: 26,011, Αίγυπτος: 7,547. The source also publishes a total of its own: 73,687. "
        "Source: T — P. Coverage: all 5 rows. updated within the last month.")
    assert answered["cumulative_only"]["text"].startswith("According to the data, 'totalvaccinations': 340 (value of 'totalvaccinations' at 2021-01-03, summed over 2 areas).")
    assert answered["asylum"]["footer"]["source_url"].endswith("sig=REDACTED")


def test_refusals_carry_no_caveats(answered):
    assert all(not a["caveats"] for a in answered.values() if a["answer_status"] == "refused")


def test_chart_needs_two_points_and_keeps_order(spark):
    points = spark.createDataFrame([
        ("a", "", "x", 1.0, 1), ("a", "", "y", 5.0, 2), ("b", "", "only", 1.0, 1), ("c", "s1", "k", 1.0, 1), ("c", "s2", "m", 2.0, 2), ("d", "", "x", 1.0, 1), ("d", "", "y", 5.0, 2),
    ], "rid string, series string, dim string, value double, pos long")
    headers = spark.createDataFrame([(r, "sum", r != "d", False, False) for r in "abcd"], "rid string, operation string, complete boolean, temporal boolean, categorical_truncation boolean")
    got = answers.chart_series(points, headers).orderBy("rid", "series", "pos").collect()
    assert [(r["dim"], r["value"]) for r in got if r["rid"] == "a"] == [("y", 5.0), ("x", 1.0)]
    assert [r["dim"] for r in got if r["rid"] == "d"] == ["x", "y"]
    assert not [r for r in got if r["rid"] == "b"]
    grouped = [r for r in got if r["rid"] == "c"]
    assert {r["kind"] for r in grouped} == {"grouped_bar"} and len(grouped) == 4 and sum(r["value"] is None for r in grouped) == 2


def test_public_view_shows_no_plan(spark):
    frame = spark.createDataFrame([("q", "x", 0.3, "answered")], "qid string, question string, confidence double, answer_status string")
    assert answers.public_view(frame).columns == ["qid", "question", "answer_status"]


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["pos", "label", "value", "n", "n_used", "omitted", "is_remainder"]


@pytest.mark.parametrize("name", [
    "grouped_sum_topn_other", "subtotal_excluded_stated_total", "latest_of_cumulative", "fold_group_variants", "paged_listing", "upsert_snapshot",
    "rrf_fusion", "csv_payload_tables", "json_records_union_header", "plan_status", "chart_matrix", "metrics_summary", "stream_dedupe",
])
def test_queries_match_their_sql(spark, data_dir, name):
    con = duckdb.connect()
    for table in DRIVER_TABLES:
        con.execute(f"create view {table} as select * from '{data_dir}/{table}.parquet'")
    cursor = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    df = contract.queries()[name](spark, data_dir)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())
