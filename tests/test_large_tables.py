"""Plans and forms that large tables need."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import claims, coercion, facts, roles
from plumbline.plans import registry
from plumbline.session import materialise
from tests.table_fixtures import TABLES, cells_of

registry.load()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_last_key_of_each_table_is_broadcast(spark, data_dir):
    assert "strategy=broadcast" in optimized(registry.QUERIES["late_total_break"](spark, data_dir))


@pytest.mark.parametrize("slots", [2, 3, 32])  # all tables in lists, some, none
def test_row_totals_in_slots_and_lists_agree(spark, monkeypatch, slots):
    rows = [{f"c{i}": str(i + r) for i in range(4)} | {"sum": str(6 + 4 * r)} for r in range(5)]
    few, negative = rows[:2], [{"a": str(-r), "b": str(r + 1), "t": "1"} for r in range(4)]
    broken = [*rows[:4], rows[4] | {"sum": "7"}]
    gaps = [*rows, rows[0] | {"c1": ""}, {"c0": "", "c1": "", "c2": "", "c3": "", "sum": "9"}]
    monkeypatch.setattr(roles, "FEW", 2)  # half of all rows are looked at first
    cells = cells_of(spark, {"row_totals": TABLES["row_totals"], "vaccination": TABLES["vaccination"], "wide": rows, "few": few, "negative": negative, "broken": broken, "gaps": gaps})
    profile = materialise(coercion.column_profile(cells), "profile")
    got = {(r["rid"], r["col_idx"]) for r in roles.row_totals(cells, profile, slots=slots).collect()}
    assert got == {("row_totals", 3), ("wide", 4), ("gaps", 4), ("negative", 2)}


def test_points_are_not_shuffled_by_table(spark):
    points = spark.range(40).select(
        F.lit("t").alias("rid"), F.lit("a").alias("identity"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("moment"), F.col("id").cast("decimal(18,2)").alias("value"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = facts.time_series(points)
        assert "strategy=broadcast" in optimized(found) and found.count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_clauses_with_figures_are_folded(spark):
    texts = spark.createDataFrame([(1, 1, "en", "As published. The item a stands at 7 ; the item b is 5 of 9 . Nothing else.")], "text_id long, answer_id long, language string, text string")
    owned = spark.createDataFrame([(1, "item a", 5), (1, "item b", 7), (1, "item c", 9)], "answer_id long, label string, value long")
    found = claims.mislabelled_figures(texts, owned)
    assert sorted(map(tuple, found.collect())) == [(1, "item a", "7"), (1, "item b", "5"), (1, "item b", "9")]
    assert "(size(tokens" in optimized(found)
