"""Guarded aggregates over the sales and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import coercion, facts
from plumbline.operators.cells import cells_from_table
from plumbline.operators.sequences import order_breaks
from plumbline.plans.registry import query, spread, table

# The grouping key in SQL, for labels without exotic scripts.
SQL_KEY = "replace(lower(strip_accents(translate({0}, 'ABEZHIKMNOPTXY', 'ΑΒΕΖΗΙΚΜΝΟΡΤΧΥ'))), 'ß', 'ss')"


def _figures(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        *extra, F.col("pos").cast("long").alias("pos"), "label", F.round("value", 4).cast("double").alias("value"),
        F.col("n").cast("long").alias("n"), F.col("n_used").cast("long").alias("n_used"),
        F.col("omitted").cast("long").alias("omitted"), "is_remainder",
    )


def _topn_sql(base: str, fact: str, n: int, keys: str = "") -> str:
    """Top-n with remainder over a relation base(keys, label, v, r)."""
    k = keys + ", " if keys else ""
    part = f"partition by {keys}" if keys else ""
    return f"""
    with base as ({base}),
    spelled as (select {k}{SQL_KEY.format('label')} as label_key, label, count(*) as n, min(r) as f, sum(v) as s from base group by all),
    named as (select *, row_number() over (partition by {k}label_key order by n desc, f) as pick from spelled),
    groups as (select {k}label_key, max(case when pick = 1 then label end) as label, sum(n) as n, min(f) as f, sum(s) as s from named group by all),
    ranked as (select *, least(row_number() over ({part} order by {fact} desc, f), {n + 1}) as p, sum(n) over ({part}) as used from groups)
    select {k}cast(p as bigint) as pos,
           case when p <= {n} then max(label) else 'Other' end as label,
           cast(round(sum({fact}), 4) as double) as value, cast(sum(n) as bigint) as n,
           cast(case when p <= {n} then max(used) else count(*) end as bigint) as n_used,
           cast(case when p <= {n} then 0 else count(*) end as bigint) as omitted,
           p > {n} as is_remainder
    from ranked group by {k}p
    """


def priced_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with a price written as ``1.234,56`` and read back as a column."""
    lines = spread(table(spark, folder, "lineitem")).select(
        "l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_idx"),
        F.translate(F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), ",.", ".,").alias("price"),
    )
    cells = cells_from_table(lines, F.lit("lineitem"), F.col("row_idx"), ["price"])
    profile = coercion.column_profile(cells)
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("label"))
    priced = coercion.with_agreed_number(lines, profile, "price", "value")
    return priced.join(parts, "l_partkey").select(F.lit("lineitem").alias("rid"), "row_idx", "label", "value")


@query("grouped_sum_topn_other", _topn_sql(
    "select p_name as label, cast(l_extendedprice as decimal(18,2)) as v, l_orderkey * 8 + l_linenumber as r from lineitem join part on l_partkey = p_partkey",
    "s", 10,
))
def grouped_sum_topn_other(spark: SparkSession, folder: str) -> DataFrame:
    return _figures(facts.grouped_facts(priced_rows(spark, folder), "sum", n=10))


@query("grouped_count_topn_other", _topn_sql(
    "select 'documents' as rid, source as label, 1 as v, doc_id as r from documents union all "
    "select 'events', event_type, 1, event_id from events", "n", 3, "rid",
))
def grouped_count_topn_other(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        F.lit("documents").alias("rid"), F.col("doc_id").alias("row_idx"), F.col("source").alias("label"))
    events = table(spark, folder, "events").select(
        F.lit("events").alias("rid"), F.col("event_id").alias("row_idx"), F.col("event_type").alias("label"))
    return _figures(facts.grouped_facts(docs.unionByName(events), "count", n=3), "rid")


@query("requested_aggregates", """
    with a as (select l_returnflag as rid, l_linestatus as label, sum(cast(l_quantity as decimal(18,2))) as s, count(*) as n,
                      min(l_quantity) as min_v, max(l_quantity) as max_v from lineitem group by all)
    select rid, label, round(cast(s as double) / n, 4) as avg_value, min_v as min_value, max_v as max_value, cast(n as bigint) as n from a
""")
def requested_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("rid"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_idx"),
        F.col("l_linestatus").alias("label"), F.col("l_quantity").cast("decimal(18,2)").alias("value"),
    )
    found = None
    for operation in ("avg", "min", "max"):
        part = facts.grouped_facts(rows, operation).select(
            "rid", "label", F.col("value").cast("decimal(38,12)").alias("value"), F.col("n").cast("long").alias("n"), F.lit(operation).alias("op"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("rid", "label", "n").agg(*[
        F.round(F.max(F.when(F.col("op") == op, F.col("value"))), 4).cast("double").alias(f"{op}_value") for op in ("avg", "min", "max")
    ])


@query("subtotal_excluded_stated_total", """
    with revenue as (
      select n_regionkey as rid, n_name as label, sum(cast(o_totalprice as decimal(18,2))) as v
      from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all),
    stated as (select rid, sum(v) as t from revenue group by rid)
    select cast(r.rid as bigint) as rid, r.label, cast(r.v as double) as value,
           cast(s.t as double) as stated_total, true as total_confirmed
    from revenue r join stated s on r.rid = s.rid
""")
def subtotal_excluded_stated_total(spark: SparkSession, folder: str) -> DataFrame:
    """Per region: nations' revenue next to the TOTAL row the publisher added."""
    orders = table(spark, folder, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("long").alias("rid"))
    detail = orders.join(customers, "o_custkey").join(nations, "n_nationkey").groupBy("rid", F.col("n_name").alias("label")).agg(
        F.sum("value").alias("value"), F.max("n_nationkey").cast("long").alias("row_idx"))
    totals = detail.groupBy("rid").agg(F.sum("value").alias("value")).select(
        "rid", F.lit("TOTAL").alias("label"), "value", F.lit(1_000_000).cast("long").alias("row_idx"))
    published = detail.unionByName(totals).withColumn("value", F.col("value").cast("decimal(28,2)"))
    shown = facts.grouped_facts(published, "sum").select("rid", "label", F.round("value", 2).cast("double").alias("value"))
    stated = facts.stated_totals(published).select("rid", F.round("stated_total", 2).cast("double").alias("stated_total"), "total_confirmed")
    return shown.join(stated, "rid").select("rid", "label", "value", "stated_total", "total_confirmed")


LATEST_BASE = """
    with daily as (select event_type, cast(ts as date) as day, user_id, sum(cast(value as decimal(18,2))) as v from events group by all),
    running as (select event_type, user_id, day, sum(v) over (partition by event_type, user_id order by day) as total from daily)
"""


@query("latest_of_cumulative", LATEST_BASE + """,
    latest as (select event_type, user_id, arg_max(total, day) as total, max(day) as day from running group by all)
    select event_type as rid, cast(sum(total) as double) as value, cast(max(day) as varchar) as as_of,
           cast(min(day) as varchar) as min_as_of, cast(count(*) as bigint) as n_used
    from latest group by event_type
""")
def latest_of_cumulative(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals per user and event type, reduced to their last values."""
    rows = running_totals(spark, folder)
    return facts.latest_of_cumulative(rows).select(
        "rid", F.round("value", 2).cast("double").alias("value"), F.col("as_of").cast("string").alias("as_of"),
        F.col("min_as_of").cast("string").alias("min_as_of"), F.col("n_used").cast("long").alias("n_used"))


def running_totals(spark: SparkSession, folder: str) -> DataFrame:
    daily = table(spark, folder, "events").groupBy("event_type", "user_id", F.to_date("ts").alias("moment")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).alias("v"), F.min("event_id").alias("row_idx"))
    # at most one row per day and key is left, so the window is over days, not events
    running = F.sum("v").over(W.partitionBy("event_type", "user_id").orderBy("moment"))
    return daily.select(F.col("event_type").alias("rid"), "row_idx", F.col("user_id").cast("string").alias("label"), "moment",
                        running.cast("decimal(28,2)").alias("value"))


@query("monotonic_per_group", """
    with e as (
      select event_type as rid, user_id as grp, cast(value as decimal(18,2)) as v,
             lag(cast(value as decimal(18,2))) over (partition by event_type, user_id order by ts, event_id) as p
      from events)
    select rid, cast(grp as bigint) as grp, cast(count(*) as bigint) as n_values, cast(count(*) filter (v < p) as bigint) as n_falls,
           count(*) filter (v < p) = 0 as monotonic
    from e group by all
""")
def monotonic_per_group(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        F.col("event_type").alias("rid"), F.col("user_id").alias("grp"), "ts", "event_id", F.col("value").cast("decimal(18,2)").alias("value"))
    breaks = order_breaks(events, ["rid", "grp"], F.date_trunc("hour", "ts"), ["ts", "event_id"], "value")
    return breaks.select(
        "rid", "grp", F.col("n_values").cast("long").alias("n_values"), F.col("n_falls").cast("long").alias("n_falls"),
        (F.col("n_falls") == 0).alias("monotonic"))


@query("time_series_duplicates", """
    with base as (
      select 'raw' as rid, o_orderpriority as identity, date_trunc('month', o_orderdate) as moment from orders
      union all
      select distinct 'monthly', o_orderpriority, date_trunc('month', o_orderdate) from orders),
    m as (select rid, identity, moment, count(*) as n from base group by all)
    select rid, cast(sum(n) as bigint) as n_used, cast(count(distinct identity) as bigint) as n_series,
           cast(sum(n) - count(*) as bigint) as duplicates
    from m group by rid
""")
def time_series_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by month and priority, raw (refused) and rolled up (a valid series)."""
    return facts.series_duplicates(_order_series(spark, folder)).select(
        "rid", F.col("n_used").cast("long").alias("n_used"), F.col("n_series").cast("long").alias("n_series"),
        F.col("duplicates").cast("long").alias("duplicates"))


def _order_series(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("identity"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("moment"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    raw = orders.select(F.lit("raw").alias("rid"), "identity", "moment", F.col("value").cast("decimal(28,2)").alias("value"))
    rolled = orders.groupBy("identity", "moment").agg(F.sum("value").cast("decimal(28,2)").alias("value")).select(
        F.lit("monthly").alias("rid"), "identity", "moment", "value")
    return raw.unionByName(rolled)


@query("time_series_points", """
    select 'monthly' as rid, o_orderpriority as series, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as dim,
           cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value
    from orders group by all
""")
def time_series_points(spark: SparkSession, folder: str) -> DataFrame:
    return facts.time_series(_order_series(spark, folder)).select(
        "rid", "series", F.col("dim").cast("string").alias("dim"), F.round("value", 2).cast("double").alias("value"))


@query("series_first_last", """
    with m as (select o_orderpriority as rid, date_trunc('month', o_orderdate) as dim, sum(cast(o_totalprice as decimal(18,2))) as v from orders group by all)
    select rid, strftime(min(dim), '%Y-%m-%d') as first_dim, cast(arg_min(v, dim) as double) as first_value,
           strftime(max(dim), '%Y-%m-%d') as last_dim, cast(arg_max(v, dim) as double) as last_value, cast(count(*) as bigint) as n_used
    from m group by rid
""")
def series_first_last(spark: SparkSession, folder: str) -> DataFrame:
    rolled = _order_series(spark, folder).filter("rid = 'monthly'").select(
        F.col("identity").alias("rid"), F.lit("").alias("identity"), "moment", "value")
    ends = facts.series_ends(facts.time_series(rolled))
    return ends.select(
        "rid", F.col("first_dim").cast("string").alias("first_dim"), F.round("first_value", 2).cast("double").alias("first_value"),
        F.col("last_dim").cast("string").alias("last_dim"), F.round("last_value", 2).cast("double").alias("last_value"),
        F.col("n_used").cast("long").alias("n_used"))


@query("max_remainder", """
    with m as (select p_type as label, max(p_retailprice) as m, min(p_partkey) as f, count(*) as n from part group by all),
    r as (select *, row_number() over (order by m desc, f) as p from m)
    select cast(least(p, 4) as bigint) as pos, round(max(m), 2) as value, cast(sum(n) as bigint) as n from r group by least(p, 4)
""")
def max_remainder(spark: SparkSession, folder: str) -> DataFrame:
    """Three types with the highest price, and the highest price among all others."""
    rows = table(spark, folder, "part").select(
        F.lit("part").alias("rid"), F.col("p_partkey").alias("row_idx"), F.col("p_type").alias("label"), F.col("p_retailprice").cast("decimal(18,2)").alias("value"))
    return facts.grouped_facts(rows, "max", n=3).select(
        F.col("pos").cast("long").alias("pos"), F.round("value", 2).cast("double").alias("value"), F.col("n").cast("long").alias("n"))


@query("series_long_names", """
    select repeat('x', 80) || p_brand as series, cast(count(*) as bigint) as points from (select distinct p_brand, p_size from part) group by 1
""")
def series_long_names(spark: SparkSession, folder: str) -> DataFrame:
    """Series whose names differ only behind their eightieth character stay apart."""
    rows = table(spark, folder, "part").groupBy("p_brand", "p_size").agg(F.max("p_retailprice").cast("decimal(18,2)").alias("value")).select(
        F.lit("part").alias("rid"), F.concat(F.lit("x" * 80), "p_brand").alias("identity"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")).alias("moment"), "value")
    return facts.time_series(rows).groupBy("series").agg(F.count(F.lit(1)).alias("points"))


@query("intent_filtered_sum", """
    select o_orderstatus as rid, o_orderpriority as label, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value, cast(count(*) as bigint) as n
    from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' and lower(o_orderpriority) = lower('1-Urgent')
    group by all
""")
def intent_filtered_sum(spark: SparkSession, folder: str) -> DataFrame:
    """A period and a label asked for, applied before the sum."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("rid"), F.col("o_orderkey").alias("row_idx"), F.col("o_orderdate").cast("date").alias("moment"),
        F.col("o_orderpriority").alias("label"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    wanted = facts.apply_intent(
        rows, F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date"), F.lit("1-URGENT"))
    return facts.grouped_facts(wanted, "sum").select(
        "rid", "label", F.round("value", 2).cast("double").alias("value"), F.col("n").cast("long").alias("n"))


@query("categorical_truncation", """
    with r as (select o_orderstatus as rid, o_orderkey, strftime(o_orderdate, '%Y-%m') as label,
                      row_number() over (partition by o_orderstatus order by o_orderkey) as pos,
                      count(*) over (partition by o_orderstatus) as total from orders),
    e as (select rid, label, max(case when pos <= greatest(total // 10, 1) then 1 else 0 end) as head,
                 max(case when pos > total - greatest(total // 10, 1) then 1 else 0 end) as tail from r where total >= 20 group by all)
    select rid, cast(sum(head) as bigint) as head_categories, cast(sum(tail) as bigint) as tail_categories,
           sum(head * tail) = 0 as categorical_truncation
    from e group by rid
""")
def categorical_truncation(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("rid"), F.col("o_orderkey").alias("row_idx"),
        F.date_format("o_orderdate", "yyyy-MM").alias("label"))
    return facts.categorical_truncation(rows, block=4096).select(
        "rid", F.col("head_categories").cast("long").alias("head_categories"),
        F.col("tail_categories").cast("long").alias("tail_categories"), "categorical_truncation")


@query("fold_group_variants", f"""
    with w as (
      select doc_id as r, regexp_extract(text, '^[^ \\n]+') as label from documents
      union all select p_partkey, case when p_partkey % 2 = 0 then upper(p_name) else p_name end from part),
    s as (select {SQL_KEY.format('label')} as label_key, label, count(*) as n, min(r) as f from w where label <> '' group by all),
    p as (select *, row_number() over (partition by label_key order by n desc, f) as pick from s)
    select label_key, max(case when pick = 1 then label end) as label, cast(count(*) as bigint) as spellings, cast(sum(n) as bigint) as n
    from p group by label_key
""")
def fold_group_variants(spark: SparkSession, folder: str) -> DataFrame:
    """First words of documents and part names in mixed case, merged by key."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_idx"), F.regexp_extract("text", "^[^ \\n]+", 0).alias("label"))
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_idx"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("label"))
    words = docs.unionByName(parts).filter("label <> ''").withColumn("rid", F.lit("words"))
    return facts.label_groups(words, with_value=False, total_labels=()).select(
        "label_key", "label", F.col("spellings").cast("long").alias("spellings"), F.col("n").cast("long").alias("n"))
