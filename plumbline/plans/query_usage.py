"""Usage summaries and retention, with events as the answer log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import usage
from plumbline.plans.registry import query, table

SQL_LOG = """
    log as (select event_id as id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k,
              case event_type when 'view' then 'answered' when 'click' then 'partial' else 'refused' end as status,
              case event_type when 'error' then 'no_match' when 'signup' then 'unsupported' when 'purchase' then 'matched_but_refused' end as shape,
              case when user_id % 3 = 0 then 'el' when user_id % 3 = 1 then 'en' else 'greeklish' end as language from events)
"""


def answer_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as answers: the kind is the outcome, ``k`` the tokens, value the latency."""
    return as_answers(table(spark, folder, "events"))


def as_answers(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind, user = F.col("event_type"), F.col("user_id")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("asked_at"), (user % 5 == 0).alias("pinned"),
        F.when(user % 3 == 0, "el").when(user % 3 == 1, "en").otherwise("greeklish").alias("language"),
        F.when(kind == "view", "answered").when(kind == "click", "partial").otherwise("refused").alias("answer_status"),
        F.when(kind == "error", "no_match").when(kind == "signup", "unsupported").when(kind == "purchase", "matched_but_refused").alias("refusal_shape"),
        k.alias("prompt_tokens"), (k % 7).alias("completion_tokens"), F.lit(1).cast("long").alias("llm_calls"),
        F.when(k % 4 != 0, k % 2 == 0).alias("from_cache"), (k > 90).alias("plan_degraded"), (k < 5).alias("narration_rejected"),
        F.col("value").alias("total_ms"), user.alias("user_id"),
    )


@query("metrics_summary", f"""
    with {SQL_LOG}
    select cast(count(*) as bigint) as total, cast(sum(k) as bigint) as prompt_tokens, cast(sum(k % 7) as bigint) as completion_tokens,
      cast(count(*) as bigint) as llm_calls, cast(count(*) filter (k % 4 <> 0 and k % 2 = 0) as bigint) as cache_hits, cast(count(*) filter (k % 4 <> 0) as bigint) as fetched,
      cast(count(*) filter (k > 90) as bigint) as degraded, cast(count(*) filter (k < 5) as bigint) as guard_rejections,
      cast(count(*) filter (user_id % 5 = 0) as bigint) as pinned_total, cast(count(*) filter (user_id % 5 = 0 and status <> 'refused') as bigint) as pinned_answered,
      cast(count(*) filter (user_id % 5 <> 0) as bigint) as searched_total, cast(count(*) filter (user_id % 5 <> 0 and status <> 'refused') as bigint) as searched_answered,
      quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95
    from log
""")
def metrics_summary(spark: SparkSession, folder: str) -> DataFrame:
    return usage.summary(answer_log(spark, folder))


@query("metrics_breakdown", f"""
    with {SQL_LOG}, f as (select 'status' as facet, status as value from log union all select 'refusal', shape from log where shape is not null union all select 'language', language from log)
    select facet, value, cast(count(*) as bigint) as n from f group by all
""")
def metrics_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return usage.breakdowns(answer_log(spark, folder)).select("facet", "value", F.col("n").cast("long").alias("n"))


@query("metrics_percentile", """
    select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by all
""")
def metrics_percentile(spark: SparkSession, folder: str) -> DataFrame:
    return usage.exact_percentiles(table(spark, folder, "events"), F.col("value"), (50, 95, 99), ["event_type"])


@query("keep_newest", """
    select event_id as id from events where ts >= (select max(ts) from events) - interval 20 days order by ts desc, event_id desc limit 5000
""")
def keep_newest(spark: SparkSession, folder: str) -> DataFrame:
    """Answers younger than twenty days, at most the newest five thousand."""
    log = answer_log(spark, folder)
    now = log.agg(F.max("asked_at")).scalar()
    return usage.purge(log, now, ttl_s=20 * 86_400, max_rows=5_000).select("id")


@query("lru_evict", """
    with s as (select event_id, ts, 100 + event_id % 900 as bytes, sum(100 + event_id % 900) over (order by ts desc, event_id desc rows unbounded preceding) as upto from events)
    select event_id as resource_id, cast(bytes as bigint) as bytes from s where upto <= 2000000
""")
def lru_evict(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "events").select(
        F.col("event_id").alias("resource_id"), F.col("ts").alias("last_accessed"), (100 + F.col("event_id") % 900).cast("long").alias("bytes"))
    return usage.evict_least_recent(records, 2_000_000).select("resource_id", "bytes")


def fetched_records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("resource_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("cached_at"),
        F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(F.col("o_orderpriority")).alias("last_modified"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("metadata_modified"),
        (F.col("o_orderkey") % 4 != 0).alias("complete"), F.col("o_orderkey").alias("bytes"), (F.col("o_orderkey") % 2).cast("int").alias("parser_version"))


SQL_RECORDS = """
    f as (select o_custkey as resource_id, strftime(o_orderdate, '%Y-%m-%d') as cached_at, o_orderkey as bytes, o_orderkey % 2 as parser_version,
            case when o_orderstatus <> 'F' then 'last_modified' when o_orderpriority <> '5-LOW' then 'metadata_modified' end as field,
            case when o_orderstatus <> 'F' then o_orderpriority when o_orderpriority <> '5-LOW' then o_orderstatus end as val from orders where o_orderkey % 4 <> 0),
    r as (select *, row_number() over (partition by resource_id order by cached_at desc, field desc, val desc) as rn,
                 count(*) over (partition by resource_id, cached_at, field, val) as same from f where field is not null),
    rec as (select * from r where rn = 1)
"""


@query("stored_records", f"with {SQL_RECORDS} select resource_id, cached_at, field, val as value from rec")
def stored_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per resource, the latest complete fetch that has a freshness key."""
    return usage.store_records(fetched_records(spark, folder)).select(
        "resource_id", "cached_at", F.col("key.field").alias("field"), F.col("key.value").alias("value"))


@query("cache_lookup", f"""
    with {SQL_RECORDS}
    select c_custkey as resource_id, coalesce(rec.cached_at >= '1999-01-01' and rec.field = 'last_modified' and rec.val = '2-HIGH', false) as hit
    from customer left join rec on rec.resource_id = c_custkey
""")
def cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Which resources can be answered from a stored record."""
    records = usage.store_records(fetched_records(spark, folder)).withColumn("parser_version", F.lit(3))
    asked = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("resource_id"), F.lit("2-HIGH").alias("last_modified"), F.lit("x").alias("metadata_modified"))
    now = F.lit("2002-01-01").cast("timestamp")
    return usage.lookup(asked, records, now, parser_version=3, ttl_s=1096 * 86_400)


@query("stage_durations", """
    select event_id, user_id, event_type as stage, round(date_diff('microsecond', ts, lead(ts) over (partition by user_id order by ts, event_id)) / 1000.0, 3) as elapsed_ms from events
""")
def stage_durations(spark: SparkSession, folder: str) -> DataFrame:
    marks = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    timed = usage.stage_durations(marks, ["user_id"], "ts", "event_id")
    elapsed = (F.unix_micros("next_at") - F.unix_micros("ts")) / 1000
    return timed.select("event_id", "user_id", F.col("event_type").alias("stage"), F.round(elapsed, 3).alias("elapsed_ms"))


@query("token_usage", """
    select user_id, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as prompt_tokens, cast(count(*) as bigint) as llm_calls from events group by all
""")
def token_usage(spark: SparkSession, folder: str) -> DataFrame:
    return answer_log(spark, folder).groupBy("user_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("llm_calls").alias("llm_calls"))
