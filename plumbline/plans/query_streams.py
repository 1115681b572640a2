"""Streams replayed from the stored tables until everything available is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import search_tokens
from plumbline.operators import retrieval
from plumbline.plans.query_search import DIM, token_bucket
from plumbline.plans.query_usage import as_answers
from plumbline.plans.registry import query, table
from plumbline.session import new_folder
from plumbline.sources import payloads
from plumbline.streaming import queries as streams


def replay(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = table(spark, folder, name).schema
    # a pattern, because a plain path to a stream must be a folder; a table may be one file or a folder of files
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def run(spark: SparkSession, stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    path = new_folder(spark, "stream")
    streams.append_batches(stream, f"{path}/out", f"{path}/state", mode).awaitTermination()
    return streams.read_latest(spark, f"{path}/out", keys)


@query("stream_tumbling_metrics", """
    select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, case event_type when 'view' then 'answered' when 'click' then 'partial' else 'refused' end as answer_status,
           cast(count(*) as bigint) as total, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as prompt_tokens,
           cast(round(sum(cast(value as decimal(18,4))), 2) as double) as sum_ms
    from events group by all
""")
def stream_tumbling_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rolled = streams.rolling_metrics(as_answers(replay(spark, folder, "events")), "1 day")
    found = run(spark, rolled, ["window_start", "answer_status"])
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "answer_status", "total", "prompt_tokens", F.round("sum_ms", 2).cast("double").alias("sum_ms"))


@query("stream_sliding_metrics", """
    with w as (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as start, * from events)
    select strftime(start, '%Y-%m-%dT%H') as start, case event_type when 'view' then 'answered' when 'click' then 'partial' else 'refused' end as answer_status,
           cast(count(*) as bigint) as total from w group by all
""")
def stream_sliding_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rolled = streams.rolling_metrics(as_answers(replay(spark, folder, "events")), "2 hours", "1 hour")
    found = run(spark, rolled, ["window_start", "answer_status"])
    return found.select(F.date_format("window_start", "yyyy-MM-dd'T'HH").alias("start"), "answer_status", "total")


@query("stream_dedupe", """
    select user_id, event_type, cast(count(*) as bigint) as firsts from (select distinct user_id, event_type, date_trunc('day', ts) as d from events) group by all
""")
def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """One submission per user, kind and day; all lie inside the horizon of one replay."""
    submitted = replay(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("asked_at"), "user_id", "event_type", F.to_date("ts").alias("day"))
    path = new_folder(spark, "dedupe")
    kept = streams.without_repeats(submitted, ["user_id", "event_type", "day"], "40 days")
    streams.append_batches(kept, f"{path}/out", f"{path}/state", "append").awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/out")
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("firsts"))


@query("stream_latest_cumulative", """
    with l as (select event_type as rid, user_id, arg_max(cast(value as decimal(18,2)), ts) as v from events group by all)
    select rid, cast(sum(v) as double) as value, cast(count(*) as bigint) as n_used from l group by rid
""")
def stream_latest_cumulative(spark: SparkSession, folder: str) -> DataFrame:
    rows = replay(spark, folder, "events").select(
        F.col("event_type").alias("rid"), F.col("user_id").alias("label"), F.col("ts").alias("moment"), F.col("event_id").alias("row_idx"),
        F.col("value").cast("decimal(18,2)").alias("value"))
    found = run(spark, streams.latest_per_group(rows), ["rid", "label"])
    return found.groupBy("rid").agg(F.round(F.sum("value"), 2).cast("double").alias("value"), F.count(F.lit(1)).alias("n_used"))


@query("stream_upsert", """
    select doc_id as id, source as title from documents union all select doc_id + 1000000000, lang from documents where doc_id % 2 = 0
""")
def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Changed and new documents land and are merged into a stored copy."""
    path = new_folder(spark, "catalogue")
    docs = table(spark, folder, "documents")
    docs.select(F.col("doc_id").alias("id"), F.lit("old").alias("title"), F.lit(0).alias("last_updated")).write.parquet(f"{path}/v")
    arriving = replay(spark, folder, "documents").select(F.explode(F.array(
        F.struct(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit(2).alias("last_updated")),
        F.struct(F.col("doc_id").alias("id"), F.lit("stale").alias("title"), F.lit(1).alias("last_updated")),
        F.struct((F.col("doc_id") + 1_000_000_000).alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("title"), F.lit(2).alias("last_updated")),
    )).alias("r")).select("r.*").filter("title is not null")
    versions = {"at": f"{path}/v"}

    def write(df: DataFrame, batch_id: int) -> None:
        target = f"{path}/v{batch_id}"
        df.write.mode("overwrite").parquet(target)
        versions["at"] = target

    streams.refresh_catalogue(arriving, lambda: spark.read.parquet(versions["at"]), write, f"{path}/state").awaitTermination()
    return spark.read.parquet(versions["at"]).select("id", "title")


@query("stream_index_refresh", """
    select doc_id, sha1(text) as sig from documents
""")
def stream_index_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Texts stream into a vector table that knows half of them already."""
    path = new_folder(spark, "vectors")

    def embed(rows: DataFrame) -> DataFrame:
        return retrieval.hashed_vectors(
            rows.select("doc_id", "sig", F.transform(search_tokens(F.col("text")), token_bucket).alias("buckets")), F.col("buckets"), DIM, ["doc_id", "sig"])

    half = table(spark, folder, "documents").filter("doc_id % 2 = 0").select("doc_id", "text", retrieval.signature(F.col("text")).alias("sig"))
    embed(half).write.parquet(f"{path}/v")
    versions = {"at": f"{path}/v"}

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        versions["at"] = f"{path}/v{batch_id}"

    streams.refresh_index(
        replay(spark, folder, "documents").select("doc_id", "text"), lambda: spark.read.parquet(versions["at"]), embed, write, f"{path}/state").awaitTermination()
    return spark.read.parquet(versions["at"]).select("doc_id", "sig")


@query("stream_payload_tables", """
    select n_name as segment, cast(count(*) as bigint) as cells from nation join customer on c_nationkey = n_nationkey group by all
""")
def stream_payload_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Customer files land as CSV, one folder per nation, and become cells."""
    path = new_folder(spark, "landing")
    names = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    rows = table(spark, folder, "customer").join(names, "c_nationkey").select("nation", F.col("nation").alias("segment"), "c_name", (F.col("c_custkey") % 7).alias("code"))
    rows.write.partitionBy("nation").option("header", "true").option("sep", ";").csv(f"{path}/in")
    landed = payloads.read_files(spark, f"{path}/in", "*.csv", stream=True)
    streams.land_cells(landed, f"{path}/out", f"{path}/state").awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/out")
    return out.filter("col_name = 'segment'").groupBy(F.col("cell").alias("segment")).agg(F.count(F.lit(1)).alias("cells"))
