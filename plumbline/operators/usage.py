"""Usage metrics of answers and retention of stored payload records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import vocab
from plumbline.operators.sequences import block_offsets, next_in_key
from plumbline.operators.sizes import is_small
from plumbline.session import materialise

METRICS_SCHEMA = (
    "id long, asked_at timestamp, question_chars int, language string, pinned boolean, plan_status string, dataset_id string,"
    "confidence double, plan_degraded boolean, answer_status string, refusal_shape string, narration_rejected boolean,"
    "caveats int, row_count long, complete boolean, from_cache boolean, prompt_tokens long, completion_tokens long,"
    "llm_calls long, llm_ms double, plan_ms double, fetch_ms double, synth_ms double, total_ms double"
)


def summary_columns() -> list[Column]:
    """Counters of an answer summary; usable in batch and streaming aggregates."""
    answered = F.col("answer_status").isin("answered", "partial")
    return [
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum("llm_calls"), F.lit(0)).alias("llm_calls"),
        F.count_if(F.col("from_cache")).alias("cache_hits"),
        F.count("from_cache").alias("fetched"),
        F.count_if("plan_degraded").alias("degraded"),
        F.count_if("narration_rejected").alias("guard_rejections"),
        F.count_if("pinned").alias("pinned_total"),
        F.count_if(F.col("pinned") & answered).alias("pinned_answered"),
        F.count_if(~F.col("pinned")).alias("searched_total"),
        F.count_if(~F.col("pinned") & answered).alias("searched_answered"),
    ]


def summary(answers: DataFrame) -> DataFrame:
    """Overall counters and latency percentiles, one row (also for no answers)."""
    exact = exact_percentiles(answers, F.coalesce("total_ms", F.lit(0.0)), (50, 95))
    found = exact.select(F.struct("p50", "p95")).scalar()
    totals = answers.agg(*summary_columns()).withColumn("_p", found)
    return totals.withColumns({p: F.coalesce(F.col("_p")[p], F.lit(0.0)) for p in ("p50", "p95")}).drop("_p")


def breakdowns(answers: DataFrame) -> DataFrame:
    """Counts by status, refusal and language in one pass: facet, value, n."""
    facets = F.array(
        F.struct(F.lit("status").alias("facet"), F.col("answer_status").alias("value")),
        F.struct(F.lit("refusal").alias("facet"), F.col("refusal_shape").alias("value")),
        F.struct(F.lit("language").alias("facet"), F.col("language").alias("value")),
    )
    return (
        answers.groupBy("answer_status", "refusal_shape", "language").agg(F.count(F.lit(1)).alias("_n"))
        .select(F.explode(facets).alias("f"), "_n")
        .filter(F.col("f.value").isNotNull() & (F.col("f.value") != ""))
        .groupBy("f.facet", "f.value").agg(F.sum("_n").alias("n"))
    )


def exact_percentiles(rows: DataFrame, value: Column, percents: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank percentiles per key, without sorting a whole key in one task.

    Equal values are counted first; ranks then come from block counts.  A first
    block is a 64th of a power of two; the blocks that hold a wanted rank are cut
    into equal slices, and only the slices that hold it are numbered by value.
    """
    work = [*keys, "_all"]
    counts = (
        rows.select(*keys, value.cast("double").alias("v")).filter("v is not null").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
        .withColumns({"_all": F.lit(0), "_block": value_block(F.col("v"))})
    )
    first = block_offsets(counts, work, F.col("_block"), F.sum("c"))
    ranks = F.array(*[
        F.struct(F.lit(p).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("total") * p / 100)).cast("long").alias("r")) for p in percents
    ])
    wanted = first.select(*work, "_block", "offset", "block_amount", F.explode(ranks).alias("w")).filter(
        (F.col("w.r") > F.col("offset")) & (F.col("w.r") <= F.col("offset") + F.col("block_amount"))
    ).select(*work, "_block", F.col("w.p").alias("_p"), (F.col("w.r") - F.col("offset")).alias("_rank"))
    bounds = counts.groupBy(*work, "_block").agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    inside = counts.join(wanted.join(bounds, [*work, "_block"]), [*work, "_block"])
    width = F.col("_high") - F.col("_low")
    inside = inside.withColumn("_slice", F.when(width > 0, F.floor((F.col("v") - F.col("_low")) / width * SLICES)).otherwise(0)).drop("_block")
    slices = block_offsets(inside, [*work, "_p"], F.col("_slice"), F.sum("c")).select(
        *work, "_p", F.col("_block").alias("_slice"), "offset", F.col("block_amount"))
    last = inside.join(slices, [*work, "_p", "_slice"]).filter(
        (F.col("_rank") > F.col("offset")) & (F.col("_rank") <= F.col("offset") + F.col("block_amount"))
    ).withColumn("_upto", F.col("offset") + F.sum("c").over(W.partitionBy(*work, "_p").orderBy("v")))
    found = last.filter(F.col("_upto") >= F.col("_rank")).groupBy(*work, "_p").agg(F.min("v").alias("v"))
    return found.groupBy(*work).agg(*[F.max(F.when(F.col("_p") == p, F.col("v"))).alias(f"p{p}") for p in percents]).drop("_all")


SLICES = 65_536


def value_block(value: Column) -> Column:
    """Order-preserving block of a number: sign, then 64ths of powers of two."""
    size = F.floor(F.log2(F.abs(value) + 1) * 64)
    return F.when(value < 0, -size - 1).otherwise(size).cast("long")


def keep_newest(rows: DataFrame, max_rows: int, time: str = "asked_at", tie: str = "id") -> DataFrame:
    """The newest ``max_rows`` rows, exactly, without one task seeing them all."""
    return _newest(rows, F.lit(1), max_rows, time, tie)


def _newest(rows: DataFrame, amount: Column, limit: int, time: str, tie: str) -> DataFrame:
    """Rows, newest first, while the running sum of ``amount`` stays within ``limit``.

    Block sums say which blocks of time lie wholly inside; only the block the limit
    cuts through is looked at more closely: hours, then seconds, then runs of ids
    within one instant.  Row-by-row numbering is left for one such run.
    """
    columns = rows.columns
    chunk = F.floor(F.col(tie) / 65_536) if rows.schema[tie].dataType.typeName() in ("long", "integer") else F.substring(F.col(tie), 1, 8)
    levels = [F.date_trunc("hour", F.col(time)), F.date_trunc("second", F.col(time)), F.struct(F.col(time).alias("t"), chunk.alias("c"))]
    open_rows = rows.withColumns({"_amount": amount.cast("long"), "_base": F.lit(0).cast("long"), "_all": F.lit(0)})
    kept = None
    for level in levels:
        sums = open_rows.groupBy("_all", level.alias("_block")).agg(F.sum("_amount").alias("_size"), F.max("_base").alias("_base"))
        newer = W.partitionBy("_all").orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
        starts = sums.select("_block", "_size", (F.col("_base") + F.coalesce(F.sum("_size").over(newer), F.lit(0))).alias("_start")).filter(
            F.col("_start") < limit)
        placed = open_rows.drop("_base").withColumn("_block", level).join(starts, "_block")
        inside = F.col("_start") + F.col("_size") <= limit
        whole = placed.filter(inside).select(*columns)
        kept = whole if kept is None else kept.unionByName(whole)
        cut = placed.filter(~inside).withColumn("_base", F.col("_start")).drop("_block", "_size", "_start")
        open_rows = materialise(cut, "cut")  # the rows of one block
        if is_small(open_rows):
            break
    order = W.partitionBy("_all").orderBy(F.desc(time), F.desc(tie)).rowsBetween(W.unboundedPreceding, 0)
    last = open_rows.withColumn("_upto", F.col("_base") + F.sum("_amount").over(order)).filter(F.col("_upto") <= limit)
    return kept.unionByName(last.select(*columns))


def evict_least_recent(records: DataFrame, max_bytes: int, time: str = "last_accessed", size: str = "bytes", tie: str = "resource_id") -> DataFrame:
    """Records kept when the least recently used are dropped until the rest fits."""
    return _newest(records, F.col(size), max_bytes, time, tie)


def purge(answers: DataFrame, now: Column, ttl_s: int = vocab.METRICS_TTL_S, max_rows: int = vocab.METRICS_MAX_ROWS) -> DataFrame:
    """Answers kept after the age limit and the row ceiling."""
    fresh = answers.filter(~is_expired(F.col("asked_at"), now, ttl_s))
    return keep_newest(fresh, max_rows)


def is_expired(stamp: Column, now: Column, ttl_s: int) -> Column:
    """Past the age limit; a stamp that cannot be read counts as expired."""
    read = stamp.try_cast("timestamp")
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(read) > ttl_s, F.lit(True))


# --- stored payload records -------------------------------------------------------


def freshness_key(last_modified: Column, metadata_modified: Column) -> Column:
    """Which time field says whether a stored body is current, and its value."""
    return F.coalesce(*[
        F.when(value != "", F.struct(F.lit(name).alias("field"), value.alias("value")))
        for name, value in (("last_modified", last_modified), ("metadata_modified", metadata_modified))
    ])


def store_records(fetched: DataFrame) -> DataFrame:
    """One record per resource: the last complete body with a freshness key.

    ``fetched``: resource_id, last_modified, metadata_modified, complete, bytes,
    parser_version, cached_at.
    """
    keyed = fetched.filter("complete").withColumn("key", freshness_key(F.col("last_modified"), F.col("metadata_modified"))).filter("key is not null")
    return keyed.groupBy("resource_id").agg(
        F.max_by(F.struct("key", "bytes", "parser_version", "cached_at"), F.struct("cached_at", "key")).alias("r")
    ).select("resource_id", "r.*")


def touch(records: DataFrame, accesses: DataFrame) -> DataFrame:
    """Last access time of every record, from the access log."""
    seen = accesses.groupBy("resource_id").agg(F.max("accessed_at").alias("_seen"))
    return records.join(seen, "resource_id", "left").withColumn("last_accessed", F.greatest("cached_at", "_seen")).drop("_seen")


def lookup(resources: DataFrame, records: DataFrame, now: Column, parser_version: int, ttl_s: int = vocab.CACHE_TTL_S) -> DataFrame:
    """resource_id, hit: same freshness key, same parser, not too old."""
    wanted = resources.select("resource_id", freshness_key(F.col("last_modified"), F.col("metadata_modified")).alias("key"))
    usable = records.filter((F.col("parser_version") == parser_version) & ~is_expired(F.col("cached_at"), now, ttl_s))
    return wanted.join(usable.select("resource_id", "key", F.lit(True).alias("_hit")), ["resource_id", "key"], "left").select(
        "resource_id", F.coalesce("_hit", F.lit(False)).alias("hit"))


def stage_durations(marks: DataFrame, keys: Sequence[str], time: str, tie: str, out: str = "next_at") -> DataFrame:
    """Each mark with the time of the next mark of its key; hours are the blocks."""
    return next_in_key(marks, keys, F.date_trunc("hour", F.col(time)), [time, tie], time, out)
