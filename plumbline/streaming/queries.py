"""The recurring work as Structured Streaming.

Sinks write to the shared folder; state lives in the checkpoint folder, so a
query started again goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import usage
from plumbline.operators.retrieval import refresh_vectors
from plumbline.sources import payloads, snapshots


def rolling_metrics(answers: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Outcome mix, tokens and latency per event-time window and answer status.

    Latency percentiles are approximate here; the batch summary is exact.
    """
    windows = F.window("asked_at", window, slide) if slide else F.window("asked_at", window)
    return (
        answers.withWatermark("asked_at", watermark)
        .groupBy(windows.alias("w"), "answer_status")
        .agg(
            *usage.summary_columns(),
            F.approx_percentile("total_ms", [0.5, 0.95], 10_000).alias("latency"),
            F.sum(F.col("total_ms").cast("decimal(18,4)")).alias("sum_ms"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.col("answer_status"),
                *[c for c in ("total", "prompt_tokens", "completion_tokens", "llm_calls", "cache_hits", "fetched", "degraded",
                              "guard_rejections", "pinned_total", "pinned_answered", "searched_total", "searched_answered", "latency", "sum_ms")])
    )


def without_repeats(submissions: DataFrame, keys: Sequence[str] = ("question", "resource_id"), horizon: str = "10 minutes", time: str = "asked_at") -> DataFrame:
    """A submission repeated within the horizon counts once."""
    return submissions.withWatermark(time, horizon).dropDuplicatesWithinWatermark(list(keys))


def latest_per_group(rows: DataFrame, keys: Sequence[str] = ("rid", "label")) -> DataFrame:
    """Each group's value at its latest moment so far (update or complete mode)."""
    return rows.groupBy(*keys).agg(
        F.max("moment").alias("moment"), F.max_by("value", F.struct("moment", (-F.col("row_idx")).alias("r"))).alias("value"))


def append_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run everything available now; each batch's changed rows become one folder.

    The folder is named by the batch, so a batch run again replaces its own
    output and nothing is counted twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")

    return (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last written state of every key of an update-mode output."""
    written = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return snapshots.latest_per_key(written, list(keys), ["batch_id"]).drop("batch_id")


def refresh_catalogue(
    packages: DataFrame, read_target: Callable[[], DataFrame], write_target: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Upsert catalogue rows as they land; rerunning a batch gives the same snapshot."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        write_target(snapshots.upsert(read_target(), batch, ["id"], ["last_updated"]), batch_id)

    return packages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_index(
    docs: DataFrame, read_vectors: Callable[[], DataFrame], embed: Callable[[DataFrame], DataFrame],
    write_vectors: Callable[[DataFrame, int], None], checkpoint: str,
) -> StreamingQuery:
    """Embed only texts that are new or changed in a batch; others stay as they are."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        current = read_vectors()
        untouched = current.join(batch.select("doc_id"), "doc_id", "left_anti")
        touched, _ = refresh_vectors(current.join(batch.select("doc_id"), "doc_id", "left_semi"), batch, embed)
        write_vectors(untouched.unionByName(touched), batch_id)

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retained(rows: DataFrame, ttl: str, time: str = "asked_at") -> DataFrame:
    """Rows not older than the age limit at the time they are read."""
    return rows.filter(F.col(time) >= F.current_timestamp() - F.expr(f"interval {ttl}"))


def land_cells(files: DataFrame, out: str, state: str) -> StreamingQuery:
    """Arriving delimited files to cells, a folder for each batch, so that a batch done again replaces its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        payloads.payload_cells(payloads.parse_delimited(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
