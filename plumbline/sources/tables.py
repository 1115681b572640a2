"""Stored tables with the row order they were published in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.sizes import broadcast_if_small


def read_in_order(spark: SparkSession, path: str, out: str = "row_idx") -> DataFrame:
    """A parquet table with a unique ``row_idx`` in file and row order.

    Rows are numbered inside their file by the reader; files add the rows of the
    files before them, which needs one counter per file and no sort of the rows.
    """
    df = spark.read.parquet(path)
    columns = df.columns
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    offsets = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(broadcast_if_small(offsets), "_file").select(*columns, (F.col("_offset") + F.col("_row")).alias(out))
