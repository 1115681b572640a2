"""Broadcast only what has been measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def measured_size(df: DataFrame, stop_after: int = MAX_BROADCAST_ROWS) -> tuple[int, int]:
    """Rows and bytes of text of ``df``; counting stops just past ``stop_after`` rows."""
    width = sum(
        (F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() in ("string", "binary")
         else F.lit(64) if f.dataType.typeName() not in ("array", "map", "struct")
         else F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)))
        for f in df.schema.fields
    )
    row = df.limit(stop_after + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    rows, size = measured_size(df, max_rows)
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when its measured size allows, else unchanged."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
