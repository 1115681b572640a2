"""The long form every table takes: one row per cell.

``cells``: rid, row_idx, col_idx, col_name, cell (text).  ``row_idx`` is the
published row order, counted from 0; all order-dependent rules use it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells_from_table(df: DataFrame, rid: Column, row_idx: Column, columns: Sequence[str]) -> DataFrame:
    """Unpivot a wide table of text columns; one pass, no shuffle."""
    named = [
        F.struct(
            F.lit(index).alias("col_idx"),
            F.lit(name).alias("col_name"),
            F.col(name).cast("string").alias("cell"),
        )
        for index, name in enumerate(columns)
    ]
    return df.select(
        rid.alias("rid"), row_idx.cast("long").alias("row_idx"), F.explode(F.array(*named)).alias("c")
    ).select("rid", "row_idx", "c.col_idx", "c.col_name", "c.cell")


def assemble_rows(typed: DataFrame, picks: DataFrame) -> DataFrame:
    """Bring the picked cells of a row back together.

    ``picks``: rid, col_idx, slot.  The result has one row per (rid, row_idx) with
    the moment, label and measure slots and the text of the series-key slots in
    column order.  Cells of a row leave the scan together, so the map side
    already folds them before the shuffle.
    """
    chosen = typed.join(picks, ["rid", "col_idx"])

    def slot(name: str, value: str) -> Column:
        return F.max(F.when(F.col("slot") == name, F.col(value)))

    return chosen.groupBy("rid", "row_idx").agg(
        slot("moment", "date_value").alias("moment"),
        slot("label", "text_value").alias("label"),
        slot("measure", "number").alias("value"),
        F.array_sort(
            F.collect_list(
                F.when(F.col("slot") == "series", F.struct("col_idx", F.coalesce("text_value", F.lit("None")).alias("text")))
            )
        ).alias("series_cells"),
    )
