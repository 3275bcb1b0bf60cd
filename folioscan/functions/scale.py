"""Helpers for keys that hold very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def running_sum(
    df: DataFrame, keys: list[str], position: str, value: Column, name: str, descending: bool = False, block: int = BLOCK
) -> DataFrame:
    """Running sum of `value` over an integer `position` within each key.

    The key's rows are cut into blocks of positions. Block totals are summed
    first, then rows only within their block, so that no task has to hold or
    walk one long key; the block table is `block` times shorter.
    """
    rows = df.withColumn("_block", F.floor(F.col(position) / block)).withColumn("_value", value)
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    block_order = F.col("_block").desc() if descending else F.col("_block").asc()
    before = Window.partitionBy(*keys).orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    row_order = F.col(position).desc() if descending else F.col(position).asc()
    inside = Window.partitionBy(*keys, "_block").orderBy(row_order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        rows.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_offset") + F.sum("_value").over(inside))
        .drop("_block", "_value", "_offset")
    )


def settle(df: DataFrame) -> DataFrame:
    """Compute the columns of `df` exactly once.

    The optimizer merges projections, and a costly column that later
    expressions use inside lambdas, filters or several branches would be
    evaluated again at each use. Passing the row through a one-row generator
    keeps the projections apart, without a shuffle.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))
