"""Ordered look-ups inside a key that stay parallel when one key holds most rows.

A plain window over ``path`` sorts one file in one task. Here the position is cut into blocks
and the first window runs per (key, block). A value that has to cross a block edge is carried
by a second window which sees, per key, only the edge rows: those still waiting for a value
and one value per block. Every other row sits in a group of its own block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _nearest(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, block: int, up: bool):
    order = F.col(pos).asc() if up else F.col(pos).desc()
    rows = df.withColumn("_value", value).withColumn(
        "_block", F.floor(F.col(pos) / F.lit(block)).cast("int")
    )
    cell = Window.partitionBy(*keys, "_block")
    passed = cell.orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    so_far = cell.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = (
        rows.withColumn("_near", F.last("_value", ignorenulls=True).over(passed))
        .withColumn("_seen", F.count("_value").over(so_far))
        .withColumn("_all", F.count("_value").over(cell))
    )
    edge = F.col("_near").isNull() | (
        F.col("_value").isNotNull() & (F.col("_seen") == F.col("_all"))
    )
    grouped = near.withColumn("_group", F.when(edge, -1).otherwise(F.col("_block")))
    across = (
        Window.partitionBy(*keys, "_group")
        .orderBy(order)
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    return grouped.withColumn(
        out, F.coalesce("_near", F.last("_value", ignorenulls=True).over(across))
    ).drop("_value", "_block", "_near", "_seen", "_all", "_group")


def following(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Add ``out``: the non-null ``value`` at the smallest position after this row's."""
    return _nearest(df, keys, pos, value, out, block, up=False)


def following_by_size(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, last: str, block: int = BLOCK
) -> DataFrame:
    """``following`` for rows that know the last position of their key in column ``last``.

    Keys that fit one block, nearly all of them, take one window and one shuffle. The branch for
    longer keys reads its rows by a filter on ``last``; use this on a stored table, where that
    filter skips row groups, since ``df`` is read twice.
    """
    short = df.where(F.col(last) < block)
    whole = (
        Window.partitionBy(*keys)
        .orderBy(F.col(pos).desc())
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    near = (
        short.withColumn("_value", value)
        .withColumn(out, F.last("_value", ignorenulls=True).over(whole))
        .drop("_value")
    )
    long = following(df.where(F.col(last) >= block), keys, pos, value, out, block)
    return near.unionByName(long)


def preceding(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Add ``out``: the non-null ``value`` at the largest position before this row's."""
    return _nearest(df, keys, pos, value, out, block, up=True)


def running_sum(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Add ``out``: sum of ``value`` over this row and all rows before it.

    Block totals are summed map-side first, so the window over a key sees one row per block.
    """
    rows = df.withColumn("_value", value).withColumn(
        "_block", F.floor(F.col(pos) / F.lit(block)).cast("int")
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_before", F.sum("_total").over(earlier))
        .where(F.col("_block") > 0)
        .drop("_total")
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_inside", F.sum("_value").over(inside))
        .join(totals, [*keys, "_block"], "left")
        .withColumn(out, (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("int"))
        .drop("_value", "_block", "_inside", "_before")
    )
