"""Equi-joins whose left side may hold one key in a third of its rows, and the search for such keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
HOT_SHARE = 256
HOT_ROWS = PART_ROWS = 1 << 20


def join_lookup(left: DataFrame, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to a side with one row per string ``key``.

    A unique side is mostly the output of a ``groupBy(key)``, whose partitioning Spark would use
    for the join directly; AQE can split a hot partition only when both inputs are fresh
    shuffles. The key passes through an expression here, which gives the (small) unique side a
    shuffle of its own, so hot keys on the left are split and the unique rows copied to the
    splits. When the unique side proves small at run time, AQE broadcasts it instead.
    """
    side = unique.withColumn("_key", F.concat(F.col(key), F.lit(""))).drop(key)
    return left.join(side, F.col(key) == F.col("_key"), how).drop("_key")


def bucket_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(rows: DataFrame, *keys: str, share: int = HOT_SHARE, least: int = HOT_ROWS) -> tuple[list[int], int]:
    """Buckets of keys (``bucket_of``) with more than one in ``share`` of all rows, so fewer than ``share`` of them, and
    the number of parts for ``dealt_by``: at least the session's, and one for each ``PART_ROWS``.

    No key outside them has more rows than that, or than ``least``, so all its rows may meet in one task. Each task
    hands on at most ``BUCKETS`` counts.
    """
    counted = rows.groupBy(bucket_of(*keys).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counted)
    few = [r["bucket"] for r in counted if r["n"] > max(least, total // share)]
    return few, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))


def dealt_by(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``rows`` by keys with the keys' hash ``_h``, which sorts faster than texts with one beginning.

    The number of parts is given, since packed rows grow fivefold for a sort: parts merged by AQE would not fit memory.
    """
    return rows.repartition(parts, *keys).withColumn("_h", F.xxhash64(*keys))
