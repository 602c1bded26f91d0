"""Row numbers inside a key that stay parallel when one key holds most rows.

The rows are dealt out by ranges of (key, order), so a hot key lies in many consecutive parts.
Each part numbers its own rows; a key that goes on in a later part starts there at the number of
its rows in the parts before. Only such continued keys, at most one a part, are carried across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def dealt(rows: DataFrame, keys: list[str], order: list[str], part: str = "_part") -> DataFrame:
    """``rows`` in ranges of keys and order, written once; ``part`` is the number of the range.

    Written, since each later reader has to see the same ranges. Equal rows are spread by a hash of
    their place in the scan, so that a row repeated without end still lies in several ranges.
    """
    marked = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    ranged = marked.repartitionByRange(*keys, *order, "_tie")
    return cut(ranged.withColumn(part, F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, keys: list[str], order: list[str], out: str = "place") -> DataFrame:
    """Add ``out``: 1, 2, ... for the rows of each key in ascending order of ``order``, nulls first.

    Rows equal in keys and order follow each other in any order. Null keys are a key of their own.
    """
    placed = dealt(rows, keys, order)
    totals = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    names = [F.col(k).alias(f"_r_{k}") for k in keys]
    parts = F.array_sort(F.collect_list(F.struct("_part", "_n")))
    # one entry for each part that holds the key; several only for keys that cross a border
    crossing = totals.groupBy(*keys).agg(parts.alias("_parts")).where(F.size("_parts") > 1)
    earlier = Window.partitionBy(*[f"_r_{k}" for k in keys]).orderBy("_r_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        crossing.select(*names, F.explode("_parts").alias("_p"))
        .select(*[f"_r_{k}" for k in keys], F.col("_p._part").alias("_r_part"), F.col("_p._n").alias("_n"))
        .withColumn("_before", F.sum("_n").over(earlier))
        .where(F.col("_before").isNotNull())
        .drop("_n")
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    on = F.col("_part") == F.col("_r_part")
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    # a proven bound: a part continues at most one key, so there are fewer offsets than parts
    return (
        placed.withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(offsets), on, "left")
        .withColumn(out, F.col("_place") + F.coalesce("_before", F.lit(0)))
        .drop("_part", "_tie", "_place", "_before", "_r_part", *[f"_r_{k}" for k in keys])
    )
