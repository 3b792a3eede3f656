"""Exact NTILE over any value domain, without a window over the rows.

``NTILE() OVER (ORDER BY ...)`` has no partition key and moves every row into one
task. Here the rows are dealt into ranges of (value, tie-break) by splitters that
Spark samples, and sorted inside each range. A row's global position is then

    rows in the ranges before + its index inside its range

The first comes from the table of range sizes, one row per range, which is the only
thing that a window without a key sees; the second is the running number of the
sorted range. As the tie-break takes part in the splitters, a value that very many
rows share is split as well, whatever its tie-breaks look like.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlens.functions.scalars import ntile_of_position
from seqlens.operators.sequence import whole

_PART_BITS = 33  # of monotonically_increasing_id, below the partition's number


def global_positions(df: DataFrame, value: str, tiebreak: str | list[str], pos: str = "_pos",
                     total: str | None = None, ranges: int | None = None) -> DataFrame:
    """Add ``pos``: the exact 0-based position of each row by ``value``, then
    ``tiebreak`` (unique), ascending, NULLs first; and the row count as ``total``.

    ``ranges``: ranges to deal the rows into (by default the session's number of
    shuffle partitions). It is fixed, so the sizes and the rows number the ranges
    alike."""
    order = [value, *([tiebreak] if isinstance(tiebreak, str) else tiebreak)]
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole(df.repartitionByRange(ranges, *order))
    sizes = dealt.groupBy(F.spark_partition_id().cast("bigint").alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    along = Window.orderBy("_part")  # at most ``ranges`` rows
    offsets = sizes.select("_part",
                           F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"),
                           F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    placed = dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumns({"_part": F.shiftright("_at", _PART_BITS), "_index": F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))})
    out = placed.join(F.broadcast(offsets), "_part").withColumn(pos, F.col("_below") + F.col("_index"))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_part", "_at", "_index", "_below", "_all")


def quantile_tiers(df: DataFrame, k: int, value: str, tiebreak: str | list[str], tier: str = "tier",
                   ranges: int | None = None) -> DataFrame:
    """``NTILE(k) OVER (ORDER BY value, tiebreak)`` as a distributed plan.

    Equal to SQL NTILE: the first ``N mod k`` tiers get one row more.
    """
    ranked = global_positions(df, value, tiebreak, total="_total", ranges=ranges)
    return ranked.withColumn(tier, ntile_of_position(F.col("_pos"), F.col("_total"), k)) \
        .drop("_pos", "_total")
