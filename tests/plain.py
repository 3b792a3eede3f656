"""The single-node window forms that the distributed operators must equal."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def window_sequence(df, entity, order, tiebreak, ordinal="ordinal", total="n"):
    w = Window.partitionBy(entity).orderBy(*order, *tiebreak)
    return df.withColumn(ordinal, F.row_number().over(w).cast("bigint")) \
        .withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(entity)))


def window_ntile(df, k, order, tier="tier"):
    return df.withColumn(tier, F.ntile(k).over(Window.orderBy(*order)).cast("bigint"))


def window_median(df, keys, value, median="median", count="rows"):
    """The middle-rows definition."""
    w = Window.partitionBy(*keys).orderBy(value)
    r = df.filter(F.col(value).isNotNull()) \
        .withColumn("_rn", F.row_number().over(w)) \
        .withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    lo, hi = F.floor((F.col("_c") + 1) / 2), F.floor((F.col("_c") + 2) / 2)
    mid = F.when((F.col("_rn") == lo) | (F.col("_rn") == hi), F.col(value))
    return r.groupBy(*keys).agg(F.max("_c").alias(count), F.avg(mid).alias(median))
