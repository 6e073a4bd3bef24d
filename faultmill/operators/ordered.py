"""Order-dependent columns without one task per key.

A window over a key puts all rows of that key into one task.  Here the rows of a key are cut into
ordered buckets, the window runs inside a bucket, one summary row per bucket is scanned along the
key, and what a bucket inherits from the earlier ones is joined back to its rows.  Buckets are cut by
rows (``in_ranges``), or by time where a caller knows that no stretch of time is crowded.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DAY = 86_400

#: Column that ``in_ranges`` adds.
RANGE = "__range"


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``RANGE``: the number of the row's range partition in the order of keys and ``order``.

    Partitions hold like numbers of rows, so a key with any share of the rows, or of one moment's
    rows, spreads over as many of them; along a key the number never decreases.  The rows are stored
    once: borders are drawn from a sample and must be the same for every reader.  A key has at most
    one summary row per partition.
    """
    return materialize(ranged(df, keys, order), "ranges")


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``in_ranges`` unstored, for a caller that reads it once and stores what it makes of it."""
    return df.repartitionByRange(*keys, *order).select("*", F.spark_partition_id().alias(RANGE))


def time_bucket(moment: Column, seconds: int = DAY) -> Column:
    return F.floor(F.unix_micros(moment) / F.lit(seconds * 1_000_000)).cast("long")


def with_previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column,
                  value: Column, name: str, reverse: bool = False) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` among the strictly earlier rows of the key.

    ``bucket`` must not decrease along ``order`` and bounds the rows one task sorts per key.
    With ``reverse`` it is the first one among the strictly later rows.
    """
    def direction(column: str) -> Column:
        return F.desc(column) if reverse else F.asc(column)

    known = df.withColumns({"__bucket": bucket, "__value": value})
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*[direction(c) for c in order])
    along = Window.partitionBy(*keys).orderBy(direction("__bucket"))
    extreme = F.min_by if reverse else F.max_by

    rows = known.withColumn("__inner", F.last("__value", ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, -1)))
    carried = (
        known.groupBy(*keys, "__bucket")
        .agg(extreme(F.col("__value"),
                     F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__last"))
        .withColumn("__carry", F.last("__last", ignorenulls=True).over(
            along.rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.col("__carry").isNotNull())
        .select(*keys, "__bucket", "__carry")
    )
    return (
        rows.join(carried, [*keys, "__bucket"], "left")
        .withColumn(name, F.coalesce("__inner", "__carry"))
        .drop("__bucket", "__value", "__inner", "__carry")
    )
