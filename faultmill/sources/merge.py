"""Stored tables that take increments: rows are added or replaced by key, partition by partition."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import materialize

#: Partitions of a dimension, which has no period.
BUCKETS = 16


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def period(moment: str, unit: str = "month") -> Column:
    return F.date_format(F.date_trunc(unit, F.col(moment)), "yyyy-MM-dd")


def bucket(key: str) -> Column:
    return F.lpad(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("string"), 2, "0")


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored table with the columns of ``like``; empty where there is none yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def merge(changes: DataFrame, path: str, keys: list[str], order: list[str], part: str, first: bool = False) -> None:
    """Add the rows of ``changes`` to the table at ``path``; of rows with one key the last in ``order``
    stays, or with ``first`` the first.

    ``part`` is a string column that never changes for a key (a period of a fixed moment, a bucket of the
    key).  Only partitions that a changed row falls into are read and written again, each replaced as a
    whole.  Changes that the table has outlived touch nothing, and a repeated increment leaves it as
    it is, so an increment that broke off is just run again.  The same for a batch and for each
    micro-batch of a stream.
    """
    spark = changes.sparkSession
    changes = materialize(changes, "changes")
    held = stored(spark, path, changes)
    place = F.struct(*order)
    known = held.select(*keys, part, place.alias("__held"))
    newer = F.col("__new") < F.col("__held") if first else F.col("__new") > F.col("__held")
    fresh = materialize(changes.withColumn("__new", place).join(known, [*keys, part], "left").filter(
        F.col("__held").isNull() | newer).select(*changes.columns), "fresh")
    touched = [r[0] for r in fresh.select(part).distinct().collect()]  # partitions, not rows
    if not touched:
        return
    pick = F.min_by if first else F.max_by
    rest = [c for c in changes.columns if c not in (*keys, part)]
    merged = held.filter(F.col(part).isin(touched)).unionByName(fresh).groupBy(*keys, part).agg(
        pick(F.struct(*rest), place).alias("__row")).select(*keys, part, "__row.*").select(*changes.columns)
    merged = materialize(merged, "merged")
    # a partition of many rows is written by several tasks, a small one by one
    merged.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        part).parquet(path)


def merge_stream(changes: DataFrame, path: str, keys: list[str], order: list[str], part: str, checkpoint: str) -> StreamingQuery:
    """``merge`` of every micro-batch."""
    return (
        changes.writeStream.outputMode("append").foreachBatch(
            lambda rows, _: merge(_last(rows, keys, order), path, keys, order, part))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key of a micro-batch, the last in ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(
        *keys, "__row.*").select(*rows.columns)
