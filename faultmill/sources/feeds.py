"""Reading feeds, joining the three vendors, keeping refused events, writing tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import fixed_values as fv
from . import airflow, dbt, generic
from .schemas import EVENT_COLUMNS, FEED

NORMALIZERS = {"airflow": airflow.normalize, "dbt": dbt.normalize, "generic": generic.normalize}


def read_feed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw payloads, one per row, under an explicit schema (JSON lines or Parquet)."""
    return spark.read.schema(FEED).format(fmt).load(path)


def read_feed_stream(spark: SparkSession, path: str, fmt: str = "json",
                     files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(FEED).format(fmt)
        .option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def union_events(*normalized: DataFrame) -> DataFrame:
    """Accepted events of several normalised feeds as one."""
    combined = None
    for part in normalized:
        part = accepted(part)
        combined = part if combined is None else combined.unionByName(part)
    return combined


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNull()).select(*EVENT_COLUMNS)


def quarantine(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNotNull()).select(
        "event_id", "received_at", "workspace_id", "reject_reason")


def drop_redelivered(events: DataFrame) -> DataFrame:
    """For feeds that deliver at least once; runs themselves are never merged."""
    return events.dropDuplicates(["event_id"])


def adhoc_reject_reason(log: Column, context: Column, platform: Column) -> Column:
    """Why a pasted log is refused; null when it is fine."""
    blank = F.lit(r"(?U)^[\s\x1c-\x1f]*$")
    return (
        F.when(log.isNull() | (F.length(log) < 1), "empty log")
        .when(F.length(log) > fv.MAX_LOG_CHARS, "log too long")
        .when(F.rlike(log, blank), "blank log")
        .when(F.length(context) > fv.MAX_CONTEXT_CHARS, "context too long")
        .when(~platform.isin(*fv.PLATFORMS), "invalid platform")
    )


def adhoc_logs(pasted: DataFrame) -> DataFrame:
    """Pasted logs with defaults and ``reject_reason``."""
    filled = pasted.withColumns({
        "platform": F.coalesce("platform", F.lit("generic")),
        "context": F.coalesce("context", F.lit(""))})
    return filled.withColumn("reject_reason", adhoc_reject_reason(
        F.col("log"), F.col("context"), F.col("platform")))


def write_by_period(df: DataFrame, path: str, moment: str, unit: str = "day",
                    mode: str = "append", *within: str) -> None:
    """Store a table partitioned by UTC day, month, quarter or year.

    The rebalance gives a small period one file and splits one that holds many rows over several
    tasks by size, so neither many small files nor one overlong task arise.  ``within`` orders the
    rows of a file.
    """
    dated = df.withColumn("dt", F.to_date(F.date_trunc(unit, moment)))
    dealt = dated.hint("rebalance", "dt")
    if within:
        dealt = dealt.sortWithinPartitions("dt", *within)
    dealt.write.mode(mode).partitionBy("dt").parquet(path)
