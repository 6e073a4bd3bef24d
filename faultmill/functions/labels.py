"""Small presentation columns of the marts."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.75, "high").when(confidence >= 0.5, "mid")
        .when(confidence.isNotNull(), "low")
    )


def confidence_percent(confidence: Column) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(confidence * 100 + F.lit(0.5)).cast("long")


def category_label(category: Column) -> Column:
    return F.replace(F.coalesce(category, F.lit("undiagnosed")), F.lit("_"), F.lit(" "))


def failure_rate(failed: Column, runs: Column) -> Column:
    return F.when(runs > 0, failed / runs).otherwise(F.lit(0.0))


def failure_band(rate: Column) -> Column:
    return F.when(rate >= 0.25, "critical").when(rate >= 0.10, "warn").otherwise("good")
