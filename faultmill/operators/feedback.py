"""Feedback on diagnoses."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diagnosis import FIELDS
from .ordered import DAY, time_bucket, with_previous


def with_diagnosis(feedback: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Adds ``diagnosis``: the newest one of the incident when the feedback came in.

    Feedback and diagnoses of an incident form one timeline and every feedback row takes the last
    diagnosis before it, so no incident's rows are paired with each other.
    """
    given = diagnoses.select(
        "incident_id", F.col("created_at").alias("at"), F.lit(0).alias("__turn"),  # at equal times first
        F.col("diagnosis_id").alias("event_id"), F.col("diagnosis_id").alias("__given"))
    asked = feedback.withColumn("__turn", F.lit(1))
    combined = asked.unionByName(given, allowMissingColumns=True)
    # only ids go through the windows; the diagnosis is looked up last
    found = (
        with_previous(combined, ["incident_id"], ["at", "__turn", "event_id"],
                      time_bucket(F.col("at"), DAY), F.col("__given"), "__found")
        .filter(F.col("__turn") == 1)
        .drop("__turn", "__given")
    )
    value = F.struct("diagnosis_id", "created_at", *FIELDS)
    return found.join(
        diagnoses.select(F.col("diagnosis_id").alias("__found"), value.alias("diagnosis")),
        "__found", "left").drop("__found")
