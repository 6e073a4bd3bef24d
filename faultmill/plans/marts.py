"""Feeds and dashboards over incidents, pipelines and diagnoses."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators.diagnosis import latest, title
from ..rules import fixed_values as fv

SUMMARY = (
    "incident_id", "pipeline_id", "pipeline_name", "platform", "title", "status", "fingerprint",
    "occurrence_count", "first_seen_at", "last_seen_at", "category", "summary", "confidence",
)


def incidents_with_pipeline(incidents: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Unknown pipelines give an empty name and no platform."""
    dimension = pipelines.select(
        "pipeline_id", F.col("name").alias("pipeline_name"), F.col("platform"))
    return incidents.join(dimension, "pipeline_id", "left").withColumn(
        "pipeline_name", F.coalesce("pipeline_name", F.lit("")))


def summaries(incidents: DataFrame, pipelines: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """The 13 fields an incident is listed with; its diagnosis is the newest one.

    The title names the cause that the newest diagnosis with a summary found, so a later answer of
    a model renames the incident.
    """
    diagnosis, order = F.col("diagnosis"), F.struct("created_at", "diagnosis_id")
    newest = diagnoses.groupBy("incident_id").agg(
        F.max_by(F.struct("category", "summary", "confidence"), order).alias("diagnosis"),
        F.max_by("summary", F.when(F.col("summary") != "", order)).alias("cause"))
    return (
        incidents_with_pipeline(incidents, pipelines)
        .join(newest, "incident_id", "left")
        .withColumns({
            "title": F.when(F.col("cause").isNull(), F.col("title")).otherwise(
                title(F.col("pipeline_name"), F.lit(""), F.col("cause"))),
            "category": diagnosis["category"],
            "summary": F.coalesce(diagnosis["summary"], F.lit("")),
            "confidence": diagnosis["confidence"]})
        .select(*SUMMARY)
    )


# --- feed ----------------------------------------------------------------------------------------

def feed_page(listed: DataFrame, limit: int = fv.FEED_LIMIT, offset: int = 0) -> DataFrame:
    """One page, newest first; filters belong before it."""
    if not 0 <= limit <= fv.FEED_LIMIT_MAX or offset < 0:
        raise ValueError(f"limit must be within 0..{fv.FEED_LIMIT_MAX}, offset not negative")
    return listed.orderBy(F.desc("last_seen_at"), "incident_id").offset(offset).limit(limit)


def with_status(listed: DataFrame, status: str) -> DataFrame:
    return listed.filter(F.col("status") == status)


def with_any_category(listed: DataFrame, diagnoses: DataFrame, category: str) -> DataFrame:
    """Incidents that ever had the category, whatever their newest diagnosis says."""
    return listed.join(
        diagnoses.filter(F.col("category") == category), "incident_id", "left_semi")


def search(listed: DataFrame, query: str = "", platform: str = "", category: str = "",
           pipeline: str = "") -> DataFrame:
    """Facets and a case-insensitive substring of title, pipeline, platform and category."""
    wanted = query.strip().lower()
    for column, value in (("platform", platform), ("category", category),
                          ("pipeline_name", pipeline)):
        if value:
            listed = listed.filter(F.col(column) == value)
    if wanted:
        shown = [F.coalesce(F.col(c), F.lit("")) for c in
                 ("title", "pipeline_name", "platform", "category")]
        listed = listed.filter(F.contains(F.lower(F.concat_ws(" ", *shown)), F.lit(wanted)))
    return listed


def facets(listed: DataFrame) -> DataFrame:
    """Distinct values to filter by, sorted, without null and empty ones."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(facet).alias("facet"), F.col(column).alias("value"))
        for facet, column in (("platform", "platform"), ("category", "category"),
                              ("pipeline", "pipeline_name"))]))
    return (
        listed.select(pairs.alias("pair")).select("pair.facet", "pair.value")
        .filter(F.coalesce(F.col("value"), F.lit("")) != "").distinct()
        .orderBy("facet", "value")
    )


def incident_logs(incidents: DataFrame, bundles: DataFrame) -> DataFrame:
    """Stored logs of all tasks of each incident's latest run."""
    return incidents.select("incident_id", "run_id").join(bundles, "run_id")


def diagnosis_history(diagnoses: DataFrame) -> DataFrame:
    """Diagnoses of each incident, newest first, numbered from 1."""
    order = Window.partitionBy("incident_id").orderBy(F.desc("created_at"), F.desc("diagnosis_id"))
    return diagnoses.withColumn("position", F.row_number().over(order))


# --- dashboard -----------------------------------------------------------------------------------

def totals(incidents: DataFrame) -> DataFrame:
    status = F.col("status")
    return incidents.agg(
        F.count(F.lit(1)).alias("total_incidents"),
        F.count_if(status == "open").alias("open_incidents"),
        F.count_if(status == "resolved").alias("resolved_incidents"),
        F.count_if(F.col("occurrence_count") > 1).alias("recurring_incidents"))


def by_category(incidents: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Incidents per newest category; undiagnosed ones are left out."""
    newest = latest(diagnoses, "category").select("incident_id", F.col("diagnosis.category").alias("category"))
    return (
        incidents.select("incident_id").join(newest, "incident_id")
        .groupBy("category").agg(F.count(F.lit(1)).alias("incidents"))
    )


def by_platform(incidents: DataFrame, pipelines: DataFrame) -> DataFrame:
    return (
        incidents.select("pipeline_id").join(pipelines.select("pipeline_id", "platform"),
                                             "pipeline_id")
        .groupBy("platform").agg(F.count(F.lit(1)).alias("incidents"))
    )


def average_confidence(diagnoses: DataFrame) -> DataFrame:
    """Mean confidence of the newest diagnoses, three decimals, halves to even; 0 when none."""
    return latest(diagnoses, "confidence").agg(F.coalesce(
        F.bround(F.avg("diagnosis.confidence"), 3), F.lit(0.0)).alias("avg_confidence"))


def recent(listed: DataFrame) -> DataFrame:
    return feed_page(listed, fv.RECENT_INCIDENTS)


def distribution(counts: DataFrame, label: str) -> DataFrame:
    """Share of the largest count (divisor at least 1), largest first; one row per category."""
    top = F.greatest(F.lit(1), F.max("incidents").over(Window.partitionBy()))
    return (
        counts.withColumns({
            "share": F.col("incidents") / top,
            "label": labels.category_label(F.col(label))})
        .orderBy(F.desc("incidents"), label)
    )


def pipeline_health(pipelines: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs and failures of every pipeline, counted before the join."""
    counted = runs.groupBy("pipeline_id").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"))
    return (
        pipelines.join(counted, "pipeline_id", "left")
        .fillna(0, ["run_count", "failed_count"])
        .withColumn("failure_rate", labels.failure_rate(F.col("failed_count"), F.col("run_count")))
        .withColumn("failure_band", labels.failure_band(F.col("failure_rate")))
    )
