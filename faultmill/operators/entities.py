"""Entity tables derived from canonical events: pipelines, connections, runs, tasks, logs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_id, with_redaction
from ..session import materialize
from ..sources.merge import bucket, merge

PIPELINE_KEYS = ["workspace_id", "platform", "pipeline_external_id"]
CONNECTION_KEYS = ["workspace_id", "platform"]


def pipelines(events: DataFrame) -> DataFrame:
    """One row per natural key; the first sighting gives the name (else the external id).

    Strings cannot be aggregated without sorting all rows: the first moment of a key is found by a hash
    aggregate and stored, and only the events of that moment are compared.  One without a moment comes first.
    """
    order = F.struct("received_at", "event_id")
    name = F.coalesce(F.nullif(F.col("pipeline_name"), F.lit("")), F.col("pipeline_external_id"))
    undated = F.col("received_at").isNull()
    first = materialize(events.groupBy(*[F.col(k).alias(f"__{k}") for k in PIPELINE_KEYS]).agg(
        F.min("received_at").alias("__created"), F.max(undated).alias("__undated")), "first-moments")
    at_first = F.when(F.col("__undated"), undated).otherwise(F.col("received_at") == F.col("__created"))
    for key in PIPELINE_KEYS:
        at_first = at_first & F.col(key).eqNullSafe(F.col(f"__{key}"))
    return (
        events.select(*PIPELINE_KEYS, "pipeline_name", "received_at", "event_id").join(first, at_first)
        .groupBy(*PIPELINE_KEYS, F.col("__created").alias("created_at"))
        .agg(F.min_by(name, order).alias("name"), F.min(order)["event_id"].alias("first_event_id"))
        .select(*PIPELINE_KEYS, "name", "created_at", "first_event_id")
        .withColumns({
            "pipeline_id": short_id(*[F.col(k) for k in PIPELINE_KEYS]),
            "connection_id": short_id(*[F.col(k) for k in CONNECTION_KEYS])})
    )


def connections(events: DataFrame) -> DataFrame:
    return (
        events.groupBy(*CONNECTION_KEYS).agg(F.min("received_at").alias("created_at"))
        .withColumns({
            "connection_id": short_id(*[F.col(k) for k in CONNECTION_KEYS]),
            "name": F.concat(F.col("platform"), F.lit(" (auto-created)"))})
    )


def unseen(found: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of an increment whose keys a stored dimension lacks."""
    return found.join(existing.select(*keys), keys, "left_anti")


def grow_pipelines(events: DataFrame, path: str) -> None:
    """Add the pipelines of an increment of events to the stored dimension.

    The first sighting of a key names it, also when a later increment brings it; increments without
    news write nothing.
    """
    found = pipelines(events).withColumn("bucket", bucket("pipeline_id"))
    merge(found, path, ["pipeline_id"], ["created_at", "first_event_id"], "bucket", first=True)


def with_pipeline(events: DataFrame, dimension: DataFrame) -> DataFrame:
    """Attach pipeline id and name to runs by natural key."""
    return events.drop("pipeline_name").join(
        dimension.select(*PIPELINE_KEYS, "pipeline_id", F.col("name").alias("pipeline_name")),
        PIPELINE_KEYS)


def runs(events: DataFrame) -> DataFrame:
    """Every event is a run of its own, also when an external run id repeats."""
    return events.select(
        short_id(F.col("workspace_id"), F.col("event_id")).alias("run_id"),
        short_id(*[F.col(k) for k in PIPELINE_KEYS]).alias("pipeline_id"),
        "workspace_id", "event_id", "received_at", "run_external_id", "status", "trigger",
        "started_at", "ended_at", "config_snapshot")


def task_runs(events: DataFrame) -> DataFrame:
    """One row per task with its list position; ``log`` is raw and must not be stored."""
    exploded = events.select(
        short_id(F.col("workspace_id"), F.col("event_id")).alias("run_id"), "workspace_id",
        "received_at", F.posexplode("tasks").alias("pos", "task"))
    task = F.col("task")
    return exploded.select(
        short_id(F.col("run_id"), F.col("pos").cast("string")).alias("task_run_id"), "run_id",
        "workspace_id", "received_at", "pos", task["task_id"].alias("task_external_id"),
        F.coalesce(F.nullif(task["name"], F.lit("")), task["task_id"]).alias("name"),
        task["node_type"].alias("node_type"), task["status"].alias("status"),
        task["try_number"].alias("try_number"), task["started_at"].alias("started_at"),
        task["ended_at"].alias("ended_at"), task["upstream_task_ids"].alias("upstream_task_ids"),
        task["log"].alias("log"))


def log_bundles(tasks: DataFrame) -> DataFrame:
    """Redacted logs of all tasks that have one, with the number of redactions."""
    logged = tasks.filter(F.coalesce(F.col("log"), F.lit("")) != "")
    redacted = with_redaction(logged, "log", "content", "redaction_count")
    return redacted.select(
        F.col("task_run_id").alias("log_bundle_id"), "task_run_id", "run_id", "received_at",
        "name", "content", "redaction_count")
