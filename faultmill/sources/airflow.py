"""Airflow payloads to canonical events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import parse_all
from ..functions.once import let, once
from ..rules import fixed_values as fv
from .payload import Checks, Doc, Field, as_events, document, kind, pair_items, paired, parsed

_TASK_FIELDS = ("task_id", "operator", "state", "try_number", "start_date", "end_date",
                "upstream_task_ids", "log")
_RUN_FIELDS = ("dag_id", "dag_display_name", "dag_run_id", "run_id", "state", "run_type",
               "start_date", "end_date", "conf", "task_instances")
_TEXTS = (
    "struct<dag_id string, dag_display_name string, dag_run_id string, run_id string, "
    "state string, run_type string, start_date string, end_date string, conf string, "
    "task_instances array<struct<task_id string, operator string, state string, "
    "try_number string, start_date string, end_date string, upstream_task_ids array<string>, "
    "log string>>>"
)


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    """A literal table as a case expression; unknown and missing keys give the default."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def map_state(state: Column) -> Column:
    """Run status of an Airflow state; anything unknown or missing counts as failed."""
    return lookup(fv.AIRFLOW_STATES, F.lower(state), "failed")


def bad_moment(value: Field) -> Column:
    """Only text can be parsed; other non-empty values are malformed."""
    return value.truthy() & ~value.of("STRING")


def text_or(value: Field, default: str) -> Column:
    return F.coalesce(value.string(), F.lit(default))


def no_texts() -> Column:
    return F.array().cast("array<string>")


def not_text_list(value: Field) -> Column:
    """Present, but not a list of strings."""
    items = F.try_variant_get(value.value, "$", "array<variant>")
    return ~value.missing() & F.coalesce(
        F.exists(items, lambda item: kind(item) != "STRING"), F.lit(True))


def _task(ti: Doc) -> Column:
    task_id = text_or(ti["task_id"], "unknown")

    def made(moments: Column) -> Column:
        return F.struct(
            task_id.alias("task_id"), task_id.alias("name"),
            text_or(ti["operator"], "").alias("node_type"),
            map_state(ti["state"].shown()).alias("status"),
            F.when(ti["try_number"].missing(), 1).otherwise(ti["try_number"].integer())
            .alias("try_number"),
            moments[0].alias("started_at"), moments[1].alias("ended_at"),
            F.coalesce(ti["upstream_task_ids"].text, no_texts()).alias("upstream_task_ids"),
            text_or(ti["log"], "").alias("log"),
        )

    return let(parse_all(ti["start_date"].string(), ti["end_date"].string()), made)


def normalize(feed: DataFrame) -> DataFrame:
    """Canonical events plus ``reject_reason`` (null for accepted ones) from a raw feed."""
    run = document()
    tasks = run["task_instances"]
    events = once(parsed(feed, _TEXTS, _RUN_FIELDS), {
        "__tis": pair_items(tasks.text, tasks.value, _TASK_FIELDS)})
    events = once(events, {
        "__tasks": F.coalesce(F.transform("__tis", lambda t: _task(paired(t))), F.array()),
        "__moments": parse_all(run["start_date"].string(), run["end_date"].string())})

    def any_task(test) -> Column:
        return F.exists("__tis", lambda t: test(paired(t)))

    checks = Checks()
    checks.refuse_when(F.col("__values").isNull(), "malformed payload")
    checks.refuse_when(run["dag_id"].missing(), "missing dag_id")
    checks.refuse_when(run["dag_id"].not_string(), "invalid dag_id")
    checks.refuse_when(
        run["dag_display_name"].truthy() & run["dag_display_name"].not_string(),
        "invalid dag_display_name")
    checks.refuse_when(
        F.when(run["dag_run_id"].truthy(), run["dag_run_id"].not_string())
        .otherwise(run["run_id"].not_string()), "invalid run id")
    checks.refuse_when(run["run_type"].not_string(), "invalid run_type")
    checks.refuse_when(bad_moment(run["start_date"]) | bad_moment(run["end_date"]),
                       "invalid date")
    checks.refuse_when(run["conf"].truthy() & ~run["conf"].of("OBJECT"), "invalid conf")
    checks.refuse_when(~tasks.missing() & F.col("__tis").isNull(), "invalid task_instances")
    checks.refuse_when(any_task(lambda t: t["task_id"].not_string()), "invalid task_id")
    checks.refuse_when(any_task(lambda t: t["operator"].not_string()), "invalid operator")
    checks.refuse_when(
        any_task(lambda t: ~t["try_number"].missing() & t["try_number"].integer().isNull()),
        "invalid try_number")
    checks.refuse_when(
        any_task(lambda t: bad_moment(t["start_date"]) | bad_moment(t["end_date"])),
        "invalid date")
    checks.refuse_when(any_task(lambda t: not_text_list(t["upstream_task_ids"])),
                       "invalid upstream_task_ids")
    checks.refuse_when(any_task(lambda t: t["log"].not_string()), "invalid log")
    checks.refuse_when(
        F.exists("__tasks", lambda t: F.length(t["log"]) > fv.MAX_LOG_CHARS), "log too long")

    dag = run["dag_id"].string()
    made = F.struct(
        F.lit("airflow").alias("platform"),
        dag.alias("pipeline_external_id"),
        F.when(run["dag_display_name"].truthy(), run["dag_display_name"].string()).otherwise(dag)
        .alias("pipeline_name"),
        F.when(run["dag_run_id"].truthy(), run["dag_run_id"].string())
        .otherwise(text_or(run["run_id"], "unknown")).alias("run_external_id"),
        map_state(run["state"].shown()).alias("status"),
        text_or(run["run_type"], "scheduled").alias("trigger"),
        F.col("__moments")[0].alias("started_at"),
        F.col("__moments")[1].alias("ended_at"),
        F.when(run["conf"].truthy(), F.to_json(run["conf"].value)).otherwise("{}")
        .alias("config_snapshot"),
        F.col("__tasks").alias("tasks"),
        checks.reason().alias("reject_reason"),
    )
    return as_events(events, made)
