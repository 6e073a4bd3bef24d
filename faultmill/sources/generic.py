"""Canonical run events posted as they are."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import parse_all
from ..functions.once import let, once
from ..rules import fixed_values as fv
from .airflow import no_texts, not_text_list, text_or
from .payload import NUMBERS, Checks, Doc, Field, as_events, document, pair_items, paired, parsed

_TASK_FIELDS = ("task_id", "name", "node_type", "status", "try_number", "started_at", "ended_at",
                "upstream_task_ids", "log")
_RUN_FIELDS = ("platform", "pipeline_external_id", "pipeline_name", "run_external_id", "status",
               "trigger", "started_at", "ended_at", "config_snapshot", "tasks")
_TEXTS = (
    "struct<platform string, pipeline_external_id string, pipeline_name string, "
    "run_external_id string, status string, trigger string, started_at string, ended_at string, "
    "config_snapshot string, tasks array<struct<task_id string, name string, node_type string, "
    "status string, try_number string, started_at string, ended_at string, "
    "upstream_task_ids array<string>, log string>>>"
)
# numbers up to this size are seconds since the epoch, larger ones milliseconds
_SECONDS_LIMIT = 20_000_000_000


def _moments(*values: Field) -> Column:
    """Instants given as ISO text or as numbers, which may be written as text."""
    def number(value: Field) -> Column:
        return F.when(
            value.of(*NUMBERS, "STRING") & F.rlike(value.text, F.lit(r"^-?\d+(\.\d+)?$")),
            value.text.try_cast("double"))

    def instant(iso: Column, number: Column) -> Column:
        seconds = F.when(F.abs(number) > _SECONDS_LIMIT, number / 1000).otherwise(number)
        return F.coalesce(
            iso, F.timestamp_micros(F.round(seconds * 1_000_000).try_cast("long")))

    return F.zip_with(
        parse_all(*[v.string() for v in values]), F.array(*[number(v) for v in values]), instant)


def _bad_moment(value: Field, moment: Column) -> Column:
    return ~value.missing() & ~value.null() & moment.isNull()


def _whole_number(value: Field) -> Column:
    """A number without fraction, or the text of one."""
    number = value.text.try_cast("double")
    return F.when(value.of("STRING", "BOOLEAN") | (number == F.floor(number)), value.integer())


def _task(task: Doc) -> Column:
    def made(moments: Column) -> Column:
        return F.struct(
            task["task_id"].string().alias("task_id"),
            text_or(task["name"], "").alias("name"),
            text_or(task["node_type"], "").alias("node_type"),
            task["status"].string().alias("status"),
            F.when(task["try_number"].missing(), 1).otherwise(_whole_number(task["try_number"]))
            .alias("try_number"),
            moments[0].alias("started_at"), moments[1].alias("ended_at"),
            F.coalesce(task["upstream_task_ids"].text, no_texts()).alias("upstream_task_ids"),
            text_or(task["log"], "").alias("log"),
        )

    return let(_moments(task["started_at"], task["ended_at"]), made)


def _not_in(value: Field, names: tuple[str, ...]) -> Column:
    return ~F.coalesce(value.string().isin(*names), F.lit(False))


def normalize(feed: DataFrame) -> DataFrame:
    """Validate canonical events; adds ``reject_reason`` (null for accepted ones)."""
    run = document()
    tasks = run["tasks"]
    events = once(parsed(feed, _TEXTS, _RUN_FIELDS), {
        "__raw": pair_items(tasks.text, tasks.value, _TASK_FIELDS)})
    events = once(events, {
        "__tasks": F.coalesce(F.transform("__raw", lambda t: _task(paired(t))), F.array()),
        "__moments": _moments(run["started_at"], run["ended_at"])})
    started, ended = F.col("__moments")[0], F.col("__moments")[1]

    def any_task(test) -> Column:
        return F.exists("__raw", lambda t: test(paired(t)))

    checks = Checks()
    checks.refuse_when(F.col("__values").isNull(), "malformed payload")
    checks.refuse_when(_not_in(run["platform"], fv.PLATFORMS), "invalid platform")
    checks.refuse_when(~run["pipeline_external_id"].of("STRING"), "invalid pipeline_external_id")
    checks.refuse_when(run["pipeline_name"].not_string(), "invalid pipeline_name")
    checks.refuse_when(~run["run_external_id"].of("STRING"), "invalid run_external_id")
    checks.refuse_when(_not_in(run["status"], fv.RUN_STATUSES), "invalid status")
    checks.refuse_when(run["trigger"].not_string(), "invalid trigger")
    checks.refuse_when(
        _bad_moment(run["started_at"], started) | _bad_moment(run["ended_at"], ended),
        "invalid date")
    checks.refuse_when(run["config_snapshot"].present_but_not("OBJECT"),
                       "invalid config_snapshot")
    checks.refuse_when(~tasks.missing() & F.col("__raw").isNull(), "invalid tasks")
    checks.refuse_when(any_task(lambda t: ~t["task_id"].of("STRING")), "invalid task_id")
    checks.refuse_when(
        any_task(lambda t: t["name"].not_string() | t["node_type"].not_string()),
        "invalid task text")
    checks.refuse_when(any_task(lambda t: _not_in(t["status"], fv.RUN_STATUSES)),
                       "invalid task status")
    checks.refuse_when(
        any_task(lambda t: ~t["try_number"].missing() & _whole_number(t["try_number"]).isNull()),
        "invalid try_number")
    checks.refuse_when(
        F.exists(F.zip_with("__raw", "__tasks", lambda raw, task: (
            _bad_moment(paired(raw)["started_at"], task["started_at"])
            | _bad_moment(paired(raw)["ended_at"], task["ended_at"]))), lambda bad: bad),
        "invalid date")
    checks.refuse_when(any_task(lambda t: not_text_list(t["upstream_task_ids"])),
                       "invalid upstream_task_ids")
    checks.refuse_when(any_task(lambda t: t["log"].not_string()), "invalid log")
    checks.refuse_when(
        F.exists("__tasks", lambda t: F.length(t["log"]) > fv.MAX_LOG_CHARS), "log too long")

    made = F.struct(
        run["platform"].string().alias("platform"),
        run["pipeline_external_id"].string().alias("pipeline_external_id"),
        text_or(run["pipeline_name"], "").alias("pipeline_name"),
        run["run_external_id"].string().alias("run_external_id"),
        run["status"].string().alias("status"),
        text_or(run["trigger"], "scheduled").alias("trigger"),
        started.alias("started_at"),
        ended.alias("ended_at"),
        F.coalesce(F.to_json(run["config_snapshot"].value), F.lit("{}")).alias("config_snapshot"),
        F.col("__tasks").alias("tasks"),
        checks.reason().alias("reject_reason"),
    )
    return as_events(events, made)
