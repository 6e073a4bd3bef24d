"""dbt run results to canonical events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import parse_all, parse_iso
from ..functions.once import let, once
from ..rules import fixed_values as fv
from .airflow import bad_moment, lookup, no_texts, text_or
from .payload import (
    Checks, Doc, Field, as_events, document, kinds, pair_items, paired, parsed, variants,
)

_WRAP_FIELDS = ("project_name", "job_id", "run_id", "run_results", "metadata", "results")
_META_FIELDS = ("invocation_id", "project_name", "dbt_version", "generated_at")
_RESULT_FIELDS = ("unique_id", "status", "message", "compiled_code", "compiled_sql", "timing")
_TIMING_FIELDS = ("name", "started_at", "completed_at")
_BODY = (
    "metadata struct<invocation_id string, project_name string, dbt_version string, "
    "generated_at string>, "
    "results array<struct<unique_id string, status string, message string, "
    "compiled_code string, compiled_sql string, "
    "timing array<struct<name string, started_at string, completed_at string>>>>"
)
_TEXTS = (
    f"struct<project_name string, job_id string, run_id string, run_results struct<{_BODY}>, "
    f"{_BODY}>"
)


def map_status(status: Column) -> Column:
    """Run status of a dbt result; warnings pass, unknown values count as failed."""
    return lookup(fv.DBT_STATUSES, F.lower(status), "failed")


def node_type(unique_id: Column) -> Column:
    return F.when(F.contains(unique_id, F.lit(".")), F.split_part(
        unique_id, F.lit("."), F.lit(1))).otherwise("model")


def node_name(unique_id: Column) -> Column:
    return F.substring_index(unique_id, ".", -1)


def execute_timing(timing: Column) -> Column:
    """The last entry named ``execute`` of an array of paired timing entries."""
    named = F.filter(timing, lambda t: F.coalesce(
        paired(t)["name"].string() == "execute", F.lit(False)))
    return F.try_element_at(named, F.lit(-1))


def _timing(result: Doc) -> Column:
    return pair_items(result["timing"].text, result["timing"].value, _TIMING_FIELDS)


def failure_log(message: Column, compiled_code: Column, compiled_sql: Column) -> Column:
    """Message, then the first part of the compiled statement if there is one."""
    compiled = F.coalesce(F.nullif(compiled_code, F.lit("")), compiled_sql, F.lit(""))
    return F.concat(
        F.coalesce(message, F.lit("")),
        F.when(compiled != "", F.concat(
            F.lit(fv.COMPILED_SQL_SEPARATOR), F.substring(compiled, 1, fv.COMPILED_SQL_CHARS)))
        .otherwise(""))


def _given(value: Field, text: Column) -> Column:
    return F.when(value.truthy(), text)


def _task(result: Doc) -> Column:
    unique_id = text_or(result["unique_id"], "unknown")
    status = map_status(result["status"].shown())
    execute = paired(execute_timing(_timing(result)))
    message, code, sql = result["message"], result["compiled_code"], result["compiled_sql"]
    log = failure_log(
        _given(message, message.shown()), _given(code, code.string()), _given(sql, sql.string()))

    def made(moments: Column) -> Column:
        return F.struct(
            unique_id.alias("task_id"), node_name(unique_id).alias("name"),
            node_type(unique_id).alias("node_type"), status.alias("status"),
            F.lit(1).alias("try_number"),
            moments[0].alias("started_at"), moments[1].alias("ended_at"),
            no_texts().alias("upstream_task_ids"),
            F.when(status == "failed", log).otherwise("").alias("log"),
        )

    return let(parse_all(execute["started_at"].string(), execute["completed_at"].string()), made)


def run_status(tasks: Column) -> Column:
    """Failed iff any result failed."""
    return F.when(F.exists(tasks, lambda t: t["status"] == "failed"), "failed").otherwise("success")


def _bad_timing(result: Doc) -> Column:
    entries = _timing(result)
    execute = paired(execute_timing(entries))
    return (~result["timing"].missing() & entries.isNull()) | bad_moment(
        execute["started_at"]) | bad_moment(execute["completed_at"])


def _bad_statement(result: Doc) -> Column:
    code, sql = result["compiled_code"], result["compiled_sql"]
    return (map_status(result["status"].shown()) == "failed") & F.when(
        code.truthy(), ~code.of("STRING")).otherwise(sql.truthy() & ~sql.of("STRING"))


def normalize(feed: DataFrame) -> DataFrame:
    """Canonical events plus ``reject_reason`` from a feed of wrapped or bare run results."""
    wrap = document()
    wrapped = ~wrap["run_results"].missing()
    inner_fields = ("metadata", "results")
    events = once(parsed(feed, _TEXTS, _WRAP_FIELDS), {
        "__body": F.when(wrapped, F.try_variant_get(
            wrap["run_results"].value, "$", variants(inner_fields))).otherwise(
            F.struct(*[wrap[f].value.alias(f) for f in inner_fields])),
        "__body_texts": F.when(wrapped, wrap["run_results"].text).otherwise(
            F.struct(*[wrap[f].text.alias(f) for f in inner_fields]))})
    body, texts = F.col("__body"), F.col("__body_texts")
    events = once(events, {
        "__meta": F.try_variant_get(body["metadata"], "$", variants(_META_FIELDS)),
        "__results": pair_items(texts["results"], body["results"], _RESULT_FIELDS)})
    events = once(events, {"__meta_kinds": kinds(F.col("__meta"), _META_FIELDS)})
    meta = Doc(texts["metadata"], F.col("__meta_kinds"), F.col("__meta"))
    events = once(events, {
        "__tasks": F.coalesce(F.transform("__results", lambda r: _task(paired(r))), F.array()),
        "__moment": parse_iso(meta["generated_at"].string())})

    outer, inner = wrap["project_name"], meta["project_name"]
    project = F.when(outer.truthy(), outer.string()).when(
        inner.truthy(), inner.string()).otherwise(fv.DBT_DEFAULT_PROJECT)

    def any_result(test) -> Column:
        return F.exists("__results", lambda r: test(paired(r)))

    checks = Checks()
    checks.refuse_when(F.col("__values").isNull(), "malformed payload")
    checks.refuse_when(body.isNull(), "invalid run_results")
    checks.refuse_when(body["metadata"].isNotNull() & F.col("__meta").isNull(),
                       "invalid metadata")
    checks.refuse_when(body["results"].isNotNull() & F.col("__results").isNull(),
                       "invalid results")
    checks.refuse_when(project.isNull(), "invalid project_name")
    checks.refuse_when(bad_moment(meta["generated_at"]), "invalid date")
    checks.refuse_when(any_result(lambda r: r["unique_id"].not_string()), "invalid unique_id")
    checks.refuse_when(any_result(_bad_timing), "invalid timing")
    checks.refuse_when(any_result(_bad_statement), "invalid compiled statement")
    checks.refuse_when(
        F.exists("__tasks", lambda t: F.length(t["log"]) > fv.MAX_LOG_CHARS), "log too long")

    version = F.coalesce(F.to_json(meta["dbt_version"].value), F.lit('""'))
    job, run_id, invocation = wrap["job_id"], wrap["run_id"], meta["invocation_id"]
    made = F.struct(
        F.lit("dbt").alias("platform"),
        F.coalesce(_given(job, job.shown()), project).alias("pipeline_external_id"),
        project.alias("pipeline_name"),
        F.coalesce(_given(run_id, run_id.shown()), _given(invocation, invocation.shown()),
                   F.lit("unknown")).alias("run_external_id"),
        run_status(F.col("__tasks")).alias("status"),
        F.lit("scheduled").alias("trigger"),
        F.col("__moment").alias("started_at"),
        F.col("__moment").alias("ended_at"),
        F.concat(F.lit('{"dbt_version":'), version, F.lit("}")).alias("config_snapshot"),
        F.col("__tasks").alias("tasks"),
        checks.reason().alias("reject_reason"),
    )
    return as_events(events, made)
