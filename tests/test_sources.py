"""Payload normalisation, refusals, moments, stored tables."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from faultmill.functions import moments
from faultmill.operators import entities, failures
from faultmill.sources import airflow, dbt, feeds, generic

AIRFLOW = {
    "dag_id": "bake_bread", "dag_display_name": "", "dag_run_id": "dawn-17", "state": "failed",
    "run_type": "manual", "start_date": "2031-03-04T05:00:00Z", "conf": {},
    "task_instances": [
        {"task_id": "sift", "operator": "MillOperator", "state": "success", "try_number": 4},
        {"task_id": "warm_oven", "state": "skipped"},
        {"task_id": "knead", "operator": "DoughOperator", "state": "failed", "try_number": 3,
         "upstream_task_ids": ["sift", "warm_oven"],
         "log": "ERROR relation bins.rye not found\nvia redis://baker:tulip9@wharf/0"},
        {"task_id": "bake", "state": "upstream_failed", "upstream_task_ids": ["knead"]}],
}
DBT = {
    "project_name": "bakery", "run_id": "oven-5",
    "run_results": {
        "metadata": {"invocation_id": "inv-5", "generated_at": "2031-03-04T06:00:00Z"},
        "results": [
            {"unique_id": "test.bakery.weight", "status": "fail", "timing": [],
             "message": "Got 5 results, configured to fail if not 0"},
            {"unique_id": "model.bakery.flour", "status": "success", "timing": []},
            {"unique_id": "model.bakery.loaf", "status": "skipped", "timing": []}]},
}
GENERIC = {"platform": "spark", "pipeline_external_id": "p", "run_external_id": "r",
           "status": "failed"}


def feed(spark, payloads):
    rows = [(f"e{i:03d}", datetime(2026, 1, 1), "w", p if isinstance(p, str) else json.dumps(p))
            for i, p in enumerate(payloads)]
    return spark.createDataFrame(
        rows, "event_id string, received_at timestamp, workspace_id string, payload string")


def reasons(normalized):
    return [r.reject_reason for r in normalized.orderBy("event_id").collect()]


def test_airflow(spark):
    event = airflow.normalize(feed(spark, [AIRFLOW])).first()
    assert event.reject_reason is None
    assert (event.pipeline_name, event.run_external_id, event.status) == (
        "bake_bread", "dawn-17", "failed")
    assert [t.status for t in event.tasks] == ["success", "skipped", "failed", "upstream_failed"]
    assert event.tasks[2].try_number == 3 and event.tasks[2].upstream_task_ids == ["sift", "warm_oven"]
    assert event.config_snapshot == "{}"


def test_airflow_refusals(spark):
    def task(**changes):
        return {"dag_id": "d", "task_instances": [{"task_id": "t", **changes}]}

    cases = [
        ("[]", "malformed payload"), ("{", "malformed payload"), ("5", "malformed payload"),
        ({}, "missing dag_id"), ({"dag_id": 5}, "invalid dag_id"),
        ({"dag_id": None}, "invalid dag_id"), ({"dag_id": ""}, None),
        (task(try_number="x"), "invalid try_number"), (task(try_number=None), "invalid try_number"),
        (task(try_number=" 3 "), None), (task(try_number=2.7), None), (task(try_number=True), None),
        (task(log=None), "invalid log"), (task(log=5), "invalid log"),
        (task(log="x" * 2_000_000), None), (task(log="x" * 2_000_001), "log too long"),
        (task(upstream_task_ids=None), "invalid upstream_task_ids"),
        (task(upstream_task_ids="a"), "invalid upstream_task_ids"),
        (task(operator=None), "invalid operator"), (task(start_date=5), "invalid date"),
        (task(start_date=0), None), ({"dag_id": "d", "conf": [1]}, "invalid conf"),
        ({"dag_id": "d", "conf": []}, None), ({"dag_id": "d", "run_type": None}, "invalid run_type"),
        ({"dag_id": "d", "run_id": None}, "invalid run id"),
        ({"dag_id": "d", "dag_run_id": "x", "run_id": None}, None),
        ({"dag_id": "d", "dag_run_id": 7}, "invalid run id"),
        ({"dag_id": "d", "task_instances": [5]}, "invalid task_instances"),
        ('{"dag_id":"a","dag_id":"b"}', None),
    ]
    got = reasons(airflow.normalize(feed(spark, [c[0] for c in cases])))
    assert got == [c[1] for c in cases]


def test_dbt(spark):
    events = dbt.normalize(feed(spark, [DBT, DBT["run_results"], {}])).orderBy("event_id").collect()
    assert [e.reject_reason for e in events] == [None] * 3
    assert [e.pipeline_external_id for e in events] == ["bakery", "dbt-project", "dbt-project"]
    assert [e.run_external_id for e in events] == ["oven-5", "inv-5", "unknown"]
    assert [e.status for e in events] == ["failed", "failed", "success"]
    assert events[0].tasks[0].log == "Got 5 results, configured to fail if not 0"
    assert events[0].tasks[1].log == ""


def test_generic(spark):
    cases = [
        (GENERIC, None), ({**GENERIC, "platform": "x"}, "invalid platform"),
        ({**GENERIC, "trigger": None}, "invalid trigger"),
        ({**GENERIC, "started_at": None}, None), ({**GENERIC, "started_at": "1700000000"}, None),
        ({**GENERIC, "started_at": "later"}, "invalid date"),
        ({**GENERIC, "tasks": None}, "invalid tasks"),
        ({**GENERIC, "tasks": [{"task_id": "t"}]}, "invalid task status"),
        ({**GENERIC, "tasks": [{"task_id": "t", "status": "failed", "try_number": "2"}]}, None),
        ({**GENERIC, "tasks": [{"task_id": "t", "status": "failed", "started_at": "x"}]},
         "invalid date"),
        ({**GENERIC, "config_snapshot": []}, "invalid config_snapshot"),
    ]
    assert reasons(generic.normalize(feed(spark, [c[0] for c in cases]))) == [c[1] for c in cases]


def test_failure_records_from_events(spark):
    quiet = {**AIRFLOW, "state": "success"}
    lost = {"dag_id": "d", "dag_run_id": "r", "state": "failed"}
    shadow = {"dag_id": "d", "state": "failed", "task_instances": [
        {"task_id": "a", "state": "failed"},
        {"task_id": "b", "state": "upstream_failed", "log": "upstream task a failed"}]}
    events = feeds.accepted(airflow.normalize(feed(spark, [AIRFLOW, quiet, lost, shadow])))
    got = failures.from_events(events).orderBy("event_id").collect()
    assert [r.event_id for r in got] == ["e000", "e002", "e003"]
    assert [r.rule_id for r in got] == [6, None, 18]
    assert [r.task_name for r in got] == ["knead", None, "b"]
    assert "tulip9" not in got[0].log
    assert got[1].log == "Run r of pipeline d failed with no task logs provided."


def test_union_drops_refused_and_keeps_redelivered(spark):
    both = feeds.union_events(
        airflow.normalize(feed(spark, [AIRFLOW, AIRFLOW, {}])), dbt.normalize(feed(spark, [DBT])))
    assert both.count() == 3
    assert feeds.drop_redelivered(both).count() == 2


def test_tables_written_by_day_come_back(spark, tmp_path):
    events = feeds.accepted(airflow.normalize(feed(spark, [AIRFLOW])))
    logs = entities.log_bundles(entities.task_runs(events))
    feeds.write_by_period(logs, str(tmp_path / "logs"), "received_at")
    back = spark.read.parquet(str(tmp_path / "logs")).collect()
    assert len(back) == 1 and "tulip9" not in back[0].content
    assert back[0].redaction_count == 1 and str(back[0].dt) == "2026-01-01"


def test_reading_json_lines(spark, tmp_path):
    line = {"event_id": "a", "received_at": "2026-01-01T00:00:00Z", "workspace_id": "w",
            "payload": json.dumps(AIRFLOW)}
    (tmp_path / "in.json").write_text(json.dumps(line) + "\n")
    events = airflow.normalize(feeds.read_feed(spark, str(tmp_path)))
    assert events.first().pipeline_external_id == "bake_bread"


def test_new_pipelines_only(spark):
    events = feeds.accepted(airflow.normalize(feed(
        spark, [AIRFLOW, {**AIRFLOW, "dag_id": "other", "dag_display_name": "Other"}])))
    first = entities.pipelines(events)
    known = first.filter("pipeline_external_id = 'other'")
    new = entities.unseen(first, known, entities.PIPELINE_KEYS).collect()
    assert [r.name for r in new] == ["bake_bread"]


@pytest.mark.parametrize("text", [
    "2026-07-16", "20260716", "2026-07-16T02:00:00Z", "2026-07-16 02:00", "2026-07-16T020000",
    "20260716T020000,1234567", "2026-07-16T02:00:00.5+05:30", "2026-W29-4", "2026W294", "2026-W29",
    "2026", "2026-13-01", "2026-02-30", "2026-07-16T25:00", "2026-07-16T02:00:00-0230",
    "2026-07-16T02:00:00+24:00", "2026-07-16T", "", "x", "2026-07-16T02:0000", "2026-W54-1",
    "2020-W53-5", "2026-07-16T02Z", "2026-07-16t02:00:00+05:30:15", "0000-01-01"])
def test_iso_moments_as_python_reads_them(spark, text):
    try:
        want = datetime.fromisoformat(text) if text else None
    except ValueError:
        want = None
    if want is not None and want.tzinfo:
        want = want.astimezone(timezone.utc).replace(tzinfo=None)
    got = spark.range(1).select(
        moments.parse_iso(F.lit(text)).cast("timestamp_ntz").alias("t")).first().t
    assert got == want


def test_adhoc_logs(spark):
    rows = [("a", None, "log", None), ("b", "spark", " \n\t", ""), ("c", "x", "log", ""),
            ("d", "dbt", "log", "c" * 10_001), ("e", "dbt", "", "")]
    got = feeds.adhoc_logs(spark.createDataFrame(
        rows, "log_id string, platform string, log string, context string")).orderBy("log_id")
    assert [r.reject_reason for r in got.collect()] == [
        None, "blank log", "invalid platform", "context too long", "empty log"]
