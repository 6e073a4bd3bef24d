"""Work that must not be repeated as inputs grow."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from faultmill.operators import entities, failures, incidents, knowledge
from faultmill.samples import feeds
from faultmill.sources import airflow
from faultmill.streaming import jobs


def test_logs_are_made_once_for_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(knowledge, "LITERALS_AT_ONCE", 2)
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(number):
        made.add(1)
        return f"step oak{number} failed"

    logs = spark.range(20).select(
        F.col("id").cast("string").alias("log_id"), F.lit("w").alias("workspace_id"), F.lit("dbt").alias("platform"),
        F.lit("2026-01-02").cast("timestamp").alias("at"), text("id").alias("log"))
    kb = spark.createDataFrame(
        [(f"k{i}", "w", "dbt", f"oak{i} ", True, "", "", "", "", "learned", datetime(2026, 1, 1)) for i in range(10)],
        knowledge.KB_SCHEMA)
    found = sorted((r.log_id, r.kb_id, r.score) for r in knowledge.match_table(logs, kb).collect())
    assert found == [(str(i), f"k{i}", 3) for i in range(10)]
    assert made.value == 20


def test_a_log_is_made_once_where_the_root_is_chosen(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(number):
        made.add(1)
        return f"ERROR {number}" if number % 5 else ""

    runs = spark.createDataFrame(
        [(f"r{i}", f"e{i}", "w", "dbt", "p", "failed") for i in range(6)],
        "run_external_id string, event_id string, workspace_id string, platform string, pipeline_external_id string, status string")
    tasks = spark.range(30).withColumns({
        "run_external_id": F.concat(F.lit("r"), (F.col("id") % 5).cast("string")), "name": F.col("id").cast("string"),
        "node_type": F.lit("sql"), "status": F.when(F.col("id") < 20, "failed").otherwise("success")}).repartition(
        3, "run_external_id").withColumn("log", text("id"))
    found = failures.from_tasks(runs, tasks, "run_external_id", F.col("id"), keep_log=True)
    got = {r.event_id: (r.task_name, "ERROR" in r.log) for r in found.collect()}
    # r0 has tasks without a log only, r5 none at all
    assert got == {"e0": (None, False), "e1": ("1", True), "e2": ("2", True), "e3": ("3", True), "e4": ("4", True), "e5": (None, False)}
    assert made.value == 20


def test_tasks_dealt_by_run_are_grouped_without_another_shuffle(spark, sf_dir, capsys):
    rows = feeds.dealt(spark.range(100).withColumn("k", F.col("id") % 7), "k")
    assert rows.rdd.getNumPartitions() == feeds.DEALT
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert feeds.dealt(spark.range(100), "id").rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    failures.root_task(feeds.tasks(spark, sf_dir), "run_external_id", feeds.position(), "name").explain()
    assert capsys.readouterr().out.count("Exchange ") == 1


def test_rows_of_a_history_are_scanned_once(spark, capsys):
    events = feeds.lifecycle_from(spark.createDataFrame(
        [(i, i % 3, ("error", "purchase")[i % 2], datetime(2026, 1, 1 + i)) for i in range(20)],
        "event_id long, user_id long, event_type string, ts timestamp"))
    found = incidents.islands(events)
    assert found.count() == 20
    capsys.readouterr()
    found.explain()
    # only the scan along the summaries is left to do: the one over the rows is stored
    assert re.findall(r"lag\((\w+)#", capsys.readouterr().out) == ["__closed"]


def test_only_first_sightings_of_a_pipeline_are_compared(spark, capsys):
    rows = [("w", "dbt", "p", "", datetime(2026, 1, 1), "b"), ("w", "dbt", "p", "late", datetime(2026, 1, 2), "a"),
            ("w", "dbt", "p", "tied", datetime(2026, 1, 1), "c"), (None, "dbt", "p", "other", datetime(2026, 1, 3), "d"),
            ("w", "dbt", "q", "dated", datetime(2026, 1, 1), "e"), ("w", "dbt", "q", "undated", None, "f"),
            ("w", "dbt", None, None, None, "g")]
    found = entities.pipelines(spark.createDataFrame(
        rows, "workspace_id string, platform string, pipeline_external_id string, pipeline_name string, "
              "received_at timestamp, event_id string"))
    got = {(r.workspace_id, r.pipeline_external_id): (r.name, r.created_at, r.first_event_id) for r in found.collect()}
    assert got == {("w", "p"): ("p", datetime(2026, 1, 1), "b"), (None, "p"): ("other", datetime(2026, 1, 3), "d"),
                   ("w", "q"): ("undated", datetime(2026, 1, 1), "f"), ("w", None): (None, None, "g")}
    capsys.readouterr()
    found.explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out


def test_a_micro_batch_of_small_payloads_keeps_all_cores_busy(spark):
    raw = spark.createDataFrame(
        [(f"e{i}", datetime(2026, 1, 1), "w", f'{{"dag_id":"d{i}","state":"failed"}}') for i in range(200)],
        "event_id string, received_at timestamp, workspace_id string, payload string").coalesce(1)
    found = jobs.failures_stream(raw, airflow.normalize)
    assert found.rdd.getNumPartitions() == jobs.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert found.count() == 200
