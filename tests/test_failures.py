"""Failure records: one log per failed run is searched, whatever the number of its failed tasks."""

from pyspark.sql import functions as F

from faultmill.operators import failures

RUN = "run_external_id string, event_id string, workspace_id string, platform string, pipeline_external_id string, status string"
TASK = "run_external_id string, name string, node_type string, status string, log string, place int"


def test_only_the_chosen_log_is_redacted(spark, monkeypatch):
    seen = []
    redact = failures.tx.with_redaction

    def watched(df, source, *more):
        seen.append(df.select(source))
        return redact(df, source, *more)

    monkeypatch.setattr(failures.tx, "with_redaction", watched)
    runs = spark.createDataFrame([
        ("r1", "e1", "w", "dbt", "p", "failed"), ("r2", "e2", "w", "dbt", "p", "success"),
        ("r3", "e3", "w", "dbt", "p", "failed")], RUN)
    tasks = spark.createDataFrame(
        [("r1", f"t{i}", "sql", "failed" if i else "upstream_failed", f"ERROR {i} password = hunter{i}", i) for i in range(9)]
        + [("r2", "t", "sql", "failed", "ERROR of a run that ended well", 0), ("r3", "t", "sql", "failed", "", 0)], TASK)
    found = failures.from_tasks(runs, tasks, "run_external_id", F.col("place"), keep_log=True)
    made = {r.event_id: r for r in found.collect()}
    assert sorted(made) == ["e1", "e3"]
    assert made["e1"].task_name == "t1" and "ERROR 1" in made["e1"].log and "hunter" not in made["e1"].log
    assert made["e3"].task_name is None and made["e3"].node_type == "" and "r3" in made["e3"].log
    assert sum(df.filter(F.col(df.columns[0]).isNotNull()).count() for df in seen) == 1
    assert "log" not in failures.from_tasks(runs, tasks, "run_external_id", F.col("place")).columns
