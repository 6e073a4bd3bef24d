"""Increments of stored tables."""

import random
from datetime import datetime, timedelta
from pathlib import Path

from faultmill.operators import entities
from faultmill.sources.merge import merge

T0 = datetime(2026, 1, 1)
ROW = "k string, v int, at int, dt string"


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_increments_give_the_table_of_one_run(spark, tmp_path):
    rng = random.Random(2)
    path = str(tmp_path / "table")
    rows = [(k := f"k{rng.randrange(30)}", i, rng.randrange(10**6), f"p{int(k[1:]) % 5}") for i in range(200)]
    for lo in (100, 0, 150, 50):
        merge(spark.createDataFrame([*{r[0]: r for r in sorted(rows[lo:lo + 50], key=lambda r: r[2])}.values()], ROW),
              path, ["k"], ["at"], "dt")
    want = {r[0]: (r[1], r[3]) for r in sorted(rows, key=lambda r: r[2])}
    assert {r.k: (r.v, r.dt) for r in spark.read.parquet(path).collect()} == want
    assert spark.read.parquet(path).count() == len(want)


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "table")
    merge(spark.createDataFrame([("a", 1, 1, "p0"), ("b", 1, 5, "p1"), ("c", 1, 1, "p2")], ROW), path, ["k"], ["at"], "dt")
    before = files(path)
    # an older row, a repeated one and a newer one
    merge(spark.createDataFrame([("b", 2, 3, "p1"), ("c", 1, 1, "p2"), ("a", 3, 2, "p0"), ("d", 1, 1, "p3")], ROW),
          path, ["k"], ["at"], "dt")
    after = files(path)
    assert {f for f in before if "dt=p0" not in f} < set(after)
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 1), ("c", 1), ("d", 1)]
    merge(spark.createDataFrame([("a", 3, 2, "p0")], ROW), path, ["k"], ["at"], "dt")
    merge(spark.createDataFrame([], ROW), path, ["k"], ["at"], "dt")
    assert files(path) == after


def test_first_sighting_names_a_pipeline_in_any_order(spark, tmp_path):
    path = str(tmp_path / "dim")
    schema = "event_id string, received_at timestamp, workspace_id string, platform string, pipeline_external_id string, pipeline_name string"
    rows = [(f"e{i}", T0 + timedelta(hours=h), "w", "dbt", p, n) for i, (h, p, n) in enumerate(
        [(5, "x", "late"), (3, "x", "early"), (4, "y", ""), (9, "y", "named"), (3, "x", "same time, later id")])]
    for part in ([0, 3], [1, 4], [2], [0]):
        entities.grow_pipelines(spark.createDataFrame([rows[i] for i in part], schema), path)
    got = {r.pipeline_external_id: (r.name, r.created_at) for r in spark.read.parquet(path).collect()}
    assert got == {"x": ("early", T0 + timedelta(hours=3)), "y": ("y", T0 + timedelta(hours=4))}
    whole = entities.pipelines(spark.createDataFrame(rows, schema))
    assert {r.pipeline_id: r.name for r in whole.collect()} == {
        r.pipeline_id: r.name for r in spark.read.parquet(path).collect()}


def test_discard_leaves_other_tables(spark, tmp_path):
    from faultmill.session import discard, materialize

    path = str(tmp_path / "mine")
    spark.range(5).write.parquet(path)
    discard(spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 5
    made = materialize(spark.range(5), "own")
    assert made.count() == 5 and files(made.inputFiles()[0].split(":", 1)[1].rsplit("/", 1)[0])
    folder = made.inputFiles()[0].split(":", 1)[1].rsplit("/", 1)[0]
    discard(made)
    assert not files(folder)
