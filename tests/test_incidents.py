"""Incident life cycle against a plain simulation, in batch and as a stream."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultmill.operators import incidents
from faultmill.operators.ordered import in_ranges, with_previous
from faultmill.plans import marts
from faultmill.samples import feeds
from faultmill.streaming import jobs
from faultmill.streaming.incidents import track

SCHEMA = ("workspace_id string, fingerprint string, at timestamp, event_id string, kind string, "
          "status string, notes string, run_id string, target_seq long")
START = datetime(2026, 1, 1)


def row(key, minutes, event, status=None, notes="", target=None):
    kind = "status" if status else "failure"
    return ("w", key, START + timedelta(minutes=minutes), event, kind, status, notes,
            None if status else f"run-{event}", target)


def simulate(rows):
    """One row after the other: event id -> (incident, folded)."""
    current, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        seq, active = current.get(r[1], (0, False))
        if r[4] == "failure":
            folded = active
            if not active:
                seq, active = seq + 1, True
            out[r[3]] = (seq, folded)
        elif seq and r[8] in (None, seq):
            active = r[5] in ("open", "acknowledged")
            out[r[3]] = (seq, False)
        current[r[1]] = (seq, active)
    return out


def history(size, seed, keys=3, hot=0.6):
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(keys)}"
        status = rng.choice([None] * 5 + ["resolved", "ignored", "acknowledged", "open"])
        rows.append(row(key, rng.randrange(20_000), f"e{i:05d}", status,
                        rng.choice(["", f"n{i}"]) if status else ""))
    return rows


def test_documented_sequence(spark):
    steps = [None, None, "acknowledged", None, "resolved", None, None, "ignored", None]
    rows = [row("k", i, f"e{i}", s) for i, s in enumerate(steps)]
    got = incidents.islands(spark.createDataFrame(rows, SCHEMA)).orderBy("at").collect()
    assert [r.incident_seq for r in got] == [1, 1, 1, 1, 1, 2, 2, 2, 3]


def test_one_moment_of_one_signature_spreads(spark):
    """All rows at one time: ranges cut by rows, and the result is that of the plain window."""
    rng = random.Random(1)
    rows = [row("hot", 0, f"e{i:05d}", rng.choice([None] * 3 + ["resolved", "open"])) for i in range(4000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = [r["count"] for r in in_ranges(frame, incidents.KEYS, incidents.ORDER).groupBy("__range").count().collect()]
        assert len(spread) == 8 and max(spread) < 1000
        found = incidents.islands(frame).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r.event_id: r.incident_seq for r in found if r.incident_seq > 0} == {
        e: seq for e, (seq, _) in simulate(rows).items()}


@pytest.mark.parametrize("bucket", [None, 60, 3600, 86_400, 10**8])
def test_islands_equal_simulation_for_any_bucket(spark, bucket):
    rows = history(1500, bucket or 5)
    want = simulate(rows)
    found = incidents.islands(spark.createDataFrame(rows, SCHEMA), bucket).collect()
    got = {r.event_id: r.incident_seq for r in found if r.incident_seq > 0}
    assert got == {e: seq for e, (seq, _) in want.items()}


def test_acknowledgements_and_counts(spark):
    rows = history(800, 7)
    want = simulate(rows)
    members = incidents.islands(spark.createDataFrame(rows, SCHEMA))
    acks = {r.event_id: r.deduplicated for r in incidents.acknowledgements(members).collect()}
    kinds = {r[3]: r[4] for r in rows}
    assert acks == {e: folded for e, (_, folded) in want.items() if kinds[e] == "failure"}
    total = incidents.rollup(members).agg(F.sum("occurrence_count")).first()[0]
    assert total == sum(k == "failure" for k in kinds.values())


def test_resolution_stays_and_notes_survive(spark):
    rows = [row("k", 0, "a"), row("k", 1, "b", "resolved", "fixed"), row("k", 2, "c", "open"),
            row("k", 3, "d"), row("k", 4, "e", "acknowledged", "")]
    found = incidents.rollup(incidents.islands(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(found) == 1
    assert (found[0].status, found[0].resolution_notes, found[0].occurrence_count) == (
        "acknowledged", "fixed", 2)
    assert found[0].resolved_at == START + timedelta(minutes=1)


def test_recurrence_skips_what_ended_ignored(spark):
    rows = [row("k", 0, "a"), row("k", 1, "b", "resolved", "fix one"), row("k", 2, "c"),
            row("k", 3, "d", "resolved", "fix two"), row("k", 4, "e", "ignored"), row("k", 5, "f")]
    known = incidents.with_recurrence(
        incidents.rollup(incidents.islands(spark.createDataFrame(rows, SCHEMA))))
    got = {r.incident_seq: r for r in known.collect()}
    assert got[1].recurrence_note == ""
    assert got[2].recurrence_note.startswith("Earlier incident") and "fix one" in got[2].recurrence_note
    assert "2026-01-01" in got[2].recurrence_note
    assert got[3].prior_incident_id == got[1].incident_id


@pytest.mark.parametrize("bucket", [None, 3600])
@pytest.mark.parametrize("ahead", [0, 3])
def test_stale_status_rows_are_set_apart(spark, bucket, ahead):
    rng = random.Random(3)
    rows, current = [], {}
    for i in range(900):
        key, minutes = rng.choice(["hot", "hot", "k"]), i * 7
        seq, active = current.get(key, (0, False))
        if rng.random() < 0.5 or seq == 0:
            rows.append(row(key, minutes, f"e{i:05d}"))
            if not active:
                seq, active = seq + 1, True
        else:
            target = rng.randint(max(1, seq - 2), seq + ahead)
            status = rng.choice(["resolved", "ignored", "acknowledged", "open"])
            rows.append(row(key, minutes, f"e{i:05d}", status, "", target))
            if target == seq:
                active = status in ("open", "acknowledged")
        current[key] = (seq, active)
    want = simulate(rows)
    kept, stale = incidents.split_stale_status(spark.createDataFrame(rows, SCHEMA), bucket)
    refused = {r.event_id: r.reason for r in stale.collect()}
    assert set(refused) == {r[3] for r in rows} - set(want)
    assert set(refused.values()) == {incidents.SUPERSEDED, *([incidents.NOT_OPEN] if ahead else [])}
    got = {r.event_id: r.incident_seq for r in incidents.islands(kept, bucket).collect()}
    assert got == {e: seq for e, (seq, _) in want.items()}


def test_status_changes_fold_into_stored_incidents(spark):
    rows = [row("k", 0, "a"), row("j", 0, "b"), row("j", 1, "c", "resolved", "old")]
    stored = incidents.rollup(incidents.islands(spark.createDataFrame(rows, SCHEMA)))
    chosen = stored.select(
        "incident_id", F.lit("ignored").alias("status"), F.lit("").alias("notes"),
        F.lit(datetime(2027, 1, 1)).alias("at"))
    changed = incidents.apply_status_changes(
        stored, incidents.status_changes(stored, chosen, "x-")).orderBy("fingerprint").collect()
    assert [r.status for r in changed] == ["ignored", "ignored"]
    assert [r.resolution_notes for r in changed] == ["old", ""]
    assert changed[0].resolved_at == START + timedelta(minutes=1)


def test_previous_value_both_ways(spark):
    rows = [("a", i, None if i % 3 else i * 10) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    bucket = F.floor(F.col("i") / 7)
    back = with_previous(df, ["k"], ["i"], bucket, F.col("v"), "p").collect()
    ahead = with_previous(df, ["k"], ["i"], bucket, F.col("v"), "p", reverse=True).collect()
    for r in back:
        assert r.p == (None if r.i == 0 else (r.i - 1) // 3 * 30)
    for r in ahead:
        following = (r.i // 3 + 1) * 30
        assert r.p == (following if following <= 1980 else None)


def written_in_order(frame, source, files):
    """One file after another, each later in time than the one before."""
    cut = frame.withColumn("part", F.ntile(files).over(Window.orderBy("at", "event_id"))).persist()
    for part in range(1, files + 1):
        cut.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    cut.unpersist()


def stream_rows(spark, tmp_path, frame, files):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    written_in_order(frame, source, files)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1) \
        .option("latestFirst", "false").parquet(source)
    jobs.run_to_files(track(stream), out, str(tmp_path / "cp")).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("files", [1, 6])
def test_stream_gives_the_batch_rows(spark, sf_dir, tmp_path, files):
    life = feeds.lifecycle(spark, sf_dir)
    got = stream_rows(spark, tmp_path, life, files)
    batch = incidents.islands(life)
    columns = ["fingerprint", "event_id", "kind", "incident_seq"]
    assert got.select(columns).exceptAll(batch.select(columns)).count() == 0
    assert got.count() == batch.count()
    known = incidents.with_recurrence(incidents.rollup(batch))
    opened = got.filter("kind = 'failure' and not deduplicated").select(
        "incident_id", "recurrence_note")
    assert opened.exceptAll(known.select("incident_id", "recurrence_note")).count() == 0


def test_stream_with_targets_equals_simulation(spark, tmp_path):
    rows = [r if r[4] == "failure" else r[:8] + (1,) for r in history(600, 11)]
    got = stream_rows(spark, tmp_path, spark.createDataFrame(rows, SCHEMA), 1).collect()
    want = simulate(rows)
    assert {r.event_id: (r.incident_seq, r.deduplicated) for r in got if not r.stale} == want


def test_live_totals_after_every_micro_batch(spark, sf_dir, tmp_path):
    life = feeds.lifecycle(spark, sf_dir)
    written_in_order(life, str(tmp_path / "in"), 5)
    stream = spark.readStream.schema(life.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.live_totals(stream, str(tmp_path / "totals"), str(tmp_path / "cp")).awaitTermination()
    got = {r.batch_id: r for r in spark.read.parquet(f"{tmp_path}/totals/batch=*").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    cut = life.withColumn("part", F.ntile(5).over(Window.orderBy("at", "event_id")))
    for batch, row in got.items():
        known = cut.filter(F.col("part") <= batch + 1).drop("part")
        want = marts.totals(incidents.rollup(incidents.islands(known))).first()
        assert all(row[name] == want[name] for name in want.asDict())
