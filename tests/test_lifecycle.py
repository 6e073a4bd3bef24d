"""The event-time stream: order, late rows, feedback, live totals after every micro-batch."""

import random
import time
from datetime import timedelta

from pyspark.sql import functions as F
from test_incidents import SCHEMA, START, history, row, simulate

from faultmill.operators import incidents
from faultmill.plans import marts
from faultmill.sources import airflow
from faultmill.streaming import jobs, lifecycle

WIDE = SCHEMA + ", platform string, category string, confidence double, engine string"


def streamed(spark, path, batches, schema=WIDE):
    """One file, and so one micro-batch, per list of rows, and one that lets the watermark pass all."""
    for rows in [*batches, [(*row("end", 10**7, "end"), None, None, None, None)]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def failing(r, number):
    if r[4] == "status":
        return *r, None, None, None, None
    return *r, ("dbt", "spark")[number % 2], ("timeout", "unknown")[number % 3 % 2], 0.25 + number % 4 / 8, None


def jumbled(rows, minutes, parts, seed):
    rng = random.Random(seed)
    placed = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rng.randrange(minutes)))
    size = -(-len(placed) // parts)
    return [placed[i:i + size] for i in range(0, len(placed), size)]


def test_jumbled_batches_give_the_batch_rows(spark, tmp_path):
    rows = [r if r[4] == "failure" else (*r[:8], 1 + i % 4) for i, r in enumerate(history(700, 3))]
    want = simulate(rows)
    stream = streamed(spark, str(tmp_path / "in"), jumbled([failing(r, i) for i, r in enumerate(rows)], 1000, 5, 2))
    jobs.run_to_files(lifecycle.follow(stream, "1000 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.event_id for r in got} == {r[3] for r in rows}
    assert {r.event_id: (r.incident_seq, r.deduplicated) for r in got if r.reason == "" and r.incident_seq > 0} == want
    kept, stale = incidents.split_stale_status(spark.createDataFrame(rows, SCHEMA))
    assert {r.event_id: r.reason for r in got if r.reason} == {r.event_id: r.reason for r in stale.collect()}
    known = incidents.with_recurrence(incidents.rollup(incidents.islands(kept))).collect()
    assert {r.incident_id: r.recurrence_note for r in got if r.opened} == {r.incident_id: r.recurrence_note for r in known}


def test_late_rows_are_given_out_and_change_nothing(spark, tmp_path):
    batches = [[row("k", 0, "a"), row("k", 100, "b"), row("k", 100, "b")], [row("k", 300, "c"), row("j", 90, "d"), row("k", 100, "b")],
               [row("k", 50, "late", "resolved"), row("k", 400, "e")], [row("k", 500, "f")]]
    stream = streamed(spark, str(tmp_path / "in"), [[failing(r, 0) for r in b] for b in batches])
    jobs.run_to_files(lifecycle.follow(stream, "60 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {r.event_id: r for r in found}
    assert set(got) == {"a", "b", "c", "d", "e", "f", "late"} and len(found) == 7
    assert got["f"].occurrence_count == 5
    assert got["late"].reason == lifecycle.LATE and got["late"].incident_seq is None
    assert {e: r.incident_seq for e, r in got.items() if e != "late"} == dict.fromkeys("abcdef", 1)


def test_feedback_takes_the_diagnosis_of_its_time(spark, tmp_path):
    def other(kind, minutes, event, target, category=None):
        return ("w", "k", START + timedelta(minutes=minutes), event, kind, None, "", None, target, None, category,
                0.5 if category else None, "llm" if category else None)

    rows = [failing(row("k", 0, "a"), 0), other("diagnosis", 10, "m1", 1, "timeout"), failing(row("k", 20, "r", "resolved"), 0),
            failing(row("k", 30, "b"), 0), other("diagnosis", 40, "m2", 1, "code_error"), other("diagnosis", 41, "m3", 9, "timeout"),
            *[other("feedback", m, f"f{m}", t) for m, t in ((-5, 1), (0, 1), (9, 1), (10, 1), (35, 1), (36, 2), (40, 1), (50, None))]]
    random.Random(4).shuffle(rows)
    stream = streamed(spark, str(tmp_path / "in"), [rows[:5], rows[5:9], rows[9:]])
    jobs.run_to_files(lifecycle.follow(stream, "2 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.event_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    first, second = (lifecycle.short_key("w", "k", n) for n in (1, 2))

    def made(incident, engine, minutes):
        return lifecycle.short_key(incident, engine, int((START + timedelta(minutes=minutes) - START.replace(
            year=1970)).total_seconds() * 1_000_000))

    assert got["a"].incident_id == first and got["b"].incident_id == second
    assert {e: r.diagnosis_id for e, r in got.items() if e[0] == "f"} == {
        "f-5": None, "f0": made(first, "rules", 0), "f9": made(first, "rules", 0), "f10": made(first, "llm", 10),
        "f35": made(first, "llm", 10), "f36": made(second, "rules", 30), "f40": made(first, "llm", 40),
        "f50": made(second, "rules", 30)}
    assert got["m3"].reason == incidents.NOT_OPEN
    assert (got["m2"].was_category, got["m2"].category) == ("timeout", "code_error")


def test_one_call_of_the_state_serves_many_signatures(spark, tmp_path, monkeypatch):
    """Signatures share the groups of the state, and waiting rows are packed in between, with the same rows out."""
    monkeypatch.setattr(lifecycle, "GROUPS", 4, raising=False)
    monkeypatch.setattr(lifecycle, "CHUNK", 7)
    rows = [failing(row(f"k{n % 100}", n, f"e{n}", "resolved" if n % 300 >= 200 else None), n) for n in range(600)]
    stream = streamed(spark, str(tmp_path / "in"), jumbled(rows, 100, 3, 4))
    query = jobs.run_to_files(lifecycle.follow(stream, "100 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 4
    got = {r.event_id: (r.incident_seq, r.occurrence_count, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {f"e{n}": (1 + n // 300, min(2, 1 + n % 300 // 100), "") for n in range(600)}


def test_totals_after_every_micro_batch(spark, tmp_path):
    rows = [failing(r, i) for i, r in enumerate(history(500, 8))]
    followed = lifecycle.follow(streamed(spark, str(tmp_path / "in"), jumbled(rows, 500, 4, 1)), "500 minutes")
    carry = jobs._carried(str(tmp_path / "totals"), jobs._summed)

    def on_batch(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/rows/batch={number}")
        for _ in range(2):  # a repeated batch changes nothing
            carry(jobs.dashboard_changes(batch), number)

    followed.writeStream.foreachBatch(on_batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start().awaitTermination()
    seen = len(list((tmp_path / "rows").glob("batch=*")))
    assert seen >= 5
    source = spark.createDataFrame(rows, WIDE)
    checked = 0
    for number in range(seen):
        done = spark.read.parquet(*[f"{tmp_path}/rows/batch={n}" for n in range(number + 1)]).select("event_id")
        life = source.join(done, "event_id", "left_semi")
        found = incidents.rollup(incidents.islands(life.select(*SCHEMA.replace(",", "").split(" ")[::2]))).join(
            source.select(F.col("event_id").alias("opening_event_id"), "platform", "category", "confidence"), "opening_event_id")
        want = {}
        for r in found.collect():
            for key in (("total", ""), ("status", r.status), ("platform", r.platform), ("category", r.category)):
                want[key] = want.get(key, 0) + 1
            if r.occurrence_count > 1:
                want["recurring", ""] = want.get(("recurring", ""), 0) + 1
        want["avg_confidence", ""] = found.agg(F.coalesce(F.bround(F.avg("confidence"), 3), F.lit(0.0))).first()[0]
        got = {(r.measure, r.item): r.value for r in jobs.live_measures(
            spark.read.parquet(f"{tmp_path}/totals/batch={number}")).collect()}
        assert got == want
        checked += len(want) > 1
        assert got.get(("total", ""), 0) == marts.totals(found).first().total_incidents
    assert checked >= 3


def test_payloads_of_one_file_are_dealt_out(spark, tmp_path):
    """A micro-batch of one file is parsed by many tasks; the journal has files by size all the same."""
    rng = random.Random(1)
    rows = [(f"e{i}", START + timedelta(minutes=i), "w", '{"dag_id":"p%d","dag_run_id":"r%d","state":"failed","conf":{"x":"%s"}}' % (
        i % 3, i, rng.randbytes(20_000).hex())) for i in range(200)]  # enough bytes for several tasks
    schema = "event_id string, received_at timestamp, workspace_id string, payload string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = jobs.failures_stream(raw, airflow.normalize).withColumn("task", F.spark_partition_id())
    jobs.run_to_files(found, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    made = spark.read.parquet(str(tmp_path / "out"))
    assert made.count() == 200 and made.select("task").distinct().count() > 1
    jobs.store_failures(raw, airflow.normalize, str(tmp_path / "base")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "base/journal/batch=*")).count() == 200
    assert len(list((tmp_path / "base/journal/batch=0").glob("*.parquet"))) == 1
