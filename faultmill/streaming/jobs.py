"""Streaming jobs: continuous ingest, incident tracking, live totals."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import diagnosis, entities, failures, knowledge
from ..rules.ruleset import BUILT_IN, RuleSet
from ..session import materialize
from ..sources import feeds
from ..sources.merge import exists, merge, period
from . import lifecycle
from .incidents import track


#: Tasks that the payloads of a micro-batch are dealt to, per core.
TASKS_A_CORE = 4


def failures_stream(raw_feed: DataFrame, normalize: Callable[[DataFrame], DataFrame],
                    rules: RuleSet = BUILT_IN) -> DataFrame:
    """Raw payloads to failure records: the batch chain, unchanged and stateless.

    A micro-batch is often one file: its rows are dealt out before they are parsed, to some tasks a core;
    without their number small payloads would be put together by size, to fewer tasks than cores keep busy.
    """
    parts = TASKS_A_CORE * raw_feed.sparkSession.sparkContext.defaultParallelism
    dealt = raw_feed.repartition(parts, F.xxhash64(*raw_feed.columns))
    return failures.from_events(feeds.accepted(normalize(dealt)), rules)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available into Parquet, exactly once per input file."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def live_totals(timeline: DataFrame, totals: str, checkpoint: str) -> StreamingQuery:
    """After every micro-batch, write the dashboard totals over all incidents so far.

    Each row of a batch changes the totals by a known amount, since the state tells what an
    incident was before it; a batch adds its sum to the totals of the batch before and reads no
    history.  A repeated batch overwrites its own file.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        failure = F.col("kind") == "failure"

        def entered(status: str) -> Column:
            now, was = F.col("status") == status, F.coalesce(F.col("was_status") == status, F.lit(False))
            return F.sum(now.cast("long") - was.cast("long"))

        made = batch.filter(~F.col("stale")).agg(
            F.count_if(failure & ~F.col("deduplicated")).alias("total_incidents"),
            entered("open").alias("open_incidents"), entered("resolved").alias("resolved_incidents"),
            F.count_if(failure & (F.col("occurrence_count") == 2)).alias("recurring_incidents"))
        names = made.columns
        if batch_id > 0:
            made = made.unionByName(spark.read.parquet(f"{totals}/batch={batch_id - 1}").select(*names))
        made.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names]) \
            .withColumn("batch_id", F.lit(batch_id)) \
            .coalesce(1).write.mode("overwrite").parquet(f"{totals}/batch={batch_id}")

    return (
        track(timeline).writeStream.outputMode("append").foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# --- live dashboard ------------------------------------------------------------------------------

def _carried(path: str, combine: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """After every micro-batch the table of the one before, combined with what this one changes.

    A batch reads one small table and no history, and a repeated batch overwrites its own.
    """
    def on_batch(made: DataFrame, batch_id: int) -> None:
        if batch_id > 0:
            made = made.unionByName(
                made.sparkSession.read.schema(made.schema).parquet(f"{path}/batch={batch_id - 1}"))
        combine(made).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return on_batch


_EXACT = "decimal(38,9)"


def dashboard_changes(followed: DataFrame) -> DataFrame:
    """Signed change rows (measure, item, n, amount): the old status or category of an incident goes out,
    the new one comes in; ``amount`` sums confidences, exactly."""
    def change(measure: str, item: Column, when: Column, sign: int = 1, amount: Column | None = None) -> Column:
        value = F.round(amount, 9).cast(_EXACT) if amount is not None else F.lit(0).cast(_EXACT)
        return F.when(when, F.struct(
            F.lit(measure).alias("measure"), item.alias("item"), F.lit(sign).cast("long").alias("n"),
            (value * F.lit(sign)).cast(_EXACT).alias("amount")))

    opened, status, was = F.col("opened"), F.col("status"), F.col("was_status")
    moved = opened | ((F.col("kind") == "status") & was.isNotNull() & (was != status))
    found = F.col("category").isNotNull()
    nothing = F.lit("")
    rows = F.array_compact(F.array(
        change("total", nothing, opened),
        change("status", status, moved), change("status", was, moved & was.isNotNull(), -1),
        change("recurring", nothing, (F.col("kind") == "failure") & (F.col("occurrence_count") == 2)),
        change("platform", F.col("platform"), opened),
        change("category", F.col("category"), found, 1, F.col("confidence")),
        change("category", F.col("was_category"), found & F.col("was_category").isNotNull(), -1, F.col("was_confidence"))))
    return _summed(followed.filter(F.col("reason") == "").select(F.explode(rows).alias("c")).select("c.*"))


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy("measure", "item").agg(
        F.sum("n").alias("n"), F.sum("amount").cast(_EXACT).alias("amount"))


def live_dashboard(followed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """After every micro-batch the totals by status, category and platform, and the sum of confidences,
    over all incidents so far (``lifecycle.follow``)."""
    carry = _carried(path, _summed)
    return (
        followed.writeStream.outputMode("append").foreachBatch(lambda rows, number: carry(dashboard_changes(rows), number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def live_health(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """After every micro-batch runs and failures of every pipeline seen so far, named as first seen."""
    def counted(batch: DataFrame) -> DataFrame:
        order = F.struct("received_at", "event_id")
        name = F.coalesce(F.nullif(F.col("pipeline_name"), F.lit("")), F.col("pipeline_external_id"))
        return batch.groupBy(*entities.PIPELINE_KEYS).agg(
            F.min_by(F.struct(order.alias("first"), name.alias("name")), order).alias("seen"),
            F.count(F.lit(1)).alias("run_count"), F.count_if(F.col("status") == "failed").alias("failed_count"))

    def combine(tables: DataFrame) -> DataFrame:
        return tables.groupBy(*entities.PIPELINE_KEYS).agg(
            F.min("seen").alias("seen"), F.sum("run_count").alias("run_count"), F.sum("failed_count").alias("failed_count"))

    carry = _carried(path, combine)
    return (
        events.writeStream.outputMode("append").foreachBatch(lambda rows, number: carry(counted(rows), number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The table after the last micro-batch."""
    tables = spark.read.parquet(f"{path}/batch=*")
    last = spark.read.option("basePath", path).parquet(f"{path}/batch=*").select(F.max("batch")).first()[0]
    return spark.read.schema(tables.schema).parquet(f"{path}/batch={last}")


def live_measures(totals: DataFrame) -> DataFrame:
    """(measure, item, value) as the dashboard shows them, from the totals of ``live_dashboard``."""
    shown = totals.filter(F.col("n") != 0).select(
        F.col("measure"), "item", F.col("n").cast("double").alias("value"))
    mean = totals.filter(F.col("measure") == "category").agg(
        F.sum("amount").alias("amount"), F.sum("n").alias("n")).select(
        F.lit("avg_confidence").alias("measure"), F.lit("").alias("item"),
        F.coalesce(F.bround((F.col("amount") / F.col("n")).cast("double"), 3), F.lit(0.0)).alias("value"))
    return shown.unionByName(mean)


# --- from payloads to stored diagnoses -----------------------------------------------------------

#: Failures in a file of the journal.
JOURNAL_ROWS = 200_000

def store_failures(raw_feed: DataFrame, normalize: Callable[[DataFrame], DataFrame], base: str,
                   rules: RuleSet = BUILT_IN) -> StreamingQuery:
    """Payloads to failure records under ``base``: whole ones with their redacted logs by month, and a
    journal of their short columns, which is what incidents are followed from.

    A micro-batch is made once and overwrites its own folders, so a repeated one adds nothing; what a
    reader of the journal then meets twice it counts once.
    """
    def on_batch(found: DataFrame, number: int) -> None:
        made = materialize(found.withColumn("dt", period("received_at")), "failures")
        # files by size, however many tasks made the rows
        made.hint("rebalance", "dt").write.mode("overwrite").partitionBy("dt").parquet(f"{base}/failures/batch={number}")
        short = made.drop("log", "dt").coalesce(1 + made.count() // JOURNAL_ROWS)
        short.write.mode("overwrite").parquet(f"{base}/journal/batch={number}")

    return (
        failures_stream(raw_feed, normalize, rules).writeStream.outputMode("append").foreachBatch(on_batch)
        .option("checkpointLocation", f"{base}/checkpoints/failures").trigger(availableNow=True).start()
    )


def diagnose_failures(spark: SparkSession, base: str, delay: str, kb_path: str | None = None,
                      rules: RuleSet = BUILT_IN, files_per_batch: int = 1000) -> StreamingQuery:
    """The journal under ``base`` to incidents and diagnoses, stored by month of opening and kept up to
    date by every micro-batch.

    Signatures are followed in the order of events (``lifecycle.follow``).  A failure that opens an
    incident has its log looked up in its month, searched for what the knowledge table at ``kb_path`` holds
    at this micro-batch, rows later than the failure left out, and diagnosed by the rules.  Both tables
    are merged by key: a repeated micro-batch changes nothing.
    """
    journal = spark.read.parquet(f"{base}/journal/batch=*")
    rows = spark.readStream.schema(journal.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{base}/journal/batch=*")
    nobody = rows.select("workspace_id", "fingerprint", "event_id", F.col("received_at").alias("at"),
                         F.lit("").alias("status"), F.lit("").alias("notes")).filter(F.lit(False))
    followed = lifecycle.follow(lifecycle.history(rows, nobody, rule_set=rules), delay)

    def on_batch(found: DataFrame, number: int) -> None:
        batch = materialize(found, "followed")
        changed = lifecycle.incident_rows(batch)
        rest = [c for c in changed.columns if c != "incident_id"]
        newest = changed.groupBy("incident_id").agg(
            F.max_by(F.struct(*rest), F.struct("at", "event_id")).alias("row")).select("incident_id", "row.*")
        merge(newest, f"{base}/incidents", ["incident_id"], ["at", "event_id"], "dt")
        opened = batch.filter("opened").select(
            "event_id", "incident_id", F.col("at").alias("created_at"), "recurrence_note", period("at").alias("dt"))
        months = [r[0] for r in opened.select("dt").distinct().collect()]  # months, not rows
        if months:
            merge(_diagnosed(opened, months), f"{base}/diagnoses", ["diagnosis_id"], ["created_at"], "dt")

    def _diagnosed(opened: DataFrame, months: list[str]) -> DataFrame:
        logs = spark.read.parquet(f"{base}/failures").drop("batch").withColumn("dt", F.col("dt").cast("string"))
        known = materialize(logs.filter(F.col("dt").isin(months)).drop("dt").join(opened, "event_id"), "opened")
        if kb_path is not None and exists(spark, kb_path):
            kb = spark.read.schema(knowledge.KB_SCHEMA).parquet(kb_path)
        else:
            kb = knowledge.curated_rows(spark).drop("curated_id")
        searched = known.select(F.col("incident_id").alias("log_id"), "workspace_id", "platform",
                                F.col("created_at").alias("at"), "log", "curated")
        texts = knowledge.hit_texts(knowledge.search(searched, kb), kb).withColumnRenamed("log_id", "incident_id")
        ruled = diagnosis.by_rules(known.join(texts, "incident_id", "left"), rules)
        return diagnosis.as_table(ruled).withColumn("dt", period("created_at"))

    return (
        followed.writeStream.outputMode("append").foreachBatch(on_batch)
        .option("checkpointLocation", f"{base}/checkpoints/incidents").trigger(availableNow=True).start()
    )
