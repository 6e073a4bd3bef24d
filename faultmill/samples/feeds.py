"""Feeds derived from the driver's tables: runs, tasks, logs, payloads, status and feedback.

Every derivation is a deterministic expression over whole tables, so it grows with them.
"""

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_id
from ..operators.knowledge import curated_rows
from ..rules import fixed_values as fv
from ..session import materialize, tune
from ..sources.feeds import NORMALIZERS
from .texts import AIRFLOW_PAYLOADS, DBT_PAYLOADS, GENERIC_PAYLOADS, TASK_LOGS, spark_choice

LINE_COLUMNS = (
    "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


#: Partitions that rows are dealt to at least before texts are derived from them.
DEALT = 32


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The driver's tables are one row group each, so a scan of them is one task: deal the rows out by
    their key.  A rebalance would not: narrow rows are below its advisory size and stay together."""
    return rows.repartition(max(DEALT, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text(number: Column) -> Column:
    return number.cast("string")


def padded(number: Column, width: int = 12) -> Column:
    return F.lpad(text(number), width, "0")


def choose(index: Column, values: tuple[str, ...]) -> Column:
    chosen = F.when(index == 0, values[0])
    for number, value in enumerate(values[1:], 1):
        chosen = chosen.when(index == number, value)
    return chosen


def marks(number: Column, pipeline: Column, day: Column | None = None) -> dict[str, Column]:
    return {
        "n": text(number), "d": text(number % 10), "s": F.lpad(text(number % 60), 2, "0"),
        "c": text(pipeline % 40), "o": F.date_format(day, "yyyy-MM-dd") if day is not None else None,
    }


# --- runs, tasks, logs ---------------------------------------------------------------------------

def runs_from(orders: DataFrame) -> DataFrame:
    customer = F.col("o_custkey")
    pipeline = F.concat(F.lit("pipe_"), text(customer % 40))
    return orders.select(
        padded(F.col("o_orderkey")).alias("event_id"),
        F.col("o_orderdate").cast("timestamp").alias("received_at"),
        F.concat(F.lit("ws_"), text(customer % 2)).alias("workspace_id"),
        choose(customer % 8, fv.PLATFORMS).alias("platform"),
        pipeline.alias("pipeline_external_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(
            F.concat(pipeline, F.lit(" v"), text(F.col("o_orderkey") % 3))).alias("pipeline_name"),
        F.concat(F.lit("run-"), text(F.col("o_orderkey"))).alias("run_external_id"),
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "O", "success").otherwise("running").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_from(table(spark, sf_dir, "orders"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by the run, which is what they are grouped by
    lines = dealt(table(spark, sf_dir, "lineitem").withColumn(
        "run_external_id", F.concat(F.lit("run-"), text(F.col("l_orderkey")))), "run_external_id")
    log = spark_choice(
        list(TASK_LOGS), F.col("l_partkey") % 24, marks(F.col("l_orderkey"), F.col("l_partkey")))
    status = F.when(F.col("l_returnflag") == "R", "failed").when(
        F.col("l_returnflag") == "A", "success").otherwise("upstream_failed")
    return lines.select(
        "run_external_id",
        F.concat(F.lit("task_"), text(F.col("l_linenumber"))).alias("name"),
        F.concat(F.lit("nt"), text(F.col("l_suppkey") % 5)).alias("node_type"),
        status.alias("status"),
        F.when(status != "success", log).alias("log"),
        *LINE_COLUMNS)


def position() -> Column:
    """List position of a derived task: rows are unique, so all columns make a total order."""
    return F.struct(*LINE_COLUMNS)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored task log: log_id of all columns, task fields and text."""
    identity = F.concat_ws("|", "run_external_id", *[F.col(c) for c in LINE_COLUMNS[:3]])
    return tasks(spark, sf_dir).filter(F.col("log").isNotNull()).withColumn("line", identity)


def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of many lines with repeated and unlike error lines, one per order."""
    number = F.col("o_orderkey")

    def line(i: Column) -> Column:
        return (
            F.when(i % 5 == 0, F.concat(F.lit("INFO step "), text(i), F.lit(" of "),
                                        text(number)))
            .when(i % 5 == 1, F.concat(F.lit("  ERROR step "), text(i % 3), F.lit(" failed in run_"),
                                       text(number), F.lit("  ")))
            .when(i % 5 == 2, F.concat(F.lit("2024-01-02 03:04:05,"), text(i + 100),
                                       F.lit(" worker 10.0.0."), text(i), F.lit(":80 refused")))
            .when(i % 5 == 3, F.concat(F.lit("OutOfMemoryError at 0x"), text(i + 1000),
                                       F.lit(" line "), text(number)))
            .otherwise(F.concat(F.lit("\tTimeout  after "), text(i * 7 % 4), F.lit(" s, attempt="),
                                text(i)))
        )

    size = F.col("o_custkey") % 60
    lines = F.when(size > 0, F.transform(F.sequence(F.lit(1).cast("long"), size), line)).otherwise(
        F.array().cast("array<string>"))
    return dealt(table(spark, sf_dir, "orders"), "o_orderkey").select(
        number.alias("log_id"), F.array_join(lines, "\n").alias("log"))


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents around one task log line each."""
    number = F.col("doc_id")
    line = spark_choice(list(TASK_LOGS), number % 24, marks(number, number))
    return dealt(table(spark, sf_dir, "documents"), "doc_id").select(
        number.alias("log_id"),
        F.concat(F.col("text"), F.lit("\n"), line, F.lit("\n"), F.col("text")).alias("log"))


def failures(spark: SparkSession, sf_dir: str, keep_log: bool = False, **options) -> DataFrame:
    from ..operators.failures import from_tasks
    return from_tasks(runs(spark, sf_dir), tasks(spark, sf_dir), "run_external_id", position(),
                      keep_log, **options)


def status_events(failed: DataFrame) -> DataFrame:
    """What people did half a day after some failures, by the order's priority."""
    priority = F.substring("priority", 1, 1)
    status = (
        F.when(priority == "1", "resolved").when(priority == "2", "acknowledged")
        .when(priority == "4", "ignored").when(priority == "5", "open"))
    even = F.col("event_id").cast("long") % 2 == 0
    return failed.filter(status.isNotNull()).select(
        "workspace_id", "fingerprint",
        (F.col("received_at") + F.expr("INTERVAL 12 HOURS")).alias("at"),
        F.concat(F.lit("s-"), F.col("event_id")).alias("event_id"), status.alias("status"),
        F.when(even, F.concat(F.lit("seen in "), F.col("event_id"))).otherwise("").alias("notes"))


def aimed_status_events(failed: DataFrame) -> DataFrame:
    """The same changes, each aimed at one of the first three incidents of its signature."""
    number = F.substring("event_id", 3, 12).cast("long")
    return status_events(failed).withColumn("target_seq", 1 + number % 3)


def aimed_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline with status changes aimed at one of the first nine incidents, open yet or not."""
    return lifecycle(spark, sf_dir).withColumn("target_seq", F.when(
        F.col("kind") == "status", 1 + F.col("event_id").cast("long") % 9))


def one_day_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole timeline as the history of one signature on one day."""
    day = 86_400_000_000
    return lifecycle(spark, sf_dir).withColumns({
        "workspace_id": F.lit("ws"), "fingerprint": F.lit("fp"),
        "at": F.timestamp_micros(F.unix_micros("at") % day)})


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle_from(table(spark, sf_dir, "events"))


def lifecycle_from(events: DataFrame) -> DataFrame:
    """The events table as a timeline of failures and status changes of 50 signatures."""
    kind = F.col("event_type")
    failure = kind.isin("error", "click")
    return events.select(
        F.concat(F.lit("ws_"), text(F.col("user_id") % 2)).alias("workspace_id"),
        F.concat(F.lit("fp_"), text(F.col("user_id") % 50)).alias("fingerprint"),
        F.col("ts").cast("timestamp").alias("at"),
        padded(F.col("event_id")).alias("event_id"),
        F.when(failure, "failure").otherwise("status").alias("kind"),
        F.when(kind == "purchase", "resolved").when(kind == "signup", "acknowledged")
        .when(kind == "view", "ignored").alias("status"),
        F.when(~failure & (F.col("event_id") % 3 == 0),
               F.concat(F.lit("note "), text(F.col("event_id")))).otherwise("").alias("notes"),
        F.when(failure, F.concat(F.lit("run-"), text(F.col("event_id")))).alias("run_id"),
    )


# --- payload feeds -------------------------------------------------------------------------------

def _feed(rows: DataFrame, number: str, pipeline: str, day: str, payloads: tuple,
          prefix: str) -> DataFrame:
    count = len(payloads)
    templates = [p[0] for p in payloads]
    return rows.select(
        F.concat(F.lit(prefix), padded(F.col(number))).alias("event_id"),
        F.col(day).cast("timestamp").alias("received_at"),
        F.concat(F.lit("ws_"), text(F.col(pipeline) % 2)).alias("workspace_id"),
        spark_choice(templates, F.col(number) % count,
                     marks(F.col(number), F.col(pipeline), F.col(day))).alias("payload"))


def airflow_feed_from(orders: DataFrame) -> DataFrame:
    return _feed(orders, "o_orderkey", "o_custkey", "o_orderdate", AIRFLOW_PAYLOADS, "a-")


def airflow_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return airflow_feed_from(dealt(table(spark, sf_dir, "orders"), "o_orderkey"))


def dbt_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(dealt(table(spark, sf_dir, "events"), "event_id"), "event_id", "user_id", "ts", DBT_PAYLOADS, "d-")


def generic_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(dealt(table(spark, sf_dir, "events"), "event_id"), "event_id", "user_id", "ts", GENERIC_PAYLOADS,
                 "g-")


def normalized(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    raw = {"airflow": airflow_feed, "dbt": dbt_feed, "generic": generic_feed}[name]
    return NORMALIZERS[name](raw(spark, sf_dir))


# --- feedback and model answers ------------------------------------------------------------------

def feedback(incidents: DataFrame) -> DataFrame:
    """One feedback per incident: the verdict by its event, half of them long after."""
    number = F.conv(F.substring("incident_id", 1, 6), 16, 10).cast("long")
    verdict = choose(number % 4, ("fixed_it", "helpful", "wrong", "great"))
    moment = F.when(number % 3 == 0, F.col("first_seen_at") - F.expr("INTERVAL 1 HOUR")).when(
        number % 3 == 1, F.col("first_seen_at") + F.expr("INTERVAL 30 MINUTES")).otherwise(
        F.col("first_seen_at") + F.expr("INTERVAL 5 HOURS"))
    return incidents.select(
        F.concat(F.lit("f-"), F.col("incident_id")).alias("event_id"), moment.alias("at"),
        "incident_id", verdict.alias("verdict"),
        F.when(number % 2 == 0, F.concat(F.lit("did "), text(number))).otherwise("")
        .alias("comment"))


def model_answers(openings: DataFrame) -> DataFrame:
    """Answers of an offline model for a third of the incidents, good, partly made up, or broken.

    ``openings``: incident_id, first_seen_at, evidence (array of quotes).
    """
    number = F.conv(F.substring("incident_id", 7, 6), 16, 10).cast("long")
    quote = F.coalesce(F.try_element_at("evidence", F.lit(1)), F.lit(""))
    said = F.struct(F.lit("log").alias("source"), quote.alias("quote"))
    made_up = F.struct(F.lit("log").alias("source"), F.lit("never logged").alias("quote"))
    form = F.col("form")

    def answer(evidence: Column, confidence: float) -> Column:
        fix = F.struct(
            F.concat(F.lit("Try "), text(F.col("number") % 7)).alias("title"),
            F.lit("retry").alias("type"), F.array(F.lit("again")).alias("steps"),
            F.lit("").alias("diff"), F.lit("low").alias("risk"))
        return F.to_json(F.struct(
            choose(F.col("number") % 5, fv.CATEGORIES[:5]).alias("root_cause_category"),
            F.concat(F.lit("Model cause "), text(F.col("number") % 9)).alias("root_cause_summary"),
            F.lit("because").alias("explanation"), evidence.alias("evidence"),
            F.array(fix).alias("fixes"), F.lit(confidence).alias("confidence"),
            (F.col("number") % 2 == 0).alias("is_transient")))

    return (
        openings.withColumn("number", number).filter(F.col("number") % 3 == 0)
        .withColumn("form", F.floor(F.col("number") / 3) % 5)
        .select(
            "incident_id",
            (F.col("first_seen_at") + F.expr("INTERVAL 1 HOUR")).alias("at"),
            F.when(form == 0, answer(F.array(said), 0.9))
            .when(form == 1, answer(F.array(said, made_up), 0.8))
            .when(form == 2, answer(F.array(made_up), 0.95))
            .when(form == 3, F.lit("{}")).otherwise("no json").alias("response"))
    )


def team_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge rows that teams wrote, one per supplier: global and owned ones, some broken, some
    without a literal that each match needs, some with a curated pattern."""
    number = F.col("s_suppkey")
    pattern = (
        F.when(number % 6 == 0, F.concat(F.lit("mart_"), text(number % 100), F.lit(r"\d+")))
        .when(number % 6 == 1, F.concat(F.lit("(svc|spill)_"), text(number % 50), F.lit(r"\d")))
        .when(number % 6 == 2, F.concat(F.lit("ROW "), text(number % 10), F.lit(r"\d*")))
        .when(number % 6 == 3, F.concat(F.lit("(open "), text(number)))
        .when(number % 6 == 4, F.concat(F.lit(r"\d{"), text(4 + number % 3), F.lit(r"}\D")))
        .otherwise(fv.CURATED_KB[7][2]))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("team-"), padded(number)).alias("kb_id"),
        F.when(number % 7 == 1, "ws_0").when(number % 7 == 2, "ws_1").alias("workspace_id"),
        choose(number % 8, fv.PLATFORMS).alias("platform"), pattern.alias("pattern"),
        F.lit(False).alias("is_literal"), F.concat(F.lit("Team note "), text(number)).alias("title"),
        F.lit("seen by a team").alias("cause"), F.concat(F.lit("see page "), text(number)).alias("fix"),
        F.lit("configuration").alias("category"), F.lit("team").alias("source"),
        (F.lit("1992-01-01").cast("timestamp") + F.make_dt_interval(number % 1500)).alias("created_at"))


def stored_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge table with rows of teams, from which one curated row was deleted."""
    curated = curated_rows(spark).drop("curated_id").filter(F.col("kb_id") != "curated-07")
    return curated.unionByName(team_rows(spark, sf_dir))


def jumbled_stream(rows: DataFrame, path: str, files: int = 4, moment: str = "at", end_days: int = 30,
                   end: dict[str, Column] | None = None) -> DataFrame:
    """Rows with a ``moment`` as a stream of several micro-batches, up to a day out of order, and a last
    row long after them that lets the watermark pass all others."""
    spark = rows.sparkSession
    late = F.unix_micros(moment) + F.pmod(F.xxhash64("event_id"), F.lit(86_400_000_000))
    placed = materialize(rows.withColumn("__place", late), "jumbled")
    low, high = placed.agg(F.coalesce(F.min("__place"), F.lit(0)), F.coalesce(F.max("__place"), F.lit(0))).first()
    part = F.least(F.floor((F.col("__place") - F.lit(low)) * files / F.lit(max(1, high - low))), F.lit(files - 1))
    for number in range(files):
        placed.filter(part == number).drop("__place").repartition(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are taken in the order of their times
    if end is None:
        end = {c: F.lit("end of stream") for c in ("workspace_id", "fingerprint", "event_id", "kind")}
    last = rows.limit(1).withColumns({**end, moment: F.timestamp_micros(F.lit(high + end_days * 86_400_000_000))})
    last.select(*rows.columns).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def incident_key(seq: Column) -> Column:
    return short_id(F.col("workspace_id"), F.col("fingerprint"), seq.cast("string"))
