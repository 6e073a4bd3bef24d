"""Registered queries: every operator over the driver's tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, moments
from ..functions import text as tx
from ..functions.once import once
from ..operators import diagnosis, entities, failures, feedback, incidents, knowledge
from ..plans import adhoc, marts
from ..plans.incident_plan import IncidentPlan
from ..rules import fixed_values as fv
from ..rules.ruleset import BUILT_IN, RuleSet
from ..session import materialize, scratch_path
from ..sources import airflow, dbt, merge
from ..sources import feeds as sources
from ..streaming import jobs, lifecycle
from ..streaming.incidents import track
from . import feeds
from .own_rules import RULES

CATEGORY = "schema_drift"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(made: Query) -> Query:
    QUERIES[made.__name__] = made
    return made


def day_time(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def joined(texts: Column, separator: str = "\n") -> Column:
    return F.array_join(texts, separator)


def plan(spark: SparkSession, sf_dir: str, answers: bool = False, asked: bool = False,
         kb: DataFrame | None = None, aimed: bool = False, rules: RuleSet = BUILT_IN, **options) -> IncidentPlan:
    return IncidentPlan(
        kb=kb, rules=rules,
        events=feeds.runs(spark, sf_dir),
        failures=feeds.failures(spark, sf_dir, keep_log=answers or asked, rules=rules, **options),
        status_events=feeds.aimed_status_events if aimed else feeds.status_events,
        answers=feeds.model_answers if answers else None,
        asked=feeds.feedback if asked else None)


# --- sources -------------------------------------------------------------------------------------

RUN_FIELDS = ("platform", "pipeline_external_id", "pipeline_name", "run_external_id", "status",
              "trigger", "config_snapshot")


def _flat(events: DataFrame) -> DataFrame:
    task = F.col("task")
    return events.select(
        "event_id", *RUN_FIELDS, day_time(F.col("started_at")).alias("started"),
        day_time(F.col("ended_at")).alias("ended"), F.posexplode_outer("tasks").alias("pos", "task"),
    ).select(
        "event_id", *RUN_FIELDS, "started", "ended", F.col("pos").cast("long").alias("pos"),
        task["task_id"].alias("task_id"), task["name"].alias("task_name"),
        task["node_type"].alias("node_type"), task["status"].alias("task_status"),
        task["try_number"].cast("long").alias("try_number"),
        day_time(task["started_at"]).alias("task_started"),
        day_time(task["ended_at"]).alias("task_ended"),
        joined(task["upstream_task_ids"], ",").alias("upstream"), task["log"].alias("log"))


@query
def src_generic_events(spark, sf_dir):
    return _flat(sources.accepted(feeds.normalized(spark, sf_dir, "generic")))


@query
def src_airflow_normalize(spark, sf_dir):
    return _flat(sources.accepted(feeds.normalized(spark, sf_dir, "airflow")))


@query
def src_dbt_normalize(spark, sf_dir):
    return _flat(sources.accepted(feeds.normalized(spark, sf_dir, "dbt")))


@query
def src_quarantine(spark, sf_dir):
    refused = None
    for name in sources.NORMALIZERS:
        part = sources.quarantine(feeds.normalized(spark, sf_dir, name)).select(
            F.lit(name).alias("feed"), "event_id", "reject_reason")
        refused = part if refused is None else refused.unionByName(part)
    return refused


@query
def feeds_union(spark, sf_dir):
    events = sources.union_events(
        *[feeds.normalized(spark, sf_dir, name) for name in sources.NORMALIZERS])
    return events.select("event_id", "workspace_id", *RUN_FIELDS,
                         F.size("tasks").cast("long").alias("n_tasks"))


@query
def src_adhoc_logs(spark, sf_dir):
    number = F.col("doc_id")
    pasted = feeds.table(spark, sf_dir, "documents").select(
        feeds.text(number).alias("log_id"),
        F.when(number % 5 == 0, F.lit(None).cast("string")).when(number % 5 == 1, "oracle")
        .otherwise("spark").alias("platform"),
        F.when(number % 7 == 0, "").when(number % 7 == 1, " \t\n ").otherwise(F.col("text"))
        .alias("log"),
        F.when(number % 3 == 0, F.repeat(F.lit("context "), F.lit(1251)))
        .when(number % 3 == 1, "nightly load").alias("context"))
    checked = sources.adhoc_logs(pasted)
    return checked.select("log_id", "platform", F.length("log").cast("long").alias("log_chars"),
                          F.length("context").cast("long").alias("context_chars"),
                          "reject_reason")


@query
def src_kb_seed(spark, sf_dir):
    stored = plan(spark, sf_dir, answers=True, asked=True).learned
    table = stored.unionByName(knowledge.seed(stored))
    return table.groupBy("source", "platform", "category").agg(
        F.count(F.lit(1)).alias("rows"), F.max("title").alias("last_title"))


@query
def dim_pipelines(spark, sf_dir):
    return entities.pipelines(feeds.runs(spark, sf_dir)).select(
        *entities.PIPELINE_KEYS, "pipeline_id", "connection_id", "name",
        day_time(F.col("created_at")).alias("created"))


@query
def dim_connections(spark, sf_dir):
    return entities.connections(feeds.runs(spark, sf_dir)).select(
        "workspace_id", "platform", "connection_id", "name",
        day_time(F.col("created_at")).alias("created"))


@query
def sink_roundtrip(spark, sf_dir):
    """Write the entity tables of the accepted events by month and read them back."""
    events = materialize(sources.accepted(feeds.normalized(spark, sf_dir, "airflow")), "events")
    base = scratch_path(spark, "tables")
    task_runs = entities.task_runs(events)
    sources.write_by_period(entities.runs(events), f"{base}/runs", "received_at", "month")
    sources.write_by_period(
        task_runs.drop("log"), f"{base}/task_runs", "received_at", "month")
    sources.write_by_period(
        entities.log_bundles(task_runs), f"{base}/log_bundles", "received_at", "month")
    runs, tasks, logs = (spark.read.parquet(f"{base}/{t}") for t in
                         ("runs", "task_runs", "log_bundles"))
    counted = tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_tasks"))
    logged = logs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_logs"),
        F.sum("redaction_count").alias("redactions"))
    return runs.join(counted, "run_id", "left").join(logged, "run_id", "left").groupBy(
        "status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum("n_tasks"), F.lit(0)).alias("n_tasks"),
        F.coalesce(F.sum("n_logs"), F.lit(0)).alias("n_logs"),
        F.coalesce(F.sum("redactions"), F.lit(0)).alias("redactions"))


@query
def sink_incidents(spark, sf_dir):
    """Write incidents and diagnoses by month and read them back."""
    base = scratch_path(spark, "incident-tables")
    plan(spark, sf_dir, answers=True).store(base)
    stored, given = (spark.read.parquet(f"{base}/{t}") for t in ("incidents", "diagnoses"))
    return stored.select("incident_id", "status", "occurrence_count").join(
        given.select("incident_id", "engine"), "incident_id").groupBy("status", "engine").agg(
        F.count(F.lit(1)).alias("diagnoses"), F.countDistinct("incident_id").alias("incidents"),
        F.sum("occurrence_count").alias("failures"))


def _incident_increment(events: DataFrame, since: str) -> DataFrame:
    """Incidents that a row from ``since`` on has changed, as they are after all ``events``."""
    members = incidents.islands(events)
    touched = members.groupBy(*incidents.KEYS, "incident_seq").agg(F.max("at").alias("changed_at")).filter(
        F.col("changed_at") >= F.lit(since).cast("timestamp"))
    return incidents.rollup(members).join(touched, [*incidents.KEYS, "incident_seq"]).withColumn(
        "dt", merge.period("first_seen_at", "day"))


@query
def sink_upsert(spark, sf_dir):
    """Incidents stored by day in three increments, the last one twice: the table of one full run."""
    path, events = f"{scratch_path(spark, 'upsert')}/incidents", feeds.lifecycle(spark, sf_dir)
    cuts = ("2024-01-05", "2024-01-20", "2100-01-01")
    for since, until in (("1970-01-01", cuts[0]), (cuts[0], cuts[1]), (cuts[1], cuts[2]), (cuts[1], cuts[2])):
        known = events.filter(F.col("at") < F.lit(until).cast("timestamp"))
        merge.merge(_incident_increment(known, since), path, ["incident_id"], ["changed_at", "occurrence_count"], "dt")
    return spark.read.parquet(path).select(
        "incident_id", "status", "occurrence_count", F.unix_micros("first_seen_at").alias("first_us"),
        F.unix_micros("last_seen_at").alias("last_us"), "resolution_notes")


@query
def dim_growth(spark, sf_dir):
    """The pipeline dimension grown over three increments that see keys out of order."""
    path, events = f"{scratch_path(spark, 'growth')}/pipelines", feeds.runs(spark, sf_dir)
    for turn in (2, 0, 1, 0):
        entities.grow_pipelines(events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == turn), path)
    return spark.read.parquet(path).select(
        *entities.PIPELINE_KEYS, "pipeline_id", "connection_id", "name", day_time(F.col("created_at")).alias("created"))


# --- projections ---------------------------------------------------------------------------------

_STATES = ("Success", "FAILED", "running", "Upstream_Failed", "skipped", "removed", "shutdown",
           "queued", "none", "")
_DBT = ("success", "PASS", "error", "fail", "Runtime Error", "skipped", "warn", "odd", "")


@query
def map_airflow_state(spark, sf_dir):
    number = F.col("l_orderkey") + F.col("l_linenumber")
    state = F.when(number % 11 == 10, F.lit(None).cast("string")).otherwise(
        feeds.choose(number % 11, _STATES))
    return feeds.table(spark, sf_dir, "lineitem").select(
        state.alias("state"), airflow.map_state(state).alias("status")).groupBy(
        "state", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def map_dbt_status(spark, sf_dir):
    number = F.col("l_orderkey") + F.col("l_linenumber")
    status = F.when(number % 10 == 9, F.lit(None).cast("string")).otherwise(
        feeds.choose(number % 10, _DBT))
    return feeds.table(spark, sf_dir, "lineitem").select(
        status.alias("raw"), dbt.map_status(status).alias("status")).groupBy(
        "raw", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def proj_defaults(spark, sf_dir):
    """Empty text counts as missing for names, but not for the trigger."""
    runs = feeds.runs(spark, sf_dir)
    number = F.col("event_id").cast("long")
    trigger = F.when(number % 4 == 0, "").when(number % 4 == 1, "manual")
    return runs.select(
        "event_id",
        F.coalesce(F.nullif("pipeline_name", F.lit("")), "pipeline_external_id").alias("name"),
        F.coalesce(trigger, F.lit("scheduled")).alias("trigger"))


@query
def ts_parse(spark, sf_dir):
    number, moment = F.col("event_id"), F.col("ts").cast("timestamp")
    shapes = (
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.date_format(moment, "yyyy-MM-dd HH:mm:ss,SSS"),
        F.date_format(moment, "yyyyMMdd'T'HHmmss"),
        F.date_format(moment, "yyyy-MM-dd"),
        F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm"), F.lit("Z")),
        F.date_format(moment, "yyyy"),
        F.concat(F.date_format(moment, "yyyy-MM-dd"), F.lit("T25:00")),
        F.lit(""),
        F.concat(F.date_format(moment, "yyyy"), F.lit("-13-01")),
        F.date_format(moment, "dd/MM/yyyy"),
    )
    text = F.lit(None).cast("string")
    for index, shape in enumerate(shapes):
        text = F.when(number % 11 == index, shape).otherwise(text)
    return feeds.table(spark, sf_dir, "events").select(
        "event_id", F.unix_micros(moments.parse_iso(text)).alias("parsed_us"))


@query
def ts_to_utc(spark, sf_dir):
    number, moment = F.col("event_id"), F.col("ts").cast("timestamp")
    zone = feeds.choose(number % 6, ("", "Z", "+05:30", "-0800", "+01", "-00:45"))
    text = F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    return feeds.table(spark, sf_dir, "events").select(
        "event_id", F.unix_micros(moments.parse_iso(text)).alias("utc_us"))


def _unique_id() -> Column:
    number = F.col("l_linenumber") % 4
    return F.when(number == 0, F.concat(F.lit("node_"), feeds.text(F.col("l_partkey")))).when(
        number == 1, F.concat(F.lit("model.shop.m_"), feeds.text(F.col("l_partkey")))).when(
        number == 2, F.concat(F.lit("test."), feeds.text(F.col("l_suppkey")), F.lit(".x."),
                              feeds.text(F.col("l_partkey")))).otherwise("source.")


@query
def dbt_node_parts(spark, sf_dir):
    return feeds.table(spark, sf_dir, "lineitem").select(
        _unique_id().alias("unique_id")).distinct().select(
        "unique_id", dbt.node_type(F.col("unique_id")).alias("node_type"),
        dbt.node_name(F.col("unique_id")).alias("name"))


@query
def dbt_execute_timing(spark, sf_dir):
    events = sources.accepted(feeds.normalized(spark, sf_dir, "dbt"))
    return events.select("event_id", F.explode("tasks").alias("task")).select(
        "event_id", F.col("task.task_id").alias("task_id"),
        day_time(F.col("task.started_at")).alias("started"),
        day_time(F.col("task.ended_at")).alias("ended"))


@query
def dbt_failure_log(spark, sf_dir):
    """Whole documents as messages and compiled statements."""
    number, body = F.col("doc_id"), F.col("text")
    nothing = F.lit(None).cast("string")
    log = dbt.failure_log(
        F.when(number % 3 > 0, F.col("source")),
        F.when(number % 4 == 0, body).when(number % 4 == 1, "").otherwise(nothing),
        F.when(number % 2 == 1, body).otherwise(nothing))
    return feeds.table(spark, sf_dir, "documents").select(
        number.alias("doc_id"), F.length(log).cast("long").alias("chars"),
        F.md5(log).alias("digest"))


@query
def dbt_run_status(spark, sf_dir):
    events = feeds.normalized(spark, sf_dir, "dbt").filter(F.col("reject_reason").isNull())
    return events.select("event_id", dbt.run_status(F.col("tasks")).alias("status"))


@query
def failed_runs(spark, sf_dir):
    return feeds.runs(spark, sf_dir).filter(F.col("status") == "failed").select(
        "event_id", "run_external_id", "workspace_id", "platform", "pipeline_external_id")


@query
def failed_task_logs(spark, sf_dir):
    return failures.failing_logs(feeds.tasks(spark, sf_dir)).groupBy(
        "status", "name", "node_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("log")).cast("long").alias("chars"))


@query
def synthetic_log(spark, sf_dir):
    runs = feeds.runs(spark, sf_dir).filter(F.col("status") == "failed")
    logged = failures.failing_logs(feeds.tasks(spark, sf_dir))
    text = failures.synthetic_log(F.col("run_external_id"), F.col("pipeline_external_id"))
    return runs.join(logged, "run_external_id", "left_anti").select("event_id", text.alias("log"))


@query
def root_cause_task(spark, sf_dir):
    chosen = failures.root_task(
        failures.failing_logs(feeds.tasks(spark, sf_dir)), "run_external_id", feeds.position(),
        "name", "node_type", "status", "log")
    return chosen.select("run_external_id", "root.*")


# --- redaction and text --------------------------------------------------------------------------

def _secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one line per kind of secret, derived from the row's own key."""
    number = feeds.text(F.col("doc_id"))
    wide = F.sha2(number, 256)
    opaque = F.concat(F.lit("Zx9Kq2Lm8Np4Rt6Vw1Yb3Dc5Fg7Hj0AsQeUiOp"), number)
    lines = [
        F.concat(F.lit("dsn postgresql://u"), number, F.lit(":pw@db/x and jdbc:mysql://h"), number),
        F.concat(F.lit("key AKIA"), F.upper(F.substring(wide, 1, 16)), F.lit(" end")),
        F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), wide,
                 F.lit("\n-----END RSA PRIVATE KEY----- done")),
        F.concat(F.lit("Authorization: Bearer "), wide, F.lit("=")),
        F.concat(F.lit('api_key = "k'), number, F.lit('zzzz" pwd:abc')),
        F.concat(F.lit("https://bob"), number, F.lit(":pw"), number, F.lit("@host/x")),
        F.concat(F.lit("mail ops"), number, F.lit("@example.com now")),
        F.concat(F.lit("blob "), opaque, F.lit(" and "), F.md5(number)),
    ]
    return feeds.dealt(feeds.table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", F.concat_ws("\n", "text", *lines).alias("text"))


def _redaction_query(position: int) -> Query:
    def run(spark, sf_dir):
        texts = _secret_lines(spark, sf_dir)
        if position < len(fv.REDACTION_RULES):
            done = tx.apply_redaction_rule(texts, fv.REDACTION_RULES[position], "text", "out", "n")
        else:
            done = tx.apply_entropy_rule(texts, "text", "out", "n")
        done = once(done, {"out": F.col("out"), "n": F.col("n")})
        return done.select("doc_id", F.md5("out").alias("digest"),
                           F.length("out").cast("long").alias("chars"),
                           F.col("n").cast("long").alias("n"))
    return run


for _position, _name in enumerate(
        ("connstr", "aws", "pem", "bearer", "kv", "url", "email", "entropy")):
    QUERIES[f"redact_{_name}"] = _redaction_query(_position)


@query
def redact_full(spark, sf_dir):
    done = tx.with_redaction(_secret_lines(spark, sf_dir), "text", "out", "n")
    return done.select("doc_id", F.md5("out").alias("digest"),
                       F.length("out").cast("long").alias("chars"), "n")


@query
def redaction_counts(spark, sf_dir):
    logs = tx.with_redaction(feeds.logs(spark, sf_dir), "log", "clean", "n")
    return logs.groupBy("name", "n").agg(
        F.count(F.lit(1)).alias("logs"), F.sum(F.length("clean")).cast("long").alias("chars"))


@query
def error_lines(spark, sf_dir):
    return feeds.job_logs(spark, sf_dir).select(
        "log_id", F.posexplode(tx.error_lines(F.col("log"))).alias("pos", "line")).select(
        "log_id", F.col("pos").cast("long").alias("pos"), "line")


@query
def normalize_text(spark, sf_dir):
    return feeds.job_logs(spark, sf_dir).select(
        "log_id", tx.normalize_text(F.col("log")).alias("normal"))


@query
def fingerprint(spark, sf_dir):
    template = tx.error_template(F.col("log"))
    return feeds.job_logs(spark, sf_dir).select("log_id", tx.fingerprint(
        template, F.concat(F.lit("pipe_"), feeds.text(F.col("log_id") % 7)),
        F.when(F.col("log_id") % 3 > 0, "SqlOperator")).alias("fingerprint"))


def _triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = feeds.document_logs(spark, sf_dir)
    return once(logs, {"rule_id": tx.triage_rule(F.col("log"))})


@query
def triage_classify(spark, sf_dir):
    rules = F.broadcast(diagnosis.rule_table(spark))  # 20 rows by construction
    return _triaged(spark, sf_dir).withColumn(
        "rule", F.coalesce("rule_id", F.lit(0))).drop("rule_id").join(
        rules.withColumnRenamed("rule_id", "rule"), "rule").select(
        "log_id", F.col("rule").cast("long").alias("rule"), "category", "summary", "confidence",
        "is_transient")


@query
def triage_quote(spark, sf_dir):
    return _triaged(spark, sf_dir).select(
        "log_id", tx.triage_quote(F.col("log"), F.col("rule_id")).alias("quote"))


@query
def triage_fixes(spark, sf_dir):
    rules = F.broadcast(diagnosis.rule_table(spark))  # 20 rows by construction
    fixed = _triaged(spark, sf_dir).join(rules, "rule_id").select(
        "log_id", F.posexplode("rule_fixes").alias("pos", "fix"))
    return fixed.select(
        "log_id", F.col("pos").cast("long").alias("pos"), "fix.title",
        F.col("fix.type").alias("kind"), joined(F.col("fix.steps"), "; ").alias("steps"),
        "fix.risk")


@query
def truncate_log(spark, sf_dir):
    short = tx.truncate_log(F.col("log"))
    tight = tx.truncate_log(F.col("log"), 400)
    return feeds.document_logs(spark, sf_dir).select(
        "log_id", F.length(short).cast("long").alias("chars"), F.md5(short).alias("digest"),
        F.md5(tight).alias("tight_digest"))


# --- incidents -----------------------------------------------------------------------------------

@query
def incident_islands(spark, sf_dir):
    return incidents.islands(feeds.lifecycle(spark, sf_dir)).select(
        "workspace_id", "fingerprint", "event_id", "kind", "incident_seq")


@query
def incident_islands_one_day(spark, sf_dir):
    """All rows in one signature and one day: cut by rows, whatever the clock says."""
    return incidents.islands(feeds.one_day_lifecycle(spark, sf_dir)).select(
        "event_id", "kind", "incident_seq", F.coalesce("opening", F.lit(False)).alias("opening"))


@query
def incident_stale_status(spark, sf_dir):
    """Status changes aimed at incidents that are closed already or not open yet are set apart."""
    kept, stale = incidents.split_stale_status(feeds.aimed_lifecycle(spark, sf_dir))
    columns = ["workspace_id", "fingerprint", "event_id", "kind"]
    return incidents.islands(kept).select(
        *columns, "incident_seq", F.lit("").alias("reason")).unionByName(
        stale.select(*columns, F.lit(None).cast("long").alias("incident_seq"), "reason"))


@query
def status_quarantine(spark, sf_dir):
    """What the plan sets apart and what the other changes make of the incidents."""
    found = plan(spark, sf_dir, aimed=True, wanted=("template",))
    counted = found.counted.groupBy(F.lit("").alias("reason"), "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("occurrence_count").alias("failures"))
    return counted.unionByName(found.quarantine.groupBy("reason", "status").agg(
        F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("failures")))


@query
def incident_rollup(spark, sf_dir):
    return incidents.rollup(incidents.islands(feeds.lifecycle(spark, sf_dir))).select(
        "incident_id", "workspace_id", "fingerprint", "incident_seq", "occurrence_count",
        F.unix_micros("first_seen_at").alias("first_us"),
        F.unix_micros("last_seen_at").alias("last_us"), "opening_event_id", "run_id")


@query
def incident_status_fold(spark, sf_dir):
    return incidents.rollup(incidents.islands(feeds.lifecycle(spark, sf_dir))).select(
        "incident_id", "status", F.unix_micros("resolved_at").alias("resolved_us"),
        "resolution_notes")


@query
def ingest_ack(spark, sf_dir):
    members = incidents.islands(feeds.lifecycle(spark, sf_dir))
    return incidents.acknowledgements(members).select(
        "event_id", "run_id", "incident_id", "deduplicated")


@query
def recurrence_asof(spark, sf_dir):
    found = incidents.rollup(incidents.islands(feeds.lifecycle(spark, sf_dir)))
    return incidents.with_recurrence(found).select(
        "incident_id", "prior_incident_id", "prior_count",
        F.unix_micros("prior_resolved_at").alias("prior_resolved_us"), "prior_notes")


@query
def recurrence_note(spark, sf_dir):
    found = incidents.rollup(incidents.islands(feeds.lifecycle(spark, sf_dir)))
    return incidents.with_recurrence(found).select("incident_id", "recurrence_note")


@query
def bulk_status(spark, sf_dir):
    """Resolve or ignore every second incident, by its id, then fold the changes in."""
    stored = materialize(
        incidents.rollup(incidents.islands(feeds.lifecycle(spark, sf_dir))), "lifecycle")
    even = F.conv(F.substring("incident_id", 1, 6), 16, 10).cast("long") % 4
    chosen = stored.filter(even < 2).select(
        "incident_id", F.when(even == 0, "resolved").otherwise("ignored").alias("status"),
        F.when(even == 0, "bulk").otherwise("").alias("notes"),
        F.lit("2030-01-01 00:00:00").cast("timestamp").alias("at"))
    changes = incidents.status_changes(stored, chosen, "bulk-")
    return incidents.apply_status_changes(stored, changes).select(
        "incident_id", "status", F.unix_micros("resolved_at").alias("resolved_us"),
        "resolution_notes")


@query
def incident_dedup(spark, sf_dir):
    """Failed runs with their incident: root task, signature, active incident lookup."""
    found = plan(spark, sf_dir, wanted=("template",))
    acks = incidents.acknowledgements(found.members)
    return acks.select("event_id", "workspace_id", "fingerprint", "incident_id", "deduplicated")


@query
def incident_title(spark, sf_dir):
    return plan(spark, sf_dir).incidents.select("incident_id", "title")


@query
def incident_renamed(spark, sf_dir):
    """Titles after the answers of a model came in, hypothesis or not."""
    found = plan(spark, sf_dir, answers=True)
    return found.listed.select("incident_id", F.col("title").alias("now")).join(
        found.incidents.select("incident_id", F.col("title").alias("first")), "incident_id")


@query
def join_run_pipeline(spark, sf_dir):
    runs = feeds.runs(spark, sf_dir)
    named = entities.with_pipeline(runs, entities.pipelines(runs))
    return named.select("event_id", "pipeline_id", "pipeline_name", "status")


@query
def join_incident_pipeline(spark, sf_dir):
    """Every incident with its pipeline, the whole dimension."""
    found = plan(spark, sf_dir)
    return marts.incidents_with_pipeline(
        found.incidents.drop("platform", "pipeline_name"), found.pipelines).select(
        "incident_id", "pipeline_id", "pipeline_name", "platform")


# --- diagnoses -----------------------------------------------------------------------------------

def _diagnosis_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "incident_id", "engine", "category", "summary", "explanation",
        joined(F.transform("evidence", lambda e: e["quote"])).alias("quotes"),
        joined(F.transform("fixes", lambda f: f["title"])).alias("fix_titles"),
        F.round("confidence", 9).alias("confidence"), "is_transient")


@query
def diagnose_rules(spark, sf_dir):
    return _diagnosis_rows(plan(spark, sf_dir, answers=True, asked=True).findings)


@query
def own_rules(spark, sf_dir):
    """The whole plan with a user's tables for redaction, volatile tokens and triage."""
    found = plan(spark, sf_dir, answers=True, rules=RULES)
    logs = found.opening_logs.select(F.col("log_id").alias("incident_id"), F.md5("log").alias("log"))
    return _diagnosis_rows(found.findings).join(logs, "incident_id").join(
        found.incidents.select("incident_id", "fingerprint", "occurrence_count", "title"), "incident_id")


@query
def diagnosis_fixes(spark, sf_dir):
    findings = plan(spark, sf_dir, answers=True, asked=True).findings
    return findings.select("incident_id", F.posexplode("fixes").alias("pos", "fix")).select(
        "incident_id", F.col("pos").cast("long").alias("pos"), "fix.title",
        F.col("fix.type").alias("kind"), joined(F.col("fix.steps"), "; ").alias("steps"))


@query
def parse_responses(spark, sf_dir):
    found = plan(spark, sf_dir, answers=True, asked=True)
    return _diagnosis_rows(found.diagnoses.filter(F.col("engine") != "rules"))


@query
def verify_evidence(spark, sf_dir):
    """Quotes taken from whole documents, some changed so that they do not occur."""
    number, body = F.col("doc_id"), F.col("text")
    real = F.substring(body, 5, 40)
    fake = F.concat(F.substring(body, 1, 10), F.lit(" <none> "))
    quotes = (F.when(number % 4 == 0, F.array(real)).when(number % 4 == 1, F.array(real, fake))
              .when(number % 4 == 2, F.array(fake, F.lit(""))).otherwise(
              F.array().cast("array<string>")))
    rows = feeds.table(spark, sf_dir, "documents").select(
        "doc_id", body.alias("log"), F.lit("cause").alias("summary"),
        F.when(number % 8 < 4, 0.9).otherwise(0.35).alias("confidence"),
        F.transform(quotes, lambda q: F.struct(
            F.lit("log").alias("source"), q.alias("quote"))).alias("evidence"))
    return diagnosis.verify_evidence(rows, "log").select(
        "doc_id", "summary", F.round("confidence", 9).alias("confidence"),
        F.size("evidence").cast("long").alias("kept"))


@query
def prompt_table(spark, sf_dir):
    found = plan(spark, sf_dir, answers=True, asked=True)
    texts = knowledge.hit_texts(found.hits, found.known).withColumnRenamed(
        "log_id", "incident_id")
    rows = found.incidents.join(texts, "incident_id", "left").join(
        found.opening_logs.select(F.col("log_id").alias("incident_id"), "log"), "incident_id")
    context = F.when(F.col("incident_seq") % 2 == 0, "second look")
    return diagnosis.prompts(rows.withColumn("context", context)).select(
        "incident_id", "prompt")


def _pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id")
    line = feeds.spark_choice(list(feeds.TASK_LOGS), number % 24, feeds.marks(number, number))
    return _secret_lines(spark, sf_dir).select(
        number.alias("log_id"), F.concat(F.col("text"), F.lit("\n"), line).alias("log"),
        F.when(number % 2 == 0, "spark").otherwise("snowflake").alias("platform"),
        F.when(number % 3 == 0, "nightly load").otherwise("").alias("context"))


@query
def adhoc_knowledge(spark, sf_dir):
    """Pasted logs against the global rows of the stored knowledge table."""
    pasted = _pasted(spark, sf_dir).withColumn("log_id", feeds.text(F.col("log_id")))
    return adhoc.diagnose(pasted, feeds.stored_knowledge(spark, sf_dir)).select(
        "log_id", "category", joined(F.transform("fixes", lambda f: f["title"])).alias("fix_titles"),
        joined(F.transform(F.coalesce("kb_hits", F.array()), lambda h: h["title"])).alias("known"))


@query
def adhoc_diagnose(spark, sf_dir):
    """Pasted logs, many of them long and with secrets, diagnosed without any history."""
    return adhoc.diagnose(_pasted(spark, sf_dir)).select(
        "log_id", "category", "summary",
        joined(F.transform("evidence", lambda e: e["quote"])).alias("quotes"),
        joined(F.transform("fixes", lambda f: f["title"])).alias("fix_titles"),
        F.round("confidence", 9).alias("confidence"), F.col("redaction_count").alias("redactions"),
        F.length("log").cast("long").alias("log_chars"), F.md5("prompt").alias("prompt"))


@query
def latest_diagnosis(spark, sf_dir):
    newest = diagnosis.latest(plan(spark, sf_dir, answers=True).diagnoses, "diagnosis_id", "engine", "category")
    return newest.select("incident_id", "diagnosis.diagnosis_id", "diagnosis.engine",
                         "diagnosis.category")


@query
def incident_latest_diag(spark, sf_dir):
    """Every incident with its newest diagnosis."""
    found = plan(spark, sf_dir, answers=True)
    newest = diagnosis.latest(found.diagnoses, "category", "summary", "confidence")
    return found.incidents.join(newest, "incident_id", "left").select(
        "incident_id", F.col("diagnosis.category").alias("category"),
        F.coalesce(F.col("diagnosis.summary"), F.lit("")).alias("summary"),
        F.round(F.col("diagnosis.confidence"), 9).alias("confidence"))


@query
def incident_diagnoses(spark, sf_dir):
    history = marts.diagnosis_history(plan(spark, sf_dir, answers=True).diagnoses)
    return history.select("incident_id", F.col("position").cast("long").alias("position"),
                          "diagnosis_id", "engine", day_time(F.col("created_at")).alias("created"))


@query
def incident_logs(spark, sf_dir):
    """All stored logs of each incident's latest run."""
    found = plan(spark, sf_dir, wanted=("template",))
    runs = feeds.runs(spark, sf_dir).select(
        "run_external_id", entities.short_id(F.col("workspace_id"), F.col("event_id"))
        .alias("run_id"))
    wanted = marts.incident_logs(found.counted, runs.join(feeds.logs(spark, sf_dir), "run_external_id"))
    return tx.with_redaction(wanted, "log", "content", "redactions").select(
        "incident_id", F.col("name").alias("task"), "content", "redactions")


# --- knowledge and feedback ----------------------------------------------------------------------

@query
def kb_match(spark, sf_dir):
    hits = plan(spark, sf_dir, answers=True, asked=True).hits
    return hits.select("log_id", F.col("hit_rank").cast("long").alias("hit_rank"), "kb_id",
                       F.col("score").cast("long").alias("score"))


@query
def kb_patterns(spark, sf_dir):
    """A table with rows of teams, patterns of any kind, and without one of the curated rows."""
    stored = feeds.stored_knowledge(spark, sf_dir)
    hits = plan(spark, sf_dir, answers=True, asked=True, kb=stored).hits
    return hits.select("log_id", F.col("hit_rank").cast("long").alias("hit_rank"), "kb_id",
                       F.col("score").cast("long").alias("score"))


@query
def kb_learn(spark, sf_dir):
    return plan(spark, sf_dir, answers=True, asked=True).learned.select(
        "kb_id", "workspace_id", "platform", "pattern", "title", "cause", "fix", "category",
        day_time(F.col("created_at")).alias("created"))


@query
def kb_validate(spark, sf_dir):
    number = F.col("l_partkey")
    shapes = (
        F.concat(F.lit("part "), feeds.text(number), F.lit(r"\d+")),
        F.concat(F.lit("(open "), feeds.text(number)),
        F.concat(F.lit("*"), feeds.text(number)),
        F.concat(F.lit("[a-"), feeds.text(number)),
    )
    pattern = F.lit(None).cast("string")
    for index, shape in enumerate(shapes):
        pattern = F.when(F.col("l_linenumber") % 4 == index, shape).otherwise(pattern)
    kb = feeds.table(spark, sf_dir, "lineitem").select(
        pattern.alias("pattern"), (F.col("l_suppkey") % 5 == 0).alias("is_literal"))
    return knowledge.with_pattern_check(kb).groupBy("is_literal", "is_valid").agg(
        F.count(F.lit(1)).alias("n"), F.min("pattern").alias("first_pattern"))


@query
def feedback_valid(spark, sf_dir):
    found = plan(spark, sf_dir)
    return knowledge.valid_feedback(feeds.feedback(found.incidents)).select(
        "event_id", "verdict", "comment")


@query
def feedback_diag(spark, sf_dir):
    found = plan(spark, sf_dir, answers=True)
    given = feedback.with_diagnosis(feeds.feedback(found.incidents), found.first_diagnoses)
    return given.select("event_id", "verdict", "diagnosis.diagnosis_id", "diagnosis.engine")


# --- feeds and dashboards ------------------------------------------------------------------------

def _summary_rows(listed: DataFrame) -> DataFrame:
    return listed.select(
        "incident_id", "pipeline_id", "pipeline_name", "platform", "title", "status",
        "fingerprint", "occurrence_count", day_time(F.col("first_seen_at")).alias("first_seen"),
        day_time(F.col("last_seen_at")).alias("last_seen"), "category", "summary",
        F.round("confidence", 9).alias("confidence"))


@query
def incident_feed(spark, sf_dir):
    """The flagship: runs and logs to the first page of diagnosed incidents."""
    return _summary_rows(marts.feed_page(plan(spark, sf_dir).listed))


@query
def incident_summary(spark, sf_dir):
    return _summary_rows(plan(spark, sf_dir, answers=True).listed)


@query
def feed_by_status(spark, sf_dir):
    return marts.with_status(plan(spark, sf_dir).listed, "resolved").select(
        "incident_id", "status", "title")


@query
def feed_by_category(spark, sf_dir):
    found = plan(spark, sf_dir, answers=True)
    return marts.with_any_category(found.listed, found.diagnoses, CATEGORY).select(
        "incident_id", "category", "title")


@query
def feed_search(spark, sf_dir):
    return marts.search(plan(spark, sf_dir).listed, "  Pipe_1 ", platform="dbt").select(
        "incident_id", "title", "pipeline_name", "category")


@query
def incident_by_id(spark, sf_dir):
    """The incident opened by the very first failure, looked up by its id in the stored listing."""
    found, base = plan(spark, sf_dir), scratch_path(spark, "listing")
    found.store(base)
    wanted = found.stored.orderBy("received_at", "event_id").limit(1).select(
        incidents.incident_id(F.lit(1))).first()[0]
    return _summary_rows(spark.read.parquet(f"{base}/listed").filter(F.col("incident_id") == wanted))


@query
def feed_facets(spark, sf_dir):
    return marts.facets(plan(spark, sf_dir).listed)


@query
def feed_page(spark, sf_dir):
    return marts.feed_page(plan(spark, sf_dir).listed, limit=25, offset=50).select(
        "incident_id", day_time(F.col("last_seen_at")).alias("last_seen"), "title")


@query
def recent_incidents(spark, sf_dir):
    return marts.recent(plan(spark, sf_dir).listed).select(
        "incident_id", day_time(F.col("last_seen_at")).alias("last_seen"), "title")


@query
def dashboard_totals(spark, sf_dir):
    return marts.totals(plan(spark, sf_dir, wanted=("template",)).counted)


@query
def dashboard_by_category(spark, sf_dir):
    found = plan(spark, sf_dir, answers=True)
    return marts.by_category(found.incidents, found.diagnoses)


@query
def dashboard_by_platform(spark, sf_dir):
    found = plan(spark, sf_dir)
    return marts.by_platform(found.incidents, found.pipelines)


@query
def dashboard_avg_confidence(spark, sf_dir):
    return marts.average_confidence(plan(spark, sf_dir, answers=True).diagnoses)


@query
def dashboard_distribution(spark, sf_dir):
    found = plan(spark, sf_dir, answers=True)
    counts = marts.by_category(found.incidents, found.diagnoses)
    return marts.distribution(counts, "category").select("category", "label", "incidents", "share")


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pipelines against all runs."""
    events = feeds.runs(spark, sf_dir)
    pipelines = entities.pipelines(events)
    runs = entities.runs(events.withColumns({
        "trigger": F.lit("scheduled"), "config_snapshot": F.lit("{}"),
        "started_at": F.col("received_at"), "ended_at": F.col("received_at")}))
    return marts.pipeline_health(pipelines, runs)


@query
def pipeline_health(spark, sf_dir):
    return _health(spark, sf_dir).select(
        "pipeline_id", "name", "platform", "pipeline_external_id", "run_count", "failed_count")


@query
def pipeline_failure_rate(spark, sf_dir):
    return _health(spark, sf_dir).select("pipeline_id", "failure_rate", "failure_band")


@query
def age_bucket(spark, sf_dir):
    moment = F.col("ts").cast("timestamp")
    as_of = F.lit("2024-01-02 12:00:00").cast("timestamp")
    return feeds.table(spark, sf_dir, "events").select(
        "event_id", moments.age_bucket(moment, as_of).alias("age"))


@query
def confidence_band(spark, sf_dir):
    share = (F.col("l_partkey") % 101).cast("double") / 100
    score = F.when(F.col("l_suppkey") % 7 > 0, share)
    return feeds.table(spark, sf_dir, "lineitem").select(
        score.alias("confidence"), labels.confidence_band(score).alias("band"),
        labels.confidence_percent(score).alias("percent")).distinct()


@query
def category_label(spark, sf_dir):
    number = F.col("l_partkey") % 15
    category = F.when(number < 14, feeds.choose(number, fv.CATEGORIES))
    return feeds.table(spark, sf_dir, "lineitem").select(
        category.alias("category"), labels.category_label(category).alias("label")).groupBy(
        "category", "label").agg(F.count(F.lit(1)).alias("n"))


# --- streaming -----------------------------------------------------------------------------------

def _stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = feeds.table(spark, sf_dir, name).schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 100)
        .option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    )


@query
def stream_ingest(spark, sf_dir):
    raw = feeds.airflow_feed_from(_stream_of(spark, sf_dir, "orders"))
    found = jobs.failures_stream(raw, airflow.normalize).select(
        "event_id", "workspace_id", "fingerprint", "task_name", "node_type", "rule_id")
    out = scratch_path(spark, "stream-ingest")
    jobs.run_to_files(found, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").withColumn("rule_id", F.col("rule_id").cast("long"))


@query
def stream_incidents(spark, sf_dir):
    timeline = feeds.lifecycle_from(_stream_of(spark, sf_dir, "events"))
    out = scratch_path(spark, "stream-incidents")
    jobs.run_to_files(track(timeline), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.select("workspace_id", "fingerprint", "event_id", "kind", "incident_seq")


@query
def stream_dashboard(spark, sf_dir):
    timeline = feeds.lifecycle_from(_stream_of(spark, sf_dir, "events"))
    out = scratch_path(spark, "stream-dashboard")
    jobs.live_totals(timeline, f"{out}/totals", f"{out}/checkpoint").awaitTermination()
    totals = spark.read.parquet(f"{out}/totals/batch=*")
    return totals.orderBy(F.desc("batch_id")).limit(1).drop("batch_id")


@query
def stream_jumbled(spark, sf_dir):
    """Rows up to a day out of order over several micro-batches give the incidents of the batch."""
    out = scratch_path(spark, "stream-jumbled")
    rows = feeds.jumbled_stream(feeds.lifecycle(spark, sf_dir), f"{out}/in")
    followed = lifecycle.follow(rows, "2 days")
    jobs.run_to_files(followed, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(
        "workspace_id", "fingerprint", "event_id", "kind", "incident_seq", "reason", "recurrence_note")


@query
def stream_upsert(spark, sf_dir):
    """The incident table kept by a stream: every micro-batch is merged into it."""
    out = scratch_path(spark, "stream-upsert")
    rows = lifecycle.incident_rows(lifecycle.follow(
        feeds.jumbled_stream(feeds.lifecycle(spark, sf_dir), f"{out}/in"), "2 days"))
    merge.merge_stream(rows, f"{out}/incidents", ["incident_id"], ["at", "event_id"], "dt",
                       f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/incidents").select(
        "incident_id", "status", "occurrence_count", F.unix_micros("first_seen_at").alias("first_us"),
        F.unix_micros("last_seen_at").alias("last_us"), "resolution_notes")


def _followed(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    """The history of all failures with status changes, answers of a model and feedback, as a stream."""
    found = plan(spark, sf_dir, answers=True, wanted=("template", "rule_id", "evidence", "curated"))
    keyed = found.incidents.select("incident_id", "workspace_id", "fingerprint", F.col("incident_seq").alias("target_seq"))
    answers = found.diagnoses.filter(F.col("engine") != "rules").join(keyed, "incident_id").select(
        "workspace_id", "fingerprint", "target_seq", F.col("created_at").alias("at"),
        F.col("diagnosis_id").alias("event_id"), "engine", "category", "confidence")
    asked = feeds.feedback(found.incidents).join(keyed, "incident_id").select(
        "workspace_id", "fingerprint", "target_seq", "at", "event_id")
    rows = lifecycle.history(found.stored, feeds.status_events(found.stored), answers, asked)
    return lifecycle.follow(feeds.jumbled_stream(rows, f"{out}/in"), "2 days")


@query
def stream_feedback(spark, sf_dir):
    """The diagnosis that each feedback was given on, from the state, over several micro-batches."""
    out = scratch_path(spark, "stream-feedback")
    jobs.run_to_files(_followed(spark, sf_dir, out), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    given = spark.read.parquet(f"{out}/rows").filter(F.col("kind") == "feedback")
    return given.select("event_id", "incident_id", "diagnosis_id", "reason")


@query
def stream_measures(spark, sf_dir):
    """Totals, categories, platforms and confidence after the last micro-batch, from signed changes."""
    out = scratch_path(spark, "stream-measures")
    jobs.live_dashboard(_followed(spark, sf_dir, out), f"{out}/totals", f"{out}/checkpoint").awaitTermination()
    return jobs.live_measures(jobs.newest(spark, f"{out}/totals"))


@query
def stream_health(spark, sf_dir):
    """Runs and failures per pipeline after the last micro-batch."""
    out = scratch_path(spark, "stream-health")
    feeds.runs(spark, sf_dir).repartition(4, "event_id").write.parquet(f"{out}/in")
    runs = spark.readStream.schema(feeds.runs(spark, sf_dir).schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    jobs.live_health(runs, f"{out}/health", f"{out}/checkpoint").awaitTermination()
    return jobs.newest(spark, f"{out}/health").select(
        *entities.PIPELINE_KEYS, F.col("seen.name").alias("name"), "run_count", "failed_count")


@query
def stream_diagnoses(spark, sf_dir):
    """Payload files in, stored incidents and diagnoses out, with the rows of the knowledge table that
    were known at each failure; payloads up to a day out of order over several micro-batches."""
    base = scratch_path(spark, "stream-diagnoses")
    feeds.stored_knowledge(spark, sf_dir).write.parquet(f"{base}/kb")
    # a failure long after all others: it waits in the state and lets the rest pass
    end = {"event_id": F.lit("end of stream"), "payload": F.lit('{"dag_id":"end","dag_run_id":"end","state":"failed"}')}
    raw = feeds.jumbled_stream(feeds.airflow_feed(spark, sf_dir), f"{base}/in", 4, "received_at", 3000, end)
    jobs.store_failures(raw, airflow.normalize, base).awaitTermination()
    jobs.diagnose_failures(spark, base, "1000 days", f"{base}/kb", files_per_batch=8).awaitTermination()
    given, counted = (spark.read.parquet(f"{base}/{t}") for t in ("diagnoses", "incidents"))
    return _diagnosis_rows(given).join(counted.select("incident_id", "occurrence_count"), "incident_id")
