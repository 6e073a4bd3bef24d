"""Incident life cycle: from a timeline of failures and status changes to incidents.

Timeline columns: workspace_id, fingerprint, at, event_id, kind (``failure`` or ``status``),
status, notes, run_id, and optionally target_seq, the incident that a status row is aimed at.
``(at, event_id)`` is the total order of a signature.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_id
from ..rules import fixed_values as fv
from ..rules.wording import recurrence_text
from ..session import materialize, ship
from .ordered import RANGE, in_ranges, ranged, time_bucket, with_previous

KEYS = ["workspace_id", "fingerprint"]
ORDER = ["at", "event_id"]
# incidents of one signature scanned together when looking for an earlier resolution
INCIDENTS_PER_BUCKET = 4096


def timeline(failures: DataFrame, status_events: DataFrame) -> DataFrame:
    """Failures and status changes as one ordered history."""
    aimed = ["target_seq"] if "target_seq" in status_events.columns else []
    return failures.select(
        *KEYS, F.col("received_at").alias("at"), "event_id",
        F.lit("failure").alias("kind"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("notes"), "run_id",
        *[F.lit(None).cast("long").alias(c) for c in aimed],
    ).unionByName(status_events.select(
        *KEYS, "at", "event_id", F.lit("status").alias("kind"), "status", "notes",
        F.lit(None).cast("string").alias("run_id"), *aimed))


def _cut(events: DataFrame, bucket_seconds: int | None) -> DataFrame:
    """Events with ``__bucket``: ranges of rows, drawn here unless they are, or stretches of time."""
    if bucket_seconds is not None:
        return events.withColumn("__bucket", time_bucket(F.col("at"), bucket_seconds))
    if RANGE not in events.columns:
        events = in_ranges(events, KEYS, ORDER)
    return events.withColumnRenamed(RANGE, "__bucket")


def islands(events: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """Adds ``incident_seq``, which incident of its signature a row belongs to, from 1, and
    ``opening``, whether the row opened it.

    A failure opens an incident when it is the first of its signature or when the row before it
    closed the incident; every other row belongs to the newest one.  Status rows before the first
    failure have nothing to act on and get 0.

    One signature may hold any share of the rows, also of one moment's rows: the history is cut into
    ranges of like numbers of rows, and a scan over one summary per range (closed or not, openings,
    how its first failure is entered) tells what a range begins with.  ``bucket_seconds`` cuts by time
    instead, which stores nothing, for histories without crowded stretches; events that
    ``ordered.in_ranges`` has cut already are used as they are.  The scanned rows are stored, and not the
    ranges: both the summaries and the rows themselves are read from there.
    """
    if bucket_seconds is None and RANGE not in events.columns:
        events = ranged(events, KEYS, ORDER)
    failure = F.col("kind") == "failure"
    closing = ~failure & F.col("status").isin(*fv.CLOSING_STATUSES)
    inside = Window.partitionBy(*KEYS, "__bucket").orderBy(*ORDER)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    rows = (
        _cut(events, bucket_seconds)
        .withColumn("__before", F.lag(closing).over(inside))
        .withColumns({
            "__reopens": (failure & F.coalesce(F.col("__before"), F.lit(False))).cast("long"),
            "__failures": F.sum(failure.cast("long")).over(running),
        })
        .withColumn("__inner", F.sum("__reopens").over(running))
    )
    if bucket_seconds is None:
        rows = materialize(rows, "scanned")
    # how the first failure of a bucket is entered: 0 at its start, 1 after a closing row, which
    # is counted already, 2 after another status row
    entry = F.when(failure & (F.col("__failures") == 1),
                   F.when(F.col("__before").isNull(), 0).when(F.col("__before"), 1).otherwise(2))
    buckets = rows.groupBy(*KEYS, "__bucket").agg(
        F.max_by(closing, F.struct(*ORDER)).alias("__closed"),
        F.min(entry).alias("__entry"),
        F.sum("__reopens").alias("__openings"),
        F.sum(failure.cast("long")).alias("__count"),
    )
    along = Window.partitionBy(*KEYS).orderBy("__bucket")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    first_ever = F.coalesce(F.sum("__count").over(earlier), F.lit(0)) == 0
    buckets = (
        buckets.withColumn("__opens", F.when(
            ((F.col("__entry") == 0)
             & (first_ever | F.coalesce(F.lag("__closed").over(along), F.lit(False))))
            | ((F.col("__entry") == 2) & first_ever), 1).otherwise(0))
        .withColumn("__base", F.coalesce(
            F.sum(F.col("__openings") + F.col("__opens")).over(earlier), F.lit(0)))
        .select(*KEYS, "__bucket", "__opens", "__base")
    )
    return (
        rows.join(buckets, [*KEYS, "__bucket"])
        .withColumn("incident_seq", (
            F.col("__base") + F.col("__inner")
            + F.when(F.col("__failures") > 0, F.col("__opens")).otherwise(0)).cast("long"))
        .withColumn("opening", failure & (
            (F.col("__reopens") == 1) | ((F.col("__failures") == 1) & (F.col("__opens") == 1))))
        .drop("__bucket", "__before", "__reopens", "__failures", "__inner", "__opens", "__base")
    )


def incident_id(sequence: Column) -> Column:
    return short_id(F.col("workspace_id"), F.col("fingerprint"), sequence.cast("string"))


def rollup(members: DataFrame) -> DataFrame:
    """One row per incident from rows with ``incident_seq``: counts, times, folded status."""
    failure = F.col("kind") == "failure"
    order = F.struct(*ORDER)
    by_failure, by_status = F.when(failure, order), F.when(~failure, order)
    resolved = ~failure & (F.col("status") == "resolved")
    noted = ~failure & (F.coalesce(F.col("notes"), F.lit("")) != "")
    return (
        members.filter(F.col("incident_seq") > 0)
        .groupBy(*KEYS, "incident_seq")
        .agg(
            F.count_if(failure).alias("occurrence_count"),
            F.min(F.when(failure, F.col("at"))).alias("first_seen_at"),
            F.max(F.when(failure, F.col("at"))).alias("last_seen_at"),
            F.min_by("event_id", by_failure).alias("opening_event_id"),
            F.max_by("run_id", by_failure).alias("run_id"),
            F.coalesce(F.max_by("status", by_status), F.lit("open")).alias("status"),
            F.max(F.when(resolved, F.col("at"))).alias("resolved_at"),
            F.coalesce(F.max_by("notes", F.when(noted, order)), F.lit(""))
            .alias("resolution_notes"),
        )
        .withColumn("incident_id", incident_id(F.col("incident_seq")))
    )


def acknowledgements(members: DataFrame) -> DataFrame:
    """Per failure: its incident and whether it folded into an existing one."""
    return members.filter(F.col("kind") == "failure").select(
        *KEYS, "event_id", "run_id", "at",
        incident_id(F.col("incident_seq")).alias("incident_id"), "incident_seq",
        (~F.col("opening")).alias("deduplicated"))


def recurrence_note(count: Column, resolved_at: Column, notes: Column) -> Column:
    """What is told of an earlier incident that ended resolved; empty where there is none."""
    before, resolved, end, noted = (F.lit(piece) for piece in recurrence_text())
    text = F.concat(
        before, count.cast("string"), resolved, F.date_format(resolved_at, "yyyy-MM-dd"), end,
        F.when(notes != "", F.concat(noted, notes)).otherwise(""))
    return F.when(count.isNotNull(), text).otherwise("")


def with_recurrence(incidents: DataFrame) -> DataFrame:
    """Adds the newest earlier incident of the signature that ended resolved, and the note.

    An incident can only open after the one before it was closed, and closed incidents no longer
    change, so the final state of an earlier incident is its state at that moment.
    """
    prior = F.when(F.col("status") == "resolved", F.struct(
        F.col("incident_id").alias("id"), F.col("occurrence_count").alias("count"),
        F.col("resolved_at").alias("resolved_at"), F.col("resolution_notes").alias("notes")))
    bucket = F.floor(F.col("incident_seq") / INCIDENTS_PER_BUCKET).cast("long")
    found = F.col("prior")
    return (
        with_previous(incidents, KEYS, ["incident_seq"], bucket, prior, "prior")
        .withColumn("recurrence_note", recurrence_note(found["count"], found["resolved_at"], found["notes"]))
        .withColumns({
            "prior_incident_id": found["id"], "prior_count": found["count"],
            "prior_resolved_at": found["resolved_at"], "prior_notes": found["notes"]})
        .drop("prior")
    )


#: Why a status row is set apart.
SUPERSEDED = "incident superseded"
NOT_OPEN = "incident not open yet"


def _openings(status_rows: DataFrame, failures: DataFrame) -> DataFrame:
    """(keys, target_seq, opened): the moment each incident of a signature opens, from status rows with
    ``__opens``, the failure that would open the next one.

    Incident 1 opens at the first failure.  Incident s+1 opens where the first row aimed at s, after s
    opened, has an ``__opens``.  That is a scan along the numbers of a signature, done on one sorted
    stream of the closing rows alone, one row in hand.
    """
    first = failures.groupBy(*KEYS).agg(F.min(F.struct(*ORDER)).alias("__to")).select(
        *KEYS, F.lit(0).cast("long").alias("seq"), F.lit(None).cast("timestamp").alias("from_at"),
        F.lit(None).cast("string").alias("from_event"), F.col("__to.at").alias("to_at"),
        F.col("__to.event_id").alias("to_event"))
    closing = status_rows.filter(F.col("__opens").isNotNull()).select(
        *KEYS, F.col("target_seq").alias("seq"), F.col("at").alias("from_at"), F.col("event_id").alias("from_event"),
        F.col("__opens.at").alias("to_at"), F.col("__opens.event_id").alias("to_event"))
    steps = first.unionByName(closing)
    names = ["workspace_id", "fingerprint", "seq", "from_at", "from_event", "to_at", "to_event"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, opened = None, None, None
        for batch in batches:
            made = []
            for workspace, fingerprint, seq, *moments in zip(
                    *[batch.column(c).to_pylist() for c in names], strict=True):
                before, after = (moments[0], moments[1]), (moments[2], moments[3])
                if (workspace, fingerprint) != key:
                    key, at, opened = (workspace, fingerprint), None, None
                if seq == 0:
                    at, opened = 1, after
                elif seq == at and before > opened:
                    at, opened = at + 1, after
                else:
                    continue
                made.append((workspace, fingerprint, at, *opened))
            columns = list(zip(*made, strict=True)) if made else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()),
                                                strict=True)],
                ["workspace_id", "fingerprint", "target_seq", "micros", "event_id"])

    ship(steps.sparkSession)
    stream = steps.repartition(*KEYS).select(
        *KEYS, "seq", F.unix_micros("from_at").alias("from_at"), "from_event", F.unix_micros("to_at").alias("to_at"),
        "to_event").sortWithinPartitions(*KEYS, "seq", "from_at", "from_event")
    found = stream.mapInArrow(run, "workspace_id string, fingerprint string, target_seq long, micros long, event_id string")
    return found.select(*KEYS, "target_seq", F.struct(F.timestamp_micros("micros").alias("at"), "event_id").alias("opened"))


def split_stale_status(events: DataFrame, bucket_seconds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Set apart status rows aimed (``target_seq``) at an incident that is not the newest one.

    Returns (timeline to go on with, quarantined rows with ``reason``).  Every status row carries its
    target.  A row is superseded when a newer incident opened before it, and early when its own had not
    opened yet.

    Incident s+1 opens at the first failure met while the last status row aimed at s is a closing one.
    For every closing row that is the next failure of the signature, provided that no later row aimed at
    s comes before it.
    """
    moment = F.struct(*ORDER)
    columns = events.columns if RANGE in events.columns or bucket_seconds is not None else [*events.columns, RANGE]
    cut = _cut(events, bucket_seconds).withColumn(RANGE, F.col("__bucket")).withColumnRenamed("__bucket", "__cut")
    bucket = F.col("__cut")
    failure = F.col("kind") == "failure"
    status_rows = with_previous(
        cut, KEYS, ORDER, bucket, F.when(failure, moment), "__failure", reverse=True,
    ).filter(~failure)
    aimed = [*KEYS, "target_seq"]
    status_rows = with_previous(
        status_rows, aimed, ORDER, bucket, moment, "__same", reverse=True)
    status_rows = status_rows.withColumn("__opens", F.when(
        F.col("status").isin(*fv.CLOSING_STATUSES)
        & (F.col("__same").isNull() | (F.col("__failure") < F.col("__same"))),
        F.col("__failure")))
    opened = _openings(status_rows, cut.filter(failure))
    # both moments of an incident in one row: its own opening and the next one's
    turns = opened.select(*aimed, F.col("opened").alias("__own")).join(
        opened.select(*KEYS, (F.col("target_seq") - 1).alias("target_seq"), F.col("opened").alias("__next")), aimed, "full")
    judged = status_rows.join(turns, aimed, "left").withColumn(
        "reason", F.when(moment > F.col("__next"), SUPERSEDED).when(
            F.col("__own").isNull() | (moment < F.col("__own")), NOT_OPEN))
    kept = judged.filter(F.col("reason").isNull()).select(*columns)
    stale = judged.filter(F.col("reason").isNotNull()).select(*[c for c in columns if c != RANGE], "reason")
    return cut.filter(failure).select(*columns).unionByName(kept), stale


def status_changes(incidents: DataFrame, selected: DataFrame, event_prefix: str) -> DataFrame:
    """Status rows for selected incident ids (columns incident_id, status, notes, at)."""
    return (
        selected.join(incidents.select("incident_id", *KEYS, "incident_seq"), "incident_id")
        .select(*KEYS, "at",
                F.concat(F.lit(event_prefix), F.col("incident_id")).alias("event_id"),
                F.lit("status").alias("kind"), "status", "notes",
                F.lit(None).cast("string").alias("run_id"),
                F.col("incident_seq").alias("target_seq"))
    )


def apply_status_changes(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Fold later status rows into stored incidents.

    Any status may follow any; notes change only when given; the resolution time stays once set.
    """
    order = F.struct(*ORDER)
    noted = F.coalesce(F.col("notes"), F.lit("")) != ""
    folded = changes.groupBy(*KEYS, F.col("target_seq").alias("incident_seq")).agg(
        F.max_by("status", order).alias("__status"),
        F.max_by("notes", F.when(noted, order)).alias("__notes"),
        F.max(F.when(F.col("status") == "resolved", F.col("at"))).alias("__resolved_at"))
    return (
        incidents.join(folded, [*KEYS, "incident_seq"], "left")
        .withColumns({
            "status": F.coalesce("__status", "status"),
            "resolution_notes": F.coalesce("__notes", "resolution_notes"),
            "resolved_at": F.coalesce("__resolved_at", "resolved_at")})
        .drop("__status", "__notes", "__resolved_at")
    )
