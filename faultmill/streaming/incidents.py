"""Incident life cycle as keyed streaming state; gives the rows the batch operator gives."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import short_id
from ..operators.incidents import KEYS
from ..rules import fixed_values as fv
from ..rules.wording import recurrence_text
from ..session import ship

_STATE = (
    "seq long, status string, count long, first_seen long, last_seen long, resolved_at long, "
    "notes string, prior_seq long, prior_count long, prior_resolved_at long, prior_notes string"
)
_EMPTY = (0, "", 0, 0, 0, None, "", 0, 0, None, "")
_OUT = (
    "workspace_id string, fingerprint string, event_id string, at_micros long, kind string, "
    "run_id string, incident_seq long, deduplicated boolean, stale boolean, was_status string, "
    "occurrence_count long, first_seen_micros long, last_seen_micros long, status string, "
    "resolved_micros long, notes string, prior_seq long, prior_count long, "
    "prior_resolved_micros long, prior_notes string"
)
_SLICE = ("incident_seq", "status", "first_seen_micros", "resolved_micros", "notes", "prior_seq",
          "prior_count", "prior_resolved_micros", "prior_notes")


def _advance(key: tuple, batches: Iterator[pd.DataFrame],
             state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold the rows a micro-batch holds for one signature into its state.

    Failures between two status rows change the state alike, so they are handled as one slice;
    the loop runs over status rows, which people make.
    """
    rows = pd.concat(list(batches), ignore_index=True).sort_values(
        ["at_micros", "event_id"], ignore_index=True)
    seq, status, count, first, last, resolved, notes, *prior = state.get if state.exists else _EMPTY
    size = len(rows)
    at = rows["at_micros"].to_numpy()
    is_status = (rows["kind"] == "status").to_numpy()
    folded, stale = np.ones(size, dtype=bool), np.zeros(size, dtype=bool)
    # state after each slice of rows, its length, and the status before its first row
    after, lengths, before, counts, seen = [], [], [], np.zeros(size, np.int64), np.zeros(size, np.int64)
    start = 0
    for stop in [*np.flatnonzero(is_status), size]:
        if stop > start:
            was = status if seq else None
            if seq == 0 or status in fv.CLOSING_STATUSES:
                if status == "resolved":
                    prior = [seq, count, resolved, notes]
                seq, status, count, first = seq + 1, "open", 0, int(at[start])
                resolved, notes = None, ""
                folded[start] = False
                was = None
            last = int(at[stop - 1])
            counts[start:stop] = np.arange(count + 1, count + stop - start + 1)
            seen[start:stop] = at[start:stop]
            count += stop - start
            before.append(was)
            lengths.append(stop - start)
            after.append((seq, status, first, resolved, notes, *prior))
        if stop < size:
            change = rows.iloc[stop]
            aimed = change["target_seq"]
            stale[stop] = seq == 0 or (not pd.isna(aimed) and int(aimed) != seq)
            before.append(status if seq else None)
            if not stale[stop]:
                status = change["status"]
                notes = change["notes"] or notes
                resolved = int(at[stop]) if status == "resolved" else resolved
            counts[stop], seen[stop] = count, last
            lengths.append(1)
            after.append((seq, status, first, resolved, notes, *prior))
        start = stop + 1
    state.update((seq, status, count, first, last, resolved, notes, *prior))
    of_row = np.repeat(np.arange(len(after)), lengths)
    out = pd.DataFrame(after, columns=list(_SLICE), dtype=object).iloc[of_row].reset_index(drop=True)
    # inside a slice of failures the status before a row is the one after the row ahead of it
    heads = np.append(True, of_row[1:] != of_row[:-1]) if size else np.empty(0, bool)
    out["was_status"] = np.where(heads, np.array(before, object)[of_row], out["status"])
    out["workspace_id"], out["fingerprint"] = key
    out = out.assign(
        event_id=rows["event_id"], at_micros=at, kind=rows["kind"], run_id=rows["run_id"],
        occurrence_count=counts, last_seen_micros=seen,
        deduplicated=np.where(is_status, False, folded), stale=stale)
    yield out[[column.split()[0] for column in _OUT.split(", ")]]


def track(timeline: DataFrame) -> DataFrame:
    """Streaming islands: one row per timeline row with its incident and the state after it.

    Within a micro-batch rows are ordered by (at, event_id), across batches by arrival.  State
    never expires.  A micro-batch, and so the rows of one key handled together, is bounded by the
    source's rate option; only ids and times reach Python, never log text.
    """
    if "target_seq" not in timeline.columns:
        timeline = timeline.withColumn("target_seq", F.lit(None).cast("long"))
    slim = timeline.select(
        *KEYS, "event_id", F.unix_micros("at").alias("at_micros"), "kind", "status",
        F.coalesce("notes", F.lit("")).alias("notes"), "run_id", "target_seq")
    ship(timeline.sparkSession)
    tracked = slim.groupBy(*KEYS).applyInPandasWithState(
        _advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    before, resolved, end, notes = (F.lit(piece) for piece in recurrence_text())
    prior_moment = F.timestamp_micros("prior_resolved_micros")
    note = F.concat(
        before, F.col("prior_count").cast("string"), resolved,
        F.date_format(prior_moment, "yyyy-MM-dd"), end,
        F.when(F.col("prior_notes") != "", F.concat(notes, F.col("prior_notes"))).otherwise(""))
    return tracked.select(
        *KEYS, "event_id", F.timestamp_micros("at_micros").alias("at"), "kind", "run_id",
        "incident_seq",
        short_id(*[F.col(k) for k in KEYS], F.col("incident_seq").cast("string"))
        .alias("incident_id"),
        "deduplicated", "stale", "was_status", "occurrence_count",
        F.timestamp_micros("first_seen_micros").alias("first_seen_at"),
        F.timestamp_micros("last_seen_micros").alias("last_seen_at"), "status",
        F.timestamp_micros("resolved_micros").alias("resolved_at"),
        F.col("notes").alias("resolution_notes"),
        F.when(F.col("prior_seq") > 0, note).otherwise("").alias("recurrence_note"))
