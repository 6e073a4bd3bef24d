"""Incidents, their diagnoses and feedback followed as keyed state, in the order of events.

One stream holds four kinds of rows of a signature: failures, status changes, diagnoses by a model and
feedback.  Rows wait in the state until the watermark has passed them and are then taken in order, so
micro-batches may bring them in any order; rows behind the watermark are given out with a reason.
"""

import hashlib
import json
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import diagnosis
from ..operators.incidents import KEYS, NOT_OPEN, SUPERSEDED, recurrence_note
from ..rules import fixed_values as fv
from ..rules.ruleset import BUILT_IN, RuleSet
from ..session import ship
from ..sources.merge import period

LATE = "behind the watermark"
CLOSING = fv.CLOSING_STATUSES

#: Stretch of time whose rows of one signature are unpacked together.
SLOT_SECONDS = 3600
_SLOT = SLOT_SECONDS * 1_000_000
#: Incidents of a signature whose diagnoses are unpacked together.
INCIDENTS_TOGETHER = 64
#: Rows given out at once.
CHUNK = 10_000

#: Groups that signatures are dealt to.  A call of the state costs milliseconds whatever it brings, so one
#: call serves all signatures of a group; a checkpoint keeps the number it was begun with.
GROUPS = 4096
#: Packed signatures by name, and when each that has rows waiting is due.
_STATE = "signatures map<string,binary>, due map<string,long>"
_NOTHING = (0, "", 0, 0, 0, None, "", 0, 0, None, "")
_ROW = (
    "at_micros long, turn int, event_id string, kind string, status string, notes string, run_id string, "
    "target_seq long, platform string, category string, confidence double, engine string")
_FIELDS = [field.split(" ")[0] for field in _ROW.split(", ")]
_OUT = (
    "workspace_id string, fingerprint string, event_id string, at_micros long, kind string, run_id string, "
    "incident_seq long, opened boolean, deduplicated boolean, reason string, was_status string, status string, "
    "occurrence_count long, platform string, was_category string, category string, was_confidence double, "
    "confidence double, engine string, diagnosis_id string, prior_count long, prior_resolved_micros long, prior_notes string, first_seen_micros long, last_seen_micros long, "
    "resolved_micros long, notes string")
_COLUMNS = [field.split(" ")[0] for field in _OUT.split(", ")]


def short_key(*parts) -> str:
    """``text.short_id`` outside of an expression."""
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:32]


class Packed:
    """Lists by number, packed until one is asked for; an empty list is none."""

    def __init__(self, packed: dict[int, bytes]):
        self._packed, self._open = packed, {}

    def of(self, number: int) -> list:
        """The list of a number, to be changed in place."""
        if number not in self._open:
            packed = self._packed.get(number)
            self._open[number] = [tuple(row) for row in json.loads(zlib.decompress(packed))] if packed else []
        return self._open[number]

    def close(self, number: int) -> None:
        """Pack a list again."""
        made = self._open.pop(number, None)
        if made:
            self._packed[number] = zlib.compress(json.dumps(made, separators=(",", ":")).encode(), 1)
        elif made is not None:
            self._packed.pop(number, None)

    def numbers(self) -> list[int]:
        return sorted(self._packed.keys() | self._open.keys())

    def packed(self) -> dict[int, bytes]:
        for number in [*self._open]:
            self.close(number)
        return self._packed


class Signature:
    """The state of one signature while rows are folded into it: the newest incident, rows not yet passed by
    the watermark in slots of time, and the diagnoses of every incident."""

    def __init__(self, name: str, stored: bytes | None):
        self.key = tuple(json.loads(name).values())
        now, waiting, given = pickle.loads(stored) if stored else (_NOTHING, {}, {})
        (self.seq, self.status, self.count, self.first, self.last, self.resolved, self.notes, *self.prior) = now
        self.waiting, self.given = Packed(waiting), Packed(given)

    def stored(self) -> bytes:
        now = (self.seq, self.status, self.count, self.first, self.last, self.resolved, self.notes, *self.prior)
        return pickle.dumps((now, self.waiting.packed(), self.given.packed()), 5)

    def wait(self, row: tuple) -> None:
        self.waiting.of(row[0] // _SLOT).append(row)

    def take(self, passed: int) -> Iterator[dict]:
        """Fold the rows that the watermark has passed."""
        for slot in self.waiting.numbers():  # one slot's rows are unpacked
            if slot * _SLOT >= passed:
                break
            rows = self.waiting.of(slot)
            ready = {r[:3]: r for r in rows if r[0] < passed}  # a row that came twice counts once
            rows[:] = [r for r in rows if r[0] >= passed]
            self.waiting.close(slot)
            yield from map(self.fold, [ready[k] for k in sorted(ready)])

    def due(self, passed: int) -> int | None:
        """When the watermark may pass a row again."""
        slots = self.waiting.numbers()
        return max(passed, slots[0] * _SLOT) if slots else None

    def diagnoses(self, seq: int) -> list[tuple]:
        """(created, id, category, confidence) of an incident's diagnoses in order: what was known when."""
        return [made[1:] for made in self.given.of(seq // INCIDENTS_TOGETHER) if made[0] == seq]

    def diagnose(self, seq: int, at: int, engine: str, category: str, confidence: float) -> tuple:
        """Enter a diagnosis; gives its id and the newest one before and after."""
        known = self.diagnoses(seq)
        made = at, short_key(short_key(*self.key, seq), engine, at), category, confidence
        before = known[-1] if known else None
        known.append(made)
        known.sort(key=lambda d: d[:2])
        block = self.given.of(seq // INCIDENTS_TOGETHER)
        block[:] = [d for d in block if d[0] != seq] + [(seq, *d) for d in known]
        return made[1], before, known[-1]

    def fold(self, row: tuple) -> dict:
        """Take one row; gives what changed."""
        at, _, event_id, kind, status, notes, run_id, target, platform, category, confidence, engine = row
        made = dict.fromkeys(_COLUMNS)
        made |= {"workspace_id": self.key[0], "fingerprint": self.key[1], "event_id": event_id, "at_micros": at, "kind": kind,
                 "run_id": run_id, "opened": False, "deduplicated": False, "reason": "", "platform": platform}
        aimed = self.seq if target is None else target
        if kind == "failure":
            self._failure(made, at, category, confidence)
        elif kind == "status":
            made["was_status"] = self.status if self.seq else None
            if aimed != self.seq:
                made["reason"] = SUPERSEDED if aimed < self.seq else NOT_OPEN
            elif self.seq:
                self.status, self.notes = status, notes or self.notes
                self.resolved = at if status == "resolved" else self.resolved
        elif kind == "diagnosis":
            if 0 < aimed <= self.seq:
                made["diagnosis_id"], before, after = self.diagnose(aimed, at, engine, category, confidence)
                if before != after:
                    made["was_category"], made["was_confidence"] = before[2:] if before else (None, None)
                    made["category"], made["confidence"] = after[2:]
                made["engine"] = engine
            else:
                made["reason"] = NOT_OPEN
        elif kind == "feedback":
            before = [d for d in (self.diagnoses(aimed) if 0 < aimed <= self.seq else []) if d[0] <= at]
            made["diagnosis_id"] = before[-1][1] if before else None
        made |= {"incident_seq": aimed if kind in ("diagnosis", "feedback") else self.seq,
                 "status": self.status if self.seq else None, "occurrence_count": self.count,
                 "first_seen_micros": self.first if self.seq else None, "last_seen_micros": self.last if self.seq else None,
                 "resolved_micros": self.resolved, "notes": self.notes}
        return made

    def _failure(self, made: dict, at: int, category: str | None, confidence: float | None) -> None:
        if self.seq == 0 or self.status in CLOSING:
            if self.status == "resolved":
                self.prior = [self.seq, self.count, self.resolved, self.notes]
            self.seq, self.status, self.count, self.first = self.seq + 1, "open", 0, at
            self.resolved, self.notes = None, ""
            made["opened"] = True
            if category is not None:
                made["diagnosis_id"], _, _ = self.diagnose(self.seq, at, "rules", category, confidence)
                made["category"], made["confidence"], made["engine"] = category, confidence, "rules"
            if self.prior[0]:
                made["prior_count"], made["prior_resolved_micros"], made["prior_notes"] = self.prior[1:]
        else:
            made["deduplicated"], made["was_status"] = True, self.status
        self.count, self.last = self.count + 1, at


def _frames(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == CHUNK:
            yield _frame(held)
            held = []
    if held:
        yield _frame(held)


def _frame(rows: list[dict]) -> pd.DataFrame:
    # plain objects: most frames hold a row or two, and Arrow takes them as typed columns anyway
    cells = np.empty((len(rows), len(_COLUMNS)), dtype=object)
    for place, row in enumerate(rows):
        cells[place] = [row[name] for name in _COLUMNS]
    return pd.DataFrame(cells, columns=_COLUMNS)


def _rows(frame: pd.DataFrame) -> Iterator[tuple[str, tuple]]:
    """Names of signatures and their rows."""
    for name, text in zip(frame["name"], frame["row"], strict=True):
        row = json.loads(text)
        confidence = row["confidence"]  # numbers beyond all are texts in JSON
        yield name, tuple({**row, "confidence": None if confidence is None else float(confidence)}.values())


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Take the rows that a micro-batch brings for a group of signatures, and fold those that the watermark
    has passed; signatures that neither get rows nor are due stay packed."""
    passed = max(0, state.getCurrentWatermarkMs()) * 1000
    stored, due = map(dict, state.get if state.exists else ({}, {}))
    known: dict[str, Signature] = {}
    unpacked = 0
    for frame in frames:
        late = []
        for name, row in _rows(frame):
            if passed > 0 and row[0] < passed:
                late.append({**dict.fromkeys(_COLUMNS), **dict(zip(_FIELDS, row, strict=True)), "reason": LATE,
                             **json.loads(name), "opened": False, "deduplicated": False})
                continue
            if name not in known:
                known[name] = Signature(name, stored.get(name))
            known[name].wait(row)
            unpacked += 1
        if unpacked > CHUNK:
            for signature in known.values():
                signature.waiting.packed()
            unpacked = 0
        yield from _frames(iter(late))

    def folded() -> Iterator[dict]:
        for name in sorted(known.keys() | {name for name, at in due.items() if at < passed}):
            signature = known.pop(name, None) or Signature(name, stored.get(name))
            yield from signature.take(passed)
            stored[name], at = signature.stored(), signature.due(passed)
            due.pop(name, None)
            if at is not None:
                due[name] = at

    yield from _frames(folded())
    state.update((stored, due))
    if due:  # called again when the watermark moves on beyond
        state.setTimeoutTimestamp(max(1, passed // 1000, min(due.values()) // 1000))


def history(failures: DataFrame, status_events: DataFrame, answers: DataFrame | None = None,
            feedback: DataFrame | None = None, rule_set: RuleSet = BUILT_IN) -> DataFrame:
    """The four kinds of rows as one.

    ``failures``: failure records with rule_id; their rule gives category and confidence.
    ``status_events``: as in batch, ``target_seq`` optional.  ``answers``: KEYS, target_seq, at, event_id,
    engine, category, confidence.  ``feedback``: KEYS, target_seq, at, event_id.
    """
    rules = F.broadcast(diagnosis.rule_table(failures.sparkSession, rule_set).select(  # a row per rule
        F.col("rule_id").alias("__rule"), "category", "confidence"))
    opened = failures.withColumn("__rule", F.coalesce("rule_id", F.lit(0))).join(rules, "__rule").select(
        *KEYS, F.col("received_at").alias("at"), "event_id", F.lit("failure").alias("kind"), "run_id", "platform",
        "category", "confidence")
    made = opened.unionByName(status_events.withColumn("kind", F.lit("status")), allowMissingColumns=True)
    if answers is not None:
        made = made.unionByName(answers.withColumn("kind", F.lit("diagnosis")), allowMissingColumns=True)
    if feedback is not None:
        made = made.unionByName(feedback.withColumn("kind", F.lit("feedback")), allowMissingColumns=True)
    return made


def follow(rows: DataFrame, delay: str) -> DataFrame:
    """What every row of a history changes, in the order of events.

    ``rows``: KEYS, at, event_id, kind and, where given, status, notes, run_id, target_seq, platform,
    category, confidence, engine.  ``(at, event_id)`` is the order of a signature, at equal times
    feedback comes last.  A row comes out once the watermark, ``delay`` behind the newest row, has passed it;
    rows that come in behind it are given out at once with a reason and change nothing.  Status changes,
    diagnoses and feedback aim at ``target_seq``, else at the newest incident.

    A row that comes twice counts once or is late.  Rows wait packed, in slots of an hour; a task holds the
    packed rows of one of ``GROUPS`` groups of signatures and unpacks a slot of one signature at a time.
    State never expires: incidents do not.
    """
    kinds = dict(status="string", notes="string", run_id="string", target_seq="long", platform="string", category="string",
                 confidence="double", engine="string")
    known = rows.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in rows.columns})
    ship(rows.sparkSession)
    row = known.withWatermark("at", delay).select(
        *KEYS, F.unix_micros("at").alias("at_micros"), (F.col("kind") == "feedback").cast("int").alias("turn"), "event_id",
        "kind", "status", F.coalesce("notes", F.lit("")).alias("notes"), "run_id", "target_seq", "platform", "category",
        F.nanvl("confidence", F.lit(None)).alias("confidence"), "engine")
    # in place of the watermarked column one that is never late: the state sees late rows, which Spark would drop unseen
    never = F.lit(None).cast("long").alias("never", metadata={"spark.watermarkDelayMs": 0})
    group = F.pmod(F.xxhash64(*KEYS), F.lit(GROUPS)).alias("group")
    whole = {"ignoreNullFields": "false"}
    slim = row.select(group, F.to_json(F.struct(*KEYS), whole).alias("name"), F.to_json(F.struct(*_FIELDS), whole).alias("row"), never)
    found = slim.groupBy("group").applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(
        *KEYS, "event_id", F.timestamp_micros("at_micros").alias("at"), "kind", "run_id", "incident_seq",
        diagnosis.short_id(*[F.col(k) for k in KEYS], F.col("incident_seq").cast("string")).alias("incident_id"),
        "opened", "deduplicated", "reason", "was_status", "status", "occurrence_count", "platform", "was_category",
        "category", "was_confidence", "confidence", "engine", "diagnosis_id",
        recurrence_note(F.col("prior_count"), F.timestamp_micros("prior_resolved_micros"), F.col("prior_notes"))
        .alias("recurrence_note"),
        F.timestamp_micros("first_seen_micros").alias("first_seen_at"),
        F.timestamp_micros("last_seen_micros").alias("last_seen_at"),
        F.timestamp_micros("resolved_micros").alias("resolved_at"), F.col("notes").alias("resolution_notes"))


def incident_rows(followed: DataFrame) -> DataFrame:
    """The state of an incident after each of its rows, for a table that is merged by incident_id and
    ``(at, event_id)`` in partitions ``dt`` of the month in which it opened."""
    own = F.col("kind").isin("failure", "status") & (F.col("reason") == "") & (F.col("incident_seq") > 0)
    return followed.filter(own).select(
        "incident_id", *KEYS, "incident_seq", "at", "event_id", "status", "occurrence_count", "first_seen_at",
        "last_seen_at", "resolved_at", "resolution_notes", period("first_seen_at").alias("dt"))
