"""Repair of conversation structure by a generalised LR parse with weighted edits."""

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Batches, column, in_batches

# The grammar of roles, s for system, u for user, a for assistant:
#   conversation -> nothing | body        body -> pair | s pair | body pair        pair -> u a
# and its LR states.  A stack is (state, stack below); the lowest one is START.
START, SYSTEM, USER, ASSISTANT, BODY = range(5)
STATES = (START, SYSTEM, USER, BODY)  #: tops that an edit can leave; ASSISTANT is reduced at once
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (BODY, "u"): USER, (USER, "a"): ASSISTANT}
ACCEPTED = (START, BODY)
ROLES = {"u": "user", "a": "assistant"}  #: roles that a rerole or an insertion can give
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  #: costs

#: Rows, and characters of text, after which a conversation goes on in a segment of its own.
SEGMENT_ROWS = 2048
SEGMENT_CHARS = 4 << 20

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"


def shifted(stack: tuple, initial: str) -> tuple | None:
    """The stack after a role, reduced as far as it goes; None where the grammar has no such role."""
    state = SHIFT.get((stack[0], initial))
    if state is None:
        return None
    stack = (state, stack)
    if state == ASSISTANT:  # pair -> u a
        below = stack[1][1]
        if below[0] in (SYSTEM, BODY):  # body -> s pair | body pair
            below = below[1]
        stack = (BODY, below)
    return stack


def stack_of(state: int) -> tuple:
    """The least stack with this top: what a segment may find when it begins."""
    return (START, None) if state == START else (state, (START, None))


Tops = dict[int, tuple[int, str, tuple]]


def merge(tops: Tops, cost: int, audit: str, stack: tuple) -> bool:
    """Enter a stack; of stacks with equal tops the one of least (cost, audit) stays.

    What may follow depends on the top alone, and of two prefixes of equal cost none begins the
    other, so the least prefix gives the least whole.
    """
    old = tops.get(stack[0])
    if old is None or (cost, audit) < old[:2]:
        tops[stack[0]] = cost, audit, stack
        return True
    return False


def insert(tops: Tops) -> None:
    """All insertions here, until no top gets better."""
    open_tops = list(tops)
    while open_tops:
        cost, audit, stack = tops[open_tops.pop()]
        for initial in ROLES:
            after = shifted(stack, initial)
            if after and merge(tops, cost + INSERT, audit + "I", after):
                open_tops.append(after[0])


def edit(tops: Tops, initial: str, must_go: bool, truncated: bool) -> Tops:
    """The tops after one row: deleted, kept or given a role, and insertions behind it."""
    made: Tops = {}
    for cost, audit, stack in tops.values():
        merge(made, cost + DELETE, audit + "D", stack)
        if must_go:
            continue
        for op, role, more in (("K", initial, KEEP), *(("R", r, REROLE) for r in ROLES)):
            after = shifted(stack, role)
            if after:
                merge(made, cost + more + (TRUNCATED if truncated else 0), audit + op, after)
    insert(made)
    return made


def apply(audit: str, state: int, rows: list[tuple[str, str]]) -> list[str]:
    """The lines ``role:text`` that the edits make of the rows, from an entry state."""
    lines, stack, at = [], stack_of(state), 0
    for op in audit:
        if op == "D":
            at += 1
            continue
        given = "a" if stack[0] == USER else "u"  # the one role a rerole or an insertion can give here
        role, text = (ROLES[given], "") if op == "I" else rows[at]
        if op == "K":
            given = role[:1]
        else:
            role = ROLES[given]
        at += op != "I"
        stack = shifted(stack, given)
        lines.append(f"{role}:{text}")
    return lines


class Segment:
    """Consecutive rows of one conversation: parses from every entry state, counts, rows."""

    def __init__(self, conv, first: bool):
        self.conv, self.first = conv, first
        self.tops: dict[int, Tops] = {}
        for state in (START,) if first else STATES:
            self.tops[state] = {state: (0, "", stack_of(state))}
            insert(self.tops[state])
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.chars = 0
        self.low = self.high = None
        self.rows: list[tuple[str, str]] = []

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        shown = text.rstrip(BLANKS)
        blank = not shown
        duplicate = not blank and repeated
        truncated = not blank and not duplicate and shown[-1] not in ENDS
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.rows:
            self.illegal += not legal(self.rows[-1][0][:1], role[:1])
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        for state, tops in self.tops.items():
            self.tops[state] = edit(tops, role[:1], blank or duplicate, truncated)
        self.rows.append((role, text))
        self.chars += len(text) + len(role)

    def record(self, part: int, number: int, last: bool) -> dict:
        """A row of the table of segments; a whole conversation is settled here and now."""
        whole = self.first and last
        made = {
            "conv": self.conv, "part": part, "number": number, "whole": whole, "low": self.low, "high": self.high,
            "turns": self.turns, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "head": self.rows[0][0][:1], "tail": self.rows[-1][0][:1],
            "paths": None, "roles": None, "texts": None, "cost": None, "audit": None, "repaired": None}
        if whole:
            cost, audit, _ = least(self.tops[START])
            made |= {"cost": cost, "audit": audit, "repaired": "\n".join(apply(audit, START, self.rows))}
        else:
            made |= {"roles": [r for r, _ in self.rows], "texts": [t for _, t in self.rows], "paths": [
                {"entry": entry, "leave": leave, "cost": cost, "audit": audit}
                for entry, tops in self.tops.items() for leave, (cost, audit, _) in tops.items()]}
        return made


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def least(tops: Tops) -> tuple[int, str, tuple]:
    """The best accepted parse; there is one, for all rows may go."""
    return min(tops[state] for state in ACCEPTED if state in tops)


_SEGMENTS = (
    "conv long, part int, number int, whole boolean, low long, high long, turns long, blank long, duplicate long, "
    "truncated long, illegal long, head string, tail string, "
    "paths array<struct<entry:int,leave:int,cost:long,audit:string>>, roles array<string>, texts array<string>, "
    "cost long, audit string, repaired string")


def _arrow_schema() -> pa.Schema:
    paths = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    fields = []
    for name, kind in (f.split(" ") for f in _SEGMENTS.replace("array<struct<entry:int,leave:int,cost:long,audit:string>>",
                                                               "paths").replace("array<string>", "texts").split(", ")):
        fields.append((name, paths if kind == "paths" else pa.list_(pa.string()) if kind == "texts" else kinds[kind]))
    return pa.schema(fields)


def segments_of(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, digest, first, several) in order to a row per segment.

    Rows are laid by ranges of (conversation, turn, role, text), so a conversation of any size
    spreads over partitions, and equal rows lie side by side.  The first and the last conversation of a
    partition may go on in others: they and overlong ones become segments parsed from every state.
    """
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("part"))
    schema = _arrow_schema()

    def run(batches: Batches) -> Batches:
        held, number, part, previous = None, 0, 0, None
        made: list[dict] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_pylist(made, schema)
            made.clear()
            return found

        for batch in batches:
            for row in zip(*[column(batch, c).to_pylist() for c in
                             ("conv", "turn", "role", "text", "digest", "first", "several", "part")], strict=True):
                conv, turn, role, text, digest, first, several, part = row
                if held is None:
                    held = Segment(conv, False)
                elif conv != held.conv or len(held.rows) >= SEGMENT_ROWS or held.chars >= SEGMENT_CHARS:
                    ends = conv != held.conv
                    made.append(held.record(part, number, ends))
                    size += held.chars
                    number += 1
                    held = Segment(conv, ends)
                    if size > SEGMENT_CHARS or len(made) >= 2000:
                        yield out()
                        size = 0
                repeated = several and (previous == (conv, turn, role, digest) or turn != first)
                held.add(turn, role, text, bool(repeated))
                previous = conv, turn, role, digest
        if held is not None:
            made.append(held.record(part, number, False))
        if made:
            yield out()

    return in_batches(laid, run, _SEGMENTS)


def prepared(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows with null roles and texts as one space, and what tells a row seen earlier: the first
    turn of equal (conversation, role, text), where there are several."""
    rows = df.select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.md5("text"))
    # a null turn is the first of all; only sets of several rows go into the join
    several = rows.groupBy("conv", "role", "digest").agg(
        F.count("*").alias("n"), F.min("turn").alias("low"), F.count("turn").alias("known")).where("n > 1").select(
        F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"),
        F.when(F.col("known") == F.col("n"), F.col("low")).alias("first"), F.lit(True).alias("several"))
    return rows.join(several, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                     & (F.col("digest") == F.col("d")), "left").drop("c", "r", "d")


class Joined:
    """The parse of one conversation out of its segments in order: edits and counts, no texts.

    Per top one chain of (cost, edits, entry state, chain before); chains share their beginnings.
    """

    def __init__(self, conv):
        self.conv = conv
        self.tops: dict[int, tuple | None] = {START: None}
        self.places: list[tuple[int, int]] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.tail = None

    def add(self, segment: dict) -> None:
        for name in self.counts:
            self.counts[name] += segment[name]
        if self.places:
            self.counts["illegal"] += not legal(self.tail, segment["head"])
        self.tail = segment["tail"]
        if segment["low"] is not None:
            self.counts["turns"] -= segment["low"] == self.high
            self.low = segment["low"] if self.low is None else self.low
            self.high = segment["high"]
        self.places.append((segment["part"], segment["number"]))
        after: dict[int, tuple] = {}
        for path in segment["paths"]:
            entry, leave = path["entry"], path["leave"]
            if entry in self.tops:
                before = self.tops[entry]
                new = (before[0] if before else 0) + path["cost"], path["audit"], entry, before
                if leave not in after or less(new, after[leave]):
                    after[leave] = new
        self.tops = after

    def result(self) -> dict:
        best = None
        for state in ACCEPTED:
            chain = self.tops.get(state)
            if chain and (best is None or less(chain, best)):
                best = chain
        edits, cost = [], best[0]
        while best:
            edits.append((best[2], best[1]))
            best = best[3]
        edits.reverse()
        return {"conv": self.conv, "low": self.low, "high": self.high, **self.counts, "cost": cost,
                "audit": "".join(audit for _, audit in edits),
                "pieces": [{"part": p, "number": n, "entry": entry, "edits": audit}
                           for (p, n), (entry, audit) in zip(self.places, edits, strict=True)]}


def less(a: tuple, b: tuple) -> bool:
    """Whether chain ``a`` has the smaller (cost, audit); only what the two do not share is compared."""
    if a[0] != b[0]:
        return a[0] < b[0]
    left, right = [], []
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[3], b[3]
    return "".join(reversed(left)) < "".join(reversed(right))


class Repair(NamedTuple):
    summary: DataFrame  #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    #: conv_id, piece, text, alone: the pieces of a conversation in order, joined by newlines, are its
    #: repaired text; ``alone`` is true where one piece is all
    texts: DataFrame


_COUNTS = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SETTLED = f"conv long, {_COUNTS}, pieces array<struct<part:int,number:int,entry:int,edits:string>>"


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> Repair:
    """Repair every conversation of ``df`` to the role grammar, by edits of least cost.

    Rows are taken by turn, null turns first, ties by role and then by the text's digest.  A row's
    first fault counts: blank, duplicate (role and text seen earlier), truncated.  Keeping a row costs
    0, another role 2, deletion 3 (and blank and duplicate rows must go), an inserted empty row 2, and
    a truncated row that stays 1.  Of edits of equal cost the ASCII-least initials count.  ``gaps`` are
    turns missing between the least and the largest.

    A graph-structured stack is kept per position: stacks with equal tops merge into the one of least
    (cost, audit).  A conversation may hold any share of the rows: it is parsed in segments, each from
    every top it may begin with, and the segments' results are joined in order; texts meet in no task.
    Its text comes as pieces of bounded size.

    Ids and turns are whole numbers.  Null roles and texts count as one space, a null conversation id as one conversation, a role that
    begins with none of s, u, a (or is empty) cannot stay.  Repeated rows are duplicates.  Columns
    other than the four named are ignored; an empty table gives empty results.
    """
    found = materialize(segments_of(prepared(df, conv_id, turn, role, text)), "segments")
    counted = ["low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = found.where("whole").select("conv", *counted)
    parts = found.where("NOT whole").select("conv", "part", "number", *counted[:-2], "head", "tail", "paths")

    def run(batches: Batches) -> Batches:
        """Segments come in order, conversation by conversation; what is in hand are the edits of one."""
        names = _SETTLED.split(", ")
        kinds = pa.list_(pa.struct([("part", pa.int32()), ("number", pa.int32()), ("entry", pa.int32()), ("edits", pa.string())]))
        schema = pa.schema([(n.split(" ")[0], kinds if n.startswith("pieces") else pa.string() if n.startswith("audit")
                             else pa.int64()) for n in names])
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv"] != held.conv:
                    yield pa.RecordBatch.from_pylist([held.result()], schema)
                    held = None
                held = held or Joined(row["conv"])
                held.add(row)
        if held:
            yield pa.RecordBatch.from_pylist([held.result()], schema)

    ordered = parts.repartition("conv").sortWithinPartitions("conv", "part", "number")
    settled = materialize(in_batches(ordered, run, _SETTLED), "settled")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    summary = whole.unionByName(settled.drop("pieces")).select(
        F.col("conv").alias("conv_id"), gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def write(batches: Batches) -> Batches:
        for batch in batches:
            texts = ["\n".join(apply(r["edits"], r["entry"], list(zip(r["roles"], r["texts"], strict=True))))
                     for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "conv"), column(batch, "piece"), pa.array(texts, pa.string())],
                                             ["conv", "piece", "text"])

    edits = settled.select(F.posexplode("pieces").alias("piece", "p")).select("piece", "p.*")
    pieces = found.where("NOT whole").select("conv", "part", "number", "roles", "texts").join(edits, ["part", "number"])
    written = in_batches(pieces.select("conv", "piece", "entry", "edits", "roles", "texts"), write,
                         "conv long, piece int, text string")
    texts = found.where("whole").select(
        "conv", F.lit(0).alias("piece"), F.col("repaired").alias("text"), F.lit(True).alias("alone")).unionByName(
        written.withColumn("alone", F.lit(False))).where("text <> ''")
    return Repair(summary, texts.withColumnRenamed("conv", "conv_id"))


def digests(texts: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations with text.

    The hash of a text in several pieces is a running one, in order by its nature: it reads them as a
    sorted stream, one piece in hand.
    """
    def run(batches: Batches) -> Batches:
        import hashlib

        conv, running, seen = None, None, False
        for batch in batches:
            made = []
            for name, text in zip(column(batch, "conv_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                if seen and name != conv:
                    made.append((conv, running.hexdigest()))
                if not seen or name != conv:
                    conv, running, seen = name, hashlib.sha256(), True
                else:
                    running.update(b"\n")
                running.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in made], pa.int64()), pa.array([h for _, h in made], pa.string())],
                                             ["conv_id", "repaired_sha256"])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([running.hexdigest()])],
                                             ["conv_id", "repaired_sha256"])

    several = texts.where("NOT alone").select("conv_id", "piece", "text")
    several = in_batches(several.repartition("conv_id").sortWithinPartitions("conv_id", "piece"), run,
                         "conv_id long, repaired_sha256 string")
    return texts.where("alone").select("conv_id", F.sha2("text", 256).alias("repaired_sha256")).unionByName(several)


def damaged(df: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with faults by the checksum of ``conv_id:turn``, nulls as one space:
    0 drops a row, 1 empties its text, 2 removes ends of sentences, 3 repeats it, 4 makes it a user's."""
    def spelled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn"))) % 20
    rows = df.select("conv_id", "turn", spelled("role").alias("role"), spelled("text").alias("text"), fault.alias("fault"))
    return rows.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
