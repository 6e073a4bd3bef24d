"""Conversation repair against exhaustive search."""

import hashlib
import random
import re
import zlib

import pytest

from faultmill.llm import conversations as cv
from faultmill.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, cost int, audit string"
GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, audit, lines) over all edits of (role, text, must go, truncated), none merged.

    A row costs 3 at most, so nothing dearer than deleting all needs a look.
    """
    best = [(3 * len(rows), "D" * len(rows), [])]

    def walk(at, cost, audit, initials, lines):
        if cost > best[0][0]:
            return
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            return  # no edit takes back an initial
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            best[0] = min(best[0], (cost, audit, lines))
        for role in ("user", "assistant"):
            walk(at, cost + 2, audit + "I", initials + role[0], [*lines, f"{role}:"])
        if at < len(rows):
            role, text, must_go, cut = rows[at]
            walk(at + 1, cost + 3, audit + "D", initials, lines)
            if not must_go:
                if role[:1]:
                    walk(at + 1, cost + cut, audit + "K", initials + role[0], [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    walk(at + 1, cost + 2 + cut, audit + "R", initials + new[0], [*lines, f"{new}:{text}"])

    walk(0, 0, "", "", [])
    return best[0]


def described(rows, search=cheapest):
    """The result for one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, marked, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = search(marked)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def repaired(frame):
    mended = cv.repair(frame)
    hashes = {r.conv_id: r.repaired_sha256 for r in cv.digests(mended.texts).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, empty))
            for r in mended.summary.collect()}


def drawn(draw, size):
    return [(draw.choice([None, i, i, i, i + draw.randint(-2, 2)]), draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
             draw.choice(["Yes.", "Why", "", " \t", "No! ", "A?\n", None, f"t{i}.", f"u{i}.", f"v{i}."])) for i in range(size)]


@pytest.mark.parametrize("segment", [2048, 2])
def test_against_exhaustive_search(spark, monkeypatch, segment):
    monkeypatch.setattr(cv, "SEGMENT_ROWS", segment)
    draw = random.Random(3)
    talks = {i: drawn(draw, draw.randint(1, 5)) for i in range(250)}
    talks[None] = [(0, "user", "Hi."), (1, "assistant", "Ho."), (1, "assistant", "Ho.")]
    rows = [(c, *r, 5, "x") for c, talk in talks.items() for r in talk]
    draw.shuffle(rows)
    got = repaired(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert got == {c: described(talk) for c, talk in talks.items()}


def test_one_conversation_over_all_partitions(spark, monkeypatch):
    """Half of the rows are of one conversation; segments and partitions must not show."""
    def plain(rows):
        """The same search over rows with one best prefix per role state."""
        best = {"": (0, "", [])}
        def step(found, state, cost, audit, lines):
            if state not in found or (cost, audit) < found[state][:2]:
                found[state] = cost, audit, lines
        def grown(state, initial):
            return initial if (state, initial) in (("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")) else None
        def filled(found):
            for _ in range(3):
                for state, (cost, audit, lines) in list(found.items()):
                    for role in ("user", "assistant"):
                        if grown(state, role[0]):
                            step(found, role[0], cost + 2, audit + "I", [*lines, f"{role}:"])
            return found
        best = filled(best)
        for role, text, must_go, cut in rows:
            found = {}
            for state, (cost, audit, lines) in best.items():
                step(found, state, cost + 3, audit + "D", lines)
                for op, new, more in [] if must_go else [("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)]:
                    if new[:1] and grown(state, new[0]):
                        step(found, new[0], cost + more + cut, audit + op, [*lines, f"{new}:{text}"])
            best = filled(found)
        return min(best[s] for s in ("", "a") if s in best)

    monkeypatch.setattr(cv, "SEGMENT_ROWS", 50)
    draw = random.Random(9)
    talks = {7: drawn(draw, 1500), **{i: drawn(draw, draw.randint(1, 12)) for i in range(100, 300)}}
    rows = [(c, *r, 5, "x") for c, talk in talks.items() for r in talk]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert cv.repair(frame).texts.where("conv_id = 7 AND NOT alone").count() > 20
        assert repaired(frame) == {c: described(talk, plain) for c, talk in talks.items()}
        spread = cv.segments_of(cv.prepared(frame, "conv_id", "turn", "role", "text")).where("conv = 7")
        assert spread.select("part").distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_texts_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi.", 0, ""), (1, 2, "user", "So", 0, ""), (2, None, None, None, 0, "")]
    mended = cv.repair(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r)[:3] for r in mended.texts.collect()] in (
        [(1, 0, "user:Hi.\nassistant:So")], [(1, 0, "user:Hi.\nassistant:So"), (2, 0, "")])
    assert {r.conv_id: (r.cost, r.audit, r.gaps) for r in mended.summary.collect()} == {1: (3, "KR", 1), 2: (3, "D", 0)}
    nothing = cv.repair(spark.createDataFrame([], SCHEMA))
    assert nothing.summary.collect() == nothing.texts.collect() == cv.digests(nothing.texts).collect() == []


def test_query(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = spark.createDataFrame([(9001, 0, "user", "x."), (None, 3, None, None), (None, None, "user", "Hm."),
                                 *[(9100 + i, 0, "user", "Only.") for i in range(40)]], table.schema)
    table.unionByName(odd).write.parquet(f"{tmp_path}/conversations.parquet")
    talks = {}
    for r in table.unionByName(odd).collect():
        talk = talks.setdefault(r.conv_id, [])
        spelled = ":".join(" " if x is None else str(x) for x in (r.conv_id, r.turn))
        fault, role, text = zlib.crc32(spelled.encode()) % 20, r.role, r.text
        text = " " if text is None else text
        if fault:
            row = (r.turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
            talk += [row] * (2 if fault == 3 else 1)
    assert any(not talk for talk in talks.values())
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == {c: described(talk) for c, talk in talks.items()}
