"""Knowledge matching against brute force, learning, diagnoses, evidence, marts."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultmill.functions import text as tx
from faultmill.operators import diagnosis, feedback, knowledge
from faultmill.plans import marts
from faultmill.rules import fixed_values as fv

T0 = datetime(2026, 1, 1)
LOGS = "log_id string, workspace_id string, platform string, at timestamp, log string"


def kb_rows(spark, rows):
    """(id, workspace, platform, literal, day)"""
    made = [(i, w, p, lit, True, f"t {i}", "c", f"f {i}", "transient", "learned",
             T0 + timedelta(days=d)) for i, w, p, lit, d in rows]
    return spark.createDataFrame(made, knowledge.KB_SCHEMA)


def brute_force(logs, rows):
    out = set()
    for log_id, ws, platform, at, log in logs:
        for kb, w, p, literal, day in rows:
            if w == ws and T0 + timedelta(days=day) <= at and literal.lower() in log.lower():
                out.add((log_id, kb, 2 + (p == platform)))
    return out


def test_learned_literals_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["error", "Load", "failed", "svc_1", "svc_12", "x", "a.b", "--", "(", "[42]", "é",
             "login failed", "\n", "tail:", "'k7'", "OOM"]

    def text(size):
        return rng.choice(["", " "]).join(rng.choice(words) + rng.choice([" ", "", ":"])
                                          for _ in range(size))

    logs = [(f"l{i}", f"w{i % 2}", rng.choice(["dbt", "spark"]), T0 + timedelta(days=rng.randrange(9)),
             text(rng.randrange(1, 900))) for i in range(60)]
    rows = []
    for i in range(150):
        source = rng.choice(logs)[4]
        start = rng.randrange(len(source))
        literal = source[start:start + rng.choice([1, 2, 5, 9, 40, 300])]
        rows.append((f"k{i:03d}", f"w{i % 2}", rng.choice(["dbt", "spark"]), literal or "x",
                     rng.randrange(9)))
    want = brute_force(logs, rows)
    got = {(r.log_id, r.kb_id, r.score) for r in knowledge.match_learned(
        spark.createDataFrame(logs, LOGS), kb_rows(spark, rows)).collect()}
    assert got == want and want


def test_literals_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(knowledge, "LITERALS_AT_ONCE", 3)
    logs = [("a", "w", "dbt", T0 + timedelta(days=5), "one two three FOUR five"), ("b", "w", "dbt", T0, None)]
    rows = [(f"k{i}", "w", "dbt", word, 0) for i, word in enumerate(
        ["one", "Two", "four", "f", "seven", "e f", "one", "three four five six", "E"])]
    got = knowledge.match_learned(spark.createDataFrame(logs, LOGS), kb_rows(spark, rows))
    assert sorted(r.kb_id for r in got.collect()) == ["k0", "k1", "k2", "k3", "k5", "k6", "k8"]


def test_pasted_logs_are_searched_once(spark, monkeypatch):
    """Rows of workspaces and patterns that do not compile take no part in the passes over pasted logs."""
    from faultmill.plans import adhoc
    passes, found = [], knowledge._found
    monkeypatch.setattr(knowledge, "LITERALS_AT_ONCE", 4)
    monkeypatch.setattr(knowledge, "_found", lambda logs, rows, best: passes.append(len(rows)) or found(logs, rows, best))
    rows = [("all", None, r"disk \d+"), ("other", None, "full"), *[(f"bad{i}", None, f"(open {i}") for i in range(9)],
            *[(f"own{i}", "w1", f"disk 1{i % 3}.") for i in range(9)]]
    kb = spark.createDataFrame([(i, w, "dbt", pattern, False, i, "c", "f", "transient", "team", T0) for i, w, pattern in rows],
                               knowledge.KB_SCHEMA)
    pasted = spark.createDataFrame([("a", "dbt", "disk 12 is full", ""), ("b", "dbt", "disk x", "")],
                                   "log_id string, platform string, log string, context string")
    got = {r.log_id: [h.title for h in r.kb_hits or ()] for r in adhoc.diagnose(pasted, kb).collect()}
    assert got == {"a": ["all", "other"], "b": []} and passes == [2]


def test_pattern_rows_of_the_table(spark):
    logs = spark.createDataFrame([("a", "w1", "dbt", T0, "Disk 12 is full"), ("b", "w2", "dbt", T0, "disk x"),
                                  ("c", None, "dbt", T0, "DISK 7")], LOGS)
    rows = [("any", None, "dbt", r"disk \d+", False), ("own", "w1", "spark", "full$", False),
            ("bad", None, "dbt", "(disk", False), ("other", "w2", "dbt", "full", False)]
    kb = spark.createDataFrame([(i, w, p, pat, lit, "t", "c", "f", "transient", "team", T0)
                                for i, w, p, pat, lit in rows], knowledge.KB_SCHEMA)
    got = {(r.log_id, r.kb_id, r.score) for r in knowledge.match_patterns(logs, kb).collect()}
    assert got == {("a", "any", 1), ("a", "own", 2), ("c", "any", 1)}


def test_table_of_all_kinds_equals_brute_force(spark, monkeypatch):
    """Literal, pattern, broken, global and owned rows, many of them alike, in one block and in several."""
    import re

    rng = random.Random(12)
    words = ["disk", "Disk 12", "full", "İndex", "credit", "incident", "err-77", "zombie task", "\n", "x" * 30]
    patterns = [r"disk \d+", "(full|empty)x?", "(open", r"\d{2}", "ındex", "credit", "d.sk", "c[a-z]+t$", r"(?!x)err-\d+", "*",
                "Zombie  ?task", "", fv.CURATED_KB[7][2], fv.CURATED_KB[2][2]]
    logs = [(f"l{i}", rng.choice(["w0", "w1", None]), rng.choice(["dbt", "spark", None]), T0 + timedelta(days=rng.randrange(9)),
             " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(80)]
    rows = [(f"k{i:03d}", rng.choice(["w0", "w1", None]), rng.choice(["dbt", "spark", None]), rng.choice(patterns),
             rng.random() < 0.3, rng.randrange(9)) for i in range(300)]
    want = {}
    for log_id, ws, platform, at, log in logs:
        found = []
        for kb, owner, p, pattern, literal, day in rows:
            if owner not in (None, ws) or T0 + timedelta(days=day) > at or not pattern:
                continue
            try:
                hit = re.search(re.escape(pattern) if literal else pattern, log, re.I | re.S)
            except re.error:
                continue
            if hit:
                found.append((-(2 * (owner is not None) + (p is not None and p == platform)), day, kb))
        want[log_id] = [(kb, -score) for score, _, kb in sorted(found)[:5]]
    frame = spark.createDataFrame(logs, LOGS).withColumn("curated", tx.curated_hits(F.col("log")))
    kb = spark.createDataFrame([(i, w, p, pattern, literal, "t", "c", "f", "transient", "team", T0 + timedelta(days=d))
                                for i, w, p, pattern, literal, d in rows], knowledge.KB_SCHEMA)
    for at_once in (20_000, 4):
        monkeypatch.setattr(knowledge, "LITERALS_AT_ONCE", at_once)
        got = {}
        for r in knowledge.search(frame, kb).orderBy("log_id", "hit_rank").collect():
            got.setdefault(r.log_id, []).append((r.kb_id, r.score))
        assert got == {k: v for k, v in want.items() if v}


def test_patterns_that_cannot_match_never_run(monkeypatch):
    ran = []

    class Counting:
        def __init__(self, text):
            self.text = text

        def search(self, text):
            ran.append(self.text)

    monkeypatch.setattr(knowledge, "_compiled", Counting)
    rows = [(None, "dbt", False, rf"pattern{i}[a-z]+\d", f"k{i}", 0) for i in range(5000)]
    finder = knowledge.Finder([*rows, (None, "dbt", False, r"\d\d", "any", 0)])
    for i in range(20):
        finder.matches("w", "dbt", 1, f"a long log with pattern{i * 7}x in it", 5)
    assert sorted(ran) == sorted([r"\d\d"] * 20 + [r[3] for i in range(20) for r in rows
                                                  if r[3].split("[")[0] in f"pattern{i * 7}x"])


def test_scope_and_visibility(spark):
    logs = [("a", "w1", "dbt", T0 + timedelta(days=5), "see Credit note OOM"),
            ("b", None, "snowflake", T0 + timedelta(days=5), "see credit note OOM")]
    frame = spark.createDataFrame(logs, LOGS).withColumn("curated", tx.curated_hits(F.col("log")))
    kb = kb_rows(spark, [("own", "w1", "spark", "oom", 1), ("late", "w1", "dbt", "oom", 6),
                         ("other", "w2", "dbt", "oom", 1)])
    table = kb.unionByName(knowledge.seed(kb))
    got = [(r.log_id, r.kb_id, r.score) for r in knowledge.search(frame, table).orderBy(
        "log_id", "hit_rank").collect()]
    assert got == [("a", "own", 2), ("a", "curated-08", 0), ("b", "curated-08", 1)]
    # what the table does not hold does not match
    fewer = knowledge.search(frame, table.filter("kb_id <> 'curated-08'")).collect()
    assert [(r.log_id, r.kb_id) for r in fewer] == [("a", "own")]


def test_top_five_in_insertion_order(spark):
    logs = spark.createDataFrame([("a", "w", "dbt", T0 + timedelta(days=99), "x failed y")], LOGS) \
        .withColumn("curated", F.array().cast("array<int>"))
    rows = [(f"k{i}", "w", "dbt" if i in (7, 9) else "spark", "FAILED", 20 - i) for i in range(10)]
    got = [r.kb_id for r in knowledge.search(logs, kb_rows(spark, rows)).orderBy(
        "hit_rank").collect()]
    assert got == ["k9", "k7", "k8", "k6", "k5"]


def test_alike_rows_of_a_built_in_pattern_meet_a_log_five_times(spark):
    """However often teams enter a built-in pattern, a log meets the first five of each platform."""
    pattern = fv.CURATED_KB[7][2]
    kb = spark.createDataFrame(
        [(f"k{i:02d}", "w" if i % 2 else None, "dbt", pattern, False, "t", "c", "f", "transient", "team",
          T0 + timedelta(hours=i)) for i in range(40)], knowledge.KB_SCHEMA)
    number = fv.CURATED_KB[7][0]
    logs = spark.createDataFrame(
        [("a", "w", "dbt", T0 + timedelta(hours=99), "", [number]), ("b", None, "spark", T0 + timedelta(hours=3), "", [number])],
        LOGS + ", curated array<int>")
    every, some = knowledge.match_curated(logs, kb), knowledge.match_curated(logs, kb, best=fv.KB_HITS)
    assert every.count() == 40 + 2 and some.count() == 10 + 2
    hits = sorted(map(tuple, knowledge.best_hits(some).collect()))
    assert hits == sorted(map(tuple, knowledge.best_hits(every).collect()))
    assert [h[2] for h in hits if h[0] == "a"] == ["k01", "k03", "k05", "k07", "k09"]
    assert sorted(map(tuple, knowledge.search(logs, kb).collect())) == hits


def test_seed_only_once(spark):
    empty = spark.createDataFrame([], knowledge.KB_SCHEMA)
    seeded = empty.unionByName(knowledge.seed(empty))
    assert seeded.count() == 13
    assert knowledge.seed(seeded).count() == 0


def test_pattern_check(spark):
    kb = spark.createDataFrame(
        [("(", False), ("(", True), ("ok.*", False)], "pattern string, is_literal boolean")
    got = {(r.pattern, r.is_literal): r.is_valid for r in
           knowledge.with_pattern_check(kb).collect()}
    assert got == {("(", False): False, ("(", True): True, ("ok.*", False): True}


def signed(spark, log, hits=None, note=""):
    from faultmill.operators.failures import with_signals
    rows = with_signals(spark.createDataFrame([("i", log)], "incident_id string, log string"), "log")
    kind = "array<struct<title string, fix string>>"
    return rows.withColumns({
        "recurrence_note": F.lit(note),
        "kb_hits": F.array(*[F.struct(F.lit(t).alias("title"), F.lit(f).alias("fix"))
                             for t, f in hits]).cast(kind) if hits else F.lit(None).cast(kind)})


def test_rule_diagnosis_adds_hits_and_note(spark):
    got = diagnosis.by_rules(signed(
        spark, "x\nOOMKilled here", [("T", "do")], "seen before")).first()
    assert got.category == "resource_exhaustion" and got.confidence == 0.9
    assert [e.quote for e in got.evidence] == ["OOMKilled here"]
    assert got.fixes[-1].title == "KB: T" and got.fixes[-1].steps == ["do"]
    assert got.explanation.startswith("seen before\n\n")


def test_knowledge_alone_stays_unknown(spark):
    log = "\n".join(f"strange error {i}" for i in range(8)) + "\ncredit"
    got = diagnosis.by_rules(signed(spark, log, [("T", "do")])).first()
    assert (got.category, got.confidence, len(got.fixes), len(got.evidence)) == (
        "unknown", 0.3, 1, 5)


def test_evidence(spark):
    def case(name, quotes, confidence):
        return (name, "the  log says\nno", "why", [("log", q) for q in quotes], confidence)

    rows = [case("kept", ["log  says no"], 0.9), case("some", ["log says", "made up"], 0.8),
            case("none", ["LOG says"], 0.95), case("low", [""], 0.2), case("empty", [], 0.7)]
    frame = spark.createDataFrame(
        rows, f"id string, log string, summary string, evidence {diagnosis.EVIDENCE}, "
              "confidence double")
    got = {r.id: r for r in diagnosis.verify_evidence(frame, "log").collect()}
    assert got["kept"].confidence == 0.9 and len(got["kept"].evidence) == 1
    assert abs(got["some"].confidence - 0.68) < 1e-9 and got["some"].summary == "why"
    assert got["none"].confidence == 0.4 and got["none"].summary == "[Hypothesis] why"
    assert got["low"].confidence == 0.2 and got["low"].summary.startswith("[Hypothesis]")
    assert got["empty"].confidence == 0.7 and got["empty"].summary == "why"


def test_answers(spark):
    rows = [("full", '{"root_cause_category":"timeout","root_cause_summary":"s","explanation":"e",'
             '"evidence":[{"source":"log","quote":"q"}],"fixes":[{"title":"t","type":"retry",'
             '"steps":["a"]}],"confidence":"0.7","is_transient":1}'),
            ("bare", "{}"), ("bad", "no"), ("list", "[]"), ("null", '{"confidence":null}'),
            ("odd", '{"root_cause_category":"strange"}'), ("ev", '{"evidence":"x"}')]
    got = {r.incident_id: r for r in diagnosis.parse_answers(spark.createDataFrame(
        rows, "incident_id string, response string")).collect()}
    assert [k for k, r in got.items() if r.parsed] == ["full", "bare"]
    assert got["full"].confidence == 0.7 and got["full"].is_transient
    assert got["full"].fixes[0].title == "t" and got["full"].evidence[0].quote == "q"
    assert (got["bare"].category, got["bare"].confidence) == ("unknown", 0.5)


def diagnoses(spark, rows):
    """(id, incident, day, category)"""
    made = [(d, i, T0 + timedelta(days=n), c, f"why {d}", "", [("log", f"quote {d}")],
             [("fix " + d, "manual", ["s"], "", "low")], 0.5, False, "rules", None)
            for d, i, n, c in rows]
    return spark.createDataFrame(
        made, "diagnosis_id string, incident_id string, created_at timestamp, category string, "
              f"summary string, explanation string, evidence {diagnosis.EVIDENCE}, "
              f"fixes {diagnosis.FIXES}, confidence double, is_transient boolean, engine string, "
              "latency_ms long")


def test_feedback_takes_the_diagnosis_of_its_time_and_teaches(spark):
    given = diagnoses(spark, [("d1", "i1", 0, "timeout"), ("d2", "i1", 10, "code_error")])
    said = [("f0", -1, "i1", "fixed_it", ""), ("f1", 1, "i1", "fixed_it", ""),
            ("f2", 11, "i1", "fixed_it", "did so"), ("f3", 12, "i1", "helpful", ""),
            ("f4", 12, "i1", "nonsense", "")]
    events = spark.createDataFrame(
        [(e, T0 + timedelta(days=d), i, v, c) for e, d, i, v, c in said],
        "event_id string, at timestamp, incident_id string, verdict string, comment string")
    judged = feedback.with_diagnosis(knowledge.valid_feedback(events), given)
    assert {r.event_id: r.diagnosis and r.diagnosis.diagnosis_id for r in judged.collect()} == {
        "f0": None, "f1": "d1", "f2": "d2", "f3": "d2"}
    incidents = spark.createDataFrame(
        [("i1", "w", "p1", "Pipe", "title")],
        "incident_id string, workspace_id string, pipeline_id string, pipeline_name string, title string")
    pipelines = spark.createDataFrame([("px", "dbt")], "pipeline_id string, platform string")
    rows = knowledge.learn(judged, incidents, pipelines).orderBy("created_at").collect()
    assert [(r.pattern, r.fix, r.platform, r.category, r.title) for r in rows] == [
        ("quote d1", "fix d1", "generic", "timeout", "Pipe: why d1"),
        ("quote d2", "did so", "generic", "code_error", "Pipe: why d2")]


def test_unmatched_sides(spark):
    """Incidents without a pipeline or a diagnosis, pipelines without a run."""
    found = spark.createDataFrame(
        [(i, p, "t " + i, "open", "f", 1, T0, T0) for i, p in (("i1", "p1"), ("i2", "px"))],
        "incident_id string, pipeline_id string, title string, status string, fingerprint string, "
        "occurrence_count long, first_seen_at timestamp, last_seen_at timestamp")
    pipelines = spark.createDataFrame([("p1", "Pipe", "dbt"), ("p2", "Idle", "adf")],
                                      "pipeline_id string, name string, platform string")
    given = diagnoses(spark, [("d1", "i1", 0, "timeout")])
    got = {r.incident_id: (r.pipeline_name, r.platform, r.title, r.category, r.summary, r.confidence)
           for r in marts.summaries(found, pipelines, given).collect()}
    assert got == {"i1": ("Pipe", "dbt", "Pipe: why d1", "timeout", "why d1", 0.5),
                   "i2": ("", None, "t i2", None, "", None)}
    runs = spark.createDataFrame([("p1", "failed"), ("p1", "success"), ("gone", "failed")], "pipeline_id string, status string")
    health = {r.pipeline_id: (r.run_count, r.failed_count, r.failure_rate, r.failure_band)
              for r in marts.pipeline_health(pipelines, runs).collect()}
    assert health == {"p1": (2, 1, 0.5, "critical"), "p2": (0, 0, 0.0, "good")}


def test_category_filter_matches_any_diagnosis(spark):
    given = diagnoses(spark, [("d1", "i1", 0, "timeout"), ("d2", "i1", 10, "code_error"),
                              ("d3", "i2", 0, "permissions")])
    listed = spark.createDataFrame([("i1",), ("i2",)], "incident_id string")
    assert [r.incident_id for r in marts.with_any_category(listed, given, "timeout").collect()] \
        == ["i1"]
    newest = {r.incident_id: r.diagnosis.category for r in diagnosis.latest(given).collect()}
    assert newest == {"i1": "code_error", "i2": "permissions"}


def test_paging(spark):
    listed = spark.createDataFrame(
        [(f"i{n:02d}", T0 + timedelta(days=n // 2)) for n in range(30)],
        "incident_id string, last_seen_at timestamp")
    first = [r.incident_id for r in marts.feed_page(listed, 10).collect()]
    second = [r.incident_id for r in marts.feed_page(listed, 10, 10).collect()]
    assert first[:3] == ["i28", "i29", "i26"] and not set(first) & set(second)
    try:
        marts.feed_page(listed, 201)
    except ValueError:
        return
    raise AssertionError("a page above the limit was served")
