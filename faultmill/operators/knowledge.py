"""Knowledge base: curated rows, learned rows, matching, learning.

Table columns: kb_id, workspace_id (null = global), platform, pattern, is_literal, title, cause,
fix, category, source, created_at.  ``(created_at, kb_id)`` is the insertion order.
"""

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import short_id
from ..rules import fixed_values as fv
from ..rules import needed
from ..rules.wording import KB_TEXTS, LEARNED_DEFAULT_FIX
from ..session import materialize, scratch_path, ship
from .diagnosis import title

KB_SCHEMA = (
    "kb_id string, workspace_id string, platform string, pattern string, is_literal boolean, "
    "title string, cause string, fix string, category string, source string, created_at timestamp"
)
CURATED_SCHEMA = "curated_id int, " + KB_SCHEMA


def curated_rows(spark: SparkSession) -> DataFrame:
    """The curated rows: a fixed table of 13, small enough to broadcast by construction."""
    rows = [
        (number, f"curated-{number:02d}", None, platform, pattern, False, *KB_TEXTS[number],
         category, "curated")
        for number, platform, pattern, category in fv.CURATED_KB
    ]
    columns = CURATED_SCHEMA.rsplit(",", 1)[0]
    return spark.createDataFrame(rows, columns).withColumn(
        "created_at", F.timestamp_seconds(F.lit(0)))


def seed(existing: DataFrame) -> DataFrame:
    """The rows to append: all curated ones when the table has none, else nothing."""
    present = existing.filter(F.col("source") == "curated").select("source").distinct()
    return curated_rows(existing.sparkSession).drop("curated_id").join(
        present, "source", "left_anti")


def _compiled(pattern: str | None) -> re.Pattern | None:
    try:
        return re.compile(pattern or "", re.I | re.S)
    except (re.error, OverflowError, RecursionError):
        return None


def with_pattern_check(kb: DataFrame) -> DataFrame:
    """Adds ``is_valid``: whether a pattern compiles.  Literal rows always are.

    Patterns are data here, so they are compiled one Arrow batch at a time and none can fail a
    later job.
    """
    @F.pandas_udf("boolean")
    def compiles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = {p: _compiled(p) is not None for p in batch.unique()}
            yield batch.map(known)

    ship(kb.sparkSession)
    return kb.withColumn("is_valid", F.col("is_literal") | compiles(F.col("pattern")))


# --- learning ------------------------------------------------------------------------------------

def valid_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.filter(F.col("verdict").isin(*fv.VERDICTS))


def learn(judged: DataFrame, incidents: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Rows learned from confirmed fixes.

    ``judged`` is feedback with the diagnosis it refers to (``diagnosis`` struct).  The first
    evidence quote becomes a literal pattern of the workspace; repeats are kept.  The row is titled as
    the incident was when the feedback came in: by the diagnosis, where it has a summary.
    """
    confirmed = judged.filter(
        (F.col("verdict") == "fixed_it") & F.col("diagnosis").isNotNull())
    quote = F.try_element_at(F.col("diagnosis.evidence"), F.lit(1))["quote"]
    first_fix = F.try_element_at(F.col("diagnosis.fixes"), F.lit(1))["title"]
    named = incidents.select("incident_id", "workspace_id", "pipeline_id", "pipeline_name", F.col("title").alias("__title")).join(
        pipelines.select("pipeline_id", "platform"), "pipeline_id", "left")
    return (
        confirmed.withColumn("pattern", F.substring(quote, 1, fv.LEARNED_PATTERN_CHARS))
        .filter(F.coalesce(F.col("pattern"), F.lit("")) != "")
        .join(named, "incident_id")
        .select(
            short_id(F.lit("learned"), F.col("event_id")).alias("kb_id"), "workspace_id",
            F.coalesce("platform", F.lit("generic")).alias("platform"), "pattern",
            F.lit(True).alias("is_literal"),
            F.when(F.col("diagnosis.summary") == "", F.col("__title")).otherwise(
                title(F.col("pipeline_name"), F.lit(""), F.col("diagnosis.summary"))).alias("title"),
            F.col("diagnosis.summary").alias("cause"),
            F.coalesce(F.nullif(F.col("comment"), F.lit("")), first_fix,
                       F.lit(LEARNED_DEFAULT_FIX)).alias("fix"),
            F.col("diagnosis.category").alias("category"), F.lit("learned").alias("source"),
            F.col("at").alias("created_at"))
    )


# --- matching ------------------------------------------------------------------------------------

#: Distinct literals and patterns searched in one pass over the logs: the bound of what a pass carries.
LITERALS_AT_ONCE = 20_000

_HIT = "log_id string, kb_id string, score int, created_at timestamp"


class Finder:
    """Looks for rows of a knowledge table in texts, all of them in one pass over a text.

    One automaton holds the literals of literal rows and, for pattern rows, the literals that each of
    their matches needs.  A pattern runs only on a text that holds one of its literals, so patterns
    that cannot match cost nothing; those without any run on every text in their scope.
    """

    def __init__(self, rows: list[tuple]):
        """``rows``: (workspace, platform, literal, text, id, created)."""
        self.automaton = ahocorasick.Automaton()
        self.always: list[int] = []
        self.scopes: list[dict[str | None, list[tuple]]] = []
        self.patterns: list[re.Pattern | None] = []
        places: dict[tuple, int] = {}
        words: dict[str, list[int]] = {}
        for workspace, platform, literal, text, kb_id, created in rows:
            key = literal, needed.fold(text) if literal else text
            if key not in places:
                pattern = None if literal else _compiled(text)
                if not literal and pattern is None:
                    continue  # a pattern that does not compile matches nothing
                places[key] = len(self.scopes)
                self.scopes.append({})
                self.patterns.append(pattern)
                needs = [key[1]] if literal else needed.required(text)
                if needs is None:
                    self.always.append(places[key])
                for word in needs or ():
                    words.setdefault(word, []).append(places[key])
            self.scopes[places[key]].setdefault(workspace, []).append((created, kb_id, platform))
        for word, entries in words.items():
            self.automaton.add_word(word, entries)
        if words:
            self.automaton.make_automaton()

    def matches(self, workspace: str | None, platform: str | None, at, text: str | None,
                best: int | None) -> list[tuple[str, int, object]]:
        """(id, score, created) of the rows found, the ``best`` ones of them, best first."""
        text = text or ""
        entries = set(self.always)
        if len(self.automaton):
            for _, found in self.automaton.iter(needed.fold(text)):
                entries.update(found)
        hits = []
        for entry in entries:
            rows = [(0, r) for r in self.scopes[entry].get(None, ())]
            if workspace is not None:
                rows += [(2, r) for r in self.scopes[entry].get(workspace, ())]
            rows = [(own, r) for own, r in rows if at is not None and r[0] <= at]
            pattern = self.patterns[entry]
            if rows and (pattern is None or pattern.search(text)):
                hits += [(-own - (platform is not None and of == platform), created, kb_id)
                         for own, (created, kb_id, of) in rows]
        hits.sort()
        return [(kb_id, -score, created) for score, created, kb_id in hits[:best]]


def _found(logs: DataFrame, rows: list[tuple], best: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(rows)
        for batch in batches:
            made = [(log_id, *hit) for log_id, workspace, platform, at, log in zip(
                *[batch.column(c).to_pylist() for c in ("log_id", "workspace_id", "platform", "micros", "log")],
                strict=True) for hit in finder.matches(workspace, platform, at, log, best)]
            yield pa.RecordBatch.from_arrays([
                pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string()),
                pa.array([m[2] for m in made], pa.int32()),
                pa.array([m[3] for m in made], pa.timestamp("us", tz="UTC"))],
                ["log_id", "kb_id", "score", "created_at"])

    ship(logs.sparkSession)
    return logs.select("log_id", "workspace_id", "platform", F.unix_micros("at").alias("micros"), "log").mapInArrow(run, _HIT)


def _compiling(rows: DataFrame) -> DataFrame:
    """Rows that can match at all: no pattern row whose pattern does not compile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            literal, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("is_literal", "pattern"))
            yield batch.filter(pa.array([own or _compiled(text) is not None for own, text in zip(literal, texts, strict=True)],
                                        pa.bool_()))

    ship(rows.sparkSession)
    return rows.mapInArrow(run, rows.schema)


def match_table(logs: DataFrame, kb: DataFrame, best: int | None = fv.KB_HITS) -> DataFrame:
    """Rows of the table, global or of the log's workspace, that the log holds and that were known
    when it came in: log_id, kb_id, score, created_at.

    ``logs``: log_id, workspace_id, platform, at, log.  Literal rows are looked for ignoring case,
    pattern rows run case-blind with dots that match line ends.  With ``best`` only rows that can be
    among so many best of a log are given: of equal rows of one workspace and platform the first ones
    precede the others in every log, so no more of them are carried, however often a row is learned.

    Patterns that do not compile are left out first.  Distinct texts are searched in blocks.  A block is all that the driver or a task holds of the
    table, and its hits are stored before the next one: no log text is shuffled.  With more than one
    block the logs are stored first, so that what made them (joins, as a rule) runs once.
    """
    usable = kb.filter((F.coalesce(F.col("pattern"), F.lit("")) != "") & F.col("created_at").isNotNull()).select(
        "workspace_id", "platform", F.coalesce("is_literal", F.lit(False)).alias("is_literal"), "pattern", "kb_id",
        F.unix_micros("created_at").alias("created"),
        F.xxhash64(F.when(F.col("is_literal"), F.lower("pattern")).otherwise(F.col("pattern")), "is_literal").alias("part"))
    if best is not None:
        alike = Window.partitionBy("workspace_id", "platform", "is_literal", "part").orderBy("created", "kb_id")
        usable = usable.withColumn("place", F.row_number().over(alike)).filter(F.col("place") <= best).drop("place")
    usable = materialize(_compiling(usable), "knowledge")
    spark, found = logs.sparkSession, None
    blocks = -(-usable.count() // LITERALS_AT_ONCE)
    if not blocks:
        return spark.createDataFrame([], _HIT)
    path = scratch_path(spark, "knowledge-hits")
    if blocks > 1:  # each block reads the logs, none makes them again
        logs = materialize(logs.select("log_id", "workspace_id", "platform", "at", "log"), "searched")
    for number in range(blocks):
        rows = usable.filter(F.pmod("part", F.lit(blocks)) == number).drop("part").collect()
        found = _found(logs, [tuple(row) for row in rows], best)
        if blocks > 1:
            found.write.mode("append").parquet(path)
    return found if blocks == 1 else spark.read.schema(_HIT).parquet(path)


def match_learned(logs: DataFrame, kb: DataFrame) -> DataFrame:
    """Every literal row of the log's workspace that occurs in the log."""
    return match_table(logs, kb.filter(F.col("is_literal") & F.col("workspace_id").isNotNull()), None)


def match_patterns(logs: DataFrame, kb: DataFrame) -> DataFrame:
    """Every pattern row of the table, global or of the log's workspace, found in the log."""
    return match_table(logs, kb.filter(~F.col("is_literal")), None)


def _built_in(kb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose pattern is a built-in one, with ``curated_id``, and the others."""
    number = F.create_map(*[F.lit(x) for n, _, pattern, _ in fv.CURATED_KB for x in (pattern, n)])
    marked = kb.withColumn("curated_id", F.when(
        ~F.coalesce(F.col("is_literal"), F.lit(False)), F.try_element_at(number, F.coalesce("pattern", F.lit("")))))
    return marked.filter(F.col("curated_id").isNotNull()), marked.filter(F.col("curated_id").isNull()).drop("curated_id")


def match_curated(logs: DataFrame, kb: DataFrame, hits: str = "curated", best: int | None = None) -> DataFrame:
    """Rows of the table with a built-in pattern, from the pattern ids found next to the log.

    Platform and workspace score; a row matches only where the table holds it and it was known.  With
    ``best`` only rows that can be among so many best of a log meet it: rows of one pattern, workspace
    and platform score alike and the first ones precede the others in every log (``match_table``).
    """
    rows = _built_in(kb)[0].filter(F.col("created_at").isNotNull()).select(
        "curated_id", F.col("workspace_id").alias("owner"), "kb_id", F.col("platform").alias("kb_platform"), "created_at")
    if best is not None:
        alike = Window.partitionBy("curated_id", "owner", "kb_platform").orderBy("created_at", "kb_id")
        rows = rows.withColumn("__place", F.row_number().over(alike)).filter(F.col("__place") <= best).drop("__place")
    found = logs.select("log_id", "workspace_id", "platform", "at", F.explode(hits).alias("curated_id"))
    score = F.when(F.col("owner").isNotNull(), 2).otherwise(0) + F.when(
        F.col("kb_platform") == F.col("platform"), 1).otherwise(0)

    def of(joined: DataFrame) -> DataFrame:
        return joined.filter(F.col("created_at") <= F.col("at")).select(
            "log_id", "kb_id", score.alias("score"), "created_at")

    everywhere = found.join(rows.filter("owner IS NULL"), "curated_id")
    owned = rows.filter("owner IS NOT NULL").withColumnRenamed("curated_id", "own_id")
    return of(everywhere).unionByName(of(found.join(
        owned, (F.col("curated_id") == F.col("own_id")) & (F.col("workspace_id") == F.col("owner")))))


def curated_texts(hits: Column, platform: Column) -> Column:
    """The five best curated rows of one log, as ``hit_texts`` gives them, without a join.

    For a workspace that has no rows of its own; the 13 rows are constants of the expression.
    """
    rows = F.array(*[
        F.struct((F.lit(of) != F.coalesce(platform, F.lit(""))).alias("foreign"), F.lit(number).alias("number"),
                 F.lit(of).alias("platform"), *[F.lit(text).alias(name) for name, text in
                                                zip(("title", "cause", "fix"), KB_TEXTS[number], strict=True)])
        for number, of, _, _ in fv.CURATED_KB])
    best = F.slice(F.array_sort(F.filter(rows, lambda r: F.array_contains(hits, r["number"]))), 1, fv.KB_HITS)
    return F.transform(best, lambda r, i: F.struct(
        (i + 1).alias("hit_rank"), *[r[name].alias(name) for name in ("platform", "title", "cause", "fix")]))


def best_hits(*matches: DataFrame) -> DataFrame:
    """The five best per log: score first, then insertion order."""
    combined = matches[0]
    for more in matches[1:]:
        combined = combined.unionByName(more)
    order = Window.partitionBy("log_id").orderBy(F.desc("score"), "created_at", "kb_id")
    return (
        combined.withColumn("hit_rank", F.row_number().over(order))
        .filter(F.col("hit_rank") <= fv.KB_HITS)
        .select("log_id", "hit_rank", "kb_id", "score")
    )


def search(logs: DataFrame, kb: DataFrame) -> DataFrame:
    """The five best rows of the table in each log: global ones and the workspace's own, known when
    the log came in.

    ``logs``: log_id, workspace_id (null for pasted logs), platform, at, log, curated.  What the table
    holds decides: built-in patterns count where their rows are there, found next to the log already;
    all other rows, added, learned or owned, are looked for in one pass.  ``kb`` is read several times:
    pass a stored table.
    """
    return best_hits(match_curated(logs, kb, best=fv.KB_HITS), match_table(logs, _built_in(kb)[1]))


def hit_texts(hits: DataFrame, kb: DataFrame) -> DataFrame:
    """Per log its hits with their texts, in rank order (at most five)."""
    columns = ["kb_id", "platform", "title", "cause", "fix"]
    seeded = F.col("kb_id").isin([f"curated-{n:02d}" for n, *_ in fv.CURATED_KB])
    # the 13 rows that most logs hit never meet in one task; the others are joined by their id
    few = F.broadcast(kb.filter(seeded).select(*columns))
    detailed = hits.join(few, "kb_id").unionByName(
        hits.filter(~seeded).join(kb.filter(~seeded).select(*columns), "kb_id"))
    return detailed.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct(
        "hit_rank", "platform", "title", "cause", "fix"))).alias("kb_hits"))
