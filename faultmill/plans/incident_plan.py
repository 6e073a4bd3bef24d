"""The write path end to end: failures and status changes to diagnosed incidents and feeds."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnosis, entities, feedback, incidents, knowledge
from ..rules.ruleset import BUILT_IN, RuleSet
from ..session import materialize
from ..sources.feeds import write_by_period
from . import marts


@dataclass
class IncidentPlan:
    """Derived tables of one history, each built on first use.

    ``failures``: failure records (with ``log`` where logs are searched or quoted);
    ``status_events``: status changes; ``events``: canonical runs.  ``answers`` and ``asked`` turn
    incident openings into model answers and feedback when there are such feeds.  ``kb``: the stored
    knowledge table, by default the curated rows; rows learned from feedback are added to it.
    ``rules``: the tables that the failure records were made with.  The failure records are stored
    once, since every later table reads their short columns again.
    """

    events: DataFrame
    failures: DataFrame
    status_events: object
    answers: object = None
    asked: object = None
    kb: DataFrame | None = None
    rules: RuleSet = BUILT_IN

    @cached_property
    def stored(self) -> DataFrame:
        return materialize(self.failures, "failures")

    @cached_property
    def pipelines(self) -> DataFrame:
        """Stored: few rows of all runs, read by the incidents, the learning and the listing."""
        return materialize(entities.pipelines(self.events), "pipelines")

    @cached_property
    def _judged_timeline(self) -> tuple[DataFrame, DataFrame | None]:
        events = incidents.timeline(self.stored, self.status_events(self.stored))
        if "target_seq" not in events.columns:
            return events, None
        kept, refused = incidents.split_stale_status(events)
        return materialize(kept, "timeline"), refused

    @property
    def timeline(self) -> DataFrame:
        """Failures and the status changes that count."""
        return self._judged_timeline[0]

    @property
    def quarantine(self) -> DataFrame | None:
        """Status changes aimed at an incident that was not the newest one, with the reason; None where
        status changes name no incident and act on the newest."""
        return self._judged_timeline[1]

    @cached_property
    def members(self) -> DataFrame:
        return incidents.islands(self.timeline)

    @cached_property
    def counted(self) -> DataFrame:
        """Incidents without title and note: the template is the only signal they need.

        Stored: the look for an earlier incident of the signature reads them twice.
        """
        return materialize(incidents.rollup(self.members), "counted")

    @cached_property
    def incidents(self) -> DataFrame:
        """Incidents with recurrence note and what their first failure showed, without the log.

        Stored: the feed, the diagnoses and the knowledge rows all start from it.
        """
        found = incidents.with_recurrence(self.counted)
        first = self.stored.select(
            F.col("event_id").alias("opening_event_id"), "platform", "pipeline_external_id",
            "task_name", "node_type", "rule_id", "evidence", "curated",
            entities.short_id(*[F.col(k) for k in entities.PIPELINE_KEYS]).alias("pipeline_id"))
        names = self.pipelines.select("pipeline_id", F.col("name").alias("pipeline_name"))
        joined = found.join(first, "opening_event_id").join(names, "pipeline_id")
        rules = F.broadcast(diagnosis.rule_table(joined.sparkSession, self.rules).select(  # a row per rule
            F.col("rule_id").alias("__rule"), F.col("summary").alias("__summary")))
        titled = joined.withColumn("__rule", F.coalesce("rule_id", F.lit(0))).join(
            rules, "__rule").withColumn("title", diagnosis.title(
                F.col("pipeline_name"), F.col("task_name"), F.col("__summary")))
        return materialize(titled.drop("__rule", "__summary"), "incidents")

    @cached_property
    def opening_logs(self) -> DataFrame:
        """Redacted log of the failure that opened each incident."""
        return self.stored.select(F.col("event_id").alias("opening_event_id"), "log").join(
            self.incidents.select(
                "opening_event_id", F.col("incident_id").alias("log_id"), "workspace_id",
                "platform", F.col("first_seen_at").alias("at"), "curated"), "opening_event_id")

    @cached_property
    def first_findings(self) -> DataFrame:
        """Rule diagnoses before knowledge hits are added: what feedback is given on.

        Rows are learned from these, and learned rows only add fixes behind a rule's own, so the
        stored ``diagnoses`` differ in nothing that learning reads.
        """
        return diagnosis.by_rules(self.incidents.withColumn(
            "kb_hits", F.lit(None).cast("array<struct<title string, fix string>>")), self.rules)

    def _diagnoses(self, by_rules: DataFrame) -> DataFrame:
        columns = ["incident_id", F.col("first_seen_at").alias("created_at"), *diagnosis.FIELDS]
        found = by_rules.select(*columns)
        if self.answers is not None:
            openings = by_rules.drop("log").join(self.opening_logs.select(
                F.col("log_id").alias("incident_id"), "log"), "incident_id")
            found = found.unionByName(
                diagnosis.by_model(self.answers(self.incidents), openings))
        return diagnosis.as_table(found)

    @cached_property
    def first_diagnoses(self) -> DataFrame:
        found = self._diagnoses(self.first_findings)
        # rule findings alone are a projection of the stored incidents
        return found if self.answers is None else materialize(found, "first-diagnoses")

    @cached_property
    def judged(self) -> DataFrame:
        """Valid feedback with the diagnosis it was given on."""
        return feedback.with_diagnosis(
            knowledge.valid_feedback(self.asked(self.incidents)), self.first_diagnoses)

    @cached_property
    def learned(self) -> DataFrame:
        return materialize(knowledge.learn(
            self.judged, self.incidents.drop("platform"), self.pipelines), "learned")

    @cached_property
    def known(self) -> DataFrame:
        """The knowledge table that logs are searched for: what is stored and what was learned."""
        given = self.kb
        if given is None:
            given = knowledge.curated_rows(self.events.sparkSession).drop("curated_id")
        return given if self.asked is None else given.unionByName(self.learned)

    @cached_property
    def hits(self) -> DataFrame:
        return knowledge.search(self.opening_logs, self.known)

    @cached_property
    def findings(self) -> DataFrame:
        """Rule diagnoses with the fixes of knowledge hits."""
        if self.asked is None and self.kb is None:  # curated rows only: found next to the log, no join
            return diagnosis.by_rules(self.incidents.withColumn("kb_hits", knowledge.curated_texts(
                F.col("curated"), F.col("platform"))), self.rules)
        texts = knowledge.hit_texts(self.hits, self.known).withColumnRenamed("log_id", "incident_id")
        return diagnosis.by_rules(self.incidents.join(texts, "incident_id", "left"), self.rules)

    @cached_property
    def diagnoses(self) -> DataFrame:
        """The stored and listed diagnoses: rule findings and fallbacks carry knowledge fixes."""
        found = self._diagnoses(self.findings)
        # rule findings alone are a projection of the stored incidents
        return found if self.answers is self.asked is self.kb is None else materialize(found, "diagnoses")

    def store(self, path: str, unit: str = "month") -> None:
        """Write incidents, diagnoses, the listing and refused status changes under ``path``: what
        readers then query.

        Partitioned by the period an incident began in; sorted by id inside files, so that a look
        at one id skips row groups.
        """
        for name, table, moment in (("incidents", self.incidents, "first_seen_at"),
                                    ("diagnoses", self.diagnoses, "created_at"),
                                    ("listed", self.listed, "first_seen_at")):
            write_by_period(table, f"{path}/{name}", moment, unit, "overwrite", "incident_id")
        if self.quarantine is not None:
            write_by_period(self.quarantine, f"{path}/quarantine", "at", unit, "overwrite", "event_id")

    @cached_property
    def listed(self) -> DataFrame:
        return marts.summaries(
            self.incidents.drop("platform", "pipeline_name"), self.pipelines, self.diagnoses)
