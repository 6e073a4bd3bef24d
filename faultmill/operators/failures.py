"""From runs and their task logs to one small failure record per failed run.

Of a failed run only the log of its root task is searched: redaction, signature template, triage and
knowledge hits are computed where it was chosen, and only these short columns travel through later
shuffles.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.once import once
from ..rules import fixed_values as fv
from ..rules.ruleset import BUILT_IN, RuleSet

FAILING = ("failed", "upstream_failed")


def synthetic_log(run: Column, pipeline: Column) -> Column:
    before, middle, after = (F.lit(piece) for piece in fv.SYNTHETIC_LOG)
    return F.concat(before, run, middle, pipeline, after)


def evidence(log: Column, rule_id: Column, rules: RuleSet = BUILT_IN) -> Column:
    """The quote of the rule, or up to five error lines when no rule matched."""
    lines = F.transform(
        tx.error_lines(log, fv.ERROR_LINES_AS_EVIDENCE),
        lambda line: F.substring(line, 1, fv.QUOTE_CHARS))
    quote = tx.triage_quote(log, rule_id, rules.triage)
    return F.when(rule_id.isNull(), lines).otherwise(
        F.filter(F.array(quote), lambda q: q != ""))


SIGNALS = ("template", "rule_id", "curated", "evidence")


def with_signals(df: DataFrame, log: str, wanted: tuple[str, ...] = SIGNALS, rules: RuleSet = BUILT_IN) -> DataFrame:
    """Adds what later steps need to know of the redacted ``log``: its signature template, the
    triage rule, curated knowledge hits and evidence quotes (which need the rule).

    Only the ``wanted`` ones are computed: none can be pruned later, see ``once``.
    """
    text, fold = F.col(log), F.col("__folded")
    made = {
        "template": lambda: tx.error_template(text, rules.volatile),
        "rule_id": lambda: tx.triage_rule(text, fold, rules.triage),
        "curated": lambda: tx.curated_hits(text, fold)}
    if set(wanted) - {"template"}:
        df = once(df, {"__folded": tx.folded(text)})
    found = once(df, {name: make() for name, make in made.items() if name in wanted}).drop("__folded")
    if "evidence" in wanted:
        found = once(found, {"evidence": evidence(text, F.col("rule_id"), rules)})
    return found


def failing_logs(tasks: DataFrame) -> DataFrame:
    """Tasks whose log can explain a failed run."""
    return tasks.filter(F.col("status").isin(*FAILING) & _logged())


def _logged() -> Column:
    return F.coalesce(F.col("log"), F.lit("")) != ""


def root_task(tasks: DataFrame, run_key: str, position: Column, *carried: str) -> DataFrame:
    """Per run the first failed one of ``failing_logs`` in list order, else the first other.

    A minimum over (not failed, position): combined before the shuffle, so a run with any number
    of tasks leaves one row per input partition.  Tasks without a log count for nothing; a run that has
    no others comes out with a null root, unless they were filtered before.
    """
    first = F.min_by(
        F.struct(*carried),
        F.when(_logged(), F.struct((F.col("status") != "failed").alias("rank"), position.alias("position"))))
    return tasks.groupBy(run_key).agg(first.alias("root"))


def root_in_event(tasks: Column) -> Column:
    """The same choice inside one event whose tasks are an array, without a shuffle."""
    def first(status: str) -> Column:
        return F.try_element_at(
            F.filter(tasks, lambda t: (t["status"] == status)
                     & (F.coalesce(t["log"], F.lit("")) != "")), F.lit(1))

    return F.coalesce(first("failed"), first("upstream_failed"))


def failed_events(events: DataFrame) -> DataFrame:
    """Failed runs of canonical events with their root task and raw log chosen, tasks dropped."""
    root = F.col("__root")
    return (
        events.filter(F.col("status") == "failed")
        .withColumn("__root", root_in_event(F.col("tasks")))
        .withColumns({
            "task_name": F.when(root.isNotNull(), F.coalesce(
                F.nullif(root["name"], F.lit("")), root["task_id"])),
            "node_type": F.coalesce(root["node_type"], F.lit("")),
            "raw_log": root["log"],
        })
        .drop("__root", "tasks")
    )


def from_events(events: DataFrame, rules: RuleSet = BUILT_IN) -> DataFrame:
    """Failure records straight from canonical events: no shuffle at all."""
    chosen = failed_events(events)
    redacted = tx.with_redaction(chosen, "raw_log", "log", "redaction_count", rules.redaction).drop("raw_log")
    stand_in = synthetic_log(F.col("run_external_id"), F.col("pipeline_external_id"))
    signed = with_signals(redacted.withColumn("log", F.coalesce("log", stand_in)), "log", rules=rules)
    return _finish(signed)


def from_tasks(runs: DataFrame, tasks: DataFrame, run_key: str, position: Column,
               keep_log: bool = False, wanted: tuple[str, ...] = SIGNALS, rules: RuleSet = BUILT_IN) -> DataFrame:
    """Failure records from run and task tables.

    The root task is chosen before any text work, so that of each failed run one log is redacted and
    reduced to the ``wanted`` signals (the template is always one), however many tasks failed with it.
    With ``keep_log`` the redacted log goes along, for readers that search or quote it.
    """
    # the log is judged where the root is chosen: as a filter, what makes it would be copied below every shuffle
    failing = tasks.filter(F.col("status").isin(*FAILING))
    chosen = root_task(failing, run_key, position, "name", "node_type", "log")
    root = F.col("root")
    joined = runs.filter(F.col("status") == "failed").join(chosen, run_key, "left").withColumns({
        "task_name": root["name"], "node_type": F.coalesce(root["node_type"], F.lit("")), "__raw": root["log"]}).drop("root")
    redacted = tx.with_redaction(joined, "__raw", "log", "redaction_count", rules.redaction).drop("__raw", "redaction_count")
    stand_in = synthetic_log(F.col("run_external_id"), F.col("pipeline_external_id"))
    signed = with_signals(redacted.withColumn("log", F.coalesce("log", stand_in)), "log", wanted, rules)
    return _finish(signed if keep_log else signed.drop("log"))


def _finish(signed: DataFrame) -> DataFrame:
    return signed.withColumns({
        "fingerprint": tx.fingerprint(
            F.col("template"), F.col("pipeline_external_id"), F.col("node_type")),
        "run_id": tx.short_id(F.col("workspace_id"), F.col("event_id")),
    }).drop("template")
