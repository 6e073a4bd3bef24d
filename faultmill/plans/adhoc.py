"""Diagnosis of pasted logs: no run, no pipeline, no history."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import diagnosis, knowledge
from ..operators.failures import with_signals
from ..rules.ruleset import BUILT_IN, RuleSet
from ..session import materialize
from ..sources.feeds import adhoc_logs

#: A pasted log is judged by all that is known now.
END_OF_TIME = "9999-12-31 00:00:00"


def diagnose(pasted: DataFrame, kb: DataFrame | None = None, rules: RuleSet = BUILT_IN) -> DataFrame:
    """Accepted pasted logs with their rule diagnosis and the prompt for an offline model.

    ``pasted``: log_id, platform, log, context.  The log is redacted first; only global knowledge
    rows apply, since a pasted log belongs to no workspace.  ``kb`` is the stored knowledge table as
    it is now; the logs are then stored once, redacted, and their hits joined by ``log_id``.  Without
    it the curated rows apply, row by row, and nothing is shuffled.
    """
    accepted = adhoc_logs(pasted).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    clean = tx.with_redaction(accepted.withColumnRenamed("log", "__raw"), "__raw", "log", "redaction_count", rules.redaction)
    signed = with_signals(clean.drop("__raw"), "log", ("rule_id", "curated", "evidence"), rules)
    if kb is None:
        signed = signed.withColumn("kb_hits", knowledge.curated_texts(F.col("curated"), F.col("platform")))
    else:
        signed = materialize(signed, "pasted")
        logs = signed.select("log_id", F.lit(None).cast("string").alias("workspace_id"), "platform",
                             F.lit(END_OF_TIME).cast("timestamp").alias("at"), "log", "curated")
        everyones = kb.filter(F.col("workspace_id").isNull())  # no other row meets a log of no workspace
        signed = signed.join(knowledge.hit_texts(knowledge.search(logs, everyones), kb), "log_id", "left")
    known = signed.withColumns({
        "recurrence_note": F.lit(""),
        **{name: F.lit(None).cast("string") for name in ("pipeline_name", "task_name", "node_type")}})
    return diagnosis.by_rules(diagnosis.prompts(known, rule_set=rules), rules)
