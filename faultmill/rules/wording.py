"""Texts shown to people: one entry per triage rule and per curated knowledge row."""

from dataclasses import dataclass

from .fixed_values import CURATED_KB, TRIAGE_RULES


@dataclass(frozen=True)
class Fix:
    title: str
    type: str
    steps: tuple[str, ...]
    diff: str = ""
    risk: str = "low"


@dataclass(frozen=True)
class RuleText:
    cause: str
    explanation: str
    fixes: tuple[Fix, ...]


RULE_TEXTS = {
    1: RuleText(
        "The task needed more memory than it was given and was killed.",
        "Memory ran out while the task held its working set. Growing input, a join that multiplies "
        "rows, or pulling a distributed result onto one node are the usual reasons.",
        (Fix("Give the task more memory", "config_change",
             ("Raise the memory request and limit of the executor or container",
              "Re-run and watch the peak usage")),
         Fix("Make the task need less memory", "code_change",
             ("Keep large results distributed instead of collecting them",
              "Process in smaller partitions and look for skewed keys")))),
    2: RuleText(
        "Local disk filled up on the machine running the task.",
        "Spilled shuffle data, temporary files or logs used all the space of the volume.",
        (Fix("Make room on the volume", "config_change",
             ("Remove stale temporary files and rotate logs",
              "Attach a larger disk or lower the spill by tuning partitions")),)),
    3: RuleText(
        "The identity of the task is not allowed to do this operation.",
        "Login worked but a privilege is absent. New objects without grants, changed roles and "
        "rotated identities are the common triggers.",
        (Fix("Grant what is missing", "config_change",
             ("Read the object and the operation from the quoted line",
              "Grant that privilege to the role of the pipeline",
              "Review recent role or credential changes")),)),
    4: RuleText(
        "The stored credentials were rejected as wrong or expired.",
        "The platform refused the login itself, so no permission was ever checked. Expired secrets "
        "and rotations that never reached the connection settings are typical.",
        (Fix("Renew the credentials of the connection", "config_change",
             ("Compare the stored secret with the current one",
              "Issue a new token or password and store it",
              "Make sure the account is active")),)),
    5: RuleText(
        "The query uses a column that its source does not have.",
        "The schema of the source probably changed: a rename, a drop, or another relation is read "
        "than before.",
        (Fix("Align the query with the source schema", "sql_patch",
             ("List the columns the source has now",
              "Rename the reference or restore an alias upstream",
              "Put a schema contract on the source")),)),
    6: RuleText(
        "A table or view the task reads is not there.",
        "It was dropped, renamed, or never built because its producer did not run; a wrong database "
        "or schema name looks the same.",
        (Fix("Check the producer of the relation", "manual",
             ("See whether the building job succeeded",
              "Compare database and schema names with the environment",
              "Adjust references after a rename")),)),
    7: RuleText(
        "A value could not be turned into the type the task expects.",
        "Incoming data changed its type or format, for instance text in a numeric column.",
        (Fix("Cast safely and trace the type change", "sql_patch",
             ("Sample the values that fail to convert",
              "Use a safe cast with rejects or repair the producer",
              "Test the format of the column")),)),
    8: RuleText(
        "Two transactions blocked each other.",
        "Several writers changed the same objects at once, often because a run overlapped its "
        "predecessor.",
        (Fix("Keep the writers apart", "config_change",
             ("Find the other transaction in the message",
              "Forbid overlapping runs and shorten transactions")),
         Fix("Run it again", "retry", ("Such collisions usually pass on a second try",)))),
    9: RuleText(
        "The work took longer than its time limit.",
        "Either the work grew, through more data, a worse plan or queueing, or the limit is tight.",
        (Fix("Find out what became slower", "manual",
             ("Compare the duration with earlier runs",
              "Look for queueing and for a changed plan")),
         Fix("Raise the limit if the growth is expected", "config_change",
             ("Set the timeout to match the new normal",)))),
    10: RuleText(
        "A remote service could not be reached over the network.",
        "Name resolution, connecting or the handshake failed, or the peer closed the connection. "
        "Once is often chance; repeats hint at endpoint or firewall settings.",
        (Fix("Run it again", "retry", ("A single network fault is usually gone by then",)),
         Fix("Trace the network path when it repeats", "manual",
             ("Resolve the host from the worker",
              "Check firewall rules and allow lists",
              "Look at the status of the service")))),
    11: RuleText(
        "A request limit or quota was reached.",
        "The platform throttled the calls; many jobs starting together is a frequent reason.",
        (Fix("Back off and spread the load", "config_change",
             ("Retry with growing pauses",
              "Spread the start times of the jobs",
              "Ask for a larger quota if the use is legitimate")),)),
    12: RuleText(
        "Rows in the load broke a database constraint.",
        "Unexpected nulls, duplicates or missing parents arrived; the cause is normally upstream.",
        (Fix("Set the offending rows aside and trace them", "manual",
             ("Sample the rows that violate the constraint",
              "Follow them back to their origin",
              "Test for this before loading")),)),
    13: RuleText(
        "A data test found data that breaks an expectation.",
        "The gate worked as meant: the data changed while the pipeline code is probably fine.",
        (Fix("Look at the rows the test rejects", "manual",
             ("Run the query of the test",
              "Decide between bad data and an outdated expectation",
              "Repair the source or the threshold")),)),
    14: RuleText(
        "An input file or object the task reads does not exist.",
        "A late or failed export, a path computed for an empty period, or a new naming scheme.",
        (Fix("Check the export and the computed path", "manual",
             ("See whether the export for this period ran",
              "Compare the computed path with what is stored",
              "Wait for the file with a sensor")),)),
    15: RuleText(
        "A library the code imports is missing in the runtime.",
        "The environment changed or a dependency is not pinned.",
        (Fix("Install and pin the library", "config_change",
             ("Add it to the image or the cluster libraries",
              "Pin the version",
              "Deploy the rebuilt environment")),)),
    16: RuleText(
        "The code or SQL does not parse.",
        "A recent edit, a template variable left unrendered, or a dialect difference.",
        (Fix("Correct the text at the reported position", "code_change",
             ("Go to the position in the message",
              "Check the rendered templates",
              "Compare with the version of the last good run")),)),
    17: RuleText(
        "The code of the task raised an exception.",
        "After a deployment suspect the change; otherwise suspect a shape of data not seen before.",
        (Fix("Reproduce it with the failing input", "code_change",
             ("Follow the last frames of the trace",
              "Compare recent changes of code and data",
              "Handle the edge case")),)),
    18: RuleText(
        "A task this one depends on failed first.",
        "This is a consequence. The earliest failed task of the run holds the cause.",
        (Fix("Work on the upstream failure", "manual",
             ("Find the first failed task of the run",
              "Fix it and restart from there")),)),
    19: RuleText(
        "Spark lost executors or shuffle data in the middle of the job.",
        "Memory pressure, reclaimed machines or strong skew took executors away.",
        (Fix("Make the executors last", "config_change",
             ("Raise executor memory and its overhead",
              "Enable decommissioning or use stable machines",
              "Look for skewed partitions and salt the key")),)),
}
assert set(RULE_TEXTS) == {rule[0] for rule in TRIAGE_RULES}

UNKNOWN_TEXT = RuleText(
    "No known failure pattern fits; a person has to look.",
    "None of the patterns matched this log. Its most telling error lines are attached.",
    (Fix("Look into it by hand", "manual",
         ("Read the attached error lines",
          "Compare with the last good run of the task",
          "Check recent deployments of code and settings")),),
)
UNKNOWN_CONFIDENCE = 0.3

# curated id -> (title, cause, fix)
KB_TEXTS = {
    1: ("Airflow task got SIGTERM",
        "Something stopped the task: a timeout, an evicted worker or a redeployed DAG.",
        "Check the execution timeout and worker evictions, allow retries, keep the task idempotent."),
    2: ("DAG file fails on import",
        "The DAG raised or was too slow while being imported.",
        "Import the file locally, move heavy work out of module level, pin its dependencies."),
    3: ("Airflow zombie or killed task",
        "The worker vanished without reporting, mostly for lack of memory.",
        "Compare memory limits with usage and raise the resources of the task."),
    4: ("dbt cannot resolve a ref or source",
        "A ref or source names a node that does not exist.",
        "Look the name up in the manifest, install packages, search for the old name."),
    5: ("dbt run hook failed",
        "A hook before or after the models failed; the models may be fine.",
        "Read the hook SQL in the project file; check its grants and audit tables."),
    6: ("Snowflake 904: unknown identifier",
        "A column does not resolve: quoting with lower case or schema drift.",
        "Check quoted identifiers and compare with the columns the table has."),
    7: ("Fault inside Snowflake",
        "The fault lies on the side of the service.",
        "Run again; if it stays, check the service status and report the query id."),
    8: ("Snowflake warehouse out of credits",
        "A resource monitor suspended the warehouse.",
        "Check the resource monitors, raise the quota, find what used the credits."),
    9: ("Databricks library does not install",
        "Version conflicts, absent repositories or init scripts broke the install.",
        "Read the cluster events, pin fitting versions, prefer prepared images."),
    10: ("Databricks driver does not respond",
         "The driver is busy collecting garbage or out of memory.",
         "Keep large data off the driver and give it more memory."),
    11: ("ADF 2200: source not found",
         "The source path of the activity does not exist for this window.",
         "Check the path parameters and whether the upstream drop is late."),
    12: ("Self-hosted runtime out of reach",
         "The self-hosted runtime node cannot be reached.",
         "Check the node and its network; add a second one."),
    13: ("Process crashed natively",
         "A native library ended the process.",
         "Reinstall and pin the native dependencies for this platform."),
}
assert set(KB_TEXTS) == {row[0] for row in CURATED_KB}

KB_FIX_TITLE_PREFIX = "KB: "
LEARNED_DEFAULT_FIX = "See the earlier incident"


def recurrence_text() -> tuple[str, str, str, str]:
    """The constant pieces around count, date and notes of the recurrence note."""
    return ("Earlier incident with the same signature: failures ", ", closed as resolved ",
            "", "; what helped: ")

