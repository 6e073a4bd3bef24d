"""Text templates from which test logs and payloads are derived.

``$n`` is an integer key, ``$d`` its last digit, ``$s`` two digits below 60, ``$c`` a pipeline
number, ``$o`` a date.  One table is rendered for Spark and for the SQL oracle.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = re.compile(r"(\$[ndsco])")

TASK_LOGS = (
    "2024-03-0$d 10:00:$s ERROR sorter met OutOfMemoryError after $n rows",
    "java.lang.OutOfMemoryError: GC overhead",
    "write failed: No space left on device /tmp/spill_$n",
    "ERROR: permission denied for schema mart_$n",
    "login failed for user svc_$n",
    'ERROR: column "c_$n" does not exist',
    "Table or view not found: raw.t_$n",
    "Numeric value 'seven' is not recognized at row $n",
    "ERROR deadlock detected while locking tuple $n",
    "statement timeout after $n ms",
    "could not connect to server 10.0.0.$d:5432",
    "HTTP 429 Too Many Requests retry in $n",
    'null value in column "k" violates not-null constraint (row $n)',
    "FAIL $n rows in unique check",
    "FileNotFoundError: /landing/part-$n.csv",
    "ModuleNotFoundError: No module named 'lib$n'",
    "mismatched input 'FRM' expecting FROM, line $n",
    "Traceback: KeyError 'k$n'",
    "upstream task extract_$n failed",
    "Lost executor $d on host-$n",
    "INFO step $n ended with code 3",
    'ERROR odd state $n; password = "pw$nsecret" mail ops$n@example.com',
    "could not connect to server: postgresql://u:p$n@db/x refused",
    "WARN credit check pending $n",
)

# (payload, reject reason or None, run fields, task fields); moments as the canonical text
AIRFLOW_PAYLOADS = (
    ('{"dag_id":"pipe_$c","dag_display_name":"Pipe $c","dag_run_id":"run-$n","state":"failed",'
     '"run_type":"manual","start_date":"$oT02:00:00Z","end_date":"$oT02:14:10+02:00",'
     '"conf":{"day":"$d"},"task_instances":['
     '{"task_id":"extract","operator":"PythonOperator","state":"success","try_number":1},'
     '{"task_id":"load","operator":"SqlOperator","state":"failed","try_number":"2",'
     '"upstream_task_ids":["extract"],"log":"ERROR: column \\"c_$n\\" does not exist"},'
     '{"task_id":"publish","state":"upstream_failed","upstream_task_ids":["load","extract"]}]}',
     None,
     ("pipe_$c", "Pipe $c", "run-$n", "failed", "manual", "$o 02:00:00", "$o 00:14:10",
      '{"day":"$d"}'),
     (("extract", "PythonOperator", "success", 1, "", ""),
      ("load", "SqlOperator", "failed", 2, "extract", 'ERROR: column "c_$n" does not exist'),
      ("publish", "", "upstream_failed", 1, "load,extract", ""))),
    ('{"dag_id":"pipe_$c","run_id":"alt-$n","state":"SUCCESS","task_instances":['
     '{"task_id":"t","operator":"","state":"Removed","try_number":3,"log":"fine $n"}]}',
     None, ("pipe_$c", "pipe_$c", "alt-$n", "success", "scheduled", None, None, "{}"),
     (("t", "", "skipped", 3, "", "fine $n"),)),
    ('{"dag_id":"pipe_$c","dag_display_name":"","dag_run_id":"","state":"queued","conf":{},'
     '"start_date":"$o 02:00"}',
     None, ("pipe_$c", "pipe_$c", "unknown", "running", "scheduled", "$o 02:00:00", None, "{}"),
     ()),
    ('{"dag_id":"pipe_$c","dag_run_id":"run-$n","state":"shutdown","start_date":"$oT020000",'
     '"end_date":"","task_instances":[]}',
     None, ("pipe_$c", "pipe_$c", "run-$n", "cancelled", "scheduled", "$o 02:00:00", None, "{}"),
     ()),
    ('{"dag_id":"pipe_$c","dag_run_id":"run-$n","state":"mystery"}',
     None, ("pipe_$c", "pipe_$c", "run-$n", "failed", "scheduled", None, None, "{}"), ()),
    ('{"dag_id":"pipe_$c","dag_run_id":"run-$n","start_date":"no date","task_instances":['
     '{"log":"ERROR: permission denied for schema mart_$n","start_date":"$oT05:00:$s"}]}',
     None, ("pipe_$c", "pipe_$c", "run-$n", "failed", "scheduled", None, None, "{}"),
     (("unknown", "", "failed", 1, "", "ERROR: permission denied for schema mart_$n"),)),
    ('{"dag_run_id":"run-$n","state":"failed"}', "missing dag_id", (), ()),
    ('{"dag_id":"pipe_$c","task_instances":[{"task_id":"t","try_number":"abc"}]}',
     "invalid try_number", (), ()),
    ('{"dag_id":"pipe_$c","task_instances":[{"task_id":"t","log":null}]}',
     "invalid log", (), ()),
    ('{"dag_id":null,"state":"failed"}', "invalid dag_id", (), ()),
    ('{"dag_id":"pipe_$c","dag_run_id":"run-$n","state":null,"conf":null,"task_instances":['
     '{"task_id":"a","state":"upstream_failed","log":"upstream task x_$n failed"},'
     '{"task_id":"b","state":"skipped","log":"skipped, told ops$n@example.com and ops@example.org"}]}',
     None, ("pipe_$c", "pipe_$c", "run-$n", "failed", "scheduled", None, None, "{}"),
     (("a", "", "upstream_failed", 1, "", "upstream task x_$n failed"),
      ("b", "", "skipped", 1, "", "skipped, told ops$n@example.com and ops@example.org"))),
    ('{"dag_id":"pipe_$c', "malformed payload", (), ()),
    ('{"dag_id":"pipe_$c","run_id":null}', "invalid run id", (), ()),
    ('{"dag_id":"pipe_$c","dag_run_id":"run-$n","state":"running",'
     '"start_date":"$oT02:00:00-05:30","end_date":"$oT23:59:59"}',
     None, ("pipe_$c", "pipe_$c", "run-$n", "running", "scheduled", "$o 07:30:00",
            "$o 23:59:59", "{}"), ()),
    ('{"dag_id":"pipe_$c","task_instances":null}', "invalid task_instances", (), ()),
    ('{"dag_id":"pipe_$c","task_instances":[{"task_id":"t","upstream_task_ids":[1]}]}',
     "invalid upstream_task_ids", (), ()),
)

DBT_PAYLOADS = (
    ('{"project_name":"analytics","job_id":"job-$c","run_id":"run-$n","run_results":{"metadata":'
     '{"invocation_id":"i$n","dbt_version":"1.8.$d","generated_at":"$oT03:09:00Z"},"results":['
     '{"unique_id":"model.analytics.stg_$c","status":"success","timing":[]},'
     '{"unique_id":"test.analytics.uniq_$c","status":"fail","message":"FAIL $n rows",'
     '"compiled_code":"select $n","timing":['
     '{"name":"compile","started_at":"$oT01:00:00Z","completed_at":"$oT01:00:01Z"},'
     '{"name":"execute","started_at":"$oT01:00:02Z","completed_at":"$oT01:00:03Z"},'
     '{"name":"execute","started_at":"$oT01:00:04Z","completed_at":"$oT01:00:05Z"}]}]}}',
     None,
     ("job-$c", "analytics", "run-$n", "failed", "scheduled", "$o 03:09:00", "$o 03:09:00",
      '{"dbt_version":"1.8.$d"}'),
     (("model.analytics.stg_$c", "stg_$c", "model", "success", None, None, ""),
      ("test.analytics.uniq_$c", "uniq_$c", "test", "failed", "$o 01:00:04", "$o 01:00:05",
       "FAIL $n rows\n\n--- compiled SQL ---\nselect $n"))),
    ('{"metadata":{"invocation_id":"i$n","project_name":"shop_$c"},"results":['
     '{"unique_id":"seed_$c","status":"WARN"},{"status":"pass"}]}',
     None,
     ("shop_$c", "shop_$c", "i$n", "success", "scheduled", None, None, '{"dbt_version":""}'),
     (("seed_$c", "seed_$c", "model", "success", None, None, ""),
      ("unknown", "unknown", "model", "success", None, None, ""))),
    ("{}", None,
     ("dbt-project", "dbt-project", "unknown", "success", "scheduled", None, None,
      '{"dbt_version":""}'), ()),
    ('{"project_name":"","job_id":$n,"run_id":$n,"run_results":{"metadata":{"dbt_version":null},'
     '"results":[{"unique_id":"snapshot.p.s_$d","status":"runtime error","message":null,'
     '"compiled_code":"","compiled_sql":"select 1 from t_$n"}]}}',
     None,
     ("$n", "dbt-project", "$n", "failed", "scheduled", None, None, '{"dbt_version":null}'),
     (("snapshot.p.s_$d", "s_$d", "snapshot", "failed", None, None,
       "\n\n--- compiled SQL ---\nselect 1 from t_$n"),)),
    ('{"project_name":"analytics","run_id":0,"run_results":{"results":['
     '{"unique_id":"model.a.m_$c","status":"odd","message":"Database Error: invalid identifier '
     "'C_$n'\"},"
     '{"unique_id":"model.a.n_$c","status":"skipped","message":"not run"},'
     '{"unique_id":"model.a.o_$c","status":null}]}}',
     None,
     ("analytics", "analytics", "unknown", "failed", "scheduled", None, None,
      '{"dbt_version":""}'),
     (("model.a.m_$c", "m_$c", "model", "failed", None, None,
       "Database Error: invalid identifier 'C_$n'"),
      ("model.a.n_$c", "n_$c", "model", "skipped", None, None, ""),
      ("model.a.o_$c", "o_$c", "model", "failed", None, None, ""))),
    ('{"run_results":null}', "invalid run_results", (), ()),
    ('{"results":null}', "invalid results", (), ()),
    ('{"results":[{"unique_id":null,"status":"error"}]}', "invalid unique_id", (), ()),
    ('{"project_name":$n}', "invalid project_name", (), ()),
    ('[$n]', "malformed payload", (), ()),
    ('{"results":[{"unique_id":"m","status":"error","timing":null}]}', "invalid timing", (), ()),
)

GENERIC_PAYLOADS = (
    ('{"platform":"databricks","pipeline_external_id":"pipe_$c","pipeline_name":"Pipe $c",'
     '"run_external_id":"run-$n","status":"failed","trigger":"manual",'
     '"started_at":"$oT04:00:00+01:00","ended_at":null,"config_snapshot":{"cluster":$d},'
     '"tasks":[{"task_id":"a","status":"upstream_failed","log":"upstream task a_$n failed"},'
     '{"task_id":"b","name":"Load b","node_type":"notebook","status":"failed","try_number":2,'
     '"upstream_task_ids":["a"],"log":"Lost executor $d on host-$n"}]}',
     None,
     ("databricks", "pipe_$c", "Pipe $c", "run-$n", "failed", "manual", "$o 03:00:00", None,
      '{"cluster":$d}'),
     (("a", "", "", "upstream_failed", 1, "", "upstream task a_$n failed"),
      ("b", "Load b", "notebook", "failed", 2, "a", "Lost executor $d on host-$n"))),
    ('{"platform":"spark","pipeline_external_id":"pipe_$c","run_external_id":"run-$n",'
     '"status":"success"}',
     None,
     ("spark", "pipe_$c", "", "run-$n", "success", "scheduled", None, None, "{}"), ()),
    ('{"platform":"adf","pipeline_external_id":"pipe_$c","run_external_id":"run-$n",'
     '"status":"failed","started_at":1700000000,"tasks":[]}',
     None,
     ("adf", "pipe_$c", "", "run-$n", "failed", "scheduled", "2023-11-14 22:13:20", None, "{}"),
     ()),
    ('{"platform":"oracle","pipeline_external_id":"p","run_external_id":"r","status":"failed"}',
     "invalid platform", (), ()),
    ('{"platform":"adf","run_external_id":"r","status":"failed"}',
     "invalid pipeline_external_id", (), ()),
    ('{"platform":"adf","pipeline_external_id":"p","status":"failed"}',
     "invalid run_external_id", (), ()),
    ('{"platform":"adf","pipeline_external_id":"p","run_external_id":"r","status":"FAILED"}',
     "invalid status", (), ()),
    ('{"platform":"adf","pipeline_external_id":"p","run_external_id":"r","status":"failed",'
     '"tasks":[{"task_id":"t","status":"odd"}]}', "invalid task status", (), ()),
    ('{"platform":"adf","pipeline_external_id":"p","run_external_id":"r","status":"failed",'
     '"tasks":[{"task_id":"t","status":"failed","try_number":2.5}]}',
     "invalid try_number", (), ()),
    ('{"platform":"adf","pipeline_external_id":"p","run_external_id":"r","status":"failed",'
     '"started_at":"soon"}', "invalid date", (), ()),
    ('{"platform":"adf","pipeline_external_id":"p","pipeline_name":null,"run_external_id":"r",'
     '"status":"failed"}', "invalid pipeline_name", (), ()),
    ("not json $n", "malformed payload", (), ()),
)


def pieces(template: str) -> list[str]:
    return [p for p in _MARK.split(template) if p]


def spark_text(template: str, marks: dict[str, Column]) -> Column:
    return F.concat(*[marks[p[1]] if _MARK.fullmatch(p) else F.lit(p) for p in pieces(template)])


def spark_choice(templates: list[str], index: Column, marks: dict[str, Column]) -> Column:
    chosen = None
    for number, template in enumerate(templates):
        text = spark_text(template, marks)
        chosen = (F.when(index == number, text) if chosen is None
                  else chosen.when(index == number, text))
    return chosen


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_text(template: str | None, marks: dict[str, str]) -> str:
    if template is None:
        return "CAST(NULL AS VARCHAR)"
    if template == "":
        return "''"
    return "(" + " || ".join(
        marks[p[1]] if _MARK.fullmatch(p) else sql_literal(p) for p in pieces(template)) + ")"


def sql_choice(templates: list[str], index: str, marks: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {number} THEN {sql_text(t, marks)}"
                     for number, t in enumerate(templates))
    return f"CASE {index} {cases} END"
