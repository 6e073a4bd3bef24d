"""Schemas of the canonical model."""

TASK = (
    "struct<task_id string, name string, node_type string, status string, try_number int, "
    "started_at timestamp, ended_at timestamp, upstream_task_ids array<string>, log string>"
)
EVENT_COLUMNS = (
    "event_id", "received_at", "workspace_id", "platform", "pipeline_external_id",
    "pipeline_name", "run_external_id", "status", "trigger", "started_at", "ended_at",
    "config_snapshot", "tasks",
)
# how a feed of raw payloads arrives: one JSON document per row
FEED = "event_id string, received_at timestamp, workspace_id string, payload string"
STATUS_EVENT = (
    "event_id string, at timestamp, workspace_id string, fingerprint string, target_seq long, "
    "status string, notes string"
)
FEEDBACK_EVENT = (
    "event_id string, at timestamp, incident_id string, verdict string, comment string"
)
ADHOC_LOG = "log_id string, platform string, log string, context string"
MODEL_RESPONSE = "incident_id string, at timestamp, response string"
