"""Closed vocabularies of ledgers, events and searches."""

# Fixed values of the record formats.
NODE_STATUSES = ("active", "pending", "superseded", "deprecated", "expired", "forgotten", "conflict_pending", "active_session", "pending_promotion", "promoted", "discarded")
NODE_TYPES = ("preference", "identity_fact", "project_fact", "project_decision", "task", "commitment", "correction", "constraint", "tool_result", "artifact_reference", "code_state", "warning", "relationship", "temporal_event", "runbook", "benchmark_requirement", "security_policy", "memory")
EDGE_TYPES = ("supersedes", "refines", "expands", "narrows", "contradicts", "depends_on", "derived_from", "temporary_override", "source_of", "blocks", "resolves")
CONTENT_OPERATIONS = ("create", "update", "supersede", "refine", "expand", "narrow", "merge", "split", "resolve_conflict")
RETIRING_OPERATIONS = ("update", "supersede", "refine", "expand", "narrow", "merge", "split", "resolve_conflict", "expire", "forget", "deprecate")
KEEPING_OPERATIONS = ("create", "rollback")
OPERATIONS = RETIRING_OPERATIONS + KEEPING_OPERATIONS
SESSION_STATUSES = ("active", "ended", "forked", "merged")
UNGROUNDED_STATUSES = ("active_session", "pending", "pending_promotion")
KNOWN_SECTIONS = ("nodes", "patches", "edges", "sessions")
FORBIDDEN_KEYS = ("org_id", "user_id", "bucket", "collection", "api_key", "apikey", "token", "access_token")
NODE_FIELDS = ("schema_version", "id", "type", "scope", "key", "content", "status", "confidence", "priority", "created_at", "updated_at", "effective_from", "effective_until", "source", "relations", "retrieval", "metadata")
PATCH_FIELDS = ("schema_version", "id", "operation", "target_ids", "new_node_ids", "reason", "source", "confidence", "resolution_policy", "created_at", "applied_at")
EDGE_FIELDS = ("schema_version", "id", "from", "to", "type", "created_at", "source_patch_id")
SESSION_FIELDS = ("schema_version", "id", "agent", "workspace", "project", "started_at", "ended_at", "status", "parent_session_id", "branch_name", "loaded_memory_ids", "session_overlay_ids", "pending_patch_ids", "active_task", "policy", "events", "created_at", "updated_at")
# What is said of a record that breaks a rule, in the order of the rules; the references come last.
NODE_PROBLEMS = ("missing {field}", "schema_version must be {version}", "id must start with mem_", "unknown type {type}", "unknown status {status}", "content cannot be empty", "long-term node requires source label or source raw span", "relations must be object", "relations.{relation} must be list", "relations.{relation} missing node {ref}")
PATCH_PROBLEMS = ("missing {field}", "schema_version must be {version}", "id must start with patch_", "unknown operation {operation}", "target_ids required for {operation}", "new_content required for {operation}", "missing target node {ref}", "missing new node {ref}")
EDGE_PROBLEMS = ("missing {field}", "schema_version must be {version}", "id must start with edge_", "unknown type {type}", "missing from node {ref}", "missing to node {ref}", "missing source patch {ref}")
SESSION_PROBLEMS = ("missing {field}", "schema_version must be {version}", "unknown status {status}")
KINDS = ("node", "patch", "edge", "session")
EVENT_KIND = "ai_job_summary"
RETRYABLE_STATUSES = (0, 404, 408, 429)
TEMPORAL_MODES = ("before", "after", "between", "as_of", "latest")
