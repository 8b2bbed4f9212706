"""Schemas of the store's tables."""

VERSION = 3
INSIGHTS = ("tenant_id string, user_id string, namespace string, id string, content string, normalized_content string, content_hash string, search_tokens array<string>, "
            "category string, importance int, tags array<string>, entities array<string>, source string, metadata string, managed boolean, access_count int, stored_at timestamp, "
            "created_at timestamp, updated_at timestamp, deleted_at timestamp, last_accessed_at timestamp, embedding array<float>, effective_importance double")
EDGES = "tenant_id string, user_id string, namespace string, source_id string, target_id string, edge_type string, weight double, metadata map<string,string>, created_at timestamp, derived boolean, edge_seq bigint, gone boolean"
OPLOG = "id bigint, tenant_id string, user_id string, namespace string, operation string, insight_id string, detail string, created_at timestamp, gone boolean"
OPERATIONS = "tenant_id string, user_id string, namespace string, key string, result string, created_at timestamp, gone boolean"
SETTINGS = "key string, value string, updated_at timestamp"
TABLES = {"insights": INSIGHTS, "edges": EDGES, "oplog": OPLOG, "operations": OPERATIONS, "settings": SETTINGS}
KEYS = {"insights": ("tenant_id", "namespace", "id"), "edges": ("tenant_id", "namespace", "source_id", "target_id", "edge_type"), "oplog": ("id",), "operations": ("tenant_id", "namespace", "key"), "settings": ("key",)}
EMPTY_ARRAYS = ("search_tokens", "tags", "entities")
