"""Schemas of the engine's tables."""

CHUNKS = (
    "chunk_id string, file_path string, start_line int, end_line int, language string, node_type string, function_name string, class_name string, raw_code string, docstring string, "
    "has_docstring boolean, imports array<string>, is_split_chunk boolean, split_index int, total_splits int, token_count int"
)
#: What parsing a file yields, before splitting.
PARSED = CHUNKS + ", calls array<string>, nested boolean, parse_errors boolean, line_count int, error string"
NODES = "node_id string, chunk_id string, file_path string, qualified_name string, language string, node_type string, start_line int, end_line int"
EDGES = "source string, target string, edge_type string, call_name string, is_resolved boolean"
MANIFEST = "file_path string, sha256 string, chunk_ids array<string>, chunk_count int, indexed_at timestamp"
QA = "id string, question string, expected_chunks array<string>, expected_keywords array<string>, notes string"
