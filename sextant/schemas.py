"""Explicit schemas of the live tables and the version of the snapshot layout."""

from __future__ import annotations


SCHEMA_VERSION = "9"



NODES = "id long, name string, fqn string, file_path string, kind string, start_line int, end_line int, signature string, docstring string, body_preview string, is_exported boolean, is_test boolean, repo_alias string"
EDGES = "id long, source_id long, target_id long, type string, call_site_line int, confidence double"
CALL_REFS = "source_fqn string, target string, type string, call_site_line int, confidence double"
IMPORT_REFS = "source_file string, target_module string, call_site_line int"
FILE_CACHE = "file_path string, content_hash string, last_indexed_at timestamp, node_count int"
OBSERVATIONS = "id long, session_id string, type string, content string, created_at timestamp, source string, confidence double, stale boolean"
OBSERVATION_LINKS = "observation_id long, node_id long"
SESSIONS = "session_id string, started_at timestamp, workspace string"
LSP_EDGES = "source_fqn string, target_fqn string, edge_type string"
CROSS_REPO_EDGES = "id long, workspace_id string, source_repo string, source_fqn string, target_repo string, target_fqn string, type string, confidence double"
CO_CHANGE = "file_a string, file_b string, coupling_score double, shared_commits long"
FILE_LINEAGE = "file_path string, commit_count long, churn_score double, last_author string, last_commit_ts timestamp"
EMBEDDINGS = "node_id long, vector_json string"
TFIDF_VOCAB = "term string, df long, idf double"
FTS_POSTINGS = "term string, id long, field string, positions array<int>, len int"
FTS_STATS = "documents long, average double"
DENSE = "node_id long, vector array<float>, model_name string"
COMMITS = "commit string, file_path string, author string, ts timestamp"
REQUEST_LOG = "ts timestamp, session string, event string, tool string, args map<string,string>, elapsed_ms double, result_chars long, result_tokens_approx long, preview string, error string"

TABLES = {
    "nodes": NODES, "edges": EDGES, "call_refs": CALL_REFS, "import_refs": IMPORT_REFS, "file_cache": FILE_CACHE, "observations": OBSERVATIONS,
    "observation_node_links": OBSERVATION_LINKS, "sessions": SESSIONS, "lsp_edges": LSP_EDGES, "cross_repo_edges": CROSS_REPO_EDGES, "co_change_edges": CO_CHANGE,
    "file_lineage": FILE_LINEAGE, "tfidf_vocab": TFIDF_VOCAB, "node_embeddings": EMBEDDINGS, "node_embeddings_dense": DENSE,
    "fts_postings": FTS_POSTINGS, "fts_stats": FTS_STATS,
}
