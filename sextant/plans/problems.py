"""Queries of the general problems over the test tables, and their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from sextant.operators import eager, incremental, orphans
from sextant.session import ensure_checkpoint_dir, table


def p1_found(spark, d):
    return eager.crowded_endpoints(table(spark, d, "edges"))


def p1_degrees(spark, d):
    return eager.degrees(table(spark, d, "nodes"), table(spark, d, "edges")).withColumn("wedges", F.col("wedges").cast("long"))


def p1_rollup(spark, d):
    return eager.rollup_by(table(spark, d, "nodes"), table(spark, d, "edges"), ["repo_alias"])


def _orphans(spark, d):
    return orphans.orphan_report(*[table(spark, d, t) for t in ("edges", "lsp_edges", "cross_repo_edges", "import_refs", "nodes", "library_nodes", "known_modules")])


def p2_found(spark, d):
    return _orphans(spark, d)


def p2_counts(spark, d):
    return orphans.orphan_counts(_orphans(spark, d))


def p5_found(spark, d):
    return incremental.replay_runs(table(spark, d, "file_cache"), table(spark, d, "index_runs")).select("run_id", "file_path")


def p5_versions(spark, d):
    return incremental.replay_runs(table(spark, d, "file_cache"), table(spark, d, "index_runs"))


def p5_run_by_run(spark, d):
    """One run after the other through the ledger on disk, as a scheduled job would go."""
    folder = os.path.join(ensure_checkpoint_dir(spark), f"ledger-{uuid.uuid4()}")
    return incremental.run_by_run(table(spark, d, "file_cache"), table(spark, d, "index_runs"), folder)


QUERIES = {f.__name__: f for f in (p1_found, p1_degrees, p1_rollup, p2_found, p2_counts, p5_found, p5_versions, p5_run_by_run)}

CANON = r"regexp_replace(replace(trim({0}, E' \t\r\n'), '\', '/'), '^\./', '')"

ORPHANS = rf"""
lives AS (
  SELECT id, fqn, repo_alias AS repo, indexed_at AS born, deleted_at AS died FROM nodes
  UNION ALL SELECT id, fqn, repo_alias, indexed_at, NULL FROM library_nodes),
pyn AS (SELECT file_path, regexp_replace(file_path, '\.py$', '') AS path, name, indexed_at AS born, deleted_at AS died FROM nodes WHERE file_path LIKE '%.py'),
parts AS (SELECT *, string_split(path, '/') AS q FROM pyn),
mods AS (SELECT *, CASE WHEN q[1] IN ('src', 'lib', 'pkg') AND len(q) > 1 THEN q[2:] ELSE q END AS m FROM parts),
cand AS (SELECT *, unnest([array_to_string(m[i:], '.') FOR i IN range(1, len(m) + 1)]) AS module FROM mods),
keys AS (
  SELECT DISTINCT 'm:' || module AS k, born, died FROM cand
  UNION SELECT 'm:' || module || '.' || name, born, died FROM cand
  UNION SELECT 'p:' || path, born, died FROM pyn
  UNION SELECT 'p:' || path || '/' || name, born, died FROM pyn
  UNION SELECT 'm:' || module, TIMESTAMPTZ '0001-01-01 00:00:00+00', NULL FROM known_modules),
imp AS (
  SELECT id, recorded_at, target_module AS t, length(regexp_extract(target_module, '^\.+')) AS dots,
    string_split({CANON.format("source_file")}, '/') AS dirs, replace(regexp_replace(target_module, '^\.+', ''), '.', '/') AS rest
  FROM import_refs WHERE target_module IS NOT NULL),
impk AS (
  SELECT id, recorded_at, CASE WHEN dots = 0 THEN 'm:' || t WHEN len(dirs) - dots < 0 THEN 'none'
    ELSE 'p:' || array_to_string(list_concat(dirs[1:len(dirs) - dots], CASE WHEN rest = '' THEN [] ELSE [rest] END), '/') END AS k FROM imp),
orphans AS (
  SELECT 'edges' AS table_name, strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS period, id AS ref_id FROM edges e WHERE target_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM lives l WHERE l.id = e.target_id AND l.born <= e.recorded_at AND (l.died IS NULL OR l.died > e.recorded_at))
  UNION ALL SELECT 'lsp_edges', strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m'), id FROM lsp_edges e WHERE target_fqn IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM lives l WHERE l.fqn = {CANON.format("e.target_fqn")} AND l.born <= e.recorded_at AND (l.died IS NULL OR l.died > e.recorded_at))
  UNION ALL SELECT 'cross_repo_edges', strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m'), id FROM cross_repo_edges e WHERE target_fqn IS NOT NULL AND target_repo IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM lives l WHERE l.fqn = {CANON.format("e.target_fqn")} AND l.repo = e.target_repo AND l.born <= e.recorded_at AND (l.died IS NULL OR l.died > e.recorded_at))
  UNION ALL SELECT 'import_refs', strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m'), id FROM impk e
    WHERE NOT EXISTS (SELECT 1 FROM keys l WHERE l.k = e.k AND l.born <= e.recorded_at AND (l.died IS NULL OR l.died > e.recorded_at)))
"""

RUNS = rf"""
ok AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS prev FROM index_runs WHERE status = 'success'),
v AS (SELECT {CANON.format("file_path")} AS file_path, lower(blake3_hash) AS version, last_indexed_at AS at, row_id, batch_id FROM file_cache WHERE blake3_hash IS NOT NULL),
st AS (SELECT o.run_id, v.file_path, arg_max(v.version, (v.at, v.row_id)) AS version FROM ok o JOIN v ON v.batch_id <= o.run_id GROUP BY ALL),
cases AS (
  SELECT s.run_id, s.file_path, s.version FROM st s JOIN ok o USING (run_id)
  LEFT JOIN st p ON p.run_id = o.prev AND p.file_path = s.file_path WHERE p.version IS DISTINCT FROM s.version)
"""

ORACLE = {
    "p1_found": """
SELECT 'source_id' AS endpoint, source_id AS node_id FROM edges WHERE source_id IS NOT NULL GROUP BY source_id HAVING count(*) * 100 >= (SELECT count(*) FROM edges) * 2
UNION ALL
SELECT 'target_id', target_id FROM edges WHERE target_id IS NOT NULL GROUP BY target_id HAVING count(*) * 100 >= (SELECT count(*) FROM edges) * 2""",
    "p1_degrees": """
WITH o AS (SELECT source_id AS node_id, count(*) AS n, count(DISTINCT target_id) AS u FROM edges GROUP BY 1),
i AS (SELECT target_id AS node_id, count(*) AS n, count(DISTINCT source_id) AS u FROM edges GROUP BY 1)
SELECT d.id AS node_id, coalesce(i.n, 0)::BIGINT AS in_rows, coalesce(o.n, 0)::BIGINT AS out_rows, coalesce(i.u, 0)::BIGINT AS callers, coalesce(o.u, 0)::BIGINT AS callees,
  (coalesce(i.n, 0) * coalesce(o.n, 0))::BIGINT AS wedges
FROM (SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL) d LEFT JOIN o ON o.node_id = d.id LEFT JOIN i ON i.node_id = d.id""",
    "p1_rollup": """
WITH o AS (SELECT source_id AS node_id, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT target_id AS node_id, count(*) AS n FROM edges GROUP BY 1)
SELECT d.repo_alias, count(*)::BIGINT AS nodes, coalesce(sum(i.n), 0)::BIGINT AS in_rows, coalesce(sum(o.n), 0)::BIGINT AS out_rows, coalesce(max(i.n), 0)::BIGINT AS top_in
FROM nodes d LEFT JOIN o ON o.node_id = d.id LEFT JOIN i ON i.node_id = d.id WHERE d.id IS NOT NULL GROUP BY d.repo_alias""",
    "p2_found": f"WITH {ORPHANS} SELECT table_name, period, ref_id FROM orphans",
    "p2_counts": f"WITH {ORPHANS} SELECT table_name, period, count(*)::BIGINT AS orphans FROM orphans GROUP BY ALL",
    "p5_found": f"WITH {RUNS} SELECT run_id, file_path FROM cases",
    "p5_run_by_run": f"WITH {RUNS} SELECT run_id, file_path, version FROM cases",
    "p5_versions": f"WITH {RUNS} SELECT run_id, file_path, version FROM cases",
}
