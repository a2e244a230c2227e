"""Filters, joins, aggregates, windows, sorts, set operations and scalar functions of the reference's inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sextant.functions import text as tx
from sextant.functions.paths import canonical_path
from sextant.operators import graph, memory, rank
from sextant.plans import views
from sextant.plans.registry import Registry
from sextant.session import table
from sextant.sources.extract import strip_marks

q = Registry()
QUERIES, ORACLE = q.queries, q.sql


@q("F01_node_projection", "SELECT id, name, fqn, file_path, kind, coalesce(start_line, 0) AS start_line FROM nodes")
def f01(s, d):
    return table(s, d, "nodes").select("id", "name", "fqn", "file_path", "kind", F.coalesce("start_line", F.lit(0)).alias("start_line"))


@q("F02_exported_calls", "SELECT e.id, e.source_id, e.target_id FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.type = 'CALLS' AND n.is_exported")
def f02(s, d):
    n = table(s, d, "nodes").where(F.col("is_exported")).select(F.col("id").alias("source_id"))
    return table(s, d, "edges").where(F.col("type") == "CALLS").join(n, "source_id", "left_semi").select("id", "source_id", "target_id")


@q("F03_in_list", "SELECT id, fqn FROM nodes WHERE file_path IN (SELECT source_file FROM import_refs)")
def f03(s, d):
    return table(s, d, "nodes").join(table(s, d, "import_refs").select(F.col("source_file").alias("file_path")), "file_path", "left_semi").select("id", "fqn")


@q("F04_like_any_column", "SELECT id FROM nodes WHERE name ILIKE '%cursor%' OR fqn ILIKE '%cursor%' OR docstring ILIKE '%cursor%' OR signature ILIKE '%cursor%'")
def f04(s, d):
    like = [F.coalesce(F.col(c).ilike("%cursor%"), F.lit(False)) for c in ("name", "fqn", "docstring", "signature")]
    return table(s, d, "nodes").where(like[0] | like[1] | like[2] | like[3]).select("id")


@q("F05_confidence_range", "SELECT id, confidence FROM edges WHERE confidence >= 0.75")
def f05(s, d):
    return table(s, d, "edges").where(F.col("confidence") >= 0.75).select("id", "confidence")


@q("F06_time_range", "SELECT doc_id, doc_kind FROM documents WHERE created_at >= (SELECT max(created_at) FROM documents) - INTERVAL 30 DAY")
def f06(s, d):
    t = table(s, d, "documents")
    return t.where(F.col("created_at") >= t.agg(F.max("created_at")).scalar() - F.expr("INTERVAL 30 DAYS")).select("doc_id", "doc_kind")


@q("F07_optional_predicates", f"WITH {views.OBSERVATIONS_SQL} SELECT id, type, session_id FROM observations WHERE type IN ('readme', 'issue') AND NOT stale AND confidence >= 0.5")
def f07(s, d):
    wanted = {"types": ["readme", "issue"], "stale": False, "confidence": 0.5, "session": None}
    keep = F.lit(True)
    if wanted["types"]:
        keep = keep & F.col("type").isin(wanted["types"])
    if wanted["stale"] is not None:
        keep = keep & (F.col("stale") == wanted["stale"])
    if wanted["confidence"] is not None:
        keep = keep & (F.col("confidence") >= wanted["confidence"])
    if wanted["session"]:
        keep = keep & (F.col("session_id") == wanted["session"])
    return views.observations(s, d).where(keep).select("id", "type", "session_id")


@q("F08_filter_after_rank", "WITH r AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id, query_id) AS r, query_id FROM (SELECT DISTINCT query_id, node_id, score FROM search_results WHERE score IS NOT NULL)) SELECT r.query_id, r.node_id FROM r JOIN nodes n ON n.id = r.node_id WHERE r <= 200 AND n.kind = 'function' ORDER BY r LIMIT 100")
def f08(s, d):
    best = table(s, d, "search_results").where(F.col("score").isNotNull()).select("query_id", "node_id", "score").distinct().orderBy(F.col("score").desc(), "node_id", "query_id").limit(200)
    n = table(s, d, "nodes").where(F.col("kind") == "function").select(F.col("id").alias("node_id"))
    return n.join(F.broadcast(best), "node_id").orderBy(F.col("score").desc(), "node_id", "query_id").limit(100).select("query_id", "node_id")


@q("F09_exclusion", "SELECT id, fqn FROM nodes WHERE fqn NOT IN (SELECT fqn FROM library_nodes) AND id NOT IN (SELECT node_id FROM search_results WHERE node_id IS NOT NULL)")
def f09(s, d):
    n = table(s, d, "nodes").join(table(s, d, "library_nodes").select("fqn"), "fqn", "left_anti")
    return n.join(table(s, d, "search_results").select(F.col("node_id").alias("id")), "id", "left_anti").select("id", "fqn")


REASON_SQL = """CASE WHEN r = '' THEN 'weak match' ELSE r END AS reason FROM (SELECT query_id, node_id, concat_ws(' + ',
  CASE WHEN b.bm25 > 0.5 THEN 'high text relevance' WHEN b.bm25 > 0.1 THEN 'keyword match' END, CASE WHEN b.semantic > 0.5 THEN 'strong semantic match' WHEN b.semantic > 0.2 THEN 'semantic similarity' END,
  CASE WHEN b.graph > 0.3 THEN 'highly connected' END) AS r FROM (SELECT DISTINCT query_id, node_id, score_breakdown AS b FROM search_results))"""


@q("F10_reason_label", f"SELECT query_id, node_id, {REASON_SQL}")
def f10(s, d):
    r = table(s, d, "search_results").select("query_id", "node_id", "score_breakdown.*").distinct()
    return r.select("query_id", "node_id", rank.reason(bm25=F.col("bm25"), semantic=F.col("semantic"), graph=F.col("graph")).alias("reason"))


@q("F11_coalesce_truncate", "SELECT id, substring(coalesce(docstring, ''), 1, 256) AS docstring, substring(coalesce(signature, ''), 1, 200) AS signature FROM nodes")
def f11(s, d):
    return table(s, d, "nodes").select("id", F.substring(F.coalesce("docstring", F.lit("")), 1, 256).alias("docstring"), F.substring(F.coalesce("signature", F.lit("")), 1, 200).alias("signature"))


@q("F12_constant_columns", "SELECT id, 5.0::DOUBLE AS score, 'function' AS kind FROM nodes WHERE name = 'fetch_symbol'")
def f12(s, d):
    return table(s, d, "nodes").where(F.col("name") == "fetch_symbol").select("id", F.lit(5.0).alias("score"), F.lit("function").alias("kind"))


@q("F13_self_loops_dropped", "SELECT id FROM edges WHERE source_id <> target_id")
def f13(s, d):
    return table(s, d, "edges").where(F.col("source_id") != F.col("target_id")).select("id")


@q("J01_nodes_with_tokens", f"SELECT term, count(*)::BIGINT AS nodes FROM (SELECT DISTINCT id, unnest({views.fts_sql('name')}) AS term FROM nodes) GROUP BY 1")
def j01(s, d):
    n = table(s, d, "nodes")
    tokens = n.select("id", F.explode(tx.fts_tokens(F.col("name"))).alias("term")).distinct()
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("nodes"))


@q("J02_edges_with_source", "SELECT e.id, n.fqn, n.kind, e.type FROM edges e JOIN nodes n ON n.id = e.source_id")
def j02(s, d):
    from sextant.operators.skew import skew_join

    n = table(s, d, "nodes").select(F.col("id").alias("source_id"), "fqn", "kind")
    return skew_join(table(s, d, "edges").select("id", "source_id", "type"), n, ["source_id"]).select("id", "fqn", "kind", "type")


@q("J03_observations_of_nodes", f"WITH {views.OBSERVATIONS_SQL} SELECT DISTINCT o.id, o.type, o.stale FROM observations o JOIN links l ON l.observation_id = o.id")
def j03(s, d):
    return views.observations(s, d).join(views.links(s, d).select(F.col("observation_id").alias("id")), "id").select("id", "type", "stale").distinct()


@q("J04_observations_with_word", f"WITH {views.OBSERVATIONS_SQL} SELECT id, type FROM observations WHERE list_contains({views.fts_sql('content')}, 'cursor')")
def j04(s, d):
    return views.observations(s, d).where(F.array_contains(tx.fts_tokens(F.col("content")), "cursor")).select("id", "type")


@q("J05_semi_join", "SELECT id FROM nodes WHERE id IN (SELECT target_id FROM edges WHERE type = 'IMPORTS')")
def j05(s, d):
    return table(s, d, "nodes").join(table(s, d, "edges").where(F.col("type") == "IMPORTS").select(F.col("target_id").alias("id")), "id", "left_semi").select("id")


@q("J06_count_per_row", "SELECT n.id, (SELECT count(*) FROM edges e WHERE e.source_id = n.id AND e.type = 'CALLS')::BIGINT AS fanout FROM nodes n")
def j06(s, d):
    c = table(s, d, "edges").where(F.col("type") == "CALLS").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("fanout"))
    return table(s, d, "nodes").select("id").join(c, "id", "left").na.fill(0)


@q("J07_anti_join", "SELECT id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id)")
def j07(s, d):
    return table(s, d, "nodes").join(table(s, d, "edges").select(F.col("target_id").alias("id")), "id", "left_anti").select("id")


@q("J08_lookup_with_default", "SELECT n.id, coalesce(c.n, 0)::BIGINT AS n_vectors FROM nodes n LEFT JOIN (SELECT node_id, count(*) AS n FROM node_embeddings GROUP BY 1) c ON c.node_id = n.id")
def j08(s, d):
    c = table(s, d, "node_embeddings").groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("n_vectors"))
    return table(s, d, "nodes").select("id").join(c, "id", "left").na.fill(0)


@q("J09_point_lookups", f"WITH {views.LSP_SQL} SELECT l.source_fqn, l.target_fqn, n.id AS target_id FROM lsp l LEFT JOIN nodes n ON n.fqn = l.target_fqn")
def j09(s, d):
    n = table(s, d, "nodes").select(F.col("fqn").alias("target_fqn"), F.col("id").alias("target_id"))
    return views.lsp(s, d).join(n, "target_fqn", "left").select("source_fqn", "target_fqn", "target_id").distinct()


ORACLE["J09_point_lookups"] = ORACLE["J09_point_lookups"].replace("SELECT l.source_fqn", "SELECT DISTINCT l.source_fqn")


@q("J10_pairs_within_commit", f"WITH {views.COMMITS_SQL} SELECT file_a, file_b, shared::BIGINT AS shared_commits FROM pairs")
def j10(s, d):
    from sextant.operators.coupling import coupling

    return coupling(views.commits(s, d), 2).select("file_a", "file_b", "shared_commits")


FULL = r"""WITH v AS (SELECT regexp_replace(replace(trim(file_path, E' \t\r\n'), '\', '/'), '^\./', '') AS f, lower(blake3_hash) AS h, batch_id FROM file_cache WHERE blake3_hash IS NOT NULL),
old AS (SELECT f, arg_max(h, (batch_id, h)) AS h FROM v WHERE batch_id <= 12 GROUP BY 1), new AS (SELECT f, arg_max(h, (batch_id, h)) AS h FROM v WHERE batch_id > 12 GROUP BY 1)
SELECT coalesce(old.f, new.f) AS file_path, CASE WHEN old.f IS NULL THEN 'new' WHEN new.f IS NULL THEN 'deleted' WHEN old.h <> new.h THEN 'changed' ELSE 'unchanged' END AS state FROM old FULL JOIN new ON old.f = new.f"""


@q("J11_full_comparison", FULL)
def j11(s, d):
    v = table(s, d, "file_cache").where(F.col("blake3_hash").isNotNull()).select(canonical_path(F.col("file_path")).alias("file_path"), F.lower("blake3_hash").alias("h"), "batch_id")
    side = lambda c, n: v.where(c).groupBy("file_path").agg(F.max(F.struct("batch_id", "h"))["h"].alias(n))
    j = side(F.col("batch_id") <= 12, "old").join(side(F.col("batch_id") > 12, "new"), "file_path", "full_outer")
    return j.select("file_path", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged").alias("state"))


@q("A01_global_counts", "SELECT (SELECT count(*) FROM nodes)::BIGINT AS nodes, (SELECT count(*) FROM edges)::BIGINT AS edges")
def a01(s, d):
    return table(s, d, "nodes").agg(F.count(F.lit(1)).alias("nodes")).withColumn("edges", table(s, d, "edges").agg(F.count(F.lit(1))).scalar())


@q("A02_count_by_kind", "SELECT kind, count(*)::BIGINT AS n FROM nodes GROUP BY kind ORDER BY n DESC, kind")
def a02(s, d):
    return table(s, d, "nodes").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "kind")


@q("A03_degree_counts", "SELECT source_id, count(*)::BIGINT AS n FROM edges WHERE source_id IS NOT NULL GROUP BY 1")
def a03(s, d):
    return table(s, d, "edges").where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@q("A04_max_either_side", f"WITH {views.COMMITS_SQL} SELECT f AS file_path, round(max(c), 6) AS couple FROM (SELECT file_a AS f, coupling_score AS c FROM coupling UNION ALL SELECT file_b, coupling_score FROM coupling) GROUP BY 1")
def a04(s, d):
    from sextant.operators.coupling import coupling

    c = coupling(views.commits(s, d), 2)
    return c.select(F.explode(F.array("file_a", "file_b")).alias("file_path"), "coupling_score").groupBy("file_path").agg(F.round(F.max("coupling_score"), 6).alias("couple"))


@q("A05_counters", f"WITH {views.COMMITS_SQL} SELECT file_path, n::BIGINT AS commits FROM fc")
def a05(s, d):
    from sextant.operators.coupling import file_counts

    return file_counts(views.commits(s, d))


@q("A06_arg_max", f"WITH {views.COMMITS_SQL} SELECT file_path, last_author, last_commit_ts FROM lineage")
def a06(s, d):
    from sextant.operators.coupling import lineage

    return lineage(views.commits(s, d)).select("file_path", "last_author", "last_commit_ts")


@q("A07_hit_scores", "SELECT id, ((coalesce(name ILIKE '%cursor%', false))::INT + (coalesce(name ILIKE '%stream%', false))::INT + (coalesce(name ILIKE '%order%', false))::INT)::DOUBLE AS score FROM nodes WHERE name ILIKE '%cursor%' OR name ILIKE '%stream%' OR name ILIKE '%order%'")
def a07(s, d):
    hits = table(s, d, "nodes").select("id", F.explode(F.array(*[F.when(F.col("name").ilike(f"%{w}%"), 1.0) for w in ("cursor", "stream", "order")])).alias("hit")).where(F.col("hit").isNotNull())
    return hits.groupBy("id").agg(F.sum("hit").alias("score"))


@q("A08_language_histogram", r"SELECT lower(regexp_extract(file_path, '(\.[^./]+)$', 1)) AS suffix, count(*)::BIGINT AS n FROM (SELECT DISTINCT file_path FROM nodes) GROUP BY 1 ORDER BY n DESC, suffix LIMIT 8")
def a08(s, d):
    return table(s, d, "nodes").select("file_path").distinct().groupBy(tx.suffix(F.col("file_path")).alias("suffix")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "suffix").limit(8)


SUMMARY = """SELECT count(*)::BIGINT AS n, round(avg(ratio), 6) AS avg_ratio, round(avg(pct), 6) AS avg_pct, count(*) FILTER (ours < base)::BIGINT AS wins, sum(ours)::BIGINT AS ours, sum(base)::BIGINT AS base, round(100 * (1 - sum(ours) / sum(base)::DOUBLE), 6) AS overall_pct
FROM (SELECT *, round(base / ours::DOUBLE, 2) AS ratio, round(100 * (1 - ours / base::DOUBLE), 1) AS pct FROM (SELECT greatest(1, length(coalesce(signature, '')) // 4) AS ours, greatest(1, length(coalesce(body_preview, '')) // 4) AS base FROM nodes))"""


@q("A09_savings_summary", SUMMARY)
def a09(s, d):
    t = table(s, d, "nodes").select(tx.approx_tokens(F.coalesce("signature", F.lit(""))).alias("ours"), tx.approx_tokens(F.coalesce("body_preview", F.lit(""))).alias("base"))
    return tx.savings_summary(t)


@q("A10_best_per_fqn", "SELECT node_id, score, query_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC NULLS LAST, query_id) AS r FROM search_results) WHERE r = 1")
def a10(s, d):
    return rank.best_by(table(s, d, "search_results"), "node_id", "score", "query_id").select("node_id", "score", "query_id")


@q("A11_distinct", "SELECT DISTINCT source_file FROM import_refs")
def a11(s, d):
    return table(s, d, "import_refs").select("source_file").distinct()


@q("W01_greedy_packing", "WITH c AS (SELECT fqn, least(1024, greatest(1, length(kind || ' ' || fqn || chr(10) || coalesce(signature, '')) // 4)) AS cost FROM nodes), u AS (SELECT fqn, cost::INT AS cost, sum(cost) OVER (ORDER BY fqn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM c) SELECT fqn, cost, used FROM u WHERE used <= 8000")
def w01(s, d):
    n = table(s, d, "nodes")
    return rank.pack(n.select("fqn", rank.token_cost(n, docstring=False).alias("cost")), 8000, "cost", F.col("fqn"))


@q("W02_top_per_group", "SELECT file_path, id, fqn FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY id) AS r FROM nodes WHERE is_exported) WHERE r <= 3")
def w02(s, d):
    return graph.first_of(table(s, d, "nodes").where(F.col("is_exported")), "file_path", 3, "id").select("file_path", "id", "fqn")


@q("W03_normalised_by_max", "SELECT id, round(deg / (SELECT max(deg) FROM (SELECT count(*) AS deg FROM edges GROUP BY target_id))::DOUBLE, 6) AS score FROM (SELECT target_id AS id, count(*) AS deg FROM edges WHERE target_id IS NOT NULL GROUP BY 1)")
def w03(s, d):
    c = table(s, d, "edges").where(F.col("target_id").isNotNull()).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return rank.normalised(c, "score").withColumn("score", F.round("score", 6))


@q("O01_score_order", "SELECT query_id, node_id, score FROM (SELECT DISTINCT query_id, node_id, score FROM search_results) ORDER BY score DESC NULLS LAST, node_id, query_id LIMIT 50")
def o01(s, d):
    return table(s, d, "search_results").select("query_id", "node_id", "score").distinct().orderBy(F.col("score").desc_nulls_last(), "node_id", "query_id").limit(50)


@q("O02_multi_key_order", f"WITH {views.OBSERVATIONS_SQL} SELECT id, stale, confidence, created_at FROM observations ORDER BY stale, confidence DESC, created_at DESC, id LIMIT 50")
def o02(s, d):
    return views.observations(s, d).orderBy("stale", F.col("confidence").desc(), F.col("created_at").desc(), "id").limit(50).select("id", "stale", "confidence", "created_at")


@q("O03_newest_first", f"WITH {views.OBSERVATIONS_SQL} SELECT id, type, created_at FROM observations ORDER BY created_at DESC, id LIMIT 20")
def o03(s, d):
    return memory.session_context(views.observations(s, d), None).select("id", "type", "created_at")


@q("O04_by_line", "SELECT file_path, name, start_line FROM nodes WHERE file_path = (SELECT min(file_path) FROM nodes)")
def o04(s, d):
    n = table(s, d, "nodes")
    return n.where(F.col("file_path") == n.agg(F.min("file_path")).scalar()).select("file_path", "name", "start_line").orderBy("start_line")


@q("O05_first_ten", "SELECT id FROM nodes WHERE kind = 'class' ORDER BY id LIMIT 10")
def o05(s, d):
    return table(s, d, "nodes").where(F.col("kind") == "class").orderBy("id").limit(10).select("id")


@q("U01_symmetric_union", f"WITH {views.COMMITS_SQL} SELECT file_a AS file_path, file_b AS coupled, round(coupling_score, 6) AS score FROM coupling UNION SELECT file_b, file_a, round(coupling_score, 6) FROM coupling")
def u01(s, d):
    from sextant.operators.coupling import coupling

    c = coupling(views.commits(s, d), 2).withColumn("score", F.round("coupling_score", 6))
    return c.select(F.col("file_a").alias("file_path"), F.col("file_b").alias("coupled"), "score").unionByName(c.select(F.col("file_b").alias("file_path"), F.col("file_a").alias("coupled"), "score")).distinct()


@q("U02_bag_union", "SELECT fqn, repo_alias FROM nodes UNION ALL SELECT fqn, repo_alias FROM library_nodes")
def u02(s, d):
    return table(s, d, "nodes").select("fqn", "repo_alias").unionByName(table(s, d, "library_nodes").select("fqn", "repo_alias"))


@q("U03_set_difference", "SELECT id FROM nodes EXCEPT SELECT node_id FROM node_embeddings_dense")
def u03(s, d):
    return table(s, d, "nodes").select("id").subtract(table(s, d, "node_embeddings_dense").select("node_id"))


@q("E01_approx_tokens", "SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4)::INT AS tokens FROM documents")
def e01(s, d):
    return table(s, d, "documents").select("doc_id", tx.approx_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


@q("E02_shorten", r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN substring(t, 200, 1) = ' ' THEN rtrim(substring(t, 1, 199), ' ') || '…'
  ELSE CASE WHEN regexp_extract(substring(t, 1, 199), '^(.*\S)\s', 1) = '' THEN substring(t, 1, 199) ELSE regexp_extract(substring(t, 1, 199), '^(.*\S)\s', 1) END || '…' END AS short FROM t""")
def e02(s, d):
    return table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", tx.shorten(F.col("text"), 200).alias("short"))


@q("E03_find_all", "SELECT id, regexp_extract_all(coalesce(signature, ''), '[A-Za-z][A-Za-z0-9_]{2,}') AS words FROM nodes")
def e03(s, d):
    return table(s, d, "nodes").select("id", F.regexp_extract_all(F.coalesce("signature", F.lit("")), F.lit("[A-Za-z][A-Za-z0-9_]{2,}"), F.lit(0)).alias("words"))


@q("E04_replace_split", "SELECT DISTINCT file_path, string_split(regexp_replace(file_path, '[^A-Za-z0-9_]+', ' ', 'g'), ' ') AS words FROM nodes")
def e04(s, d):
    return table(s, d, "nodes").select("file_path").distinct().select("file_path", F.split(F.regexp_replace("file_path", "[^A-Za-z0-9_]+", " "), " ").alias("words"))


@q("E05_truncate", "SELECT doc_id, substring(text, 1, 50) AS head FROM documents")
def e05(s, d):
    return table(s, d, "documents").select("doc_id", F.substring("text", 1, 50).alias("head"))


@q("E06_split_fqn", "SELECT id, string_split(fqn, '::')[1] AS file, string_split(fqn, '::')[-1] AS symbol FROM nodes")
def e06(s, d):
    return table(s, d, "nodes").select("id", F.substring_index("fqn", "::", 1).alias("file"), F.substring_index("fqn", "::", -1).alias("symbol"))


@q("E07_string_tests", "SELECT id, (starts_with(lower(name), 'test') OR contains(lower(file_path), 'test') OR ends_with(file_path, '.lua')) AS hit FROM nodes")
def e07(s, d):
    return table(s, d, "nodes").select("id", (F.lower("name").startswith("test") | F.lower("file_path").contains("test") | F.col("file_path").endswith(".lua")).alias("hit"))


@q("E08_path_parts", r"SELECT DISTINCT file_path, lower(regexp_extract(file_path, '(\.[^./]+)$', 1)) AS suffix, string_split(file_path, '/')[-1] AS base, regexp_replace(string_split(file_path, '/')[-1], '\.[^.]*$', '') AS stem FROM nodes")
def e08(s, d):
    f = F.col("file_path")
    return table(s, d, "nodes").select("file_path").distinct().select("file_path", tx.suffix(f).alias("suffix"), tx.basename(f).alias("base"), tx.stem(f).alias("stem"))


@q("E09_join_parts", "SELECT DISTINCT file_path, array_to_string(string_split(file_path, '/')[1:2], '.') AS head FROM nodes")
def e09(s, d):
    return table(s, d, "nodes").select("file_path").distinct().select("file_path", F.array_join(F.slice(F.split("file_path", "/"), 1, 2), ".").alias("head"))


@q("E10_round", "SELECT DISTINCT query_id, node_id, round(score, 4) AS score FROM search_results")
def e10(s, d):
    return table(s, d, "search_results").select("query_id", "node_id", F.round("score", 4).alias("score")).distinct()


@q("E11_norm_dot", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def e11(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(tx.norm(F.col("embedding")), 6).alias("norm"))


@q("E12_json_map", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def e12(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "map<string,bigint>")["k"].alias("k"))


@q("E13_vector_values", "SELECT vec_id, len(embedding)::INT AS n, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def e13(s, d):
    return table(s, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@q("E14_epoch", "SELECT run_id, epoch(started_at)::BIGINT AS seconds, strftime(started_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS iso FROM index_runs")
def e14(s, d):
    return table(s, d, "index_runs").select("run_id", F.unix_timestamp("started_at").alias("seconds"), F.date_format(F.timestamp_seconds(F.unix_timestamp("started_at")), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@q("E15_date_arithmetic", "SELECT run_id, started_at - INTERVAL 7 DAY AS week_before FROM index_runs")
def e15(s, d):
    return table(s, d, "index_runs").select("run_id", (F.col("started_at") - F.expr("INTERVAL 7 DAYS")).alias("week_before"))


@q("E16_diagram_id", "SELECT id, translate(replace(fqn, '::', '__'), './-', '___') AS mangled FROM nodes")
def e16(s, d):
    return table(s, d, "nodes").select("id", tx.diagram_id(F.col("fqn")).alias("mangled"))


#: All white space there is, as SQL.
BLANKS = " || ".join(f"chr({c})" for c in range(0x3001) if chr(c).isspace())
E17 = rf"""WITH t AS (SELECT id, regexp_replace(regexp_replace(trim(docstring, {BLANKS}), '^\s*/\*+!?', ''), '\*+/\s*$', '') AS d FROM nodes WHERE docstring IS NOT NULL)
SELECT id, trim(array_to_string(list_transform(string_split(d, chr(10)), lambda x: rtrim(regexp_replace(x, '^\s*(///?|//!|--+|#+|\*+)\s?', ''), {BLANKS})), chr(10)), {BLANKS}) AS plain FROM t"""


@q("E17_comment_marks", E17)
def e17(s, d):
    """The extractor's own stripping of comment marks."""
    strip = F.pandas_udf(lambda x: x.map(strip_marks), "string")
    return table(s, d, "nodes").where(F.col("docstring").isNotNull()).select("id", strip("docstring").alias("plain"))


@q("E18_heading_slug", r"SELECT doc_id, replace(substring(trim(regexp_replace(string_split(replace(text, chr(13), ''), chr(10))[1], '[^A-Za-z0-9_\s]', '', 'g'), ' '), 1, 60), ' ', '_') AS slug FROM documents WHERE text IS NOT NULL")
def e18(s, d):
    first = F.element_at(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n"), 1)
    return table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", tx.heading_slug(first).alias("slug"))


RECALL = r"""WITH p AS (SELECT id, list_filter(regexp_split_to_array(lower(file_path), '[/\\._ ]'), lambda t: length(t) >= 3 AND t NOT IN ('any', 'file', 'importing', 'or', 'similar')) AS p, lower(coalesce(docstring, '') || ' ' || fqn) AS t FROM nodes)
SELECT id, len(p) > 0 AND len(list_filter(p, lambda x: contains(t, x))) >= greatest(1, len(p) // 2) AS recalled FROM p"""


@q("E19_recall", RECALL)
def e19(s, d):
    return table(s, d, "nodes").select("id", tx.recalled(F.col("file_path"), F.concat_ws(" ", F.coalesce("docstring", F.lit("")), "fqn")).alias("recalled"))


@q("E20_baseline_recall", r"SELECT id, contains(lower(file_path), lower(regexp_replace(string_split(file_path, '/')[-1], '\.[^.]*$', ''))) AS recalled FROM nodes")
def e20(s, d):
    return table(s, d, "nodes").select("id", F.contains(F.lower("file_path"), F.lower(tx.stem(F.col("file_path")))).alias("recalled"))


@q("E21_savings", "SELECT doc_id, round(coalesce(n_chars / nullif(length(source), 0)::DOUBLE, 0), 2) AS ratio, round(coalesce(100 * (1 - length(source) / nullif(n_chars, 0)::DOUBLE), 0), 1) AS pct FROM documents")
def e21(s, d):
    return table(s, d, "documents").select("doc_id", tx.savings_ratio(F.col("n_chars"), F.length("source")).alias("ratio"), tx.percent_saved(F.col("n_chars"), F.length("source")).alias("pct"))


@q("E22_session_prefix", "SELECT doc_id, substring(replace(coalesce(text, ''), chr(10), ' '), 1, 8) AS head FROM documents")
def e22(s, d):
    return table(s, d, "documents").select("doc_id", F.substring(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), 1, 8).alias("head"))
