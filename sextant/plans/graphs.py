"""Graph, coupling, store, extraction and composite queries of the reference's inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant import render
from sextant.functions.paths import module_candidates
from sextant.operators import capsule, coupling, graph, lexical, memory, store
from sextant.plans import views
from sextant.plans.problems import RUNS
from sextant.plans.registry import Registry
from sextant.functions.text import savings_summary
from sextant.plans.retrieval import BM25, HYBRID, index
from sextant.plans.views import QUERY
from sextant.session import cut, table
from sextant.sources import extract, files
from sextant.streaming import flows

q = Registry()
QUERIES, ORACLE = q.queries, q.sql


@q("G01_degree", "SELECT id, count(*)::BIGINT AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) WHERE id IS NOT NULL GROUP BY 1")
def g01(s, d):
    return graph.degree(table(s, d, "edges"))


def expansion_sql(seeds: str, depth: int = 2, name: str = "near") -> str:
    """CTEs that end in ``name`` (id, role, hop)."""
    out = [f"""
calls AS (SELECT source_id, target_id, confidence FROM edges WHERE type = 'CALLS'),
outs AS (SELECT source_id FROM calls GROUP BY 1 HAVING count(*) <= 40), ins AS (SELECT target_id FROM calls GROUP BY 1 HAVING count(*) <= 40),
hop0 AS (SELECT DISTINCT id FROM ({seeds}))"""]
    for h in range(1, depth + 1):
        before = " UNION ".join(f"SELECT id FROM hop{k}" for k in range(h))
        out.append(f"""hop{h} AS (SELECT id, min(role) AS role FROM (
  SELECT target_id AS id, 'callee' AS role FROM calls WHERE confidence >= 0.75 AND source_id IN (SELECT id FROM hop{h - 1}) AND source_id IN (SELECT source_id FROM outs)
  UNION ALL SELECT source_id, 'caller' FROM calls WHERE confidence >= 0.75 AND target_id IN (SELECT id FROM hop{h - 1}) AND target_id IN (SELECT target_id FROM ins))
  WHERE id IS NOT NULL AND id NOT IN ({before}) GROUP BY id)""")
    out.append(f"{name} AS (" + " UNION ALL ".join(f"SELECT id, role, {h} AS hop FROM hop{h}" for h in range(1, depth + 1)) + ")")
    return ", ".join(out)


SEEDS = "SELECT id FROM bm25 ORDER BY score DESC, id LIMIT 15"


@q("G02_expansion", f"WITH {BM25}, {expansion_sql(SEEDS)} SELECT id, role, hop FROM near")
def g02(s, d):
    n = table(s, d, "nodes")
    return graph.expand_neighbours(table(s, d, "edges"), lexical.bm25_search(n, QUERY, limit=15).select("id"))


ROOT = "(SELECT n.id FROM edges e JOIN nodes n ON n.id = e.target_id GROUP BY n.id ORDER BY count(*), n.id LIMIT 1)"

CROWDED = "(SELECT n.id FROM edges e JOIN nodes n ON n.id = e.target_id GROUP BY n.id ORDER BY count(*) DESC, n.id LIMIT 1)"


def _root(s, d, crowded=False):
    n = table(s, d, "nodes").select("id", "fqn")
    e = table(s, d, "edges").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(e, "id").orderBy(F.col("n").desc() if crowded else "n", "id").first().fqn


def impact_sql(depth: int, cross: bool, root: str = ROOT) -> str:
    out = [f"lv0 AS (SELECT id, fqn FROM nodes WHERE id = {root})"]
    for h in range(1, depth + 1):
        before = " UNION ".join(f"SELECT fqn FROM lv{k}" for k in range(h))
        far = f" UNION ALL SELECT c.source_fqn, n.id, c.source_repo, 'function', c.type, p.fqn, c.id, 1 FROM cross_repo_edges c JOIN lv{h - 1} p ON c.target_fqn = p.fqn LEFT JOIN nodes n ON n.fqn = c.source_fqn" if cross else ""
        out.append(f"""lv{h} AS (SELECT * EXCLUDE (r, edge, far), {h} AS depth FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY far, edge) AS r FROM (
  SELECT n.fqn, n.id, n.file_path, n.kind, e.type AS edge_type, p.fqn AS target_fqn, e.id AS edge, 0 AS far FROM edges e JOIN lv{h - 1} p ON e.target_id = p.id JOIN nodes n ON n.id = e.source_id{far})
  WHERE fqn NOT IN ({before})) WHERE r = 1)""")
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT fqn, file_path, kind, depth, edge_type, target_fqn FROM lv{h}" for h in range(1, depth + 1))


@q("G03_impact", impact_sql(3, False))
def g03(s, d):
    return graph.impact(table(s, d, "nodes"), table(s, d, "edges"), _root(s, d), 3)


@q("G04_impact_cross_repo", impact_sql(2, True))
def g04(s, d):
    return graph.impact(table(s, d, "nodes"), table(s, d, "edges"), _root(s, d), 2, table(s, d, "cross_repo_edges"))


@q("G03_impact_whole", impact_sql(5, False, CROWDED))
def g03_whole(s, d):
    """Five levels, from the node with the most edges to it."""
    return graph.impact(table(s, d, "nodes"), table(s, d, "edges"), _root(s, d, True))


@q("G04_impact_cross_repo_whole", impact_sql(5, True, CROWDED))
def g04_whole(s, d):
    return graph.impact(table(s, d, "nodes"), table(s, d, "edges"), _root(s, d, True), cross=table(s, d, "cross_repo_edges"))


def reach_sql(hops: int, root: str = ROOT) -> str:
    out = [f"h0 AS (SELECT {root} AS id)"]
    for h in range(1, hops + 1):
        before = " UNION ".join(f"SELECT id FROM h{k}" for k in range(h))
        out.append(f"h{h} AS MATERIALIZED (SELECT DISTINCT target_id AS id FROM edges WHERE type = 'CALLS' AND target_id IS NOT NULL AND source_id IN (SELECT id FROM h{h - 1}) AND target_id NOT IN ({before}))")
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT id, {h} AS hop FROM h{h}" for h in range(hops + 1))


@q("G05_reachable", reach_sql(10))
def g05(s, d):
    start = table(s, d, "nodes").where(F.col("fqn") == _root(s, d)).select("id")
    return graph.reachable(table(s, d, "edges").where(F.col("type") == "CALLS"), start)


ENDS = "ends AS (SELECT (SELECT id FROM nodes WHERE id IN (SELECT source_id FROM edges WHERE type = 'CALLS') ORDER BY id LIMIT 1) AS a, (SELECT e.target_id FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.type = 'CALLS' GROUP BY 1 ORDER BY count(*) DESC, e.target_id LIMIT 1) AS b)"
PATHS = f"""WITH RECURSIVE {ENDS}, c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE type = 'CALLS' AND source_id <> target_id),
p AS (SELECT a AS cur, [a] AS ids, [n.fqn] AS path FROM ends JOIN nodes n ON n.id = a
  UNION ALL SELECT c.target_id, list_append(p.ids, c.target_id), list_append(p.path, coalesce(n.fqn, c.target_id::VARCHAR)) FROM p JOIN c ON c.source_id = p.cur LEFT JOIN nodes n ON n.id = c.target_id
  WHERE len(p.ids) < 4 AND NOT list_contains(p.ids, c.target_id) AND p.cur <> (SELECT b FROM ends))
SELECT row_number() OVER (ORDER BY len(path), path)::INT AS path_no, path FROM p WHERE cur = (SELECT b FROM ends) ORDER BY len(path), path LIMIT 3"""


@q("G05_reachable_crowded", reach_sql(10, CROWDED))
def g05_crowded(s, d):
    start = table(s, d, "nodes").where(F.col("fqn") == _root(s, d, True)).select("id")
    return graph.reachable(table(s, d, "edges").where(F.col("type") == "CALLS"), start)


def _ends(s, d):
    n, e = table(s, d, "nodes"), table(s, d, "edges").where(F.col("type") == "CALLS")
    a = n.join(e.select(F.col("source_id").alias("id")), "id", "left_semi").orderBy("id").select("fqn").first()
    b = e.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("c")).join(n.select("id", "fqn"), "id").orderBy(F.col("c").desc(), "id").first()
    return a.fqn, b.fqn


@q("G06_paths", PATHS)
def g06(s, d):
    return graph.call_paths(table(s, d, "nodes"), table(s, d, "edges"), *_ends(s, d), 3, 4)


@q("G06_paths_whole")
def g06_whole(s, d):
    """Paths of up to ten nodes. Without SQL: the recursion lists all paths before it takes the first."""
    return graph.call_paths(table(s, d, "nodes"), table(s, d, "edges"), *_ends(s, d))


RESOLVED = f"""WITH {views.LSP_SQL}, refs AS (SELECT source_fqn, target_fqn AS target, edge_type AS type FROM lsp UNION ALL SELECT source_fqn, string_split(string_split(target_fqn, '::')[-1], '.')[-1], edge_type FROM lsp),
nm AS (SELECT name, min(id) AS id FROM nodes WHERE name IS NOT NULL GROUP BY 1)
SELECT DISTINCT s.id AS source_id, coalesce(f.id, nm.id) AS target_id, r.type FROM refs r JOIN nodes s ON s.fqn = r.source_fqn LEFT JOIN nodes f ON f.fqn = r.target LEFT JOIN nm ON nm.name = r.target
WHERE coalesce(f.id, nm.id) IS NOT NULL AND coalesce(f.id, nm.id) <> s.id"""


@q("G07_edge_resolution", RESOLVED)
def g07(s, d):
    l = views.lsp(s, d).withColumnRenamed("edge_type", "type").withColumn("call_site_line", F.lit(None).cast("int")).withColumn("confidence", F.lit(1.0))
    short = F.element_at(F.split(F.substring_index("target_fqn", "::", -1), r"\."), -1)
    refs = l.select("source_fqn", F.col("target_fqn").alias("target"), "type", "call_site_line", "confidence").unionByName(l.select("source_fqn", short.alias("target"), "type", "call_site_line", "confidence"))
    return graph.resolve_edges(refs, table(s, d, "nodes")).select("source_id", "target_id", "type")


@q("G08_import_capture", f"WITH {views.LSP_SQL} SELECT DISTINCT string_split(source_fqn, '::')[1] AS source_file, target_fqn AS target_module FROM lsp WHERE edge_type = 'IMPORTS'")
def g08(s, d):
    l = views.lsp(s, d).select("source_fqn", F.col("target_fqn").alias("target"), F.col("edge_type").alias("type"), F.lit(None).cast("int").alias("call_site_line"))
    return graph.import_references(l).select("source_file", "target_module")


MODULES = r"""mp AS (SELECT file_path, string_split(regexp_replace(file_path, '\.py$', ''), '/') AS q FROM (SELECT DISTINCT file_path FROM nodes)),
mm AS (SELECT file_path, CASE WHEN q[1] IN ('src', 'lib', 'pkg') AND len(q) > 1 THEN q[2:] ELSE q END AS m FROM mp),
modules AS (SELECT file_path, unnest([array_to_string(m[i:], '.') FOR i IN range(1, len(m) + 1)]) AS module FROM mm)"""


@q("G09_module_candidates", f"WITH {MODULES} SELECT file_path, module FROM modules")
def g09(s, d):
    return table(s, d, "nodes").select("file_path").distinct().select("file_path", F.explode(module_candidates(F.col("file_path"))).alias("module"))


SEED_FILES = f"seedf AS (SELECT DISTINCT file_path FROM nodes WHERE id IN ({SEEDS}))"
IMPORTERS = """imf AS (SELECT DISTINCT source_file AS file_path FROM import_refs WHERE target_module IN (SELECT module FROM modules WHERE file_path IN (SELECT file_path FROM seedf)) AND source_file NOT IN (SELECT file_path FROM seedf)),
imn AS (SELECT *, least(1024, greatest(1, length(kind || ' ' || fqn || chr(10) || coalesce(signature, '')) // 4)) AS cost FROM (SELECT n.*, row_number() OVER (PARTITION BY file_path ORDER BY id) AS r FROM nodes n WHERE is_exported AND file_path IN (SELECT file_path FROM imf)) WHERE r <= 3),
imp AS (SELECT * FROM (SELECT *, sum(cost) OVER (ORDER BY file_path, id ROWS UNBOUNDED PRECEDING) AS used FROM imn) WHERE used <= 1600)"""


def _seed_files(s, d):
    n = table(s, d, "nodes")
    return n.join(lexical.bm25_search(n, QUERY, limit=15).select("id"), "id", "left_semi").select("file_path").distinct()


@q("G10_importers", f"WITH {BM25}, {SEED_FILES}, {MODULES}, {IMPORTERS} SELECT fqn, file_path FROM imp")
def g10(s, d):
    ix = capsule.Index(table(s, d, "nodes"), table(s, d, "edges"), table(s, d, "import_refs"))
    return capsule.importer_entries(ix, cut(_seed_files(s, d)), 1600).select("fqn", "file_path")


CO_CHANGE = """cs AS (SELECT file_a AS f, file_b AS c, coupling_score AS s FROM coupling UNION SELECT file_b, file_a, coupling_score FROM coupling),
ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY s DESC, c) AS r FROM cs WHERE f IN (SELECT file_path FROM seedf)) WHERE r <= 3),
cn AS (SELECT n.*, ct.f, ct.c, ct.s, least(1024, greatest(1, length(kind || ' ' || fqn || chr(10) || coalesce(signature, '')) // 4)) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY id) AS r FROM nodes) n JOIN ct ON ct.c = n.file_path WHERE n.r <= 5),
cou AS (SELECT *, sum(cost) OVER (ORDER BY f, s DESC, c, id ROWS UNBOUNDED PRECEDING) AS used FROM cn)"""


@q("G11_co_change", f"WITH {views.COMMITS_SQL}, {BM25}, {SEED_FILES}, {CO_CHANGE} SELECT fqn, round(s, 6) AS score FROM cou WHERE used <= 2000")
def g11(s, d):
    c = views.commits(s, d)
    ix = capsule.Index(table(s, d, "nodes"), table(s, d, "edges"), coupling=cut(coupling.coupling(c, 2)))
    return capsule.co_change_entries(ix, cut(_seed_files(s, d)), 2000).select("fqn", F.round("score", 6).alias("score"))


@q("R06_role_scores", f"WITH {views.COMMITS_SQL}, {BM25}, {SEED_FILES}, {MODULES}, {IMPORTERS}, {CO_CHANGE} SELECT fqn, 'importer' AS role, 0.3::DOUBLE AS score FROM imp UNION ALL SELECT fqn, 'co_change', round(s, 6) FROM cou WHERE used <= 2000")
def r06(s, d):
    """The scores that the capsule gives by role: a fixed one to importers, the coupling to files that change together."""
    c = views.commits(s, d)
    ix = capsule.Index(table(s, d, "nodes"), table(s, d, "edges"), table(s, d, "import_refs"), coupling=cut(coupling.coupling(c, 2)))
    f = cut(_seed_files(s, d))
    return capsule.importer_entries(ix, f, 1600).unionByName(capsule.co_change_entries(ix, f, 2000)).select("fqn", "role", F.round("score", 6).alias("score"))


@q("G12_coupling", "WITH c AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS f FROM lineitem), n AS (SELECT f, count(*) AS n FROM c GROUP BY 1), p AS (SELECT a.f AS fa, b.f AS fb, count(*) AS s FROM c a JOIN c b ON a.k = b.k AND a.f < b.f GROUP BY ALL HAVING count(*) >= 4) SELECT fa AS file_a, fb AS file_b, round(s / greatest(x.n, y.n)::DOUBLE, 6) AS coupling_score, s::BIGINT AS shared_commits FROM p JOIN n x ON x.f = fa JOIN n y ON y.f = fb")
def g12(s, d):
    c = table(s, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("file_path"))
    return coupling.coupling(c).withColumn("coupling_score", F.round("coupling_score", 6))


@q("G13_lineage", f"WITH {views.COMMITS_SQL} SELECT file_path, commit_count::BIGINT AS commit_count, round(churn_score, 6) AS churn_score, last_author, last_commit_ts FROM lineage")
def g13(s, d):
    return coupling.lineage(views.commits(s, d)).withColumn("churn_score", F.round("churn_score", 6))


@q("K01_node_upsert", "SELECT fqn, kind, repo_alias FROM nodes WHERE deleted_at IS NULL UNION ALL SELECT fqn, upper(kind), repo_alias FROM nodes WHERE deleted_at IS NOT NULL UNION ALL SELECT fqn, upper(kind), 'moved' FROM library_nodes WHERE fqn NOT IN (SELECT fqn FROM nodes)")
def k01(s, d):
    n = table(s, d, "nodes").select("fqn", "kind", "repo_alias", F.col("deleted_at").isNotNull().alias("gone"))
    new = n.where("gone").drop("gone").unionByName(table(s, d, "library_nodes").select("fqn", "kind", "repo_alias")).select("fqn", F.upper("kind").alias("kind"), F.lit("moved").alias("repo_alias"))
    return store.upsert(n.drop("gone"), new.withColumn("written", F.lit(1)), ["fqn"], order="written", keep=["repo_alias"])


@q("K02_replace_newest", "SELECT node_id, arg_max(vector_json, (updated_at, vector_json)) AS vector_json FROM node_embeddings WHERE vector_json IS NOT NULL GROUP BY 1")
def k02(s, d):
    """What was delivered until the middle of the time is there already, later rows replace it."""
    e = table(s, d, "node_embeddings").where(F.col("vector_json").isNotNull()).withColumn("v", F.struct("updated_at", "vector_json"))
    t = e.agg(((F.unix_micros(F.min("updated_at")) + F.unix_micros(F.max("updated_at"))) / 2).cast("long")).first()[0]
    late = F.unix_micros("updated_at") > F.lit(t)
    there = store.upsert(e.where(F.lit(False)), e.where(~late), ["node_id"], order="v")
    return store.upsert(there, e.where(late), ["node_id"], order="v").select("node_id", "vector_json")


@q("K03_distinct_edges", "SELECT source_id, target_id, type, call_site_line, min(id) AS id, max(confidence) AS confidence FROM edges GROUP BY ALL")
def k03(s, d):
    return graph.distinct_edges(table(s, d, "edges"))


@q("K04_cascade_delete", "WITH gone AS (SELECT id FROM nodes WHERE file_path IN (SELECT file_path FROM nodes WHERE deleted_at IS NOT NULL)) SELECT id FROM edges WHERE (source_id IS NULL OR source_id NOT IN (SELECT id FROM gone)) AND (target_id IS NULL OR target_id NOT IN (SELECT id FROM gone))")
def k04(s, d):
    n = table(s, d, "nodes")
    out = store.delete_files({"nodes": n, "edges": table(s, d, "edges")}, n.where(F.col("deleted_at").isNotNull()))
    return out["edges"].select("id")


@q("K08_observation_links", f"WITH {views.OBSERVATIONS_SQL} SELECT o.id AS observation_id, n.id AS node_id FROM observations o JOIN nodes n ON n.id = o.id + 1001 WHERE n.fqn IS NOT NULL UNION SELECT observation_id, node_id FROM links")
def k08(s, d):
    """Every observation is linked to one more node by its FQN, and to one that isn't there; the links of before stay."""
    n, o = table(s, d, "nodes"), views.observations(s, d)
    new = o.join(n.select((F.col("id") - 1001).alias("id"), "fqn"), "id", "left").withColumn("linked", F.array_compact(F.array("fqn", F.concat("session_id", F.lit("::none"))))).drop("fqn")
    return memory.save_observations(o, views.links(s, d), n, new)[1]


@q("K09_auto_observation", "SELECT event_id, substring('[' || event_type || '] ' || props, 1, 200 + length(event_type) + 3) AS content FROM events")
def k09(s, d):
    return memory.auto_observations(table(s, d, "events"), "event_type", "props").select("event_id", "content")


@q("K10_external_edges", f"WITH {views.LSP_SQL} SELECT DISTINCT s.id AS source_id, t.id AS target_id, l.edge_type AS type, 1.0::DOUBLE AS confidence FROM lsp l JOIN nodes s ON s.fqn = l.source_fqn JOIN nodes t ON t.fqn = l.target_fqn WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = s.id AND e.target_id = t.id AND e.type = l.edge_type)")
def k10(s, d):
    return store.merge_external_edges(views.lsp(s, d), table(s, d, "nodes"), table(s, d, "edges"))


@q("K11_log_entry", "SELECT event_id, length(props)::INT AS result_chars, (length(props) // 4)::BIGINT AS result_tokens_approx, substring(props, 1, 300) AS preview FROM events")
def k11(s, d):
    return memory.log_entry(table(s, d, "events").select("event_id", F.col("props").alias("result")))


@q("K15_new_sessions", f"WITH {views.OBSERVATIONS_SQL}, k AS (SELECT session_id, min(created_at) AS since FROM observations WHERE stale GROUP BY 1) SELECT session_id, since FROM k UNION ALL SELECT session_id, NULL FROM (SELECT DISTINCT session_id FROM observations) WHERE session_id NOT IN (SELECT session_id FROM k WHERE session_id IS NOT NULL) AND session_id IS NOT NULL")
def k15(s, d):
    """Sessions with a stale observation are known, with their time; all others are added without one."""
    o = views.observations(s, d).where(F.col("session_id").isNotNull())
    known = o.where("stale").groupBy("session_id").agg(F.min("created_at").alias("since"))
    return store.insert_new(known, o.select("session_id", F.lit(None).cast("timestamp").alias("since")), ["session_id"])


@q("S02_excluded_dirs", f"SELECT DISTINCT file_path, len(list_intersect(string_split(file_path, '/'), [{', '.join(repr(x) for x in [*files.EXCLUDED_DIRS, 'tests'])}])) > 0 AS excluded FROM nodes")
def s02(s, d):
    return table(s, d, "nodes").select("file_path").distinct().select("file_path", files.in_excluded_dir(F.col("file_path"), [*files.EXCLUDED_DIRS, "tests"]).alias("excluded"))


@q("S04_ignored", r"SELECT DISTINCT file_path, CASE WHEN regexp_matches(file_path, '(^|/)tests?(/|$)') THEN true WHEN regexp_matches(file_path, '^lib/keep') THEN false WHEN regexp_matches(file_path, '\.lua$') THEN true WHEN regexp_matches(file_path, '^lib/') THEN true ELSE false END AS ignored FROM nodes")
def s04(s, d):
    return table(s, d, "nodes").select("file_path").distinct().select("file_path", files.ignored_column(F.col("file_path"), ["test", "tests/", "!/lib/keep*", "*.lua", "/lib"]).alias("ignored"))


@q("S06_language_of_path", r"SELECT DISTINCT file_path, CASE lower(regexp_extract(file_path, '(\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.java' THEN 'java' WHEN '.lua' THEN 'lua' WHEN '.swift' THEN 'swift' END AS lang FROM nodes")
def s06(s, d):
    return table(s, d, "nodes").select("file_path").distinct().select("file_path", files.language_column(F.col("file_path")).alias("lang"))


@q("S08_language_filter", r"SELECT id FROM nodes WHERE regexp_matches(file_path, '\.(py|go)$')")
def s08(s, d):
    return table(s, d, "nodes").where(files.language_column(F.col("file_path")).isin("python", "go")).select("id")


@q("S09_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def s09(s, d):
    return table(s, d, "documents").select("doc_id", files.content_hash(F.col("text")).alias("hash"))


S12 = """WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l, (1 + doc_id % 4)::INT AS a, CASE WHEN doc_kind = 'issue' THEN NULL ELSE (1 + doc_id % 4 + doc_id % 7)::INT END AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(l[a:coalesce(b, a + 59)], chr(10)) AS lines FROM t"""


@q("S12_source_slice", S12)
def s12(s, d):
    """Slices of different places and lengths, of issues to the default length."""
    t = table(s, d, "documents").where(F.col("text").isNotNull())
    start, end = (1 + F.col("doc_id") % 4).cast("int"), F.when(F.col("doc_kind") == "issue", None).otherwise((1 + F.col("doc_id") % 4 + F.col("doc_id") % 7).cast("int"))
    return t.select("doc_id", files.source_slice(F.col("text"), start, end).alias("lines"))


@q("S15_tool_calls", "SELECT event_id, event_type AS tool, value AS elapsed_ms FROM events WHERE event_type IS NOT NULL")
def s15(s, d):
    return memory.tool_calls(views.request_log(s, d)).select("event_id", "tool", "elapsed_ms")


def _sources(s, d):
    t = table(s, d, "documents")
    lang = F.when(F.col("doc_kind") == "source", "python").otherwise("markdown")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_kind") == "source", ".py").otherwise(".md"))
    return t.select(path.alias("file_path"), lang.alias("lang"), F.col("text").alias("content"))


@q("X01_extract")
def x01(s, d):
    e = extract.extract_symbols(_sources(s, d))
    return e.select("file_path", "lang", F.size("symbols").alias("symbols"), F.size("edges").alias("edges"), "error")


@q("X02_python_symbols")
def x02(s, d):
    return extract.symbol_rows(extract.extract_symbols(_sources(s, d).where(F.col("lang") == "python")))


@q("X09_markdown_headings")
def x09(s, d):
    return extract.symbol_rows(extract.extract_symbols(_sources(s, d).where(F.col("lang") == "markdown"))).select("fqn", "kind", "name", "start_line")


@q("X10_references")
def x10(s, d):
    return extract.reference_rows(extract.extract_symbols(_sources(s, d)))


CAPSULE = f"""WITH {HYBRID.replace(':candidates', '75')}, seeds AS (SELECT id, round(total, 4) AS score FROM hyb WHERE r <= 15),
seedf AS (SELECT DISTINCT file_path FROM nodes WHERE id IN (SELECT id FROM seeds)), {expansion_sql("SELECT id FROM seeds")},
ndeg AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) WHERE id IN (SELECT id FROM near) GROUP BY 1),
np AS (SELECT x.id, x.role, round(0.6 * coalesce(ndeg.n, 0) / (SELECT coalesce(max(n), 1) FROM ndeg)::DOUBLE + 0.25 * coalesce(cf.c, 0) + 0.15 * coalesce(l.churn_score, 0), 9) AS score FROM near x JOIN nodes n ON n.id = x.id LEFT JOIN ndeg ON ndeg.id = x.id LEFT JOIN cf ON cf.f = n.file_path LEFT JOIN lineage l ON l.file_path = n.file_path),
e0 AS (SELECT n.*, s.score, 'seed' AS role, 1 AS o, substring(coalesce(docstring, ''), 1, 256) AS doc FROM seeds s JOIN nodes n USING (id)
  UNION ALL BY NAME SELECT n.*, p.score, p.role, CASE p.role WHEN 'callee' THEN 2 ELSE 3 END AS o, coalesce(docstring, '') AS doc FROM np p JOIN nodes n USING (id)),
tk AS (SELECT *, least(1024, greatest(1, length(trim(regexp_replace(kind || ' ' || fqn || chr(10) || coalesce(signature, '') || chr(10) || doc, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) // 4)) AS tok FROM e0),
{CO_CHANGE}, {MODULES}, {IMPORTERS},
allx AS (SELECT fqn, score, role, o, tok, is_test, is_exported FROM tk
  UNION ALL SELECT fqn, s, 'co_change', 4, least(1024, greatest(1, length(trim(regexp_replace(kind || ' ' || fqn || chr(10) || coalesce(signature, '') || chr(10) || coalesce(docstring, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) // 4)), is_test, is_exported FROM cou WHERE used <= greatest(0, 8000 - (SELECT sum(tok) FROM tk))
  UNION ALL SELECT fqn, 0.3, 'importer', 5, least(1024, greatest(1, length(trim(regexp_replace(kind || ' ' || fqn || chr(10) || coalesce(signature, '') || chr(10) || coalesce(docstring, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) // 4)), is_test, is_exported FROM imp),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY score DESC, o) AS r1 FROM allx) WHERE r1 = 1),
pen AS (SELECT *, round(CASE WHEN coalesce(is_test, false) THEN score * 0.3 WHEN NOT coalesce(is_exported, true) THEN score * 0.85 ELSE score END, 9) AS final FROM best),
packed AS (SELECT *, sum(tok) OVER (ORDER BY final DESC, fqn ROWS UNBOUNDED PRECEDING) AS used FROM pen)
SELECT fqn, role, tok::INT AS token_estimate, used::BIGINT AS used, round(final, 4) AS score FROM packed WHERE used <= 8000"""


@q("C01_capsule", CAPSULE)
def c01(s, d):
    ix = index(s, d)
    c = capsule.capsule(ix, QUERY, vector=views.query_vector(ix.dense))
    return c.select("fqn", "role", "token_estimate", "used", F.round("score", 4).alias("score"))


@q("C02_linked_observations", f"WITH {views.OBSERVATIONS_SQL} SELECT DISTINCT content, created_at, stale, confidence FROM observations WHERE id IN (SELECT observation_id FROM links WHERE node_id IN (SELECT id FROM nodes WHERE is_exported)) ORDER BY stale, confidence DESC, created_at DESC, content LIMIT 5")
def c02(s, d):
    return capsule.linked_observations(views.observations(s, d), views.links(s, d), table(s, d, "nodes").where(F.col("is_exported")))


@q("C06_skeleton", "WITH f AS (SELECT min(file_path) AS f FROM nodes UNION ALL SELECT max(file_path) FROM nodes UNION ALL SELECT 'no/such.py') SELECT f AS file_path, name, kind, start_line, substring(replace(trim(coalesce(signature, ''), ' '), chr(10), ' '), 1, 200) AS signature, CASE WHEN length(trim(coalesce(docstring, ''), ' ')) > 120 THEN substring(trim(docstring, ' '), 1, 120) || '…' ELSE trim(coalesce(docstring, ''), ' ') END AS docstring, is_exported FROM f LEFT JOIN nodes ON file_path = f")
def c06(s, d):
    n = table(s, d, "nodes")
    r = n.agg(F.min("file_path").alias("a"), F.max("file_path").alias("b")).first()
    return capsule.skeleton(n, [r.a, r.b, "no/such.py"])


@q("C08_index_status", "SELECT 'nodes' AS what, count(*)::BIGINT AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'files', count(*) FROM file_cache UNION ALL SELECT 'embeddings', count(*) FROM node_embeddings UNION ALL SELECT 'kind:' || coalesce(kind, ''), count(*) FROM nodes GROUP BY kind")
def c08(s, d):
    return memory.index_status(*[table(s, d, t) for t in ("nodes", "edges", "file_cache", "node_embeddings")])


@q("C09_session_context", f"WITH {views.OBSERVATIONS_SQL} SELECT id, type, created_at FROM observations WHERE session_id = (SELECT min(session_id) FROM observations) AND type IN ('readme', 'issue') ORDER BY created_at DESC, id LIMIT 20")
def c09(s, d):
    o = views.observations(s, d)
    return memory.session_context(o, o.agg(F.min("session_id")).first()[0], ["readme", "issue"]).select("id", "type", "created_at")


@q("C11_changed_per_run", f"WITH {RUNS} SELECT run_id, count(*)::BIGINT AS files FROM cases GROUP BY 1")
def c11(s, d):
    from sextant.operators.incremental import replay_runs

    return replay_runs(table(s, d, "file_cache"), table(s, d, "index_runs")).groupBy("run_id").agg(F.count(F.lit(1)).alias("files"))


WORDS = ("cursor", "stream", "registry", "symbol")


def _read_whole(s, d):
    """w, base: tokens of the whole first three documents that contain each word."""
    w = s.createDataFrame([(x,) for x in WORDS], "w string")
    t = table(s, d, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    hits = t.join(F.broadcast(w), F.contains("text", "w")).select("w", "doc_id", F.length("text").alias("n"))
    return graph.first_of(hits, "w", 3, "doc_id").groupBy("w").agg(F.greatest(F.lit(1), F.floor(F.sum("n") / 4)).cast("int").alias("base"))


@q("C13_grep_baseline", """WITH w AS (SELECT unnest(['cursor', 'stream', 'registry', 'symbol']) AS w), hits AS (SELECT w, doc_id, length(text) AS n FROM documents JOIN w ON contains(text, w))
SELECT w, greatest(1, sum(n) // 4)::INT AS base FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id) AS r FROM hits) WHERE r <= 3 GROUP BY w""")
def c13(s, d):
    """What reading the whole first three documents with each word costs."""
    return _read_whole(s, d)


@q("C13_capsule_savings")
def c13_capsule(s, d):
    """Whole first three documents that contain a word against the text of the word's capsule. Without SQL: the capsule's text is rendered."""
    ix = index(s, d)
    tokens = [(w, max(1, len(render.capsule_text(w, capsule.capsule(ix, w), 8000)) // 4)) for w in WORDS]
    ours = s.createDataFrame(tokens, "w string, ours int")
    return savings_summary(_read_whole(s, d).join(F.broadcast(ours), "w").select("ours", "base"))


@q("Z02_not_yet_sent", f"WITH {views.OBSERVATIONS_SQL} SELECT DISTINCT session_id AS session, type AS fqn FROM observations WHERE (session_id, type) NOT IN (SELECT session_id, type FROM observations WHERE stale)")
def z02(s, d):
    o = views.observations(s, d).select(F.col("session_id").alias("session"), F.col("type").alias("fqn"), "stale")
    return flows.not_yet_sent(o, o.where("stale")).select("session", "fqn")


@q("Z03_tool_statistics", "SELECT date_trunc('hour', ts) AS start, event_type AS tool, count(*)::BIGINT AS calls, round(avg(value), 6) AS mean_ms, max(value) AS max_ms FROM events GROUP BY ALL")
def z03(s, d):
    return flows.tool_statistics(views.request_log(s, d)).withColumn("mean_ms", F.round("mean_ms", 6))
