"""Retrieval, fusion and vector queries of the reference's inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import text as tx
from sextant.operators import capsule, lexical, memory, rank, vectors
from sextant.plans import views
from sextant.plans.registry import Registry
from sextant.plans.views import QUERY
from sextant.session import cut, table

q = Registry()
QUERIES, ORACLE = q.queries, q.sql
PHRASES = lexical.phrases(QUERY)
BM25 = views.bm25_sql("nodes", "id", lexical.FIELDS, PHRASES)
STOPS = ", ".join(f"'{w}'" for w in tx.STOPWORDS)

QUERY_SQL = f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*'), lambda t: length(t) >= 3 AND lower(t) NOT IN ({STOPS})) AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, w, list_transform(w, lambda t: lower(t)) AS l FROM w)
SELECT d.doc_id, CASE WHEN len(f.w) > 0 THEN array_to_string(list_filter(f.w, lambda t, i: list_position(f.l, lower(t)) = i), ' OR ') ELSE substring(d.text, 1, 50) END AS fts FROM documents d JOIN f USING (doc_id)"""


@q("T01_fts_query", QUERY_SQL)
def t01(s, d):
    return table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", tx.fts_query(F.col("text")).alias("fts"))


@q("T02_bm25_search", f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, id LIMIT 100")
def t02(s, d):
    return lexical.bm25_search(table(s, d, "nodes"), QUERY).select("id", F.round("score", 6).alias("score"))


@q("T02_bm25_indexed", f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, id LIMIT 100")
def t02_indexed(s, d):
    """The same from a stored inverted index."""
    return lexical.FullText.build(table(s, d, "nodes")).stored().search(QUERY).select("id", F.round("score", 6).alias("score"))


LIKE = " + ".join(f"greatest({', '.join(f'coalesce({c} ILIKE {chr(39)}%{w}%{chr(39)}, false)::INT' for c in ('name', 'fqn', 'docstring', 'signature'))})" for w in ("order", "the", "pending", "cursor", "records"))


@q("T03_like_fallback", f"SELECT * FROM (SELECT id, ({LIKE})::DOUBLE AS score FROM nodes) WHERE score > 0 ORDER BY score DESC, id LIMIT 100")
def t03(s, d):
    return lexical.substring_search(table(s, d, "nodes"), QUERY)


NAMED = "(SELECT name FROM nodes GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"


def _common_name(n):
    return n.groupBy("name").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "name").first().name


@q("T04_exact_name", f"SELECT id, 5.0::DOUBLE AS score FROM nodes WHERE name = {NAMED} ORDER BY id LIMIT 10")
def t04(s, d):
    n = table(s, d, "nodes")
    return lexical.exact_names(n, _common_name(n))


@q("T05_anchors", f"WITH {BM25}, top AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 100) SELECT id, 3.0::DOUBLE AS score FROM nodes WHERE fqn IN (SELECT min(fqn) FROM nodes UNION SELECT max(fqn) FROM nodes) AND id NOT IN (SELECT id FROM top)")
def t05(s, d):
    n = table(s, d, "nodes")
    r = n.agg(F.min("fqn").alias("a"), F.max("fqn").alias("b")).first()
    return lexical.anchor_nodes(n, [r.a, r.b]).join(lexical.bm25_search(n, QUERY), "id", "left_anti")


@q("T06_dense_cosine", f"WITH {views.DENSE_SQL} SELECT id, round(score, 6) AS score FROM cosines")
def t06(s, d):
    v = vectors.newest_dense(table(s, d, "node_embeddings_dense"))
    return vectors.dense_scores(v, views.query_vector(v)).select("id", F.round("score", 6).alias("score"))


TFIDF = r"""
txt AS (SELECT id, concat_ws(' ', nullif(name, ''), nullif(fqn, ''), nullif(signature, ''), nullif(docstring, ''), nullif(body_preview, '')) AS t FROM nodes),
tok AS (SELECT id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS term FROM txt),
cnt AS (SELECT id, term, count(*) AS n FROM tok WHERE regexp_full_match(term, '[a-z_][\p{L}\p{N}_]{2,}') GROUP BY ALL),
voc AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM nodes)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM cnt GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(n) DESC, term LIMIT 20000),
wgt AS (SELECT id, term, (1 + ln(n)) * idf AS w FROM cnt JOIN voc USING (term)),
vec AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM wgt)
"""


def _fit(s, d):
    n = table(s, d, "nodes")
    return vectors.tfidf_fit(n, vectors.embedding_text(n))


@q("T08_tfidf_fit", f"WITH {TFIDF} SELECT id, term, round(weight, 6) AS weight FROM vec")
def t08(s, d):
    return _fit(s, d)[1].withColumn("weight", F.round("weight", 6))


@q("T08_vocabulary", f"WITH {TFIDF} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM voc")
def t08v(s, d):
    return _fit(s, d)[0].withColumn("idf", F.round("idf", 6))


QV = r"""
qt AS (SELECT term, 1 + ln(count(*)) AS tf FROM (SELECT unnest(regexp_extract_all(lower('{0}'), '[\p{{L}}\p{{N}}_]+')) AS term) WHERE regexp_full_match(term, '[a-z_][\p{{L}}\p{{N}}_]{{2,}}') GROUP BY 1),
qw AS (SELECT term, tf * idf AS w FROM qt JOIN voc USING (term)), qn AS (SELECT term, w / sqrt(sum(w * w) OVER ()) AS q FROM qw)
""".format(QUERY)


@q("T07_tfidf_cosine", f"WITH {TFIDF}, {QV} SELECT id, round(sum(q * weight), 6) AS score FROM vec JOIN qn USING (term) GROUP BY id")
def t07(s, d):
    vocab, vecs = _fit(s, d)
    return vectors.tfidf_scores(vocab, vecs, QUERY).select("id", F.round("score", 6).alias("score"))


@q("T09_tfidf_of_changed", f"WITH {TFIDF} SELECT id, term, round(weight, 6) AS weight FROM vec WHERE id IN (SELECT n.id FROM nodes n WHERE n.indexed_at > (SELECT max(started_at) FROM index_runs WHERE status = 'success'))")
def t09(s, d):
    since = table(s, d, "index_runs").where(F.col("status") == "success").agg(F.max("started_at")).scalar()
    changed = table(s, d, "nodes").where(F.col("indexed_at") > since).select("id")
    return _fit(s, d)[1].join(changed, "id", "left_semi").withColumn("weight", F.round("weight", 6))


@q("T10_embedding_text", "SELECT id, concat_ws(' ', nullif(name, ''), nullif(fqn, ''), nullif(signature, ''), nullif(docstring, ''), nullif(body_preview, '')) AS text FROM nodes")
def t10(s, d):
    n = table(s, d, "nodes")
    return n.select("id", vectors.embedding_text(n).alias("text"))


@q("T11_encode")
def t11(s, d):
    return vectors.dense_build(table(s, d, "nodes"))


@q("T12_encode_changed")
def t12(s, d):
    n = table(s, d, "nodes")
    done = table(s, d, "node_embeddings_dense").select(F.col("node_id").alias("id"))
    return vectors.dense_build(n, changed=n.select("id").join(done, "id", "left_anti"))


@q("T14_expand_query", "SELECT name, fqn, file_path, r::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM nodes WHERE name IN (SELECT unnest(regexp_extract_all((SELECT string_agg(name, ' ') FROM (SELECT name FROM nodes GROUP BY name ORDER BY count(*) DESC, name LIMIT 5)), '[A-Za-z][A-Za-z0-9_]{2,}')))) WHERE r <= 3")
def t14(s, d):
    n = table(s, d, "nodes")
    top = n.groupBy("name").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "name").limit(5).collect()
    return lexical.expand_query(n, " ".join(r.name for r in top))


MEMORY_SQL = views.bm25_sql("observations", "id", {"content": 1.0}, PHRASES, "mem")


@q("T15_search_memory", f"WITH {views.OBSERVATIONS_SQL}, {MEMORY_SQL} SELECT o.id, o.type, o.stale, round(m.score, 6) AS score FROM observations o JOIN mem m USING (id) ORDER BY o.stale, m.score DESC, id LIMIT 10")
def t15(s, d):
    return memory.search_memory(views.observations(s, d), QUERY).select("id", "type", "stale", F.round("score", 6).alias("score"))


@q("T16_semantic_override", f"WITH {TFIDF}, {QV.replace(QUERY, 'scan the partition checkpoint')}, {BM25}, top AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 100) SELECT id, round(sum(q * weight), 6) AS score FROM vec JOIN qn USING (term) WHERE id IN (SELECT id FROM top) GROUP BY id")
def t16(s, d):
    vocab, vecs = _fit(s, d)
    n = table(s, d, "nodes")
    ix = capsule.Index(n, table(s, d, "edges"), vocabulary=vocab, sparse=vecs)
    return capsule.semantic_scores(ix, "scan the partition checkpoint", lexical.bm25_search(n, QUERY)).select("id", F.round("score", 6).alias("score"))


RESOLVE = f"""WITH asked AS (SELECT {NAMED} AS asked UNION ALL SELECT 'cursor'),
e AS (SELECT asked, id, fqn, kind, file_path, true AS exact FROM asked JOIN nodes ON name = asked WHERE kind = 'function'),
l AS (SELECT asked, id, fqn, kind, file_path, false AS exact FROM asked JOIN nodes ON contains(fqn, asked) WHERE asked NOT IN (SELECT asked FROM e)),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY id) AS r FROM (SELECT * FROM e UNION ALL SELECT * FROM l))
SELECT asked, id, fqn, kind, file_path, exact FROM r WHERE r <= 5"""


@q("T17_resolve_symbols", RESOLVE)
def t17(s, d):
    n = table(s, d, "nodes")
    return lexical.resolve_symbols(n, [_common_name(n), "cursor"], kind="function")


@q("K05_fts_index", f"SELECT term, id, field, count(*)::BIGINT AS hits, min(pos)::INT AS first FROM (SELECT id, field, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM ({' UNION ALL '.join(f'SELECT id, {chr(39)}{f}{chr(39)} AS field, {views.fts_sql(f)} AS t FROM nodes' for f in lexical.FIELDS)})) GROUP BY term, id, field")
def k05(s, d):
    return lexical.fts_index(table(s, d, "nodes"))


@q("K06_vocabulary_saved", f"WITH {TFIDF} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM voc")
def k06(s, d):
    return _fit(s, d)[0].withColumn("idf", F.round("idf", 6))


@q("R01_max_normalised", f"WITH {BM25}, top AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 100) SELECT id, round(score / (SELECT max(score) FROM top), 6) AS score FROM top")
def r01(s, d):
    return rank.normalised(cut(lexical.bm25_search(table(s, d, "nodes"), QUERY)), "score").select("id", F.round("score", 6).alias("score"))


#: Prior, fusion and hydration over the candidates ``top``.
FUSED = """
deg AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) WHERE id IN (SELECT id FROM top) GROUP BY 1),
cf AS (SELECT f, max(c) AS c FROM (SELECT file_a AS f, coupling_score AS c FROM coupling UNION ALL SELECT file_b, coupling_score FROM coupling) GROUP BY 1),
prior AS (SELECT t.id, round(0.6 * coalesce(deg.n, 0) / (SELECT coalesce(max(n), 1) FROM deg)::DOUBLE + 0.25 * coalesce(cf.c, 0) + 0.15 * coalesce(l.churn_score, 0), 9) AS g
  FROM top t JOIN nodes n ON n.id = t.id LEFT JOIN deg ON deg.id = t.id LEFT JOIN cf ON cf.f = n.file_path LEFT JOIN lineage l ON l.file_path = n.file_path),
fused AS (SELECT t.id, t.score / (SELECT max(score) FROM top) AS b, coalesce(c.score, 0) AS s, p.g FROM top t JOIN prior p ON p.id = t.id LEFT JOIN cosines c ON c.id = t.id),
scored AS (SELECT *, round(0.45 * b + 0.40 * s + 0.15 * g, 9) AS total FROM fused)
"""


@q("R04_graph_prior", f"WITH {views.COMMITS_SQL}, {views.DENSE_SQL}, {BM25}, top AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 100), {FUSED} SELECT id, round(g, 6) AS score FROM prior")
def r04(s, d):
    from sextant.operators import coupling as cp

    c = views.commits(s, d)
    n = table(s, d, "nodes")
    return rank.graph_prior(cut(lexical.bm25_search(n, QUERY)), n, table(s, d, "edges"), cp.coupling(c, 2), cp.lineage(c)).select("id", F.round("score", 6).alias("score"))


def index(s, d) -> capsule.Index:
    """The test tables as an index, with dense vectors, coupling and lineage."""
    from sextant.operators import coupling as cp

    c = views.commits(s, d)
    dense = cut(vectors.newest_dense(table(s, d, "node_embeddings_dense")))
    return capsule.Index(table(s, d, "nodes"), table(s, d, "edges"), table(s, d, "import_refs"), cut(cp.coupling(c, 2)), cut(cp.lineage(c)), dense, observations=views.observations(s, d), links=views.links(s, d), cross=table(s, d, "cross_repo_edges"))


@q("R02_fusion", f"WITH {views.COMMITS_SQL}, {views.DENSE_SQL}, {BM25}, top AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 100), {FUSED} SELECT id, round(b, 6) AS bm25, round(s, 6) AS semantic, round(g, 6) AS graph, round(total, 6) AS score FROM scored")
def r02(s, d):
    ix = index(s, d)
    hits = cut(lexical.bm25_search(ix.nodes, QUERY))
    f = rank.fuse(hits, vectors.dense_scores(ix.dense, views.query_vector(ix.dense)), rank.graph_prior(hits, ix.nodes, ix.edges, ix.coupling, ix.lineage))
    return f.select("id", *[F.round(c, 6).alias(c) for c in ("bm25", "semantic", "graph", "score")])


HYBRID = f"""{views.COMMITS_SQL}, {views.DENSE_SQL}, {BM25}, top AS (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT :candidates), {FUSED},
hyb AS (SELECT s.*, row_number() OVER (ORDER BY total DESC, id) AS r FROM scored s)"""


@q("R03_hybrid_search", f"WITH {HYBRID.replace(':candidates', '100')} SELECT id AS node_id, fqn, round(total, 4) AS score, CASE WHEN x = '' THEN 'weak match' ELSE x END AS reason FROM (SELECT n.fqn, hyb.*, concat_ws(' + ', CASE WHEN round(b, 3) > 0.5 THEN 'high text relevance' WHEN round(b, 3) > 0.1 THEN 'keyword match' END, CASE WHEN round(s, 3) > 0.5 THEN 'strong semantic match' WHEN round(s, 3) > 0.2 THEN 'semantic similarity' END, CASE WHEN round(g, 3) > 0.3 THEN 'highly connected' END) AS x FROM hyb JOIN nodes n ON n.id = hyb.id) WHERE r <= 20")
def r03(s, d):
    ix = index(s, d)
    return capsule.hybrid_search(ix, QUERY, vector=views.query_vector(ix.dense)).select("node_id", "fqn", "score", "reason")


@q("R05_rounding", "SELECT DISTINCT query_id, node_id, round(score::DECIMAL(24, 8), 4)::DOUBLE AS score, round(score_breakdown.bm25::DECIMAL(24, 8), 3)::DOUBLE AS bm25, round(score_breakdown.graph::DECIMAL(24, 8), 3)::DOUBLE AS graph FROM search_results")
def r05(s, d):
    b = F.col("score_breakdown")
    return table(s, d, "search_results").select("query_id", "node_id", F.round("score", 4).alias("score"), F.round(b["bm25"], 3).alias("bm25"), F.round(b["graph"], 3).alias("graph")).distinct()


@q("R07_penalties", "SELECT n.id, round(CASE WHEN coalesce(is_test, false) THEN s * 0.3 WHEN NOT coalesce(is_exported, true) THEN s * 0.85 ELSE s END, 6) AS score FROM nodes n JOIN (SELECT node_id, max(score) AS s FROM search_results GROUP BY 1) ON node_id = n.id")
def r07(s, d):
    b = table(s, d, "search_results").groupBy(F.col("node_id").alias("id")).agg(F.max("score").alias("score"))
    j = table(s, d, "nodes").join(b, "id")
    return j.select("id", F.round(rank.penalised(j, QUERY), 6).alias("score"))
