"""Queries of the language-model problems over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.llm import leaks, leximin, pairs, permutation, reading, relevance, tokens
from sextant.session import table


def p3_found(spark, d):
    return leximin.search_ranking(table(spark, d, "search_results")).select("query_id", "node_id")


def p3_ranking(spark, d):
    """The whole ranking: every item of every query."""
    return leximin.search_ranking(table(spark, d, "search_results"), k=None)


def p4_found(spark, d):
    return permutation.neighbour_pairs(table(spark, d, "node_embeddings_dense"))


def p4_neighbours(spark, d):
    return permutation.nearest_neighbours(table(spark, d, "node_embeddings_dense")).withColumn("cosine", F.round("cosine", 6))


def p4_nearest(spark, d):
    """Of every vector its five most similar, however low their cosine. Without SQL: the index is approximate where no cosine is wanted."""
    return permutation.nearest_neighbours(table(spark, d, "node_embeddings_dense"), floor=None).withColumn("cosine", F.round("cosine", 6))


def p6_found(spark, d):
    return pairs.function_pairs(table(spark, d, "nodes")).select("node_id")


def p6_pairs(spark, d):
    return pairs.function_pairs(table(spark, d, "nodes"))


def p7_found(spark, d):
    return relevance.marking_terms(table(spark, d, "nodes"), table(spark, d, "node_embeddings")).select("node_id", "term")


def p7_weights(spark, d):
    return relevance.bm25_weights(relevance.term_postings(table(spark, d, "nodes"), table(spark, d, "node_embeddings"))).select("node_id", "term", F.round("weight", 6).alias("weight"))


def p8_ids(spark, d):
    return tokens.encode_corpus(table(spark, d, "documents"))


#: Documents that ``p8_joined`` puts together: a fixed number, so that no text grows with the table.
JOINED = 512


def p8_joined(spark, d):
    """Very long texts: every ``JOINED`` neighbouring documents as one. Without SQL; a test compares with encoding the whole texts."""
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / JOINED).cast("long").alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    long = docs.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "t"))).alias("p")).select("part", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))
    return tokens.encode_corpus(long, "part", "text")


def p9_found(spark, d):
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_near(spark, d):
    """Proximity matches. Without SQL: words are read through their forms; a test compares with brute force."""
    return leaks.near_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark, d):
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES = {f.__name__: f for f in (p3_found, p3_ranking, p4_found, p4_neighbours, p4_nearest, p6_found, p6_pairs, p7_found, p7_weights, p8_ids, p8_joined, p9_found, p9_near, p10_found)}

LEXIMIN = """
items AS (SELECT query_id, node_id, max(score_breakdown.bm25) AS a, max(score_breakdown.semantic) AS b, max(score_breakdown.graph) AS c
  FROM search_results WHERE query_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL),
long AS (SELECT query_id, node_id, 'a' AS s, a AS v FROM items UNION ALL SELECT query_id, node_id, 'b', b FROM items UNION ALL SELECT query_id, node_id, 'c', c FROM items),
r AS (SELECT *, rank() OVER (PARTITION BY query_id, s ORDER BY v ASC NULLS FIRST) - 1 AS below,
  count(*) OVER (PARTITION BY query_id, s, v) AS ties, count(*) OVER (PARTITION BY query_id, s) AS n FROM long),
st AS (SELECT query_id, node_id, list_sort(list(CASE WHEN n <= 1 THEN 1.0 ELSE (below + (ties - 1) / 2.0) / (n - 1) END::DOUBLE)) AS standing FROM r GROUP BY ALL),
ranked AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY standing DESC, node_id) AS rank, standing FROM st)
"""

NEIGHBOURS = """
newest AS (SELECT node_id, arg_max(vector, updated_at) AS v FROM (SELECT node_id, coalesce(vector, []) AS vector, updated_at FROM node_embeddings_dense WHERE node_id IS NOT NULL) GROUP BY 1),
u AS (SELECT node_id, v::DOUBLE[] AS v, len(v) AS d, sqrt(list_sum(list_transform(v::DOUBLE[], lambda x: x * x))) AS n FROM newest WHERE len(v) > 0),
p AS (SELECT a.node_id AS node, b.node_id AS neighbour, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.n * b.n) AS cosine
  FROM u a JOIN u b ON a.d = b.d AND a.node_id <> b.node_id WHERE a.n > 0 AND b.n > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cosine DESC, neighbour) AS rank FROM p WHERE cosine >= 0.9),
top AS (SELECT * FROM r WHERE rank <= 5)
"""

POSTINGS = r"""
newest AS (SELECT node_id, max(struct_pack(u := updated_at, v := vector_json)).v AS v FROM node_embeddings WHERE node_id IS NOT NULL GROUP BY 1),
src AS (SELECT id AS node_id, CASE WHEN regexp_replace(body_preview, '^\s+', '') = '' THEN NULL ELSE body_preview END AS body FROM nodes WHERE id IS NOT NULL),
words AS (SELECT node_id, unnest(regexp_extract_all(body, '[A-Za-z0-9_]+')) AS w, 1.0 AS n FROM src WHERE body IS NOT NULL),
maps AS (SELECT node_id, unnest(map_entries(try_cast(try_cast(v AS JSON) AS MAP(VARCHAR, DOUBLE)))) AS e FROM src JOIN newest USING (node_id) WHERE body IS NULL),
allterms AS (SELECT node_id, w, n FROM words UNION ALL SELECT node_id, e.key, e.value FROM maps WHERE e.value > 0),
post AS (SELECT node_id, lower(w) AS term, sum(n)::DOUBLE AS tf FROM allterms WHERE regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]{2,}$') GROUP BY ALL),
dl AS (SELECT node_id, sum(tf) AS l FROM post GROUP BY 1),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
st AS (SELECT count(*) AS n, avg(l) AS a FROM dl)
"""

ORACLE = {
    "p3_found": f"WITH {LEXIMIN} SELECT query_id, node_id FROM ranked WHERE rank <= 5",
    "p3_ranking": f"WITH {LEXIMIN} SELECT query_id, node_id, rank::INTEGER AS rank, standing FROM ranked",
    "p4_found": f"WITH {NEIGHBOURS} SELECT DISTINCT least(node, neighbour) AS node_a, greatest(node, neighbour) AS node_b FROM top",
    "p4_neighbours": f"WITH {NEIGHBOURS} SELECT node, neighbour, round(cosine, 6) AS cosine, rank::INTEGER AS rank FROM top",
    "p7_found": f"WITH {POSTINGS} SELECT node_id, term FROM post JOIN df USING (term) WHERE tf >= 3 AND df <= 5",
    "p7_weights": f"""WITH {POSTINGS} SELECT node_id, term,
  round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a)), 6) AS weight
FROM post JOIN df USING (term) JOIN dl USING (node_id), st""",
}
