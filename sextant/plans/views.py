"""Domain tables as views over the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.paths import canonical_path
from sextant.functions.text import ACCENTS, PLAIN
from sextant.session import table

QUERY = "order the pending cursor records and fetch_symbol of a stream registry"

#: Commits: an order is a commit, a part is the file whose smallest node id is the part's key.
COMMITS_SQL = """
files AS (SELECT file_path, min(id) AS no FROM nodes GROUP BY 1),
commits AS (SELECT l_orderkey AS commit, f.file_path, o.o_custkey::VARCHAR AS author, o.o_orderdate AS ts FROM lineitem JOIN files f ON f.no = l_partkey JOIN orders o ON o.o_orderkey = l_orderkey),
fc AS (SELECT file_path, count(DISTINCT commit) AS n FROM commits GROUP BY 1),
dc AS (SELECT DISTINCT commit, file_path FROM commits),
pairs AS (SELECT a.file_path AS file_a, b.file_path AS file_b, count(*) AS shared FROM dc a JOIN dc b ON a.commit = b.commit AND a.file_path < b.file_path GROUP BY ALL HAVING count(*) >= 2),
coupling AS (SELECT file_a, file_b, shared / greatest(x.n, y.n)::DOUBLE AS coupling_score, shared AS shared_commits FROM pairs JOIN fc x ON x.file_path = file_a JOIN fc y ON y.file_path = file_b),
lineage AS (SELECT file_path, count(DISTINCT commit) AS commit_count, count(DISTINCT commit) / (SELECT max(n) FROM fc)::DOUBLE AS churn_score, max(struct_pack(t := ts, a := author)).a AS last_author, max(ts) AS last_commit_ts FROM commits GROUP BY 1)
"""


def commits(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "nodes").groupBy("file_path").agg(F.min("id").alias("no"))
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = l.select("l_orderkey", "l_partkey").join(files, F.col("l_partkey") == F.col("no")).join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_orderkey").alias("commit"), "file_path", F.col("o_custkey").cast("string").alias("author"), F.col("o_orderdate").alias("ts"))


#: Observations: a document with a text is an observation of its source's session; a third is stale. Links: to the nodes whose id is its own plus 1000.
OBSERVATIONS_SQL = """
observations AS (SELECT doc_id AS id, source AS session_id, doc_kind AS type, text AS content, created_at, 'agent' AS source, (doc_id % 10) / 10.0::DOUBLE AS confidence, doc_id % 3 = 0 AS stale FROM documents WHERE text IS NOT NULL),
links AS (SELECT o.id AS observation_id, n.id AS node_id FROM observations o JOIN nodes n ON n.id = o.id + 1000)
"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where(F.col("text").isNotNull())
    return t.select(F.col("doc_id").alias("id"), F.col("source").alias("session_id"), F.col("doc_kind").alias("type"), F.col("text").alias("content"), "created_at", F.lit("agent").alias("source"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"), (F.col("doc_id") % 3 == 0).alias("stale"))


def links(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).select(F.col("id").alias("observation_id"))
    return o.join(table(spark, d, "nodes").select(F.col("id").alias("node_id")), F.col("node_id") == F.col("observation_id") + 1000)


#: Request log: an event is a tool call.
def request_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("tool"), F.col("value").alias("elapsed_ms"), "props")


#: External edges in canonical spelling, types in capitals.
LSP_SQL = r"""
lsp AS (SELECT DISTINCT regexp_replace(replace(trim(source_fqn, E' \t\r\n'), '\', '/'), '^\./', '') AS source_fqn, regexp_replace(replace(trim(target_fqn, E' \t\r\n'), '\', '/'), '^\./', '') AS target_fqn, upper(edge_type) AS edge_type FROM lsp_edges)
"""


def lsp(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lsp_edges")
    return t.select(canonical_path(F.col("source_fqn")).alias("source_fqn"), canonical_path(F.col("target_fqn")).alias("target_fqn"), F.upper("edge_type").alias("edge_type")).distinct()


def fts_sql(column: str) -> str:
    """The full-text tokens of a column."""
    return rf"regexp_extract_all(translate(lower(coalesce({column}, '')), '{ACCENTS}', '{PLAIN}'), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(source: str, id_col: str, fields: dict[str, float], phrase_list: list[list[str]], name: str = "bm25") -> str:
    """CTEs that end in ``name`` (id, score): fielded BM25 of the phrases over a table."""

    def hits(f: str, p: list[str]) -> str:
        same = " AND ".join(f"t_{f}[i + {k}] = '{w}'" for k, w in enumerate(p))
        return f"len(list_filter(range(1, len(t_{f}) + 1), lambda i: {same}))"

    toks = ", ".join(f"{fts_sql(f)} AS t_{f}" for f in fields)
    length = " + ".join(f"len(t_{f})" for f in fields)
    hs = ", ".join("(" + " + ".join(f"{w} * {hits(f, p)}" for f, w in fields.items()) + f")::DOUBLE AS h{i}" for i, p in enumerate(phrase_list))
    ns = ", ".join(f"count(*) FILTER (h{i} > 0) AS n{i}" for i in range(len(phrase_list)))
    score = " + ".join(f"CASE WHEN h{i} > 0 THEN greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * h{i} * 2.2 / (h{i} + 1.2 * (1 - 0.75 + 0.75 * len / avg)) ELSE 0 END" for i in range(len(phrase_list)))
    any_hit = " + ".join(f"h{i}" for i in range(len(phrase_list)))
    return f"""
{name}_t AS (SELECT {id_col} AS id, {toks} FROM {source}),
{name}_h AS (SELECT id, ({length})::DOUBLE AS len, {hs} FROM {name}_t),
{name}_s AS (SELECT count(*) AS n, avg(len) AS avg, {ns} FROM {name}_h),
{name} AS (SELECT id, round({score}, 9) AS score FROM {name}_h, {name}_s WHERE {any_hit} > 0)
"""


#: Newest usable dense vectors, and the query's vector: that of the smallest id with 64 numbers.
DENSE_SQL = """
dense_n AS (SELECT node_id AS id, max(struct_pack(u := updated_at, v := vector)).v AS v FROM node_embeddings_dense WHERE node_id IS NOT NULL GROUP BY 1),
dense AS (SELECT id, v::DOUBLE[] AS v, sqrt(list_sum(list_transform(v::DOUBLE[], lambda x: x * x))) AS n FROM dense_n WHERE len(v) > 0),
qv AS (SELECT v, n FROM dense WHERE len(v) = 64 AND n > 0 ORDER BY id LIMIT 1),
cosines AS (SELECT d.id, list_sum(list_transform(list_zip(d.v, q.v), lambda z: z[1] * (z[2] / q.n))) / d.n AS score FROM dense d, qv q WHERE len(d.v) = len(q.v) AND d.n > 0)
"""


def query_vector(dense: DataFrame) -> list[float]:
    """The vector of the smallest id with 64 numbers."""
    r = dense.where(F.size("vector") == 64).orderBy("id").select("vector").first()
    return [float(x) for x in r.vector] if r else []
