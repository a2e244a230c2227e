"""Observations of sessions: saving, searching, listing; status of the index; the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import lexical


def new_observations(columns: list[str], links: DataFrame, nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, links) that ``new`` adds: id, session_id, type, content, created_at, source, confidence, linked (FQNs). Unknown FQNs make no link."""
    o = new.withColumn("stale", F.lit(False)).select(*columns)
    l = new.select(F.col("id").alias("observation_id"), F.explode("linked").alias("fqn")).join(nodes.select("fqn", F.col("id").alias("node_id")), "fqn").select("observation_id", "node_id").distinct()
    return o, l.join(links, ["observation_id", "node_id"], "left_anti")


def save_observations(observations: DataFrame, links: DataFrame, nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, links) with ``new_observations`` appended."""
    o, l = new_observations(observations.columns, links, nodes, new)
    return observations.unionByName(o), links.unionByName(l)


def auto_observation(tool: str, summary: str) -> str:
    """The text of an automatic observation after a tool call."""
    return f"[{tool}] {summary[:200]}"


def auto_observations(calls: DataFrame, tool: str, summary: str) -> DataFrame:
    """The same for a table of calls, as a column ``content``."""
    return calls.withColumn("content", F.concat(F.lit("["), tool, F.lit("] "), F.substring(summary, 1, 200)))


def search_memory(observations: DataFrame, query: str, limit: int = 10, include_stale: bool = True, since=None, session: str | None = None) -> DataFrame:
    """id, content, type, created_at, stale, confidence, score: observations by BM25 of their content, fresh ones first. ``since`` is a timestamp column or value."""
    hits = lexical.bm25_search(observations, query, {"content": 1.0}, limit=None)
    o = observations.join(hits, "id")
    if not include_stale:
        o = o.where(~F.col("stale"))
    if session is not None:
        o = o.where(F.col("session_id") == session)
    if since is not None:
        o = o.where(F.col("created_at") >= since)
    return o.select("id", "content", "type", "created_at", "stale", "confidence", "score").orderBy("stale", F.col("score").desc(), "id").limit(limit)


def session_context(observations: DataFrame, session: str | None, types: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Observations of a session, or of all if None, of the given types, newest first."""
    keep = F.lit(True)
    if session is not None:
        keep = keep & (F.col("session_id") == session)
    if types:
        keep = keep & F.col("type").isin(types)
    return observations.where(keep).select("id", "content", "type", "created_at", "stale", "confidence").orderBy(F.col("created_at").desc(), "id").limit(limit)


def index_status(nodes: DataFrame, edges: DataFrame, files: DataFrame, embeddings: DataFrame) -> DataFrame:
    """what, n: numbers of nodes, edges, files, vectors, and of nodes by kind."""
    one = lambda d, w: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "n")
    out = one(nodes, "nodes").unionByName(one(edges, "edges")).unionByName(one(files, "files")).unionByName(one(embeddings, "embeddings"))
    return out.unionByName(nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("kind:"), F.coalesce("kind", F.lit(""))).alias("what"), "n"))


def tool_calls(log: DataFrame) -> DataFrame:
    """The request log's tool calls with their approximate tokens; rows without a tool are session events."""
    return log.where(F.col("tool").isNotNull())


def log_entry(df: DataFrame, result: str = "result") -> DataFrame:
    """Rows to be logged: the result replaced by its length, its approximate tokens and a preview of 300 characters."""
    return df.withColumn("result_chars", F.length(result)).withColumn("result_tokens_approx", F.floor(F.length(result) / 4)).withColumn("preview", F.substring(result, 1, 300)).drop(result)
