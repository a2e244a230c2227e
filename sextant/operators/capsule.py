"""Hybrid search and the context capsule: what to show of a code base for a question, within a budget of tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import coupling as cpl
from sextant.operators import graph, lexical, rank, vectors
from sextant.session import cut

SEEDS, IMPORTER_SHARE, IMPORTER_SCORE = 15, 5, 0.3


@dataclass
class Index:
    """The tables a query runs over. Only ``nodes`` and ``edges`` are needed; ``dense`` is (id, vector, length), ``vocabulary`` and ``sparse`` those of a TF-IDF fit."""

    nodes: DataFrame
    edges: DataFrame
    imports: DataFrame | None = None
    coupling: DataFrame | None = None
    lineage: DataFrame | None = None
    dense: DataFrame | None = None
    vocabulary: DataFrame | None = None
    sparse: DataFrame | None = None
    observations: DataFrame | None = None
    links: DataFrame | None = None
    cross: DataFrame | None = None
    encoder: object | None = None
    fulltext: lexical.FullText | None = None


def semantic_scores(ix: Index, text: str, candidates: DataFrame, vector: list[float] | None = None) -> DataFrame:
    """id, score of the candidates: dense cosine where there is a vector of the query, else TF-IDF cosine, else nothing."""
    if ix.dense is not None and (vector is not None or ix.encoder is not None):
        q = vector if vector is not None else [float(x) for x in ix.encoder([text])[0]]
        return vectors.dense_scores(ix.dense.join(candidates.select("id"), "id", "left_semi"), q)
    if ix.vocabulary is not None and ix.sparse is not None:
        return vectors.tfidf_scores(ix.vocabulary, ix.sparse.join(candidates.select("id"), "id", "left_semi"), text)
    return candidates.select("id", F.lit(0.0).alias("score")).where(F.lit(False))


def hybrid_search(ix: Index, query: str, limit: int = 20, kind: str | None = None, anchors: list[str] | None = None, semantic_text: str | None = None, vector: list[float] | None = None) -> DataFrame:
    """node_id, name, fqn, file_path, kind, start_line, signature, docstring, score, score_breakdown, reason: the best of 5 * limit lexical candidates by the fused score.

    ``semantic_text`` replaces the query on the semantic side only; ``vector`` is its vector if already known.
    """
    hits = cut(lexical.lexical_candidates(ix.nodes, query, 5 * limit, anchors, ix.fulltext))
    fused = rank.fuse(hits, semantic_scores(ix, semantic_text or query, hits, vector), rank.graph_prior(hits, ix.nodes, ix.edges, ix.coupling, ix.lineage))
    return rank.hydrate(fused, ix.nodes, limit, kind)


def _as_entries(nodes: DataFrame, score, role, reason) -> DataFrame:
    d = nodes.select("fqn", "file_path", "kind", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("signature", F.lit("")).alias("signature"), F.coalesce("docstring", F.lit("")).alias("docstring"), score.alias("score"), reason.alias("reason"), role.alias("role"))
    return d.withColumn("token_estimate", rank.token_cost(d)).withColumn("docstring", F.substring("docstring", 1, 512))


def importer_entries(ix: Index, files: DataFrame, budget: int) -> DataFrame:
    """The first three exported nodes of each importing file, files in order of path, as long as they fit the budget."""
    f = graph.importer_files(ix.imports, files)
    n = graph.first_of(ix.nodes.where(F.col("is_exported")).join(f, "file_path", "left_semi"), "file_path", 3, "id")
    n = rank.pack(n.withColumn("cost", rank.token_cost(n, docstring=False)), budget, "cost", F.col("file_path"), F.col("id"))
    return _as_entries(n, F.lit(IMPORTER_SCORE), F.lit("importer"), F.concat(F.lit("IMPORTS ("), F.col("file_path"), F.lit(")")))


def co_change_entries(ix: Index, files: DataFrame, budget: int) -> DataFrame:
    """The first five nodes of the three files most coupled with each file, as long as they fit the budget."""
    c = cpl.coupled_files(ix.coupling, files).withColumnRenamed("file_path", "seed_file")
    n = graph.first_of(ix.nodes, "file_path", 5, "id").join(c, F.col("file_path") == F.col("coupled"))
    order = (F.col("seed_file"), F.col("coupling_score").desc(), F.col("coupled"), F.col("id"))
    n = rank.pack(n.withColumn("cost", rank.token_cost(n, docstring=False)), budget, "cost", *order)
    return _as_entries(n, F.col("coupling_score"), F.lit("co_change"), F.format_string("CO_CHANGES_WITH (score %.2f)", F.col("coupling_score")))


def capsule(ix: Index, query: str, max_tokens: int = 8000, depth: int = 2, exclude: list[str] | None = None, anchors: list[str] | None = None, semantic_text: str | None = None, vector: list[float] | None = None) -> DataFrame:
    """fqn, file_path, kind, start_line, signature, docstring, score, reason, role, token_estimate, used: the capsule's nodes, best first by score.

    Seeds of the search, their callers and callees, nodes of co-changing files and of importing files are put together; of an
    FQN found several ways the best score counts (ties in this order of roles); scores of test and unexported nodes are lowered; then the best are taken while they fit ``max_tokens``. ``exclude`` keeps
    FQNs out of all roles but caller and callee; an excluded seed is still expanded.
    """
    seeds = cut(hybrid_search(ix, query, SEEDS, None, anchors, semantic_text, vector))
    out = ix.nodes.sparkSession.createDataFrame([(f,) for f in exclude or []], "fqn string")
    kept = seeds.join(F.broadcast(out), "fqn", "left_anti") if exclude else seeds
    parts = _as_entries(kept, F.col("score"), F.lit("seed"), F.col("reason"))
    near = graph.expand_neighbours(ix.edges, seeds.select(F.col("node_id").alias("id")), depth)
    prior = rank.graph_prior(near, ix.nodes, ix.edges, ix.coupling, ix.lineage)
    n = ix.nodes.join(near, "id").join(prior.withColumnRenamed("score", "prior"), "id")
    parts = cut(parts.unionByName(_as_entries(n, F.col("prior"), F.col("role"), F.col("role"))))
    files = seeds.select("file_path").distinct()
    more = []
    if ix.coupling is not None:
        spent = parts.agg(F.sum("token_estimate")).first()[0] or 0
        more.append(co_change_entries(ix, files, max(0, max_tokens - spent)))
    if ix.imports is not None and max_tokens // IMPORTER_SHARE > 0:
        more.append(importer_entries(ix, files, max_tokens // IMPORTER_SHARE))
    for m in more:
        parts = parts.unionByName(m.join(F.broadcast(out), "fqn", "left_anti") if exclude else m)
    order = F.array_position(F.array(*map(F.lit, ("seed", "callee", "caller", "co_change", "importer"))), F.col("role"))
    best = rank.best_by(parts.withColumn("role_order", order), "fqn", "score", "role_order").drop("role_order")
    best = best.join(ix.nodes.select("fqn", "is_test", "is_exported"), "fqn", "left")
    best = best.withColumn("score", F.round(rank.penalised(best, query), 9)).drop("is_test", "is_exported")
    return rank.pack(best, max_tokens, "token_estimate", F.col("score").desc(), F.col("fqn"))


def linked_observations(observations: DataFrame, links: DataFrame, ids: DataFrame, limit: int = 5) -> DataFrame:
    """content, created_at, stale, confidence: observations linked to any of the nodes (id), fresh ones first, then by confidence and time."""
    l = links.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("observation_id").distinct()
    o = observations.join(l, F.col("id") == F.col("observation_id"), "left_semi").select("content", "created_at", "stale", "confidence").distinct()
    return o.orderBy("stale", F.col("confidence").desc(), F.col("created_at").desc(), "content").limit(limit)


def skeleton(nodes: DataFrame, files: list[str], detail: str = "standard", root: str | None = None) -> DataFrame:
    """file_path, name, kind, start_line, signature, docstring, is_exported of each asked file's symbols; a file that isn't indexed has one row with null name.

    minimal: exported symbols without docstrings; standard: docstrings of at most 120 characters; detailed: whole docstrings. Signatures are cut at 200 characters. Paths under ``root`` are tried
    relative to it too.
    """
    if detail not in ("minimal", "standard", "detailed"):
        raise ValueError(f"unknown detail: {detail}")
    base = (root or "").rstrip("/") + "/"
    rows = [(f, f[len(base):] if root and f.startswith(base) else f) for f in dict.fromkeys(files)]
    asked = nodes.sparkSession.createDataFrame(rows, "file_path string, local string")
    n = nodes.select(F.col("file_path").alias("at"), "name", "kind", "start_line", "signature", "docstring", "is_exported", "id")
    j = F.broadcast(asked).join(n, (F.col("at") == F.col("file_path")) | (F.col("at") == F.col("local")), "left")
    if detail == "minimal":
        j = j.where(F.coalesce("is_exported", F.col("name").isNull()))
    doc = F.trim(F.coalesce("docstring", F.lit("")))
    doc = {"minimal": F.lit(""), "detailed": doc, "standard": F.when(F.length(doc) > 120, F.concat(F.substring(doc, 1, 120), F.lit("…"))).otherwise(doc)}[detail]
    sig = F.substring(F.replace(F.trim(F.coalesce("signature", F.lit(""))), F.lit("\n"), F.lit(" ")), 1, 200)
    return j.select("file_path", "name", "kind", "start_line", sig.alias("signature"), doc.alias("docstring"), "is_exported").orderBy("file_path", "start_line", "name")
