"""Fusing scores, penalties, deduplication and packing into a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.text import MAX_NODE_TOKENS, approx_tokens, node_text, shorten

#: Weights of the fused score and of the graph prior; words that make a query one about tests.
LEXICAL, SEMANTIC, GRAPH = 0.45, 0.40, 0.15
DEGREE, COUPLING, CHURN = 0.6, 0.25, 0.15
TEST_WORDS = ["test", "spec", "fixture", "mock"]
TEST_FACTOR, HIDDEN_FACTOR = 0.3, 0.85


def normalised(df: DataFrame, column: str) -> DataFrame:
    """The column divided by its maximum over all rows (1 where that is null or zero). The maximum is a scalar subquery, no row is moved."""
    top = df.agg(F.max(column)).scalar()
    return df.withColumn(column, F.col(column) / F.when(top.isNull() | (top == 0), F.lit(1.0)).otherwise(top))


def graph_prior(candidates: DataFrame, nodes: DataFrame, edges: DataFrame, coupling: DataFrame | None = None, lineage: DataFrame | None = None) -> DataFrame:
    """id, score for every candidate: 0.6 * degree / greatest degree + 0.25 * the file's greatest coupling + 0.15 * the file's churn.

    Degree counts edges of all types in both directions, over the candidates only. The candidates' ids restrict the edges
    before they are counted, and counting is combined on the map side.
    """
    c = candidates.select("id").distinct()
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    deg = ends.join(c, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    d = c.join(deg, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("double").alias("deg"))
    d = normalised(d, "deg").join(nodes.select("id", "file_path"), "id", "left")
    if coupling is not None:
        both = coupling.select(F.explode(F.array("file_a", "file_b")).alias("file_path"), "coupling_score").groupBy("file_path").agg(F.max("coupling_score").alias("couple"))
        d = d.join(both, "file_path", "left")
    if lineage is not None:
        d = d.join(lineage.select("file_path", F.col("churn_score").alias("churn")), "file_path", "left")
    part = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name in d.columns else F.lit(0.0)
    return d.select("id", F.round(DEGREE * F.col("deg") + COUPLING * part("couple") + CHURN * part("churn"), 9).alias("score"))


#: Labels of a result's reason by score, the first bound exceeded counts.
REASONS = {
    "bm25": [(0.5, "high text relevance"), (0.1, "keyword match")],
    "semantic": [(0.5, "strong semantic match"), (0.2, "semantic similarity")],
    "graph": [(0.3, "highly connected")],
}
NO_REASON = "weak match"


def reason(**scores: Column) -> Column:
    """Which scores carried a result: the labels of the bounds they exceed."""
    labels = []
    for name, bounds in REASONS.items():
        c = F.lit(None).cast("string")
        for bound, label in reversed(bounds):
            c = F.when(scores[name] > bound, F.lit(label)).otherwise(c)
        labels.append(c)
    joined = F.concat_ws(" + ", *labels)
    return F.when(joined == "", NO_REASON).otherwise(joined)


def fuse(lexical: DataFrame, semantic: DataFrame, graph: DataFrame) -> DataFrame:
    """id, bm25, semantic, graph, score: candidates of the lexical side with their other scores, missing ones 0, lexical scores divided by their maximum."""
    j = normalised(lexical.select("id", F.col("score").alias("bm25")), "bm25")
    j = j.join(semantic.select("id", F.col("score").alias("semantic")), "id", "left").join(graph.select("id", F.col("score").alias("graph")), "id", "left").na.fill(0.0, ["semantic", "graph"])
    return j.withColumn("score", F.round(LEXICAL * F.col("bm25") + SEMANTIC * F.col("semantic") + GRAPH * F.col("graph"), 9))


def hydrate(fused: DataFrame, nodes: DataFrame, limit: int, kind: str | None = None) -> DataFrame:
    """The ``limit`` best results with their node's columns: of the best 2 * limit candidates those of the kind. Ties go to the smaller id."""
    best = fused.orderBy(F.col("score").desc(), "id").limit(2 * limit)
    n = nodes.select("id", "name", "fqn", "file_path", "kind", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("signature", F.lit("")).alias("signature"), F.substring(F.coalesce("docstring", F.lit("")), 1, 256).alias("docstring"))
    j = n.join(F.broadcast(best), "id")
    if kind:
        j = j.where(F.col("kind") == kind)
    r3 = {c: F.round(c, 3) for c in ("bm25", "semantic", "graph")}
    j = j.orderBy(F.col("score").desc(), "id").limit(limit)
    return j.select(F.col("id").alias("node_id"), "name", "fqn", "file_path", "kind", "start_line", "signature", "docstring", F.round("score", 4).alias("score"), F.struct(*[e.alias(c) for c, e in r3.items()]).alias("score_breakdown"), reason(**r3).alias("reason"))


def token_cost(df: DataFrame, docstring: bool = True) -> Column:
    """Tokens a node costs in a context, at most MAX_NODE_TOKENS."""
    t = shorten(node_text(F.col("kind"), F.col("fqn"), F.col("signature"), F.col("docstring") if docstring else None)) if docstring else node_text(F.col("kind"), F.col("fqn"), F.col("signature"))
    return F.least(approx_tokens(t), F.lit(MAX_NODE_TOKENS))


def best_by(df: DataFrame, key: str, score: str = "score", *ties: str) -> DataFrame:
    """Of each key the row with the greatest score, ties by the given columns."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), *ties)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")


def penalised(df: DataFrame, query: str) -> Column:
    """The score, times 0.3 for test nodes and else 0.85 for unexported ones, unless the query is about tests."""
    s = F.col("score")
    if any(w in query.lower() for w in TEST_WORDS):
        return s
    return F.when(F.coalesce("is_test", F.lit(False)), s * TEST_FACTOR).when(~F.coalesce("is_exported", F.lit(True)), s * HIDDEN_FACTOR).otherwise(s)


def pack(df: DataFrame, budget: int, cost: str, *order: Column) -> DataFrame:
    """The longest prefix in the given order whose summed cost stays within the budget.

    Every cost is at least 1, so at most ``budget`` rows can fit: only so many are ranked in one window, the rest is never
    moved there.
    """
    first = df.orderBy(*order).limit(max(budget, 0) + 1)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)
