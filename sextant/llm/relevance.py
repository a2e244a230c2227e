"""How distinctive a term is for a record: probabilistic relevance weights (BM25) of every term of every record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.skew import heavy_counts, skew_join
from sextant.session import keep

K1, B = 1.2, 0.75
#: A term within a text; a whole string that is a term.
RUN, TERM = "(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]{2,}", "^[A-Za-z_][A-Za-z0-9_]{2,}$"


def blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, r"^\s+", "") == "")


def newest_vectors(vectors: DataFrame) -> DataFrame:
    """node_id, counts: the newest readable-or-not vector of each node as a map; unreadable JSON is null.

    Ties of updated_at go to the greater JSON text, so that repeated rows don't matter. Null node ids are left out.
    """
    j = vectors.where(F.col("node_id").isNotNull()).groupBy(F.col("node_id").alias("vector_node")).agg(F.max(F.struct("updated_at", "vector_json")).alias("v"))
    text = F.col("v.vector_json")
    readable = F.get_json_object(text, "$").isNotNull()
    return j.select("vector_node", F.when(readable, F.from_json(text, "map<string,double>", {"mode": "PERMISSIVE"})).alias("counts"))


def term_postings(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """node_id, length, term, tf: the terms of each node and their counts; length is the node's number of terms with repeats.

    Terms are the lower-cased maximal runs of ``[A-Za-z0-9_]`` of at least three characters that don't begin with
    a digit, counted in the whole body_preview; where that is null or blank, those of the newest vector_json. A node
    with neither has no rows. Counts of a vector that are null or not positive are ignored; keys that differ in case only are added up.

    The texts are spread by node id, then tokenised and counted where they lie, so that no posting is shuffled before it is
    counted. Only nodes without a body are joined with their vectors.
    """
    n = nodes.where(F.col("id").isNotNull()).select(F.col("id").alias("node_id"), "body_preview")
    text = n.where(~blank(F.col("body_preview"))).repartition("node_id").select("node_id", F.regexp_extract_all("body_preview", F.lit(RUN), F.lit(0)).alias("words"))
    # explode_outer: explode would have the optimizer infer a filter that finds the terms of every text a second time
    text = text.select("node_id", F.size("words").cast("double").alias("length"), F.explode_outer("words").alias("w")).where(F.col("w").isNotNull())
    text = text.groupBy("node_id", "length", F.lower("w").alias("term")).agg(F.count(F.lit(1)).cast("double").alias("tf"))
    bare = n.where(blank(F.col("body_preview"))).select("node_id")
    vec = bare.join(newest_vectors(vectors), F.col("node_id") == F.col("vector_node")).select("node_id", F.explode("counts").alias("w", "n")).where(F.col("w").rlike(TERM) & (F.col("n") > 0))
    vec = vec.groupBy("node_id", F.lower("w").alias("term")).agg(F.sum("n").alias("tf"))
    vec = vec.select("node_id", F.sum("tf").over(Window.partitionBy("node_id")).alias("length"), "term", "tf")
    return text.unionByName(vec)


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _saturation(tf: Column, length: Column, avg: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))


def bm25_weights(postings: DataFrame, k1: float = K1, b: float = B, least: tuple[int, int] | None = None) -> DataFrame:
    """node_id, term, tf, df, weight for every posting.

    weight = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length)), where df is the
    number of nodes with the term and N the number of nodes with any term. Statistics are over all nodes, computed here.
    Frequent terms are joined in salted parts. With ``least`` = (tf, df) only postings with at least the weight that a term
    with that tf and df has in the same record: one with a greater tf and a smaller df never weighs less.

    The postings are written once, so that no text is read for its terms twice.
    """
    postings = keep(postings)
    df = keep(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    docs = postings.select("node_id", "length").distinct()
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("a")).first()
    n, avg = F.lit(stats["n"]), F.lit(float(stats["a"] or 1.0))
    heavy = heavy_counts(df.select("term", F.col("df").alias("__n")), ["term"])
    if least is not None:
        # a necessary condition that needs no join; the weights decide below
        postings = postings.where(F.col("tf") >= least[0])
    j = skew_join(postings, df, ["term"], heavy=heavy)
    weight = _idf(n, F.col("df")) * _saturation(F.col("tf"), F.col("length"), avg, k1, b)
    out = j.withColumn("weight", weight)
    if least is not None:
        bound = _idf(n, F.lit(least[1])) * _saturation(F.lit(float(least[0])), F.col("length"), avg, k1, b)
        out = out.where(F.col("weight") >= bound * (1 - 1e-9))
    return out.select("node_id", "term", "tf", "df", "weight")


def marking_terms(nodes: DataFrame, vectors: DataFrame, min_tf: int = 3, max_df: int = 5) -> DataFrame:
    """The terms that mark few nodes strongly: node_id, term, tf, df, weight of postings with tf >= min_tf and df <= max_df.

    Every such posting weighs at least what (min_tf, max_df) weighs in its node, so the weight chooses the postings; among them are some
    with a greater df and a much greater tf, which the exact check of tf and df takes out.
    """
    strong = bm25_weights(term_postings(nodes, vectors), least=(min_tf, max_df))
    return strong.where((F.col("tf") >= min_tf) & (F.col("df") <= max_df))
