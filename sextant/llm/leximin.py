"""One ranking from several scores on unlike scales: leximin order of percentiles.

Each score is replaced by its percentile among the results of the same query; each item's percentiles are sorted
ascending and the vectors are compared from their weakest entry on, so that no score decides by its range
and no strong score hides a weak one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.skew import HEAVY_SHARE
from sextant.session import cut, keep

#: Ranges into which the values of a very large group are divided for ranking.
RANK_PARTS = 64


def percentiles(long: DataFrame, group: list[str], value: str, parts: int = RANK_PARTS) -> DataFrame:
    """``long`` with ``pct``: the share of the group's other rows that are below the value, ties counted half.

    Nulls and NaN are equal to each other and below all values. A group of one row has 1.0. Rows with a null in ``group`` form a group too.

    A group is ranked in one window. Where groups hold 1 % of all rows or more (at most 100 can), they are divided at approximate quantiles into
    ``parts`` ranges of values that are ranked apart and shifted by the counts of the ranges below; the quantiles only divide the work, the ranks are
    exact. A value with 1 % of all rows or more (at most 100) takes part as one weighted row, and its rank is given to its rows afterwards. What is
    broadcast has at most 100 * ``parts`` rows.
    """
    present = F.col(value).isNotNull() & ~F.isnan(value)
    d = long.withColumn("__ok", present).withColumn("__v", F.when(present, F.col(value) + F.lit(0.0)).otherwise(F.lit(0.0))).withColumn("__w", F.lit(1).cast("long"))
    sizes = d.groupBy(*group).agg(F.count(F.lit(1)).alias("__size"))
    big = cut(sizes.where(F.col("__size") >= sizes.agg(F.sum("__size")).scalar() * HEAVY_SHARE))
    key = [*group, "__ok", "__v"]
    d = d.withColumn("__hot", F.lit(False)).withColumn("__part", F.lit(0))
    hot = None
    if not big.isEmpty():
        total = sizes.agg(F.sum("__size")).scalar()
        counts = cut(_null_safe(d, big.select(*group), group, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("__n")))
        hot = cut(counts.where(F.col("__n") >= F.greatest(F.lit(2), total * HEAVY_SHARE)))
        bounds = cut(counts.groupBy(*group).agg(F.percentile_approx(F.when(F.col("__ok"), F.col("__v")), [i / parts for i in range(1, parts)], 1000).alias("__bounds")))
        light = _null_safe(d, hot.select(*key), key, "left_anti")
        weighted = hot.select(*key, F.col("__n").alias("__w"), F.lit(True).alias("__hot"), F.lit(0).alias("__part"))
        d2 = light.unionByName(weighted, allowMissingColumns=True)
        d2 = _null_safe(d2, bounds, group, "left")
        d2 = d2.withColumn("__part", F.when(F.col("__ok") & F.col("__bounds").isNotNull(), F.size(F.filter("__bounds", lambda b: b < F.col("__v")))).otherwise(0)).drop("__bounds")
    else:
        d2 = d
    at = Window.partitionBy(*group, "__part")
    r = d2.withColumn("__below", F.sum("__w").over(at.orderBy("__ok", "__v"))).withColumn("__ties", F.sum("__w").over(Window.partitionBy(*group, "__part", "__ok", "__v")))
    r = r.withColumn("__below", F.col("__below") - F.col("__ties")).withColumn("__all", F.sum("__w").over(at))
    if hot is not None:
        big_part = _null_safe(d2, big, group, "inner").groupBy(*group, "__part", "__size").agg(F.sum("__w").alias("__m"))
        up = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        shift = cut(big_part.select(*group, "__part", "__size", F.coalesce(F.sum("__m").over(up), F.lit(0)).alias("__shift")))
        r = _null_safe(r, shift, [*group, "__part"], "left").withColumn("__below", F.col("__below") + F.coalesce("__shift", F.lit(0))).withColumn("__all", F.coalesce("__size", "__all")).drop("__shift", "__size")
        ranks = cut(r.where("__hot").select(*key, "__below", "__ties", "__all"))
        heavy = _null_safe(d.drop("__hot", "__part", "__w"), ranks, key, "inner")
        r = r.where(~F.col("__hot")).drop("__hot", "__part", "__w").unionByName(heavy)
    pct = F.when(F.col("__all") <= 1, F.lit(1.0)).otherwise((F.col("__below") + (F.col("__ties") - 1) / F.lit(2.0)) / (F.col("__all") - 1))
    return r.withColumn("pct", pct).select(*long.columns, "pct")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys in which null equals null, with the left's keys kept."""
    names = {k: f"__k_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    on = [left[k].eqNullSafe(F.col(n)) for k, n in names.items()]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(F.broadcast(renamed), cond, how).drop(*names.values())


def whole_ranks(standing: DataFrame) -> DataFrame:
    """``standing`` (q, i, standing) with ``rank``, the place of every item in its query's order.

    The rows are divided into ranges of that order, over all queries at once, and written; ranks are taken within ranges, and shifted by the
    sizes of the ranges before. So a query with most of the rows is ranked by many tasks. A range begins in the middle of at most one query, so
    the shifts are at most as many as the ranges, and are broadcast.
    """
    order = [F.col("standing").desc(), F.col("i")]
    d = keep(standing.repartitionByRange("q", *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy("q").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = d.groupBy("q", "__range").agg(F.count(F.lit(1)).alias("n")).withColumn("__shift", F.sum("n").over(before)).where(F.col("__shift").isNotNull()).drop("n")
    here = F.row_number().over(Window.partitionBy("q", "__range").orderBy(*order))
    out = d.withColumn("__here", here).join(F.broadcast(shift), ["q", "__range"], "left")
    return out.select("q", "i", "standing", (F.col("__here") + F.coalesce("__shift", F.lit(0))).cast("int").alias("rank"))


def leximin_rank(results: DataFrame, query: str, item: str, scores: dict[str, Column], k: int | None) -> DataFrame:
    """The ``k`` items of each query that stand highest in leximin order, or with None all items: query, item, rank, standing.

    ``scores`` names the score columns; higher is better, a null score is below all others. Rows of the same item count once, with
    each score's greatest value. Rows with a null query or item are left out. Ties in all scores go to the smaller item. ``standing`` is the
    ascending vector of percentiles. An empty table gives no rows; other columns of the table are ignored.
    """
    names = list(scores)
    d = results.select(F.col(query).alias("q"), F.col(item).alias("i"), *[F.when(~F.isnan(c), c).alias(f"s_{n}") for n, c in scores.items()])
    d = d.where(F.col("q").isNotNull() & F.col("i").isNotNull()).groupBy("q", "i").agg(*[F.max(f"s_{n}").alias(f"s_{n}") for n in names])
    long = d.select("q", "i", F.inline(F.array(*[F.struct(F.lit(n).alias("score_name"), F.col(f"s_{n}").alias("value")) for n in names])))
    p = percentiles(long, ["q", "score_name"], "value")
    standing = p.groupBy("q", "i").agg(F.sort_array(F.collect_list("pct")).alias("standing"))
    if k is None:
        return whole_ranks(standing).select(F.col("q").alias(query), F.col("i").alias(item), "rank", "standing")
    w = Window.partitionBy("q").orderBy(F.col("standing").desc(), F.col("i"))
    top = standing.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("q").alias(query), F.col("i").alias(item), "rank", "standing")


def search_ranking(results: DataFrame, k: int | None = 5) -> DataFrame:
    """Leximin ranking of search results by the three scores of ``score_breakdown``. A null struct is three null scores."""
    s = {n: F.col(f"score_breakdown.{n}").cast("double") for n in ("bm25", "semantic", "graph")}
    return leximin_rank(results, "query_id", "node_id", s, k)
