"""Per-key results where a few keys hold most rows: aggregation before the join.

Both inputs of a join are reduced to one compact state per join key before they meet. The states hold what is
needed to compute the aggregates of the joined rows algebraically: with n and m rows of a key on the two
sides, the join has n * m rows of that key, and a column of the left sums to its own sum times m. The reduction is combined on the
map side, so a key with a third of all rows sends one row per map task, and no joined row is ever made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def key_state(df: DataFrame, key: str, sums: dict[str, str] | None = None, prefix: str = "", name: str | None = None) -> DataFrame:
    """One row per non-null value of ``key``: ``{prefix}n`` rows and, for ``sums`` {name: column}, the sums.

    Sums skip nulls and are 0 for keys whose values are all null. Columns of ``df`` not named are ignored.
    """
    aggs = [F.count(F.lit(1)).alias(f"{prefix}n")]
    aggs += [F.coalesce(F.sum(F.col(c)), F.lit(0)).alias(f"{prefix}{n}") for n, c in (sums or {}).items()]
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(name or key)).agg(*aggs)


def eager_join_aggregate(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_sums: dict[str, str] | None = None, right_sums: dict[str, str] | None = None, outer: bool = False) -> DataFrame:
    """Aggregates of ``left JOIN right ON left_key = right_key`` per key, without making the joined rows.

    Columns: ``key``, ``left_n`` and ``right_n`` (rows of the key on each side), ``pairs`` (joined rows,
    decimal so that it can't overflow), ``sum_<name>`` of every named column over the joined rows.
    Null keys join nothing and are left out. With ``outer`` keys of one side only come out too, with 0 for the other side.
    An empty side gives no rows, or with ``outer`` the other side's keys. Repeated rows count each.
    """
    a = key_state(left, left_key, left_sums, "left_", "key")
    b = key_state(right, right_key, right_sums, "right_", "key")
    j = a.join(b, "key", "full_outer" if outer else "inner").na.fill(0)
    pairs = (F.col("left_n").cast(WIDE) * F.col("right_n")).cast(WIDE)
    return j.select(
        "key", "left_n", "right_n", pairs.alias("pairs"),
        *[(F.col(f"left_{n}") * F.col("right_n")).alias(f"sum_{n}") for n in left_sums or {}],
        *[(F.col(f"right_{n}") * F.col("left_n")).alias(f"sum_{n}") for n in right_sums or {}],
    )


def endpoint_profile(edges: DataFrame) -> DataFrame:
    """For every value of ``source_id`` or ``target_id``: node_id, out_rows, in_rows and wedges.

    The join of edges with itself (target = next source) is aggregated eagerly: wedges is the number of
    two-step paths through the node, in_rows * out_rows. Null endpoints are no nodes. Repeated edges count each.
    """
    j = eager_join_aggregate(edges, edges, "source_id", "target_id", outer=True)
    return j.select(F.col("key").alias("node_id"), F.col("left_n").alias("out_rows"), F.col("right_n").alias("in_rows"), F.col("pairs").alias("wedges"))


def crowded_endpoints(edges: DataFrame, percent: int = 2) -> DataFrame:
    """The endpoint values that stand in at least ``percent`` % of all rows of ``edges``: endpoint, node_id.

    Rows with a null endpoint count among all rows but are never a case. An empty table has no cases.
    """
    total = edges.select(F.lit(1).alias("one")).agg(F.count("one")).scalar()
    sides = endpoint_profile(edges).select(
        F.inline(F.array(
            F.struct(F.lit("source_id").alias("endpoint"), F.col("node_id"), F.col("out_rows").alias("n")),
            F.struct(F.lit("target_id").alias("endpoint"), F.col("node_id"), F.col("in_rows").alias("n")),
        ))
    )
    return sides.where((F.col("n") > 0) & (F.col("n") * 100 >= total * percent)).select("endpoint", "node_id")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every node: node_id, in_rows, out_rows, callers, callees, wedges.

    callers and callees are distinct other ends. The pairs are made distinct first, spread over both ends, so that even a node with a third of
    all edges loads no task; then each side is reduced to a state per node and the states are joined. Nodes without edges
    have zeros. A repeated id of ``nodes`` counts once, a null id never.
    """
    pairs = edges.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).select("source_id", "target_id").distinct()
    callees = key_state(pairs, "source_id", prefix="callees_", name="node_id")
    callers = key_state(pairs, "target_id", prefix="callers_", name="node_id")
    ids = nodes.where(F.col("id").isNotNull()).select(F.col("id").alias("node_id")).distinct()
    j = ids.join(endpoint_profile(edges), "node_id", "left").join(callers, "node_id", "left").join(callees, "node_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("node_id", zero("in_rows").alias("in_rows"), zero("out_rows").alias("out_rows"), zero("callers_n").alias("callers"), zero("callees_n").alias("callees"), zero("wedges").cast(WIDE).alias("wedges"))


def rollup_by(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges rolled up by columns of their end nodes: ``by``, nodes, in_rows, out_rows, top_in.

    The edges are reduced to one state per node before they meet ``nodes`` (whose id is unique), the joined states are summed. Groups with null values
    are kept as groups. Endpoints that are no nodes are not counted.
    """
    n = nodes.where(F.col("id").isNotNull()).select(F.col("id").alias("node_id"), *by)
    j = n.join(endpoint_profile(edges), "node_id", "left")
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.coalesce(F.sum("in_rows"), F.lit(0)).alias("in_rows"),
        F.coalesce(F.sum("out_rows"), F.lit(0)).alias("out_rows"),
        F.coalesce(F.max("in_rows"), F.lit(0)).alias("top_in"),
    )
