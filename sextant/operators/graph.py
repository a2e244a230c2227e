"""Graph operators: expansion, impact, reachability, paths, edge resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.paths import module_candidates
from sextant.operators.skew import HEAVY_SHARE, heavy_keys, skew_join
from sextant.session import cut, keep

MIN_CONFIDENCE, MAX_FANOUT = 0.75, 40


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges that differ in source, target, type or call site line, each once, with its smallest id, greatest confidence and first time."""
    aggs = [F.min("id").alias("id")] if "id" in edges.columns else []
    aggs += [F.max("confidence").alias("confidence")] if "confidence" in edges.columns else []
    return edges.groupBy("source_id", "target_id", "type", "call_site_line").agg(*aggs) if aggs else edges.select("source_id", "target_id", "type", "call_site_line").distinct()


def degree(edges: DataFrame) -> DataFrame:
    """id, degree: edges of all types at each node, both directions."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def expand_neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 2, confidence: float = MIN_CONFIDENCE, fanout: int = MAX_FANOUT) -> DataFrame:
    """id, role, hop: callers and callees within ``depth`` hops of the seeds (id), the seeds left out.

    Only CALLS with enough confidence are followed, and only from nodes with at most ``fanout`` CALLS in that direction (all of
    them counted). The first discovery gives the role; within a hop callee comes before caller. Every level is written to the
    checkpoint folder; the frontier is joined by the optimizer's choice of strategy, so that neither a small nor a large one is forced into a broadcast.
    """
    calls = edges.where(F.col("type") == "CALLS").select("source_id", "target_id", "confidence")
    good = calls.where(F.col("confidence") >= confidence).select("source_id", "target_id").distinct()

    def from_quiet(end: str) -> DataFrame:
        n = calls.where(F.col(end).isNotNull()).groupBy(end).agg(F.count(F.lit(1)).alias("n"))
        # hubs with 1 % of all rows or more, at most 100, go before the join, so that it has no crowded key left
        hubs = n.where((F.col("n") > fanout) & (F.col("n") >= n.agg(F.sum("n")).scalar() * HEAVY_SHARE)).select(end)
        return good.join(F.broadcast(hubs), end, "left_anti").join(n.where(F.col("n") <= fanout).select(end), end, "left_semi")

    fwd, back = from_quiet("source_id"), from_quiet("target_id")
    seen = cut(seeds.select("id").distinct().select("id", F.lit("seed").alias("role"), F.lit(0).alias("hop")))
    front = seen.select("id")
    for hop in range(1, depth + 1):
        found = fwd.join(front, F.col("source_id") == F.col("id"), "left_semi").select(F.col("target_id").alias("id"), F.lit("callee").alias("role"))
        found = found.unionByName(back.join(front, F.col("target_id") == F.col("id"), "left_semi").select(F.col("source_id").alias("id"), F.lit("caller").alias("role")))
        new = found.groupBy("id").agg(F.min("role").alias("r")).join(seen, "id", "left_anti")
        new = cut(new.select("id", F.when(F.col("r") == "callee", "callee").otherwise("caller").alias("role"), F.lit(hop).alias("hop")))
        seen, front = seen.unionByName(new), new.select("id")
    return seen.where(F.col("hop") > 0)


def find_root(nodes: DataFrame, fqn: str) -> DataFrame:
    """id, fqn of the node with the FQN, else of the one with the smallest id whose name is what follows the last ``::``."""
    rank = F.when(F.col("fqn") == fqn, 0).when(F.col("name") == fqn.split("::")[-1], 1)
    return nodes.select("id", "fqn", rank.alias("r")).where(F.col("r").isNotNull()).orderBy("r", "id").limit(1).select("id", "fqn")


def impact(nodes: DataFrame, edges: DataFrame, fqn: str, depth: int = 5, cross: DataFrame | None = None) -> DataFrame:
    """fqn, file_path, kind, depth, edge_type, target_fqn: all that depends on a symbol, transitively, over edges of all types.

    target_fqn is the node through which the dependent was first found: the one with the smallest edge id. With ``cross``, edges
    between repositories (source_fqn, source_repo, target_fqn, type) are followed too, by FQN; their sources that are no nodes end there. Dangling edges are not followed.
    """
    n = nodes.select("id", "fqn", "file_path", "kind")
    e = edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.col("type").alias("edge_type"), F.col("id").alias("edge"))
    # the most referenced targets are divided, whatever the size of a level
    crowded = cut(heavy_keys(e, ["t"]))
    root = cut(find_root(nodes, fqn))
    seen = root.select("fqn", "id")
    front = seen.select(F.col("id").alias("t"), F.col("fqn").alias("target_fqn"))
    out = None
    for d in range(1, depth + 1):
        hits = skew_join(e, front, ["t"], heavy=crowded).join(n, F.col("s") == F.col("id")).select("fqn", "id", "file_path", "kind", "edge_type", "target_fqn", "edge", F.lit(0).alias("far"))
        if cross is not None:
            x = cross.select(F.col("source_fqn").alias("fqn"), F.col("source_repo").alias("file_path"), F.col("target_fqn").alias("xt"), F.col("type").alias("edge_type"), F.col("id").alias("edge"))
            x = x.join(front, F.col("xt") == F.col("target_fqn")).join(n.select(F.col("fqn").alias("nf"), F.col("id")), F.col("fqn") == F.col("nf"), "left")
            hits = hits.unionByName(x.select("fqn", "id", "file_path", F.lit("function").alias("kind"), "edge_type", "target_fqn", "edge", F.lit(1).alias("far")))
        # the first discovery is a minimum, combined on the map side: a caller with very many edges loads no single task
        new = hits.join(seen.select("fqn"), "fqn", "left_anti").groupBy("fqn").agg(F.min(F.struct("far", "edge", "id", "file_path", "kind", "edge_type", "target_fqn")).alias("m"))
        new = cut(new.select("fqn", "m.id", "m.file_path", "m.kind", F.lit(d).alias("depth"), "m.edge_type", "m.target_fqn"))
        out = new if out is None else out.unionByName(new)
        seen, front = seen.unionByName(new.select("fqn", "id")), new.select(F.col("id").alias("t"), F.col("fqn").alias("target_fqn"))
    if out is None:
        return root.select("fqn", F.lit("").alias("file_path"), F.lit("").alias("kind"), F.lit(0).alias("depth"), F.lit("").alias("edge_type"), F.lit("").alias("target_fqn")).where(F.lit(False))
    return out.drop("id")


def reachable(pairs: DataFrame, start: DataFrame, hops: int = 10) -> DataFrame:
    """id, hop: nodes reachable from the start (id) over pairs (source_id, target_id) within ``hops``, with the least number of hops; the start has 0.

    Stops early when a level finds nothing new; the distinct pairs are written once, and each level is written to the checkpoint folder and anti-joined with what was seen.
    """
    p = keep(pairs.select("source_id", "target_id").where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).distinct())
    seen = cut(start.select("id").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for h in range(1, hops + 1):
        new = p.join(front.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).where(F.col("id").isNotNull()).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(h))
        front = cut(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def call_paths(nodes: DataFrame, edges: DataFrame, start_fqn: str, end_fqn: str, max_paths: int = 3, max_nodes: int = 10) -> DataFrame:
    """path_no, path: the first ``max_paths`` simple paths of CALLS from one symbol to another with at most ``max_nodes`` nodes, shorter ones first, then by their FQNs.

    The distance of every node to the end is found first. Paths are then grown one length at a time, through nodes that can still reach the
    end in time only, and growing stops with the length at which enough paths are complete. Of the shortest paths only the first ``max_paths`` ways to each node are kept at
    every step: no node can be met twice on them, so what follows is the same for all ways to a node, and their number doesn't grow with the steps.
    """
    spark = nodes.sparkSession
    empty = spark.createDataFrame([], "path_no int, path array<string>")
    calls = keep(edges.where(F.col("type") == "CALLS").select("source_id", "target_id").where(F.col("source_id") != F.col("target_id")).distinct())
    ends = nodes.where(F.col("fqn").isin(start_fqn, end_fqn)).select("id", "fqn").collect()
    ids = {r.fqn: r.id for r in ends}
    if start_fqn not in ids or end_fqn not in ids:
        return empty
    a, b = ids[start_fqn], ids[end_fqn]
    to_end = reachable(calls.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), spark.createDataFrame([(b,)], "id long"), max_nodes - 1)
    near = to_end.where(F.col("id") == a).select("hop").first()
    if near is None:
        return empty
    step = cut(calls.join(to_end.select(F.col("id").alias("target_id"), F.col("hop").alias("left")), "target_id").join(nodes.select(F.col("id").alias("target_id"), F.col("fqn").alias("next_fqn")), "target_id", "left"))
    found, done = None, 0
    for length in range(near.hop, max_nodes):
        p = spark.createDataFrame([(a, [a], [start_fqn])], "at long, ids array<long>, path array<string>")
        for i in range(1, length + 1):
            grown = p.join(step, F.col("at") == F.col("source_id")).where((F.col("left") <= length - i) & ~F.array_contains("ids", F.col("target_id")) & ((F.col("target_id") != b) | F.lit(i == length)))
            p = grown.select(F.col("target_id").alias("at"), F.concat("ids", F.array("target_id")).alias("ids"), F.concat("path", F.array(F.coalesce("next_fqn", F.col("target_id").cast("string")))).alias("path"))
            if length == near.hop and i < length:
                p = first_of(p, "at", max_paths, "path")
        p = cut(p.where(F.col("at") == b).select(F.lit(length).alias("length"), "path").distinct().orderBy("path").limit(max_paths))
        found = p if found is None else found.unionByName(p)
        done += p.count()
        if done >= max_paths:
            break
    w = Window.orderBy("length", "path")
    return found.orderBy("length", "path").limit(max_paths).withColumn("path_no", F.row_number().over(w)).select("path_no", "path")


def resolve_edges(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id, target_id, type, call_site_line, confidence of references by name: source_fqn, target (an FQN or a name), type, call_site_line, confidence.

    A target is the node with that FQN, else the one with that name and the smallest id; unresolved ones, unknown sources and self-loops are dropped.
    Equal edges come out once. Names that very many references share are joined in salted parts.
    """
    by_fqn = nodes.select(F.col("fqn").alias("target"), F.col("id").alias("fqn_id"))
    by_name = nodes.where(F.col("name").isNotNull()).groupBy(F.col("name").alias("target")).agg(F.min("id").alias("name_id"))
    c = calls.select("source_fqn", "target", "type", "call_site_line", "confidence").join(nodes.select(F.col("fqn").alias("source_fqn"), F.col("id").alias("source_id")), "source_fqn").drop("source_fqn")
    c = skew_join(skew_join(c, by_fqn, ["target"], "left"), by_name, ["target"], "left")
    c = c.withColumn("target_id", F.coalesce("fqn_id", "name_id")).where(F.col("target_id").isNotNull() & (F.col("target_id") != F.col("source_id")))
    return c.select("source_id", "target_id", "type", "call_site_line", "confidence").distinct()


def import_references(calls: DataFrame) -> DataFrame:
    """source_file, target_module, call_site_line: IMPORTS as written, whether or not they resolve."""
    return calls.where(F.col("type") == "IMPORTS").select(F.substring_index("source_fqn", "::", 1).alias("source_file"), F.col("target").alias("target_module"), "call_site_line").distinct()


def file_modules(files: DataFrame) -> DataFrame:
    """file_path, module: every module name a file can be imported by."""
    return files.select("file_path", F.explode(module_candidates(F.col("file_path"))).alias("module"))


def importer_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file_path: files with an import of any of the given files (file_path), those left out."""
    f = files.select("file_path").distinct()
    hits = imports.join(file_modules(f).select(F.col("module").alias("target_module")).distinct(), "target_module", "left_semi").select(F.col("source_file").alias("file_path")).distinct()
    return hits.join(f, "file_path", "left_anti")


def first_of(df: DataFrame, by: str, n: int, *order: str | Column) -> DataFrame:
    """Of each group the first ``n`` rows in the given order."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
