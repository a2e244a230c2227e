"""References to records that do not exist when they are made.

Distinct non-null foreign keys are anti-joined with the parent keys and their times of life; the few keys that
fail are joined back to the rows, which are then anti-joined with the times of life one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.paths import canonical_path, module_candidates, relative_base
from sextant.operators.skew import heavy_counts, skew_join
from sextant.session import cut, keep

#: Parts in which the lives of one key are merged first, so that a key with very many lives loads no single task.
MERGE_PARTS = 16
#: A key with fewer lives than this is never taken for a crowded one.
FEW_LIVES = 64


def merge_lives(df: DataFrame, keys: list[str], parts: int = MERGE_PARTS) -> DataFrame:
    """Lives [born, died) of each key, merged until they are disjoint; null died means still alive.

    Lives that are empty or have a null born are dropped. Merged in two rounds, the first within hashed parts of a key.
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp")

    def once(d: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("born", "died")
        before = F.max("died").over(w.rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("__new", F.when(before.isNull() | (F.col("born") > before), 1).otherwise(0))
        d = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return d.groupBy(*by, "__run").agg(F.min("born").alias("born"), F.max("died").alias("died")).drop("__run")

    d = df.select(*keys, "born", F.coalesce("died", far).alias("died")).where(F.col("born").isNotNull() & (F.col("born") < F.col("died"))).distinct()
    d = once(d.withColumn("__p", F.pmod(F.xxhash64("born", "died"), F.lit(parts))), [*keys, "__p"]).drop("__p")
    d = once(d, keys)
    return d.select(*keys, "born", F.when(F.col("died") < far, F.col("died")).alias("died"))


def _days(start: Column, end: Column) -> Column:
    return F.sequence(F.datediff(start, F.lit("1970-01-01")), F.datediff(end, F.lit("1970-01-01")))


def _orphans_of_crowded(refs: DataFrame, lives: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of ``refs`` without a life at their time, for keys with very many lives: these are merged, then key and day are the key of the join.

    So no task has more than the lives of one key on one day. A row without a time has a life, as its key has some.
    """
    span = refs.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    timed = refs.where(F.col(at).isNotNull())
    if span["a"] is None:
        return timed
    first, last = F.lit(span["a"]), F.lit(span["b"])
    l = merge_lives(lives, keys).where((F.col("born") <= last) & (F.col("died").isNull() | (F.col("died") > first)))
    l = l.withColumn("__day", F.explode(_days(F.greatest("born", first), F.least(F.coalesce("died", last), last)))).withColumnsRenamed({"born": "__born", "died": "__died"})
    alive = lambda r, x: (x["__born"] <= r[at]) & (x["__died"].isNull() | (x["__died"] > r[at]))
    return skew_join(timed.withColumn("__day", F.datediff(at, F.lit("1970-01-01"))), l, [*keys, "__day"], "left_anti", condition=alive).drop("__day")


def orphan_references(refs: DataFrame, parents: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of ``refs`` whose key was not live in ``parents`` at the time ``at``.

    ``parents`` has the keys and the lives: born (inclusive), died (exclusive, null: never); a key may have several.
    Rows with a null in a key refer to nothing and are no cases. A null ``at`` can't be placed in time: such a row is
    a case only if its key has no life at all. Repeated rows are cases each. All columns of ``refs`` are kept.

    The distinct keys, the heavy ones and those that fail are written to the checkpoint folder, so that none is worked out twice. Keys that hold a large part of
    the lives go a way of their own, on which lives are divided by day.
    """
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    refs = refs.where(present)
    parents = parents.select(*keys, "born", "died").where(present & F.col("born").isNotNull())
    # one aggregation gives the keys with their times and the heavy ones among them
    fk = keep(refs.groupBy(*keys).agg(F.min(at).alias("__first"), F.max(at).alias("__last"), F.count(F.lit(1)).alias("__n")))
    heavy = cut(heavy_counts(fk.select(*keys, "__n"), keys))
    lives_of = keep(parents.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= FEW_LIVES))
    crowded = cut(heavy_counts(lives_of, keys).select(*keys))
    apart = not crowded.isEmpty()
    some = parents.join(F.broadcast(crowded), keys, "left_anti") if apart else parents
    same = lambda a, b, names: reduce(lambda x, y: x & y, [a[k] == b[n] for k, n in zip(keys, names)])
    pk = [f"__p{i}" for i in range(len(keys))]
    p = some.select(*[F.col(k).alias(n) for k, n in zip(keys, pk)], F.col("born").alias("__born"), F.col("died").alias("__died"))
    whole = (p["__born"] <= fk["__first"]) & (p["__died"].isNull() | (p["__died"] > fk["__last"]))
    suspects = cut(fk.join(p, same(fk, p, pk) & (fk["__first"].isNull() | whole), "left_anti").select(*keys))
    rows = skew_join(refs, suspects, keys, "left_semi", heavy=heavy)
    alive = lambda l, r: l[at].isNull() | ((r["__born"] <= l[at]) & (r["__died"].isNull() | (r["__died"] > l[at])))
    lives = some.select(*keys, F.col("born").alias("__born"), F.col("died").alias("__died"))
    if not apart:
        return skew_join(rows, lives, keys, "left_anti", condition=alive, heavy=heavy)
    hot = F.broadcast(crowded)
    out = skew_join(rows.join(hot, keys, "left_anti"), lives, keys, "left_anti", condition=alive, heavy=heavy)
    return out.unionByName(_orphans_of_crowded(refs.join(hot, keys, "left_semi"), parents.join(hot, keys, "left_semi"), keys, at).select(*out.columns))


def node_lives(nodes: DataFrame, library: DataFrame) -> DataFrame:
    """Lives of nodes and library nodes: id, fqn, repo, born, died. Library nodes never die."""
    a = nodes.select("id", "fqn", F.col("repo_alias").alias("repo"), F.col("indexed_at").alias("born"), F.col("deleted_at").alias("died"))
    b = library.select("id", "fqn", F.col("repo_alias").alias("repo"), F.col("indexed_at").alias("born"), F.lit(None).cast("timestamp").alias("died"))
    return a.unionByName(b)


def module_lives(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Lives of what an import can name: key, born, died.

    Keys ``m:<module>`` for absolute targets (known modules, modules of .py files and symbols in them) and
    ``p:<path>`` for the full paths that relative targets resolve to. Known modules live always.
    """
    n = nodes.where(F.col("file_path").endswith(".py")).select(F.col("file_path"), "name", F.col("indexed_at").alias("born"), F.col("deleted_at").alias("died"))
    path = F.regexp_replace("file_path", r"\.py$", "")
    files = merge_lives(n, ["file_path"])
    named = n.where(F.col("name").isNotNull())
    at_file = files.select(F.explode(F.concat(F.transform(module_candidates(F.col("file_path")), lambda m: F.concat(F.lit("m:"), m)), F.array(F.concat(F.lit("p:"), path)))).alias("key"), "born", "died")
    at_name = named.select(F.explode(F.concat(F.transform(module_candidates(F.col("file_path")), lambda m: F.concat(F.lit("m:"), m, F.lit("."), F.col("name"))), F.array(F.concat(F.lit("p:"), path, F.lit("/"), F.col("name"))))).alias("key"), "born", "died")
    always = known.where(F.col("module").isNotNull()).select(F.concat(F.lit("m:"), "module").alias("key"), F.lit("0001-01-01 00:00:00").cast("timestamp").alias("born"), F.lit(None).cast("timestamp").alias("died"))
    return merge_lives(at_file.unionByName(at_name).unionByName(always), ["key"])


def import_key(target: str = "target_module", source: str = "source_file"):
    """The key of an import target among ``module_lives``: relative targets by their full path, all others as they are."""
    return F.when(F.col(target).startswith("."), F.concat(F.lit("p:"), F.coalesce(relative_base(F.col(target), canonical_path(F.col(source))), F.lit("\u0000above the root")))).otherwise(F.concat(F.lit("m:"), F.col(target)))


def orphan_report(edges: DataFrame, lsp: DataFrame, cross: DataFrame, imports: DataFrame, nodes: DataFrame, library: DataFrame, known: DataFrame) -> DataFrame:
    """Orphan references of all four tables: table_name, period (YYYY-MM), ref_id. One row per orphan row."""
    lives = node_lives(nodes, library)
    parts = [
        ("edges", edges.select("id", F.col("target_id").alias("k"), "recorded_at"), lives.select(F.col("id").alias("k"), "born", "died"), ["k"]),
        ("lsp_edges", lsp.select("id", canonical_path(F.col("target_fqn")).alias("k"), "recorded_at"), lives.select(F.col("fqn").alias("k"), "born", "died"), ["k"]),
        ("cross_repo_edges", cross.select("id", canonical_path(F.col("target_fqn")).alias("k"), F.col("target_repo").alias("repo"), "recorded_at"), lives.select(F.col("fqn").alias("k"), "repo", "born", "died"), ["k", "repo"]),
        ("import_refs", imports.select("id", import_key().alias("k"), "recorded_at"), cut(module_lives(nodes, known)).withColumnRenamed("key", "k"), ["k"]),
    ]
    out = None
    for name, refs, parents, keys in parts:
        one = orphan_references(refs, parents, keys, "recorded_at").select(F.lit(name).alias("table_name"), F.date_format("recorded_at", "yyyy-MM").alias("period"), F.col("id").alias("ref_id"))
        out = one if out is None else out.unionByName(one)
    return out


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table and period: table_name, period, orphans."""
    return orphans.groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("orphans"))
