"""Change coupling and lineage of files, from commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SHARED = 4
#: The files of a commit with more than this are divided into blocks, and every two blocks are a key of their own.
BLOCK = 1000


def file_counts(commits: DataFrame) -> DataFrame:
    """file_path, commits: in how many commits each file changed. ``commits`` has commit, file_path."""
    return commits.select("commit", "file_path").distinct().groupBy("file_path").agg(F.count(F.lit(1)).alias("commits"))


def coupling(commits: DataFrame, min_shared: int = MIN_SHARED, block: int = BLOCK) -> DataFrame:
    """file_a < file_b, coupling_score, shared_commits: files that changed together at least ``min_shared`` times; score = shared / the greater number of commits.

    Files with fewer commits than ``min_shared`` can't be in a pair and are dropped before the self-join, which shrinks large commits most. Pairs are counted
    with map-side combining. A file that is in very many commits only meets the files of each commit, and a commit with very many files meets itself
    block by block, so that no task has more than the pairs of two blocks of one commit to form.
    """
    c = commits.where(F.col("file_path").isNotNull() & F.col("commit").isNotNull()).select("commit", "file_path").distinct()
    n = c.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_shared)
    k = c.join(n, "file_path").select("commit", "file_path", "n")
    large = c.groupBy("commit").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where(F.col("blocks") > 1)
    k = k.join(large, "commit", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, every = F.pmod(F.xxhash64("file_path"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = k.select("commit", own.alias("x"), every.alias("y"), F.col("file_path").alias("file_a"), F.col("n").alias("na"))
    b = k.select("commit", every.alias("x"), own.alias("y"), F.col("file_path").alias("file_b"), F.col("n").alias("nb"))
    p = a.join(b, ["commit", "x", "y"]).where(F.col("file_a") < F.col("file_b")).groupBy("file_a", "file_b", "na", "nb").agg(F.count(F.lit(1)).alias("shared_commits")).where(F.col("shared_commits") >= min_shared)
    return p.select("file_a", "file_b", (F.col("shared_commits") / F.greatest("na", "nb")).alias("coupling_score"), "shared_commits")


def lineage(commits: DataFrame) -> DataFrame:
    """file_path, commit_count, churn_score, last_author, last_commit_ts. ``commits`` has commit, file_path, author, ts; ties of the last time go to the greater author."""
    c = commits.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.count_distinct("commit").alias("commit_count"), F.max(F.struct("ts", "author")).alias("last"))
    top = c.agg(F.max("commit_count")).scalar()
    return c.select("file_path", "commit_count", (F.col("commit_count") / top).alias("churn_score"), F.col("last.author").alias("last_author"), F.col("last.ts").alias("last_commit_ts"))


def coupled_files(pairs: DataFrame, files: DataFrame, n: int = 3) -> DataFrame:
    """file_path, coupled, coupling_score: the ``n`` files most coupled with each given file, ties by path."""
    from sextant.operators.graph import first_of

    both = pairs.select(F.col("file_a").alias("file_path"), F.col("file_b").alias("coupled"), "coupling_score").unionByName(pairs.select(F.col("file_b").alias("file_path"), F.col("file_a").alias("coupled"), "coupling_score")).distinct()
    return first_of(both.join(files.select("file_path").distinct(), "file_path", "left_semi"), "file_path", n, F.col("coupling_score").desc(), "coupled")
