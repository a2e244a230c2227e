"""Joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds at least this share of the rows, or this many rows where that is less: so no task gets many more, however large the table.
HEAVY_SHARE, HEAVY_ROWS = 0.01, 4_000_000
#: At most this many heavy keys: on very large tables a key of less than a millionth of the rows isn't divided.
MAX_HEAVY = 1_000_000
#: Parts into which the rows of a heavy key are divided: at least these, and as many as leave each part half of what makes a key heavy.
SALTS = 8


def heavy_counts(counts: DataFrame, keys: list[str], share: float = HEAVY_SHARE, rows: int = HEAVY_ROWS) -> DataFrame:
    """Of keys with their numbers of rows (``__n``) the heavy ones: keys, ``__salts``.

    The total is worked out first, as one number. At most max(1 / share, total / rows) keys come out, and at most MAX_HEAVY, which
    bounds what callers broadcast.
    """
    total = counts.agg(F.sum("__n")).first()[0] or 0
    least = max(2, total / MAX_HEAVY, min(total * share, rows))
    return counts.where(F.col("__n") >= least).select(*keys, F.greatest(F.lit(SALTS), F.ceil(F.col("__n") * 2 / F.lit(least))).cast("int").alias("__salts"))


def heavy_keys(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE, rows: int = HEAVY_ROWS) -> DataFrame:
    """The key values that hold at least ``share`` of the rows whose keys are not null, or ``rows`` rows: keys, ``__salts``.

    The counts are combined on the map side, so a heavy key costs no task more than another.
    """
    present = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    counts = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = present.count()
    least = max(2, total / MAX_HEAVY, min(total * share, rows))
    return counts.where(F.col("__n") >= least).select(*keys, F.greatest(F.lit(SALTS), F.ceil(F.col("__n") * 2 / F.lit(least))).cast("int").alias("__salts"))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", condition=None, heavy: DataFrame | None = None) -> DataFrame:
    """Equi-join whose heavy left keys are divided into parts.

    Rows of a heavy left key go to a part by the hash of the whole row, the right rows of such a key are
    copied to every part; all other rows have part 0. ``how`` is inner, left, left_semi or left_anti; ``condition``
    is a function of the two aliases "l" and "r" giving a further condition. ``heavy`` has the keys and their number of parts (``__salts``), as
    ``heavy_keys`` gives them; it is broadcast, and bounded as described there. Null keys match nothing; with left and left_anti their rows are kept, spread
    by their own hash.

    Rows come out with all columns of the left, then (inner, left) the right's columns but its keys. Columns
    of the right that clash with the left's must be renamed by the caller.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    if heavy is None:
        heavy = heavy_keys(left, keys)
    hk = [f"__h{i}" for i in range(len(keys))]
    marks = F.broadcast(heavy.select(*[F.col(k).alias(h) for k, h in zip(keys, hk)], F.col("__salts").alias("__s")))
    on = lambda d: reduce(lambda a, b: a & b, [d[k] == marks[h] for k, h in zip(keys, hk)])
    anynull = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salts = F.when(anynull, F.lit(SALTS)).otherwise(F.col("__s"))
    l = left.join(marks, on(left), "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), salts), F.lit(0)).cast("int")).drop("__s", *hk)
    r = right.join(marks, on(right), "left").withColumn("__part", F.explode(F.when(F.col("__s").isNotNull(), F.sequence(F.lit(0), F.col("__s") - 1)).otherwise(F.array(F.lit(0))))).drop("__s", *hk)
    rk = [f"__r{i}" for i in range(len(keys))]
    r = r.select(*[F.col(k).alias(n) for k, n in zip(keys, rk)], F.col("__part").alias("__rpart"), *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [l[k] == r[n] for k, n in zip(keys, rk)] + [l["__part"] == r["__rpart"]])
    if condition is not None:
        cond = cond & condition(l, r)
    return l.join(r, cond, how).drop("__part", "__rpart", *rk)
