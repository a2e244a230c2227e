"""Leximin ranking against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from sextant.llm import leximin

SCHEMA = "q long, i long, a double, b double, c double, score_name string, pct int"
def scores():
    return {n: F.col(n) for n in "abc"}



def plain(rows, k):
    groups = {}
    for q, i, *s, _, _ in rows:
        if q is None or i is None:
            continue
        old = groups.setdefault(q, {}).get(i, (None,) * 3)
        best = lambda x, y: x if y is None else y if x is None else max(x, y)
        groups[q][i] = tuple(best(x, None if y != y else y) for x, y in zip(old, s))
    out = []
    for q, items in groups.items():
        n, vec = len(items), {i: [] for i in items}
        for k2 in range(3):
            for i in items:
                v = items[i][k2]
                low = lambda x, y: (x is None and y is not None) or (x is not None and y is not None and x < y)
                below, ties = sum(low(w[k2], v) for w in items.values()), sum(w[k2] == v for w in items.values())
                vec[i].append(1.0 if n == 1 else (below + (ties - 1) / 2) / (n - 1))
        order = sorted(items, key=lambda i: ([-x for x in sorted(vec[i])], i))
        out += [(q, i, r) for r, i in enumerate(order[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain(spark, seed):
    r = random.Random(seed)
    val = lambda s: r.choice([None, float("nan"), 0.0, -0.0, round(r.gauss(0, s), 1), r.random() * s])
    rows = [(r.choice([1, 1, 1, 2, 3]), r.randrange(60), val(1), val(1000), val(1e-3), "x", 1) for _ in range(150)] + [(9, 5, None, None, None, "x", 1), (None, 1, 1.0, 1.0, 1.0, "x", 1)]
    got = leximin.leximin_rank(spark.createDataFrame(rows + rows[:9], SCHEMA), "q", "i", scores(), 5)
    assert sorted((x.q, x.i, x.rank) for x in got.collect()) == plain(rows, 5)
    got = leximin.leximin_rank(spark.createDataFrame(rows + rows[:9], SCHEMA), "q", "i", scores(), None)
    assert sorted((x.q, x.i, x.rank) for x in got.collect()) == plain(rows, None)


def test_one_crowded_query(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("q"), F.col("id").alias("i"), F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    got = leximin.leximin_rank(df, "q", "i", scores(), 3).orderBy("rank").collect()
    assert len(got) == 3 and all(x.standing[0] == got[0].standing[0] for x in got)
    p = leximin.percentiles(df.select("q", F.col("a").alias("value")), ["q"], "value")
    assert p.where(F.abs(F.col("pct") - F.col("value") / 2999) > 1e-12).count() == 0


def test_a_crowded_query_is_ranked_in_ranges(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 5 == 0, F.col("id") % 7).otherwise(9).cast("long").alias("q"), F.col("id").alias("i"), F.xxhash64("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    got = leximin.leximin_rank(df, "q", "i", scores(), None)
    by = {}
    for r in got.collect():
        by.setdefault(r.q, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert rows == sorted(rows, key=lambda r: ([-x for x in r.standing], r.i))


def test_empty(spark):
    assert leximin.leximin_rank(spark.createDataFrame([], SCHEMA), "q", "i", scores(), None).count() == 0
    assert leximin.leximin_rank(spark.createDataFrame([], SCHEMA), "q", "i", scores(), 5).count() == 0


def test_null_breakdown(spark):
    s = spark.createDataFrame([(1, 1, None), (1, 2, (1.0, 1.0, 1.0))], "query_id long, node_id long, score_breakdown struct<bm25:double,semantic:double,graph:double>")
    assert [(r.node_id, r["rank"]) for r in leximin.search_ranking(s).orderBy("rank").collect()] == [(2, 1), (1, 2)]
