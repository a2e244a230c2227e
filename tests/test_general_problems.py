"""Crowded keys, orphan references, incremental runs: nulls, ties, repeats, empty tables, clashing columns."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sextant.operators import eager, incremental, orphans
from sextant.operators.skew import heavy_keys, skew_join

EDGES = "id long, source_id long, target_id long, n string"
T0 = dt.datetime(2025, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def edges(spark):
    r = random.Random(1)
    rows = [(i, r.choice([1, 1, 1, 2, 3, None, r.randrange(50)]), r.choice([7, 7, 8, None, r.randrange(50)]), "x") for i in range(600)]
    return rows, spark.createDataFrame(rows, EDGES)


def test_crowded_endpoints(spark, edges):
    rows, df = edges
    want = set()
    for side, k in (("source_id", 1), ("target_id", 2)):
        want |= {(side, v) for v, c in Counter(x[k] for x in rows).items() if v is not None and c * 50 >= len(rows)}
    assert {tuple(r) for r in eager.crowded_endpoints(df).collect()} == want
    assert eager.crowded_endpoints(df.where(F.lit(False))).count() == 0


def test_eager_join_equals_the_join(spark, edges):
    _, df = edges
    a, b = df.withColumn("x", F.col("id") * 2), df.withColumn("y", F.col("id") + 1)
    got = eager.eager_join_aggregate(a, b, "source_id", "target_id", {"x": "x"}, {"y": "y"})
    want = a.select(F.col("source_id").alias("key"), "x").join(b.select(F.col("target_id").alias("key"), "y"), "key").groupBy("key").agg(F.count(F.lit(1)).alias("pairs"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    assert {(r.key, int(r.pairs), r.sum_x, r.sum_y) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_degrees_of_all_nodes(spark, edges):
    rows, df = edges
    nodes = spark.createDataFrame([(1, "n"), (7, "n"), (7, "n"), (999, "n"), (None, "n")], "id long, in_rows string")
    got = {r.node_id: r for r in eager.degrees(nodes, df).collect()}
    assert set(got) == {1, 7, 999}
    assert got[999].in_rows == got[999].callers == 0
    assert got[7].in_rows == sum(r[2] == 7 for r in rows)
    assert got[7].callers == len({r[1] for r in rows if r[2] == 7 and r[1] is not None})


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, how):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 1), (2, 1), (None, 5), (9, 9)], "k long, a long")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k long, b string")
    got = skew_join(left, right, ["k"], how)
    want = left.join(right, "k", how).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert heavy_keys(left, ["k"]).count() <= 100


def test_orphans_by_time(spark):
    parents = spark.createDataFrame([(1, day(0), None), (2, day(5), day(10)), (3, None, None)], "k long, born timestamp, died timestamp")
    refs = spark.createDataFrame([(10, 1, day(0), "a"), (11, 1, day(-1), "a"), (12, 2, day(5), "a"), (13, 2, day(10), "a"), (14, 3, day(1), "a"), (15, None, day(1), "a"), (16, 9, None, "a"), (17, 1, None, "a"), (13, 2, day(10), "a")], "id long, k long, recorded_at timestamp, born string")
    got = sorted(r.id for r in orphans.orphan_references(refs, parents, ["k"], "recorded_at").collect())
    assert got == [11, 13, 13, 14, 16]
    assert orphans.orphan_references(refs.where(F.lit(False)), parents, ["k"], "recorded_at").count() == 0
    assert orphans.orphan_references(refs, parents.where(F.lit(False)), ["k"], "recorded_at").count() == 8


@pytest.mark.parametrize("seed", range(2))
def test_a_parent_with_very_many_lives(spark, seed):
    r = random.Random(seed)
    lives = [(1, day(3 * i), day(3 * i + r.choice([1, 2, 5]))) for i in range(80)] + [(2, day(i), day(i + 1)) for i in range(1, 30, 2)] + [(k, day(r.randrange(200)), None) for k in range(3, 60)]
    refs = [(i, r.choice([1, 1, 1, 2, 2, 7, 99, None]), r.choice([None, day(r.randrange(-5, 260)) + dt.timedelta(hours=r.randrange(24))])) for i in range(400)]
    want = sorted(i for i, k, t in refs if k is not None and not any(k == x and (t is None or b <= t and (e is None or t < e)) for x, b, e in lives))
    got = orphans.orphan_references(spark.createDataFrame(refs, "id long, k long, recorded_at timestamp"), spark.createDataFrame(lives, "k long, born timestamp, died timestamp"), ["k"], "recorded_at")
    assert sorted(x.id for x in got.collect()) == want and want


def test_merge_lives(spark):
    df = spark.createDataFrame([("a", day(0), day(2)), ("a", day(1), day(3)), ("a", day(3), day(4)), ("a", day(6), None), ("a", day(7), day(8)), ("b", day(1), day(1)), ("b", None, day(2))], "k string, born timestamp, died timestamp")
    assert [(r.k, r.born, r.died) for r in orphans.merge_lives(df, ["k"]).orderBy("born").collect()] == [("a", day(0), day(4)), ("a", day(6), None)]


def test_import_targets(spark):
    nodes = spark.createDataFrame([(1, "f", "src/a/b.py", day(0), None), (2, "g", "src/a/c.py", day(0), day(5)), (3, "h", "src/a/x.go", day(0), None)], "id long, name string, file_path string, indexed_at timestamp, deleted_at timestamp")
    known = spark.createDataFrame([("os", "s")], "module string, origin string")
    targets = ["a.b", "b", "b.f", "a.b.f", "src.a.b", "os", "x", ".b", ".b.f", "..a.b", "...a.b", ".c", "a.c", "b.zz", "."]
    imports = spark.createDataFrame([(i, "src/a/c.py", t, day(6)) for i, t in enumerate(targets)], "id long, source_file string, target_module string, recorded_at timestamp")
    refs = imports.select("id", orphans.import_key().alias("k"), "recorded_at")
    got = {targets[r.id] for r in orphans.orphan_references(refs, orphans.module_lives(nodes, known).withColumnRenamed("key", "k"), ["k"], "recorded_at").collect()}
    assert got == {"src.a.b", "x", "...a.b", ".c", "a.c", "b.zz", "."}


LOG = "row_id long, file_path string, blake3_hash string, last_indexed_at timestamp, node_count int, batch_id int, version string"
RUNS = "run_id long, started_at timestamp, finished_at timestamp, status string"


def naive(log, runs):
    out, state = [], {}
    for run in sorted(runs):
        if run[3] != "success":
            continue
        best = {}
        for row, path, h, at, _, batch, _ in log:
            if h is None or path is None or batch > run[0]:
                continue
            path = path.strip().replace("\\", "/").removeprefix("./")
            best[path] = max(best.get(path, (at, row, h.lower())), (at, row, h.lower()))
        for path, (_, _, h) in best.items():
            if state.get(path) != h:
                state[path] = h
                out.append((run[0], path))
    return sorted(out)


def sample(seed):
    r = random.Random(seed)
    runs = [(i, day(10 * i), None if s == "crashed" else day(10 * i + r.choice([1, 15])), s) for i in range(1, 9) for s in [r.choice(["success", "success", "failed", "crashed", "partial"])]]
    log = [(i, r.choice(["a.py", "./a.py", " b\\c.py", "b/c.py ", "d.py", None]), r.choice(["h1", "H1", "h2", "h3", None]), day(r.randrange(80)), 1, r.randrange(1, 9), "x") for i in range(120)]
    return log + log[:5], runs


@pytest.mark.parametrize("limit", [0, incremental.MAX_BROADCAST_RUNS])
@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_naive(spark, seed, limit):
    log, runs = sample(seed)
    got = incremental.replay_runs(spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUNS), limit)
    assert sorted((r.run_id, r.file_path) for r in got.collect()) == naive(log, runs)


def test_run_by_run_with_ledger(spark, tmp_path):
    log, runs = sample(5)
    ldf, rdf = spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUNS)
    ledger, got = incremental.Ledger(spark, str(tmp_path / "ledger")), []
    for run in runs:
        if run[3] != "success":
            continue
        seen = ldf.where(F.col("batch_id") <= run[0])
        failed, _ = incremental.changed_since(seen, ledger.read(), rdf, run[0])
        failed.count()  # a try that fails before its commit changes nothing
        todo, state = incremental.changed_since(seen, ledger.read(), rdf, run[0])
        got += [(run[0], r.file_path) for r in todo.collect()]
        ledger.commit(state, run[0])
    assert sorted(got) == naive(log, runs)


def test_runs_go_on_after_a_failure(spark, tmp_path, monkeypatch):
    log, runs = sample(2)
    ldf, rdf = spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUNS)
    commit, calls = incremental.Ledger.commit, []

    def fails_once(self, state, run):
        calls.append(run)
        if len(calls) == 2:
            raise OSError("lost")
        commit(self, state, run)

    monkeypatch.setattr(incremental.Ledger, "commit", fails_once)
    with pytest.raises(OSError):
        incremental.run_by_run(ldf, rdf, str(tmp_path / "l"))
    got = incremental.run_by_run(ldf, rdf, str(tmp_path / "l"))
    assert sorted((r.run_id, r.file_path) for r in got.collect()) == naive(log, runs)
    assert calls[1] == calls[2]


def test_reads_join_by_equal_batches(spark):
    log, runs = sample(0)
    plan = incremental.replay_runs(spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUNS), 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Join Cross" not in plan


def test_incremental_without_rows(spark):
    log, runs = sample(1)
    e = incremental.replay_runs(spark.createDataFrame([], LOG), spark.createDataFrame(runs, RUNS))
    assert e.count() == 0
    assert incremental.replay_runs(spark.createDataFrame(log, LOG), spark.createDataFrame([], RUNS)).count() == 0
