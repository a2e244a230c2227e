"""The permutation index: recall against brute force, copies, dirty vectors."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.llm import permutation as pm

SCHEMA = "node_id long, vector array<float>, updated_at timestamp, rank int, cosine double"
T = dt.datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], T + dt.timedelta(days=d), 1, 0.5) for i, v, d in rows], SCHEMA)


def brute(vectors, k, floor):
    ids = sorted(vectors)
    out = set()
    for i in ids:
        u = vectors[i] / np.linalg.norm(vectors[i])
        sims = [(-round(float(u @ (vectors[j] / np.linalg.norm(vectors[j]))), 6), j) for j in ids if j != i and len(vectors[j]) == len(vectors[i])]
        out |= {(min(i, j), max(i, j)) for s, j in sorted(sims)[:k] if -s >= floor}
    return out


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(4)
    out, n = {}, 0
    for _ in range(150):
        c = r.normal(size=64)
        c /= np.linalg.norm(c)
        for _ in range(r.integers(1, 9)):
            out[n] = ((c + r.normal(size=64) * 0.03) * r.uniform(0.5, 3)).astype(np.float32)
            n += 1
    for _ in range(400):
        out[n] = r.normal(size=64).astype(np.float32)
        n += 1
    for _ in range(12):
        out[n] = r.normal(size=48).astype(np.float32)
        n += 1
    return out


def test_recall(spark, clustered):
    got = {tuple(r) for r in pm.neighbour_pairs(frame(spark, [(i, v, 0) for i, v in clustered.items()])).collect()}
    want = brute(clustered, 5, 0.9)
    assert len(got & want) >= 0.98 * len(want)
    assert len(got - want) <= 0.02 * len(want)


def nearest(got):
    by = {}
    for x in sorted(got, key=lambda x: x.rank):
        by.setdefault(x.node, []).append(x.neighbour)
    return by


@pytest.mark.parametrize("block", [16, 4096])
def test_every_vector_has_its_nearest_without_a_floor(spark, clustered, monkeypatch, block):
    monkeypatch.setattr(pm, "BLOCK", block)
    got = nearest(pm.nearest_neighbours(frame(spark, [(i, v, 0) for i, v in clustered.items()]), floor=None).collect())
    assert set(got) == set(clustered) and all(len(x) == 5 for x in got.values())
    hits = 0
    for i, v in clustered.items():
        sims = sorted((-float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), j) for j, w in clustered.items() if j != i and len(w) == len(v))
        hits += len({j for _, j in sims[:5]} & set(got[i]))
    assert hits >= 0.9 * 5 * len(clustered)


def test_without_a_shared_file_all_are_compared(spark, monkeypatch):
    monkeypatch.setattr(pm, "_first_shared", lambda a, b: pm.LONG + 1)
    r = np.random.default_rng(5)
    vectors = {i: r.normal(size=64).astype(np.float32) for i in range(90)}
    got = nearest(pm.nearest_neighbours(frame(spark, [(i, v, 0) for i, v in vectors.items()]), floor=None).collect())
    for i, v in vectors.items():
        sims = sorted((-float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), j) for j, w in vectors.items() if j != i)
        assert got[i] == [j for _, j in sims[:5]]


def test_copies_and_dirty_vectors_without_a_floor(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=64), r.normal(size=64)
    rows = [(i, a, 0) for i in range(40)] + [(100, b, 0), (101, b, 0), (102, -b, 0), (103, None, 1), (103, a, 0), (104, np.zeros(64), 0), (105, a[:48], 0), (106, a * 3, 0), (None, a, 0)]
    got = nearest(pm.nearest_neighbours(frame(spark, rows), floor=None).collect())
    assert got[20] == [0, 1, 2, 3, 4] and got[2] == [0, 1, 3, 4, 5] and got[106] == [0, 1, 2, 3, 4]
    assert got[100][0] == 101 and len(got[102]) == 5 and not {103, 104, 105} & set(got)
    assert pm.nearest_neighbours(spark.createDataFrame([], SCHEMA), floor=None).count() == 0


def test_long_files_are_divided(spark, clustered, monkeypatch):
    monkeypatch.setattr(pm, "BLOCK", 16)
    got = {tuple(r) for r in pm.neighbour_pairs(frame(spark, [(i, v, 0) for i, v in clustered.items()])).collect()}
    want = brute(clustered, 5, 0.9)
    assert len(got & want) >= 0.98 * len(want)


def test_copies(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=64), r.normal(size=64)
    rows = [(i, a, 0) for i in range(40)] + [(100, a + 0.01 * b, 0), (101, b, 0), (102, b, 0)]
    got = pm.nearest_neighbours(frame(spark, rows)).collect()
    by = {}
    for x in got:
        by.setdefault(x.node, []).append((x.rank, x.neighbour))
    assert [n for _, n in sorted(by[20])] == [0, 1, 2, 3, 4]
    assert [n for _, n in sorted(by[2])] == [0, 1, 3, 4, 5]
    assert [n for _, n in sorted(by[100])] == [0, 1, 2, 3, 4]
    assert by[101] == [(1, 102)] and by[102] == [(1, 101)]


def test_dirty_vectors(spark):
    r = np.random.default_rng(2)
    a = r.normal(size=64)
    rows = [(1, a, 0), (2, a * 2, 0), (3, None, 1), (3, a, 0), (4, np.zeros(64), 0), (5, a[:48], 0), (6, a, 2), (6, -a, 1), (6, a, 2), (7, [np.nan] * 64, 0), (8, [], 0), (None, a, 0)]
    got = {tuple(x) for x in pm.neighbour_pairs(frame(spark, rows)).collect()}
    assert got == {(1, 2), (1, 6), (2, 6)}


def test_empty(spark):
    assert pm.neighbour_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def dense(clusters, size, noise, others=0, seed=7):
    r = np.random.default_rng(seed)
    m = np.repeat(r.normal(size=(clusters, 64)), size, axis=0)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m = np.vstack([m + r.normal(size=m.shape) * noise / 8, r.normal(size=(others, 64))]).astype(np.float32)
    return m[r.permutation(len(m))]


def true_pairs(m, k, floor):
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = set()
    for s in range(0, len(u), 500):
        sim = u[s : s + 500] @ u.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -2
        near = np.argpartition(-sim, k, axis=1)[:, :k]
        for i, row in enumerate(near):
            out |= {(min(s + i, int(j)), max(s + i, int(j))) for j in row if sim[i, j] >= floor}
    return out


@pytest.mark.parametrize(("clusters", "size", "noise", "others"), [(200, 10, 0.2, 0), (20, 100, 0.2, 2000), (1, 2000, 0.1, 0), (1, 2000, 0.3, 0), (1, 2000, 0.02, 3000), (1, 2000, 0.0005, 0), (1, 10_000, 0.1, 5000)])
def test_dense_regions(spark, clusters, size, noise, others):
    m = dense(clusters, size, noise, others)
    got = {tuple(r) for r in pm.neighbour_pairs(spark.createDataFrame(pd.DataFrame({"node_id": np.arange(len(m)), "vector": list(m), "updated_at": T}), "node_id long, vector array<float>, updated_at timestamp")).collect()}
    want = true_pairs(m, 5, 0.9)
    assert want and len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_a_dense_region_gives_few_candidates(spark):
    m = dense(1, 3000, 0.1)
    raw, latest, pivots = pm.newest_orders(frame(spark, [(i, v, 0) for i, v in enumerate(m)]), "node_id", "vector", "updated_at", 0.9)
    reps = latest.select("dim", F.col("id").alias("rep"), "perm", "sketch")
    assert pm.candidate_pairs(reps, pivots, pm.measured_bounds(reps, pivots, 5, 0.9), 0.9, 5).count() <= len(m) * (5 + pm.SPARE)


def test_exact(spark, clustered):
    few = {i: v for i, v in clustered.items() if i < 500}
    few |= {len(few) + i: v for i, v in enumerate(dense(1, 300, 0.6))}
    got = {tuple(r) for r in pm.neighbour_pairs(frame(spark, [(i, v, 0) for i, v in few.items()]), floor=0.5, exact=True).collect()}
    assert got == brute(few, 5, 0.5)
    all_of = nearest(pm.nearest_neighbours(frame(spark, [(i, v, 0) for i, v in few.items()]), floor=None, exact=True).collect())
    assert set(all_of) == set(few) and all(len(x) == 5 for x in all_of.values())


def test_sketches_keep_small_differences():
    m = dense(1, 400, 0.001).astype(np.float64)
    u = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    v = pm.from_sketches(pm.sketches(u, np.tile(u[0], (len(u), 1))), np.tile(u[0], (len(u), 1)))
    a, b = (np.linalg.norm(x[1] - x[2:].astype(np.float64), axis=1) for x in (u, v))
    assert np.abs(a / b - 1).max() < 0.02


def test_pivots_are_spread():
    m = dense(5, 200, 0.05)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    kept = pm.spread_out(u, 0.9)
    assert len(kept) == 5 and len(pm.spread_out(u[:0], 0.9)) == 0


def test_footrule_is_the_sum_of_moves():
    r = np.random.default_rng(3)
    a = np.array([r.permutation(20)[: pm.PREFIX] for _ in range(6)], dtype=np.uint16)
    place = lambda row, p: list(row).index(p) if p in row else pm.PREFIX
    want = [[sum(abs(place(x, p) - place(y, p)) for p in range(20)) for y in a] for x in a]
    assert (pm.footrule(a, a) == np.array(want)).all()


def test_pivots_are_bounded():
    assert pm.pivot_count(0) == pm.MIN_PIVOTS and pm.pivot_count(10**15) == pm.MAX_PIVOTS
