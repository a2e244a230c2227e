"""Graph operators against plain searches over random graphs."""

import itertools
import random
from collections import defaultdict, deque

import pytest

from sextant.operators import coupling, graph
from sextant.plans import graphs

EDGES = "id long, source_id long, target_id long, type string, call_site_line int, confidence double"


def make(spark, seed, n=14, m=34):
    r = random.Random(seed)
    rows = [(i, r.randrange(n), r.randrange(n), r.choice(["CALLS", "CALLS", "IMPORTS"]), i, r.choice([0.65, 0.75, 1.0])) for i in range(m)]
    nodes = [(i, f"f{i}", f"a.py::f{i:02d}", "a.py", "function") for i in range(n)]
    return rows, spark.createDataFrame(rows, EDGES), nodes, spark.createDataFrame(nodes, "id long, name string, fqn string, file_path string, kind string")


@pytest.mark.parametrize("seed", range(3))
def test_reachable(spark, seed):
    rows, edges, _, _ = make(spark, seed)
    out, dist, todo = defaultdict(set), {0: 0}, deque([0])
    for _, a, b, *_ in rows:
        out[a].add(b)
    while todo:
        x = todo.popleft()
        for y in out[x]:
            if y not in dist and dist[x] < 3:
                dist[y] = dist[x] + 1
                todo.append(y)
    assert {(r.id, r.hop) for r in graph.reachable(edges, spark.createDataFrame([(0,)], "id long"), 3).collect()} == set(dist.items())


@pytest.mark.parametrize("seed", range(3))
def test_paths(spark, seed):
    rows, edges, nodes, ndf = make(spark, seed)
    out = defaultdict(set)
    for _, a, b, t, *_ in rows:
        if t == "CALLS" and a != b:
            out[a].add(b)
    found = []

    def walk(path):
        if path[-1] == 5:
            found.append([nodes[i][2] for i in path])
        elif len(path) < 6:
            for y in out[path[-1]] - set(path):
                walk([*path, y])

    walk([0])
    want = sorted(found, key=lambda p: (len(p), p))[:4]
    got = [r.path for r in graph.call_paths(ndf, edges, "a.py::f00", "a.py::f05", 4, 6).orderBy("path_no").collect()]
    assert got == want
    assert graph.call_paths(ndf, edges, "a.py::f00", "none", 4, 6).count() == 0


def test_the_registered_paths_go_up_to_ten_nodes(spark, tmp_path):
    # the end, 30, has the most callers; 0 reaches it over 1..8 (ten nodes), over 10..14 (seven) and over 20..28 (eleven)
    ways = [[0, *range(1, 9), 30], [0, *range(10, 15), 30], [0, *range(20, 29), 29, 30]]
    pairs = [p for w in ways for p in itertools.pairwise(w)] + [(12, 4), (5, 11)]
    rows = [(i, a, b, "CALLS", i, 1.0) for i, (a, b) in enumerate(pairs)]
    nodes = [(i, f"f{i}", f"a.py::f{i:02d}", "a.py", "function") for i in range(31)]
    spark.createDataFrame(rows, EDGES).write.parquet(str(tmp_path / "edges.parquet"))
    spark.createDataFrame(nodes, "id long, name string, fqn string, file_path string, kind string").write.parquet(str(tmp_path / "nodes.parquet"))
    out, found = defaultdict(set), []
    for a, b in pairs:
        out[a].add(b)

    def walk(path):
        if path[-1] == 30:
            found.append([nodes[i][2] for i in path])
        elif len(path) < 10:
            for y in out[path[-1]] - set(path):
                walk([*path, y])

    walk([0])
    want = sorted(found, key=lambda p: (len(p), p))[:3]
    assert [len(p) for p in want] == [7, 10, 10]
    got = graphs.g06_whole(spark, str(tmp_path)).orderBy("path_no").collect()
    assert [r.path for r in got] == want


@pytest.mark.parametrize("seed", range(3))
def test_expansion(spark, seed):
    rows, edges, _, _ = make(spark, seed)
    good = {(a, b) for _, a, b, t, _, c in rows if t == "CALLS" and c >= 0.75}
    seen, front, want = {0}, {0}, {}
    for hop in (1, 2):
        new = {b: "callee" for a, b in good if a in front and b not in seen}
        new |= {a: "caller" for a, b in good if b in front and a not in seen and a not in new}
        want |= {k: (v, hop) for k, v in new.items()}
        seen |= set(new)
        front = set(new)
    got = {r.id: (r.role, r.hop) for r in graph.expand_neighbours(edges, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == want


def test_fanout_is_capped(spark):
    star = lambda n: spark.createDataFrame([(i, 0, i + 1, "CALLS", 1, 1.0) for i in range(n)], EDGES)
    seed = spark.createDataFrame([(0,)], "id long")
    assert graph.expand_neighbours(star(41), seed).count() == 0
    assert graph.expand_neighbours(star(40), seed).count() == 40


def test_impact_falls_back_to_the_name(spark):
    _, edges, _, nodes = make(spark, 1)
    a = {(r.fqn, r.depth) for r in graph.impact(nodes, edges, "a.py::f01", 3).collect()}
    assert {(r.fqn, r.depth) for r in graph.impact(nodes, edges, "zz.py::f1", 3).collect()} == a
    assert graph.impact(nodes, edges, "zz.py::none", 3).count() == 0


def test_the_registered_impact_has_five_levels_from_the_most_referenced_node(spark, tmp_path):
    # 0 has three callers; the chain 1 <- 4 <- 5 ... goes on beyond the fifth level, 20 is called once only
    pairs = [(1, 0), (2, 0), (3, 0), (4, 1), *((i + 1, i) for i in range(4, 9)), (21, 20)]
    rows = [(i, a, b, "CALLS", i, 1.0) for i, (a, b) in enumerate(pairs)]
    nodes = [(i, f"f{i}", f"a.py::f{i:02d}", "a.py", "function") for i in range(22)]
    spark.createDataFrame(rows, EDGES).write.parquet(str(tmp_path / "edges.parquet"))
    spark.createDataFrame(nodes, "id long, name string, fqn string, file_path string, kind string").write.parquet(str(tmp_path / "nodes.parquet"))
    far = [(1, "x::a", "x", "a.py::f07", "CALLS")]
    spark.createDataFrame(far, "id long, source_fqn string, source_repo string, target_fqn string, type string").write.parquet(str(tmp_path / "cross_repo_edges.parquet"))
    want = {("a.py::f01", 1), ("a.py::f02", 1), ("a.py::f03", 1), ("a.py::f04", 2), ("a.py::f05", 3), ("a.py::f06", 4), ("a.py::f07", 5)}
    assert {(r.fqn, r.depth) for r in graphs.g03_whole(spark, str(tmp_path)).collect()} == want
    assert {(r.fqn, r.depth) for r in graphs.g04_whole(spark, str(tmp_path)).collect()} == want
    assert {r.id for r in graphs.g05_crowded(spark, str(tmp_path)).collect()} == {0}


def test_coupling_and_lineage(spark):
    r = random.Random(3)
    commits = {c: r.sample("abcdef", r.randrange(1, 5)) for c in range(30)}
    rows = [(c, f, f"u{c % 3}", c) for c, fs in commits.items() for f in fs]
    df = spark.createDataFrame(rows + rows[:3], "commit long, file_path string, author string, ts long")
    count, pairs = defaultdict(int), defaultdict(int)
    for fs in commits.values():
        for f in fs:
            count[f] += 1
        for a, b in itertools.combinations(sorted(fs), 2):
            pairs[a, b] += 1
    want = {(a, b, n, round(n / max(count[a], count[b]), 9)) for (a, b), n in pairs.items() if n >= 4}
    assert {(x.file_a, x.file_b, x.shared_commits, round(x.coupling_score, 9)) for x in coupling.coupling(df).collect()} == want
    assert {x.file_path: x.commit_count for x in coupling.lineage(df).collect()} == dict(count)


def test_savings_are_of_the_capsules(spark, data, monkeypatch):
    texts = {w: "x" * 4 * n for w, n in zip(graphs.WORDS, (100, 200, 300, 400))}
    asked = []
    monkeypatch.setattr(graphs, "index", lambda s, d: None)
    monkeypatch.setattr(graphs.capsule, "capsule", lambda ix, w: asked.append(w))
    monkeypatch.setattr(graphs.render, "capsule_text", lambda w, found, most: texts[w])
    got, base = graphs.c13_capsule(spark, data).first(), graphs.c13(spark, data).collect()
    assert asked == list(graphs.WORDS)
    assert (got.n, got.base, got.ours) == (len(base), sum(r.base for r in base), 1000)


def test_a_large_commit_meets_itself_by_blocks(spark):
    df = spark.createDataFrame([(c, f"f{i:03d}") for c in range(5) for i in range(60)] + [(9, "f000"), (9, "f001")], "commit long, file_path string")
    rows = lambda x: sorted((r.file_a, r.file_b, r.shared_commits, r.coupling_score) for r in x.collect())
    assert rows(coupling.coupling(df, block=7)) == rows(coupling.coupling(df)) and coupling.coupling(df, block=7).count() == 60 * 59 // 2
