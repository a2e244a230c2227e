"""Term weights on a small collection."""

import datetime as dt
import math

from sextant.llm import relevance as rv

T = dt.datetime(2025, 1, 1)
NODES = "id long, body_preview string, term string, df long"
VECTORS = "node_id long, vector_json string, updated_at timestamp, tf int"


def test_weights(spark):
    nodes = spark.createDataFrame([(1, "Alpha alpha beta 9x _ok no", "t", 1), (2, " \n", "t", 1), (3, None, "t", 1), (4, "alpha", "t", 1), (5, "", "t", 1), (None, "alpha", "t", 1), (6, "-- !!", "t", 1)], NODES)
    vec = spark.createDataFrame([(2, '{"Gamma": 2.0, "gamma": 1, "9x": 3, "ab": 5, "zero": 0}', T, 1), (2, '{"old": 9}', T - dt.timedelta(days=1), 1), (3, '{"broken": 4, "x', T, 1), (1, '{"ignored": 7}', T, 1), (2, '{"Gamma": 2.0, "gamma": 1, "9x": 3, "ab": 5, "zero": 0}', T, 1), (5, "null", T, 1), (None, '{"a": 1}', T, 1)], VECTORS)
    p = {(r.node_id, r.term): (r.tf, r.length) for r in rv.term_postings(nodes, vec).collect()}
    assert p == {(1, "alpha"): (2, 4), (1, "beta"): (1, 4), (1, "_ok"): (1, 4), (2, "gamma"): (3, 3), (4, "alpha"): (1, 1)}
    w = {(r.node_id, r.term): r for r in rv.bm25_weights(rv.term_postings(nodes, vec)).collect()}
    avg = 8 / 3
    want = math.log(1 + (3 - 2 + 0.5) / 2.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / avg))
    assert abs(w[1, "alpha"].weight - want) < 1e-12 and w[1, "alpha"].df == 2
    assert {(r.node_id, r.term) for r in rv.marking_terms(nodes, vec, 2, 1).collect()} == {(2, "gamma")}


def test_empty(spark):
    n, v = spark.createDataFrame([], NODES), spark.createDataFrame([], VECTORS)
    assert rv.marking_terms(n, v).count() == 0
    assert rv.marking_terms(spark.createDataFrame([(1, "alpha alpha alpha", "t", 1)], NODES), v).count() == 1
