"""BM25 against SQLite's full-text search."""

import re
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from sextant.functions import text as tx
from sextant.operators import lexical

ROWS = [
    (1, "order_signal", "a.py::order_signal", "Orders the signal of a cursor.", "def order_signal(x)", "return cursor.next()"),
    (2, "cursor", "b.py::cursor", None, "class cursor", "pass"),
    (3, "été_cursor", "c.py::été_cursor", "Une chaîne d'été", "", "été ete"),
    (4, "other", "d.py::other", "Nothing here; order and signal apart.", "def other()", "order the_signal"),
    (5, "fetchSymbol", "e.py::fetchSymbol", "fetch symbol", None, None),
    (6, "noise", "f.py::noise", "", "", "the the the"),
    (7, "late", "g.py::late", "order", "", "x"),
    (8, "more", "h.py::more", "text", "", "y"),
]
SCHEMA = "id long, name string, fqn string, docstring string, signature string, body_preview string"


@pytest.mark.parametrize("query", ["cursor", "order_signal of a cursor", "ete chaine symbol", "fetch symbol and the order"])
def test_bm25_equals_sqlite(spark, query):
    c = sqlite3.connect(":memory:")
    try:
        c.execute("CREATE VIRTUAL TABLE t USING fts5(name, fqn, docstring, signature, body_preview)")
    except sqlite3.OperationalError:
        pytest.skip("SQLite lacks FTS5")
    c.executemany("INSERT INTO t(rowid, name, fqn, docstring, signature, body_preview) VALUES (?, ?, ?, ?, ?, ?)", ROWS)
    want = dict(c.execute("SELECT rowid, -bm25(t, 10.0, 5.0, 1.0, 2.0, 0.5) FROM t WHERE t MATCH ?", (" OR ".join(lexical.parse_query(query)),)).fetchall())
    got = {r.id: r.score for r in lexical.bm25_search(spark.createDataFrame(ROWS, SCHEMA), query).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_query_without_words(spark):
    assert lexical.bm25_search(spark.createDataFrame(ROWS, SCHEMA), "a of 12").count() == 0


def test_resolve_prefers_exact_names(spark):
    n = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'function' AS kind", "'f.py' AS file_path")
    got = {(r.asked, r.id, r.exact) for r in lexical.resolve_symbols(n, ["cursor", "Symbol", "nothing"]).collect()}
    assert got == {("cursor", 2, True), ("Symbol", 5, False)}


@pytest.mark.parametrize("query", ["cursor", "order_signal of a cursor", "ete chaine symbol", "fetch symbol and the order", "the of", "nowhere at_all", "été_cursor order_signal order"])
def test_stored_index_equals_one_pass(spark, query):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    index = lexical.FullText.build(docs).stored()
    for limit in (None, 2):
        want = {r.id: r.score for r in lexical.bm25_search(docs, query, limit=limit).collect()}
        assert {r.id: r.score for r in index.search(query, limit=limit).collect()} == want
    assert lexical.FullText.build(docs.limit(0)).stored().search(query).count() == 0


def test_a_question_reads_its_own_words(spark):
    index = lexical.FullText.build(spark.createDataFrame(ROWS, SCHEMA)).stored()
    plan = index.postings.where(index.postings.term.isin(["cursor"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(term,cursor)]" in plan or "In(term" in plan or "IsNotNull(term), EqualTo(term,cursor)" in plan


def query_by_hand(text):
    seen = {}
    for w in re.findall("[A-Za-z][A-Za-z0-9_]*", text):
        if len(w) >= 3 and w.lower() not in tx.STOPWORDS:
            seen.setdefault(w.lower(), w)
    return " OR ".join(seen.values()) or text[:50]


def test_query_terms_of_long_texts(spark):
    """A text's words are found once, not again for each of its words: the seconds are far from those of a quadratic search."""
    long = " ".join(f"{'Name' if (i + i // 6000) % 2 else 'nAME'}_{i * 7919 % 6000} The of" for i in range(12000))
    texts = [long, "Cursor cursor CURSOR order Order", "_ab 9abc ab_ a1 x__ été_cursor", "THE of 12", "", "é" * 60, "12 \U0001f600 " * 20, "The Thee the thee"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", tx.fts_query(F.col("text")).alias("fts"))
    began = time.time()
    got = {r.id: r.fts for r in df.collect()}
    assert time.time() - began < 30
    assert got == {i: query_by_hand(t) for i, t in enumerate(texts)}
    assert spark.createDataFrame([(None,)], "text string").select(tx.fts_query(F.col("text")).alias("fts")).first().fts is None
