"""Reading level: held-out accuracy, isotonic regression, dirty labels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import reading

EASY = "the cat can see a big red box and we put it on the old mat to play".split()
HARD = "notwithstanding asymptotic characterisation presupposes hierarchical dimensionality whereby orthogonal factorisation substantiates probabilistic equivalence".split()
MIDDLE = "when you open the folder select each record so that the window refreshes every setting quickly".split()
UPPER = "because the scheduler reconciles every partition the extractor recalculates whichever dependency had been invalidated previously".split()


def make(seed, n=80):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        level = i % 4 + 1
        w = [r.choice((EASY, MIDDLE, UPPER, HARD)[level - 1]) for _ in range(r.randrange(60, 120))]
        other = [r.choice((EASY, MIDDLE, UPPER, HARD)[(level + 1) % 4]) for _ in range(20)]
        rows.append((i, ". ".join([" ".join(w[k : k + 9]) for k in range(0, len(w), 9)] + [" ".join(other)]), "en", "readme", "x"))
        labels.append((i, level, "a"))
    return rows, labels


DOCS, LABELS = "doc_id long, text string, lang string, doc_kind string, level string", "doc_id long, reading_level int, rater string"


def test_held_out_accuracy(spark):
    rows, labels = make(1)
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:40], LABELS)).collect()}
    assert sum(got[i] == v for i, v, _ in labels[40:]) >= 0.95 * 40


def test_held_out_accuracy_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "reading_labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(docs, labels.where(fold)).collect()}
    test = [(r.label_doc, r.level) for r in reading.clean_labels(labels.where(~fold)).collect() if r.label_doc in got]
    if not test:
        pytest.skip("no labels")
    assert sum(got[i] == v for i, v in test) >= 0.85 * len(test)


def test_code_and_headings_do_not_count(spark):
    rows, labels = make(2)
    easy = rows[0][1]
    hard = " ".join(HARD * 20)
    extra = [(1000, f"# {hard}\n\n{easy}\n\n```\n{hard}\n{hard}\n```\n", "en", "issue", "x"), (1001, easy.replace(". ", " "), "en", "issue", "x")]
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(spark.createDataFrame(rows + extra, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert got[1000] == got[1001] == got[0] == 1


def test_who_gets_a_level(spark):
    rows, labels = make(3, 16)
    t = rows[0][1]
    odd = [(100, None, "en", "readme", "x"), (101, "", "en", "readme", "x"), (102, "too short", "en", "readme", "x"), (103, t, "de", "readme", "x"), (104, t, None, "readme", "x"), (105, t, "en", "source", "x"), (106, t, "en", "changelog", "x"), (107, t, "en", None, "x"), (108, "1 2 3 " * 20, "en", "issue", "x"), (None, t, "en", "issue", "x")]
    labels = labels + [(0, 1, "b"), (1, 4, "b"), (2, None, "b"), (3, 9, "b"), (999, 1, "b"), (None, 1, "b")]
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert set(got) == set(range(16)) | {107, 108} and got[108] == 1


def test_without_labels(spark):
    rows, _ = make(4, 4)
    df = reading.reading_levels(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS))
    assert df.count() == 0 and df.columns == ["doc_id", "reading_level"]


def test_isotonic():
    r = np.random.default_rng(1)
    y, w = r.normal(size=50) + np.arange(50) / 20, r.uniform(0.1, 1, 50)
    f = reading.isotonic(y, w)
    assert (np.diff(f) >= -1e-12).all() and abs((f * w).sum() - (y * w).sum()) < 1e-9
    assert (reading.isotonic(np.arange(5.0), np.ones(5)) == np.arange(5.0)).all()


def test_every_labelled_document_counts(spark):
    # each word is in two labelled documents only, and in one without a label
    n = 12_000
    word = F.translate(F.lpad((F.col("id") % n).cast("string"), 5, "0"), "0123456789", "abcdefghij")
    docs = spark.range(3 * n).select(F.col("id").alias("doc_id"), F.repeat(F.concat(word, F.lit(" ")), 40).alias("text"), F.lit("en").alias("lang"), F.lit("readme").alias("doc_kind"))
    labels = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % n % 2 == 0, 1).otherwise(4).alias("reading_level"))
    got = reading.reading_levels(docs, labels).where(F.col("doc_id") >= 2 * n)
    assert got.count() == n and got.where(F.col("reading_level") != F.when(F.col("doc_id") % 2 == 0, 1).otherwise(4)).count() == 0


@pytest.mark.parametrize("head", [0, 40, 2000])
def test_the_head_does_not_change_the_result(spark, monkeypatch, head):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "reading_labels"))
    levels = lambda: sorted((r.doc_id, r.reading_level) for r in reading.reading_levels(docs, labels).collect())
    model, tail = reading.train(docs, labels)
    whole = levels()
    assert tail is None and len({v for _, v in whole}) == 4
    monkeypatch.setattr(reading, "MAX_HEAD", head)
    monkeypatch.setattr(reading, "HELD", 50)
    monkeypatch.setattr(reading, "MAX_BROADCAST_LABELS", 0)
    part, tail = reading.train(docs, labels)
    assert len(part.number) + (part.keys >= 0).sum() <= head and tail.count() == len(model.number) + len(model.keys) - len(part.number) - (part.keys >= 0).sum()
    assert (part.total == model.total).all() and (part.map == model.map).all()
    assert levels() == whole
