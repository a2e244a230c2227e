"""Reading level of documents by surprisal.

For every graded level an interpolated n-gram model (words, pairs of words, a floor) is trained on the documents with that
label. Every word of a document has a surprisal under each model; the surprisals are averaged over a short stretch of words
around each place, which gives the distribution of difficulty over the whole document. Isotonic regression on the labelled documents
maps difficulty monotonically to a level; the document's level is the one of most of its prose.

Counts and map are those of all labelled documents, however many. The most frequent words and pairs are broadcast; where there are more of them, the counts
of the others are joined to the documents that have them, with the same result.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.skew import skew_join
from sextant.session import keep

LEVELS = 4
#: Up to this many words and pairs, the most frequent ones, come to the driver and are broadcast. It decides only where a count is looked up.
MAX_HEAD = 1 << 20
#: Up to this many labels are broadcast to the texts.
MAX_BROADCAST_LABELS = 1 << 20
#: Distinct words and pairs that a task holds before it passes them on.
HELD = 1 << 18
#: Weights of the floor and of the single word; the rest goes to the pair.
FLOOR, SINGLE, FLOOR_WORDS = 0.02, 0.35, 50_000
#: Words over which surprisal is averaged, and cells of the difficulty scale.
STRETCH, BINS = 9, 300

_WORD = re.compile(r"[a-z]+(?:[-'][a-z]+)*")
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_NOT_PROSE = re.compile(r"^(?:(?: {4}|\t)(?!\s*[-*+•]\s).*|\s*#{1,6}\s.*|\s*[=\-~*_]{3,}\s*)$", re.M)


def prose(text: str) -> str:
    """A text without fenced and indented code, headings and rules."""
    return _NOT_PROSE.sub("", _FENCE.sub("\n", text.replace("\r\n", "\n").replace("\r", "\n")))


def prose_words(text: str) -> list[str]:
    """The lower-cased words of the prose. Falls back to the whole text where there is no prose."""
    return _WORD.findall(prose(text).lower()) or _WORD.findall(text.lower())


class Model:
    """Exact counts of words and of pairs of words by level, and the isotonic map of difficulty.

    ``head`` has the words (``b`` is empty) and the pairs ``a b`` with their counts ``n1`` and on, and every word of a pair that it has; ``total`` is the number of
    words by level, those outside the head included. Counts outside the head come with each document, as its ``tail``.

    Words are numbered; number 0 is any word outside the head. A pair is the number of its first word times the number of words, plus that of its
    second, looked up in a sorted array: nothing is hashed, so no two words or pairs share a count.
    """

    def __init__(self, head: pa.Table, total: np.ndarray):
        counts = lambda t: np.stack([t[f"n{v}"].to_numpy().astype(np.float64) for v in range(1, LEVELS + 1)])
        one = pc.equal(head["b"], "")
        alone, pairs = head.filter(one), head.filter(pc.invert(one))
        words = alone["a"].combine_chunks()
        self.number = {w: i for i, w in enumerate(words.to_pylist(), 1)}
        size = len(self.number) + 1
        self.single = np.pad(counts(alone), ((0, 0), (1, 0)))
        first, second = (pc.add(pc.index_in(pairs[c], value_set=words), 1).to_numpy().astype(np.int64) for c in "ab")
        keys = first * size + second
        order = np.argsort(keys)
        # no pair has the key -1; one column more, of zeros, for pairs outside the head
        self.keys = keys[order] if len(keys) else np.full(1, -1, np.int64)
        self.pair = np.zeros((LEVELS, len(self.keys) + 1))
        self.pair[:, : len(keys)] = counts(pairs)[:, order]
        self.known = np.flatnonzero(total > 0)
        self.total = np.maximum(total, 1).astype(np.float64)[:, None]
        self.scale = 1 + (np.arange(BINS) + 0.5) * (LEVELS - 1) / BINS

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the words and of the pairs that they end; the first word ends no known pair."""
        get = self.number.get
        w = np.fromiter((get(x, 0) for x in words), np.int64, len(words))
        pair = np.full(len(w), len(self.keys), np.int64)
        if len(w) > 1:
            key = w[:-1] * self.single.shape[1] + w[1:]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            pair[1:] = np.where(self.keys[i] == key, i, len(self.keys))
        return w, pair

    def outside(self, words: list[str]) -> set[tuple[str, str]]:
        """The words and pairs that the head hasn't got; a word has an empty second."""
        w, pair = self.numbers(words)
        return {(words[i], "") for i in np.flatnonzero(w == 0)} | {(words[i], words[i + 1]) for i in np.flatnonzero(pair[1:] == len(self.keys))}

    def difficulty(self, words: list[str], own: int | None = None, tail: list[dict] | None = None) -> np.ndarray:
        """Difficulty at each word: the mean level, weighted by how little the stretch around it surprises each level's model.

        With ``own`` the document is one of that level's own, and its words are taken out of that model first. ``tail``: the counts of those of the words
        and pairs that are outside the head; what is in neither, no labelled document has.
        """
        w, pairs = self.numbers(words)
        single, pair, total = self.single[:, w], self.pair[:, pairs], self.total
        if tail:
            # numbered downwards from -1, within the document
            rest = {(x["a"], x["b"]): (-1 - j, [x[f"n{v}"] for v in range(1, LEVELS + 1)]) for j, x in enumerate(tail)}
            for i in np.flatnonzero(w == 0):
                if got := rest.get((words[i], "")):
                    w[i], single[:, i] = got
            for i in np.flatnonzero(pairs[1:] == len(self.keys)) + 1:
                if got := rest.get((words[i - 1], words[i])):
                    pairs[i], pair[:, i] = got
        if own is not None:
            for counts, at in ((single, w), (pair, pairs)):
                _, back, n = np.unique(at, return_inverse=True, return_counts=True)
                counts[own - 1] = np.maximum(counts[own - 1] - n[back], 0)
            total = total.copy()
            total[own - 1] = max(total[own - 1, 0] - len(w), 1)
        p = FLOOR / FLOOR_WORDS + SINGLE * single / total
        if len(w) > 1:
            p[:, 1:] += (1 - FLOOR - SINGLE) * np.minimum(pair[:, 1:] / np.maximum(single[:, :-1], 1), 1.0)
        s = -np.log(p)
        side = STRETCH // 2
        padded = np.pad(s, ((0, 0), (side, side)), "edge")
        c = np.cumsum(np.pad(padded, ((0, 0), (1, 0))), axis=1)
        mean = (c[:, STRETCH:] - c[:, :-STRETCH]) / STRETCH
        mean = mean[self.known]
        odds = np.exp(-(mean - mean.min(axis=0, keepdims=True)) * STRETCH / 2)
        return ((self.known[:, None] + 1) * odds).sum(axis=0) / odds.sum(axis=0)

    def bins(self, words: list[str], own: int | None = None, tail: list[dict] | None = None) -> np.ndarray:
        d = self.difficulty(words, own, tail)
        return np.bincount(np.clip(((d - 1) * BINS / (LEVELS - 1)).astype(int), 0, BINS - 1), minlength=BINS)

    def fit(self, counts: np.ndarray) -> None:
        """``counts``: words by difficulty bin and level of their document. Each level's words are given the same total weight."""
        w = counts / np.maximum(counts.sum(axis=0, keepdims=True), 1)
        weight = w.sum(axis=1)
        mean = np.where(weight > 0, (w * np.arange(1, LEVELS + 1)).sum(axis=1) / np.where(weight > 0, weight, 1), self.scale)
        self.map = np.rint(isotonic(mean, weight + 1e-12)).astype(int)

    def level(self, words: list[str], tail: list[dict] | None = None) -> int:
        """The level of most of the prose, counted in words; of the easiest of equals."""
        return int(np.argmax(np.bincount(self.map, weights=self.bins(words, tail=tail), minlength=LEVELS + 1)[1:])) + 1


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to y in weighted squares (pool adjacent violators)."""
    value, weight, size = [], [], []
    for a, b in zip(y, w):
        value.append(float(a)), weight.append(float(b)), size.append(1)
        while len(value) > 1 and value[-2] > value[-1]:
            v, u, n = value.pop(), weight.pop(), size.pop()
            value[-1] = (value[-1] * weight[-1] + v * u) / (weight[-1] + u)
            weight[-1] += u
            size[-1] += n
    return np.repeat(value, size)


def clean_labels(labels: DataFrame) -> DataFrame:
    """doc_id, level: documents whose labels agree. Null and impossible labels are ignored, repeated ones count once, conflicting ones drop the document."""
    ok = labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").between(1, LEVELS)).groupBy("doc_id").agg(F.min("reading_level").alias("level"), F.max("reading_level").alias("most"))
    return ok.where(F.col("level") == F.col("most")).select(F.col("doc_id").alias("label_doc"), F.col("level").cast("int").alias("level"))


def numbered(df: DataFrame) -> DataFrame:
    """``df``, written once, with a number for each row."""
    return keep(df.withColumn("row", F.monotonically_increasing_id()))


def with_tail(d: DataFrame, shared, tail: DataFrame) -> DataFrame:
    """The rows of ``d`` (``row``, ``text``) with ``tail``: the counts of those of their words and pairs that are outside the broadcast model's head; null for none."""

    def outside(batches):
        m, rows, first, second = shared.value, [], [], []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["row", "a", "b"])
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x, y in m.outside(prose_words(t)):
                    rows.append(i), first.append(x), second.append(y)
                if len(rows) >= HELD:
                    yield batch()
                    rows, first, second = [], [], []
        yield batch()

    found = skew_join(keep(d.select("row", "text").mapInArrow(outside, "row long, a string, b string")), tail, ["a", "b"])
    lists = found.groupBy("row").agg(F.collect_list(F.struct("a", "b", *[f"n{v}" for v in range(1, LEVELS + 1)])).alias("tail"))
    return d.join(lists, "row", "left")


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame | None] | None:
    """A model from all labelled texts, and the counts that are outside its head (``a``, ``b``, ``n1`` and on; None if there are none); None without labelled texts.

    Counting is distributed. What comes to the driver are at most MAX_HEAD words and pairs, totals by level and the bins. The map of
    difficulty is fitted out of sample: a labelled document's own words are taken out of its level's model before its difficulty is measured.
    """
    usable = clean_labels(labels)
    if usable.count() <= MAX_BROADCAST_LABELS:
        usable = F.broadcast(usable)
    d = numbered(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(usable, F.col("doc_id") == F.col("label_doc")).select("text", "level"))

    def count(batches):
        batch = lambda n: pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array([k[1] for k in n], pa.string()), pa.array([k[2] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["level", "a", "b", "n"])
        n: dict[tuple, int] = defaultdict(int)
        for b in batches:
            for t, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = prose_words(t)
                for x in w:
                    n[v, x, ""] += 1
                for x in zip(w, w[1:]):
                    n[v, *x] += 1
                if len(n) >= HELD:
                    yield batch(n)
                    n.clear()
        yield batch(n)

    names = [f"n{v}" for v in range(1, LEVELS + 1)]
    counts = keep(d.select("text", "level").mapInArrow(count, "level int, a string, b string, n long").groupBy("a", "b").agg(*[F.sum(F.when(F.col("level") == v, F.col("n")).otherwise(0)).alias(c) for v, c in enumerate(names, 1)]))
    # by the binary digits of its count a word comes no later than its pairs, so the head has every word of a pair that it has
    digits = F.length(F.bin(sum(F.col(c) for c in names)))
    sizes = counts.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("b") == "", F.col(c)).otherwise(0)).alias(c) for c in names]).orderBy(F.desc("digits")).collect()
    if not sizes:
        return None
    least = sizes[0].digits + 1
    for r, n in zip(sizes, np.cumsum([r.n for r in sizes])):
        if n > MAX_HEAD:
            break
        least = r.digits
    model = Model(counts.where(digits >= least).toArrow(), np.array([sum(r[c] for r in sizes) for c in names]))
    tail = counts.where(digits < least) if least > sizes[-1].digits else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def spread(batches):
        m, out = shared.value, np.zeros((BINS, LEVELS))
        for b in batches:
            rest = b.column(2) if b.num_columns > 2 else None
            for i, (t, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if w := prose_words(t):
                    out[:, v - 1] += m.bins(w, v, rest[i].as_py() if rest is not None else None)
        i, v = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(v, pa.int32()), pa.array(out[i, v])], names=["bin", "level", "n"])

    d = d.select("text", "level") if tail is None else with_tail(d, shared, tail).select("text", "level", "tail")
    bins = np.zeros((BINS, LEVELS))
    for r in d.mapInArrow(spread, "bin int, level int, n double").groupBy("bin", "level").agg(F.sum("n").alias("n")).collect():
        bins[r.bin, r.level] = r.n
    model.fit(bins)
    return model, tail


def reading_levels(docs: DataFrame, labels: DataFrame, lang: str = "en", not_kinds: tuple = ("source", "changelog"), least_words: int = 40) -> DataFrame:
    """doc_id, reading_level of every document of the language, not of the kinds named, with at least ``least_words`` blank-separated words.

    Null texts, ids and languages are left out; a null kind is none of those named. Code, headings and the way sentences are cut don't matter, as levels are
    taken from stretches of words; a text without any prose is judged by all its words, one without any letters gets level 1.
    Without a usable label nothing can be said and no rows come out. Repeated rows come out once each; extra columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    trained = train(docs, labels)
    if trained is None:
        return spark.createDataFrame([], f"doc_id {kind}, reading_level int")
    model, tail = trained
    shared = spark.sparkContext.broadcast(model)
    d = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("lang") == lang) & ~F.coalesce("doc_kind", F.lit("")).isin(*not_kinds)).select("doc_id", "text")
    if tail is not None:
        d = with_tail(numbered(d), shared, tail).select("doc_id", "text", "tail")

    def level(batches):
        m = shared.value
        for b in batches:
            rows, out = [], []
            rest = b.column(2) if b.num_columns > 2 else None
            for i, t in enumerate(b.column(1).to_pylist()):
                if len(t.split()) >= least_words:
                    w = prose_words(t)
                    rows.append(i), out.append(m.level(w, rest[i].as_py() if rest is not None else None) if w else 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.int32())], names=["doc_id", "reading_level"])

    return d.mapInArrow(level, f"doc_id {kind}, reading_level int")
