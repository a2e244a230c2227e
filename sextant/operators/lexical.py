"""Lexical retrieval: fielded BM25, substring fallback, boosts, query expansion, symbol resolution."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.text import ACCENTS, PLAIN, STOPWORDS, fts_tokens
from sextant.session import cut, keep, spread

#: Weights of the searched columns.
FIELDS = {"name": 10.0, "fqn": 5.0, "docstring": 1.0, "signature": 2.0, "body_preview": 0.5}
K1, B = 1.2, 0.75
EXACT_NAME, ANCHOR = 5.0, 3.0


def parse_query(query: str) -> list[str]:
    """Words of a query: identifier-like, at least three characters, no stop words, each once whatever its case."""
    seen: dict[str, str] = {}
    for t in re.findall(r"[A-Za-z][A-Za-z0-9_]*", query):
        if len(t) >= 3 and t.lower() not in STOPWORDS:
            seen.setdefault(t.lower(), t)
    return list(seen.values())


def phrases(query: str) -> list[list[str]]:
    """The query's words as phrases of full-text tokens: an underscore divides a word into a phrase."""
    fold = str.maketrans(ACCENTS, PLAIN)
    return [p for w in parse_query(query) if (p := re.findall(r"[^\W_]+", w.lower().translate(fold)))]


def _hits(tokens: Column, phrase: Column) -> Column:
    """Places at which a phrase (array of words) stands among the tokens. It is looked for only where its first word stands."""
    first = phrase[0]
    single = F.size(tokens) - F.size(F.array_remove(tokens, first))
    several = F.size(F.filter(tokens, lambda t, i: (t == first) & (F.slice(tokens, i + 1, F.size(phrase)) == phrase)))
    return F.when(F.array_contains(tokens, first), F.when(F.size(phrase) == 1, single).otherwise(several)).otherwise(0)


def bm25_search(docs: DataFrame, query: str, fields: dict[str, float] | None = None, id_col: str = "id", limit: int | None = 100) -> DataFrame:
    """id, score: documents with any phrase of the query, by fielded BM25; the ``limit`` best, ties to the smaller id.

    score = sum over phrases of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length)), tf being the weighted
    hits over the columns, length the tokens in all columns, idf = ln((N - n + 0.5) / (n + 0.5)) but at least 1e-6. Null columns are
    empty. A query without words finds nothing. One pass over the texts, whose hits are written, and one over the hits. For repeated questions over the
    same documents there is ``FullText``.
    """
    fields = fields or FIELDS
    ps = phrases(query)
    if not ps:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where(F.lit(False))
    t = spread(docs.select(F.col(id_col).alias("id"), *fields), "id").select("id", *[fts_tokens(F.col(f)).alias(f"t_{f}") for f in fields])
    length = sum((F.size(f"t_{f}") for f in fields), F.lit(0)).cast("double")
    wanted = F.array(*[F.array(*map(F.lit, p)) for p in ps])
    hits = F.transform(wanted, lambda p: sum((F.lit(w) * _hits(F.col(f"t_{f}"), p) for f, w in fields.items()), F.lit(0.0)))
    # inline keeps the filter on the hits above the projection, so that they are counted once for each row
    h = keep(t.select("id", F.inline(F.array(F.struct(length.alias("len"), hits.alias("h"))))))
    s = h.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col("h")[i] > 0).alias(f"n{i}") for i in range(len(ps))]).alias("s")).scalar()
    idf = lambda i: F.greatest(F.log((s["n"] - s[f"n{i}"] + 0.5) / (s[f"n{i}"] + 0.5)), F.lit(1e-6))
    part = lambda i: idf(i) * F.col("h")[i] * (K1 + 1) / (F.col("h")[i] + K1 * (1 - B + B * F.col("len") / s["avg"]))
    # rounded, so that equal scores tie whatever the order in which they were added up
    score = F.round(sum((F.when(F.col("h")[i] > 0, part(i)).otherwise(0.0) for i in range(len(ps))), F.lit(0.0)), 9)
    out = h.where(F.exists("h", lambda x: x > 0)).select("id", score.alias("score"))
    return out if limit is None else out.orderBy(F.col("score").desc(), "id").limit(limit)


def fts_index(docs: DataFrame, fields: dict[str, float] | None = None, id_col: str = "id") -> DataFrame:
    """The inverted index as a table: term, id, field, hits, first (position from 1)."""
    fields = fields or FIELDS
    t = docs.select(F.col(id_col).alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), fts_tokens(F.col(f)).alias("tokens")) for f in fields])))
    t = t.select("id", "field", F.posexplode("tokens").alias("pos", "term"))
    return t.groupBy("term", "id", "field").agg(F.count(F.lit(1)).alias("hits"), (F.min("pos") + 1).alias("first"))


@dataclass
class FullText:
    """An inverted index for repeated questions: postings (term, id, field, positions, len) in order of their terms, and statistics of the documents (documents, average).

    ``len`` is the number of tokens of the whole document, so that a question reads the postings of its own words and nothing else.
    """

    postings: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, fields: dict[str, float] | None = None, id_col: str = "id") -> FullText:
        """The postings are ordered by term and id over all files, so a reader skips files and row groups of other words, and a very frequent word is in many files. Null columns are empty."""
        t = keep(spread(docs.select(F.col(id_col).alias("id"), *(fields or FIELDS)), "id").select("id", F.map_from_arrays(F.array(*map(F.lit, fields or FIELDS)), F.array(*[fts_tokens(F.col(f)) for f in fields or FIELDS])).alias("tokens")))
        t = t.withColumn("len", F.aggregate(F.map_values("tokens"), F.lit(0), lambda a, x: a + F.size(x)))
        words = t.select("id", "len", F.explode("tokens").alias("field", "tokens")).select("id", "len", "field", F.posexplode("tokens").alias("pos", "term"))
        p = words.groupBy("term", "id", "field").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.first("len").alias("len"))
        stats = t.agg(F.count(F.lit(1)).alias("documents"), F.avg(F.col("len").cast("double")).alias("average"))
        return cls(p.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), stats)

    def stored(self) -> FullText:
        """The same, written to the checkpoint folder."""
        return FullText(keep(self.postings), keep(self.stats))

    def search(self, query: str, fields: dict[str, float] | None = None, limit: int | None = 100) -> DataFrame:
        """id, score: as ``bm25_search``, from the postings of the query's words."""
        ps = phrases(query)
        spark = self.postings.sparkSession
        if not ps:
            return spark.createDataFrame([], "id long, score double")
        s = self.stats.first()
        weight = spark.createDataFrame(list((fields or FIELDS).items()), "field string, weight double")
        p = self.postings.where(F.col("term").isin(sorted({w for x in ps for w in x}))).join(F.broadcast(weight), "field")
        words = spark.createDataFrame([(i, len(x), k, w) for i, x in enumerate(ps) for k, w in enumerate(x)], "phrase int, size int, offset int, term string")
        at = p.join(F.broadcast(words), "term")
        single = at.where(F.col("size") == 1).select("phrase", "id", "len", (F.col("weight") * F.size("positions")).alias("w"))
        # a phrase stands where all of its words stand at their offsets
        several = at.where(F.col("size") > 1).select("phrase", "size", "id", "len", "field", "weight", F.explode(F.transform("positions", lambda x: x - F.col("offset"))).alias("start"))
        several = several.groupBy("phrase", "size", "id", "len", "field", "weight", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("size")).select("phrase", "id", "len", F.col("weight").alias("w"))
        hits = keep(single.unionByName(several).groupBy("phrase", "id", "len").agg(F.sum("w").alias("h")))
        n = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
        idf = F.greatest(F.log((s["documents"] - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
        part = idf * F.col("h") * (K1 + 1) / (F.col("h") + K1 * (1 - B + B * F.col("len") / F.lit(float(s["average"] or 1.0))))
        # added up in the order of the phrases, as in a pass over the texts
        out = hits.join(F.broadcast(n), "phrase").select("id", F.struct("phrase", part.alias("part")).alias("x")).groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x"))
        out = out.select("id", F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x["part"]), 9).alias("score"))
        return out if limit is None else out.orderBy(F.col("score").desc(), "id").limit(limit)


def substring_search(docs: DataFrame, query: str, columns=("name", "fqn", "docstring", "signature"), limit: int = 100, words: int = 5) -> DataFrame:
    """id, score: one point for each of the query's first five words of three letters or more that occurs in any column, whatever its case. An underscore stands for any character."""
    tokens = [t for t in re.findall(r"[A-Za-z0-9_]{3,}", query)][:words]
    if not tokens:
        return docs.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    has = lambda t: F.greatest(*[F.coalesce(F.col(c).ilike(f"%{t}%"), F.lit(False)).cast("int") for c in columns])
    s = docs.select("id", sum((has(t).cast("double") for t in tokens), F.lit(0.0)).alias("score")).where(F.col("score") > 0)
    return s.orderBy(F.col("score").desc(), "id").limit(limit)


def exact_names(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """id, score: up to ten nodes whose name is the whole query, at a fixed score."""
    return nodes.where(F.col("name") == query).orderBy("id").limit(limit).select("id", F.lit(EXACT_NAME).alias("score"))


def anchor_nodes(nodes: DataFrame, fqns: list[str]) -> DataFrame:
    """id, score: nodes with the given FQNs, at a fixed score."""
    return nodes.where(F.col("fqn").isin(fqns or [None])).select("id", F.lit(ANCHOR).alias("score"))


def lexical_candidates(nodes: DataFrame, query: str, limit: int, anchors: list[str] | None = None, index: FullText | None = None) -> DataFrame:
    """BM25 hits, from an index if there is one, then exact names, then anchors, each only where not found before: id, score."""
    hits = cut(index.search(query, limit=limit) if index is not None else bm25_search(nodes, query, limit=limit))
    for more in (exact_names(nodes, query), anchor_nodes(nodes, anchors or [])):
        hits = hits.unionByName(more.join(hits, "id", "left_anti"))
    return hits


def expand_query(nodes: DataFrame, query: str, per_name: int = 3) -> DataFrame:
    """name, fqn, file_path: nodes whose name is a word of the query, up to three for each word, in order of id. Their FQNs are anchors of the search."""
    names = list(dict.fromkeys(re.findall(r"[A-Za-z][A-Za-z0-9_]{2,}", query)))
    w = Window.partitionBy("name").orderBy("id")
    return nodes.where(F.col("name").isin(names or [None])).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_name).select("name", "fqn", "file_path", "rn")


def path_words(anchors: DataFrame, limit: int = 10) -> DataFrame:
    """word: words of three letters or more from the paths of a query's anchors, the first file of each name, each word once."""
    t = anchors.where(F.col("rn") == 1).select("name", F.posexplode(F.split(F.regexp_replace("file_path", r"[^A-Za-z0-9_]+", " "), " ")).alias("pos", "word")).where(F.length("word") >= 3)
    return t.groupBy("word").agg(F.min(F.struct("name", "pos")).alias("at")).orderBy("at").limit(limit).select("word")


def resolve_symbols(nodes: DataFrame, names: list[str], file_hint: str | None = None, kind: str | None = None, limit: int = 5) -> DataFrame:
    """asked, id, fqn, kind, file_path, exact: up to five nodes with each name (and file and kind if given); for names without any, nodes with the name within their FQN, filters not applied."""
    asked = nodes.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "asked string")
    keep = F.lit(True)
    if file_hint:
        keep = keep & F.col("file_path").contains(file_hint)
    if kind:
        keep = keep & (F.col("kind") == kind)
    cols = ["id", "fqn", "kind", "file_path"]
    a = F.broadcast(asked)
    exact = nodes.where(keep).join(a, F.col("name") == F.col("asked")).select("asked", *cols, F.lit(True).alias("exact"))
    rest = asked.join(exact.select("asked").distinct(), "asked", "left_anti")
    loose = nodes.join(F.broadcast(rest), F.col("fqn").contains(F.col("asked"))).select("asked", *cols, F.lit(False).alias("exact"))
    w = Window.partitionBy("asked").orderBy("id")
    return exact.unionByName(loose).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")
