"""Sparse and dense vectors: TF-IDF, cosine, encoding."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import dot, norm, vector_terms
from sextant.operators.skew import heavy_counts, skew_join
from sextant.session import cut, keep

MIN_DF, MAX_TERMS = 2, 20_000


def embedding_text(nodes: DataFrame) -> Column:
    """Name, FQN, signature, docstring and body, those that aren't empty, with blanks between."""
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "fqn", "signature", "docstring", "body_preview")])


def term_counts(docs: DataFrame, text: Column, id_col: str = "id") -> DataFrame:
    """id, term, n."""
    return docs.select(F.col(id_col).alias("id"), F.explode(vector_terms(text)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


def tfidf_vocabulary(counts: DataFrame, total: Column, min_df: int = MIN_DF, max_terms: int = MAX_TERMS) -> DataFrame:
    """term, df, idf: terms in at least ``min_df`` documents, the ``max_terms`` most frequent by corpus count (ties by term); idf = ln((1 + N) / (1 + df)) + 1."""
    v = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf")).where(F.col("df") >= min_df)
    v = v.orderBy(F.col("cf").desc(), "term").limit(max_terms)
    return v.select("term", "df", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_fit(docs: DataFrame, text: Column, id_col: str = "id", min_df: int = MIN_DF, max_terms: int = MAX_TERMS) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, vectors): vectors are id, term, weight with tf = 1 + ln(n), times idf, of length one.

    The vocabulary has at most ``max_terms`` rows and is broadcast. A document without a term of it has no rows; without any term both are empty.
    """
    # written once: the vocabulary and the vectors both need them
    counts = keep(term_counts(docs, text, id_col))
    vocab = cut(tfidf_vocabulary(counts, docs.agg(F.count(F.lit(1))).scalar(), min_df, max_terms))
    w = counts.join(F.broadcast(vocab), "term").select("id", "term", ((1 + F.log(F.col("n").cast("double"))) * F.col("idf")).alias("w"))
    lengths = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return vocab, w.join(lengths, "id").select("id", "term", (F.col("w") / F.col("len")).alias("weight"))


def query_vector(vocab: DataFrame, query: str) -> DataFrame:
    """term, q: a text as a vector of length one over a vocabulary."""
    n: dict[str, int] = {}
    for t in re.findall(r"[^\W]+", query.lower()):
        if re.fullmatch(r"[a-z_]\w{2,}", t):
            n[t] = n.get(t, 0) + 1
    rows = vocab.sparkSession.createDataFrame([(t, 1 + math.log(c)) for t, c in n.items()], "term string, tf double")
    w = vocab.join(F.broadcast(rows), "term").select("term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(w.agg(F.sum(F.col("w") * F.col("w"))).scalar())
    return w.select("term", (F.col("w") / length).alias("q"))


def tfidf_scores(vocab: DataFrame, vectors: DataFrame, query: str) -> DataFrame:
    """id, score: cosine of every document that shares a term with the query. The query's few terms are broadcast."""
    return vectors.join(F.broadcast(query_vector(vocab, query)), "term").groupBy("id").agg(F.sum(F.col("q") * F.col("weight")).alias("score"))


def newest_dense(dense: DataFrame) -> DataFrame:
    """id, vector, length: of each node the vector of the row with the greatest updated_at; null, empty and all-zero vectors are left out."""
    d = dense.where(F.col("node_id").isNotNull()).groupBy(F.col("node_id").alias("id")).agg(F.max(F.struct("updated_at", "vector"))["vector"].alias("vector"))
    return d.where(F.size("vector") > 0).withColumn("length", norm(F.col("vector"))).where(F.col("length") > 0)


def dense_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """id, score: cosine of each vector with the query's; vectors of another length are left out."""
    size = math.sqrt(sum(x * x for x in query))
    q = F.array(*[F.lit(float(x) / size) for x in query]) if size else F.array()
    return vectors.where(F.size("vector") == len(query)).select("id", (dot(F.col("vector"), q) / F.col("length")).alias("score"))


class HashingEncoder:
    """A deterministic encoder that needs no model: words hashed into signed cells, of length one. The default where no model is plugged in."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), dtype=np.float32)
        for r, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[r, h % self.size] += 1 if h & 0x10000 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


#: Encoders by name: how to make one, and the length of its vectors.
ENCODERS: dict[str, tuple[Callable, int]] = {"hashing-64": (HashingEncoder, 64), "hashing-256": (partial(HashingEncoder, 256), 256)}


def register_encoder(name: str, make: Callable, size: int) -> None:
    """Make an encoder known by a name; ``make`` is called once in each worker."""
    ENCODERS[name] = (make, size)


def encoder_available(name: str) -> bool:
    """Whether an encoder is known and can be made here."""
    try:
        return name in ENCODERS and ENCODERS[name][0]() is not None
    except Exception:  # noqa: BLE001 - a missing model or library is the answer
        return False


def encode_text(make: Callable[[], Callable[[list[str]], np.ndarray]] = HashingEncoder, batch: int = 64):
    """A column function from text to array<float>; the encoder is made once for each worker and called in batches."""

    @F.pandas_udf("array<float>")
    def run(batches: "pd.Series") -> "pd.Series":
        enc = make()
        out: list = []
        for s in range(0, len(batches), batch):
            out += list(enc([x or "" for x in batches.iloc[s : s + batch]]))
        return pd.Series(out)

    return run


def dense_build(nodes: DataFrame, make=HashingEncoder, model_name: str = "hashing-64", changed: DataFrame | None = None) -> DataFrame:
    """node_id, vector, model_name: vectors of all nodes, or of those in ``changed`` (id)."""
    n = nodes if changed is None else nodes.join(changed.select("id").distinct(), "id", "left_semi")
    return n.select(F.col("id").alias("node_id"), encode_text(make)(embedding_text(n)).alias("vector"), F.lit(model_name).alias("model_name"))


def sparse_json(vectors: DataFrame) -> DataFrame:
    """node_id, vector_json: sparse vectors as JSON maps, terms in order."""
    m = vectors.groupBy(F.col("id").alias("node_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "weight")))).alias("m"))
    return m.select("node_id", F.to_json("m").alias("vector_json"))


def sparse_from_json(rows: DataFrame) -> DataFrame:
    """id, term, weight of JSON maps; unreadable ones have no rows."""
    ok = rows.where(F.get_json_object("vector_json", "$").isNotNull())
    return ok.select(F.col("node_id").alias("id"), F.explode(F.from_json("vector_json", "map<string,double>")).alias("term", "weight"))


def idf_join(counts: DataFrame, df: DataFrame) -> DataFrame:
    """Counts with their document frequencies; frequent terms are joined in salted parts."""
    heavy = heavy_counts(df.select("term", F.col("df").alias("__n")), ["term"])
    return skew_join(counts, df, ["term"], heavy=heavy)
