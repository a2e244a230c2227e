"""Most similar vectors for every vector, by a permutation index.

Every vector is represented by the order of its nearest pivots. It is posted in the inverted files of its first
pivots. Vectors in the same file are compared by the footrule distance of their orders; those near enough are
reranked, first by a sketch that travels with the posting, then by the exact cosine.

Pivots are spread over space: of those drawn from the data the ones very near another are left out, so that a dense region isn't cut into pieces
whose orders have nothing in common. In how many files a vector is posted and how great a footrule distance is still
looked at is measured: the true neighbours of a sample, found by brute force, must be reached. The sketch is what is left of a vector without its
nearest pivot, on a scale of its own, so it tells the members of a dense region apart as well as any others.

Without a least cosine, every vector keeps the nearest of all that share a file with it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.skew import skew_join
from sextant.session import cut

#: Pivots in an order that footrule distances compare; pivots of an order that are kept; files in which a vector is posted at least.
PREFIX, DEPTH, LISTS = 8, 16, 4
#: Least bound of the footrule distance of a candidate; PREFIX * (PREFIX + 1) = 72 is that of orders without a common pivot.
FOOTRULE = 52
#: The sketch's cosine may be this much lower than the wanted one. Its error is under 0.01.
SKETCH_SLACK = 0.03
#: Candidates kept for a vector beyond the wanted number, and the share of the distance within which sketches are taken as equal (the smaller id first).
SPARE, SAME = 4, 0.004
#: Pivots: about 4 * sqrt(rows), at least and at most these. They are a bounded sample; every row is indexed. With the most, files grow beyond 4 billion rows.
MIN_PIVOTS, MAX_PIVOTS = 64, 1 << 18
#: Without a least cosine, a pivot is left out if an earlier one has this cosine or more with it; with one, if it has at least that.
SAME_PIVOT = 0.95
#: A file with more postings than this is divided into blocks, and every two blocks are compared as a task of their own.
BLOCK = 4096
#: Sampled vectors of each length. With a least cosine: the share of their true neighbours that must be reached by files and by footrule distance,
#: the share below which the index is given up for comparing all, and the number of neighbours below which nothing is concluded.
TRIED, REACHED_NEAR, GIVEN_UP, ENOUGH = 512, 0.99, 0.95, 10
#: Without a least cosine: longest order, sampled vectors of each length, and the share of their true neighbours that must share a file with them.
LONG, SAMPLE, REACHED = 32, 256, 0.93
#: Cosines in float32 may be this much off; within it candidates are compared by float64.
SINGLE = 1e-6


def pivot_count(rows: int) -> int:
    """The power of two next to 4 * sqrt(rows), within the bounds."""
    return int(min(MAX_PIVOTS, max(MIN_PIVOTS, 2 ** round(math.log2(4 * math.sqrt(max(rows, 1)))))))


def spread_out(pivots: np.ndarray, near: float) -> np.ndarray:
    """Of unit rows those that have a cosine of less than ``near`` with every earlier one that is kept."""
    kept = pivots[:0]
    for s in range(0, len(pivots), 512):
        part = pivots[s : s + 512]
        part = part[(part @ kept.T).max(axis=1, initial=-1) < near]
        close = np.triu(part @ part.T >= near, 1)
        take = np.ones(len(part), bool)
        for i in range(len(part)):
            if take[i]:
                take &= ~close[i]
        kept = np.vstack([kept, part[take]])
    return kept


def choose_pivots(vectors: DataFrame, id_col: str, vec_col: str, rows: int, near: float = SAME_PIVOT) -> dict[int, np.ndarray]:
    """Unit pivots by vector length: rows whose id has a small hash, at most twice the wanted number, without those very near another; for lengths with too few, unit axes are added."""
    p = pivot_count(rows)
    share = min(1.0, p / max(rows, 1))
    h = F.xxhash64(id_col)
    picked = vectors.where(h.cast("double") <= F.lit((share - 0.5) * 2.0**64)).orderBy(h, F.xxhash64(vec_col)).limit(2 * p).select(vec_col).toPandas()[vec_col]
    by: dict[int, list] = {}
    for v in picked:
        if v is not None and len(v):
            a = np.asarray(v, dtype=np.float64)
            n = np.linalg.norm(a)
            if np.isfinite(n) and n > 0:
                by.setdefault(len(a), []).append(a / n)
    return {d: spread_out(np.asarray(v, dtype=np.float32), near) for d, v in by.items()}


def _with_axes(pivots: dict[int, np.ndarray], d: int) -> np.ndarray:
    have = pivots.get(d)
    if have is None or len(have) < 2 * PREFIX:
        axes = np.eye(min(d, 2 * PREFIX), d, dtype=np.float32)
        have = axes if have is None else np.vstack([have, axes])
        pivots[d] = have
    return have


def orders(m: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each unit row, nearest first, as int32; padded with -1 where there are fewer."""
    out = np.full((len(m), prefix), -1, dtype=np.int32)
    k = min(prefix, len(pivots))
    step = max(16, min(2048, (1 << 22) // max(len(pivots), 1)))
    for s in range(0, len(m), step):
        sim = m[s : s + step] @ pivots.T
        idx = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < sim.shape[1] else np.tile(np.arange(k), (len(sim), 1))
        near = np.take_along_axis(sim, idx, 1)
        out[s : s + step, :k] = np.take_along_axis(idx, np.lexsort((idx, -near), axis=1), 1)
    return out


def sketches(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of bytes for unit rows: their part along the nearest pivot, a scale, and the rest as whole numbers of that scale."""
    along = np.einsum("ij,ij->i", m, first)
    rest = m - along[:, None] * first
    scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
    head = np.stack([along, scale], 1).astype(np.float32)
    return np.hstack([head.view(np.int8).reshape(len(m), 8), np.rint(rest / scale[:, None]).astype(np.int8)])


def from_sketches(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Unit rows that the sketches stand for."""
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    m = head[:, :1] * first + head[:, 1:] * raw[:, 8:].astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Footrule distances of truncated orders, all of a against all of b: the sum over pivots of |place in a - place in b|, an absent pivot being in place PREFIX."""
    n = a.shape[1]
    same = np.zeros((len(a), len(b)), dtype=np.int8)
    for i in range(n):
        col = a[:, i, None]
        for j in range(n):
            same += (col == b[None, :, j]).view(np.int8) * np.int8(n - max(i, j))
    return n * (n + 1) - 2 * same.astype(np.int16)


def _by_length(vec: pa.Array):
    """(rows, length, vectors, greatest absolute values) of each length of vector in an array of lists; null, all-zero and not finite ones are left out."""
    lengths = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        m = flat[(starts[at][:, None] + np.arange(d)[None, :])]
        top = np.abs(m).max(axis=1)
        ok = np.isfinite(top) & (top > 0)
        if ok.any():
            yield at[ok], int(d), m[ok], top[ok]


def _index_rows(pivots: dict[int, np.ndarray]):
    schema = pa.schema([("id", pa.int64()), ("at", pa.timestamp("us", "UTC")), ("h", pa.int64()), ("dim", pa.int32()), ("perm", pa.binary()), ("sketch", pa.binary())])
    width = _width(pivots)

    def run(batches):
        for b in batches:
            vec, size = b.column(3), len(b)
            lengths = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            perm, sketch = [None] * size, [None] * size
            for at, d, m, top in _by_length(vec):
                m = m / top[:, None]
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
                p = _with_axes(pivots, d)
                o = orders(m, p, DEPTH)
                for r, x, y in zip(at, o.astype(width), sketches(m, p[o[:, 0]])):
                    perm[r], sketch[r] = x.tobytes(), y.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(schema.field(1).type), b.column(2), pa.array(lengths, pa.int32()), pa.array(perm, pa.binary()), pa.array(sketch, pa.binary())], schema=schema)

    return run


def _width(pivots: dict[int, np.ndarray]):
    """The narrowest type for numbers of pivots; those that are missing become its greatest number."""
    return np.uint16 if max(map(len, pivots.values()), default=0) + 2 * PREFIX < 65535 else np.uint32


def _rows(perm, sketch, dim: int, pivots: dict[int, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, unit rows) of Arrow columns of one length of vector; ``n`` pivots in each order."""
    o = np.frombuffer(b"".join(perm.to_pylist()), dtype=_width(pivots)).reshape(-1, n)
    raw = np.frombuffer(b"".join(sketch.to_pylist()), dtype=np.int8).reshape(len(o), dim + 8)
    return o, from_sketches(raw, _with_axes(pivots, dim)[o[:, 0]])


class Near:
    """How near unit rows are: cosine - 1, as half the squared distance of rows taken from their middle, so that in a dense region small differences are not lost."""

    OUT = np.float32(-9)

    def __init__(self, *rows: np.ndarray):
        middle = np.vstack(rows).mean(axis=0, dtype=np.float64) if sum(map(len, rows)) else 0.0
        self.rows = [(r - middle).astype(np.float32) for r in rows]
        self.half = [np.einsum("ij,ij->i", r, r) / 2 for r in self.rows]
        #: Scores may be this much off.
        self.off = np.float32(4e-7) * max((h.max(initial=0) for h in self.half), default=0)

    def scores(self, a: int, at, b: int, to) -> np.ndarray:
        out = self.rows[a][at] @ self.rows[b][to].T
        out -= self.half[a][at][:, None]
        out -= self.half[b][to][None, :]
        return out

    def best(self, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the ``k`` greatest of each row, without what is OUT; among those that sketches can't tell apart the first columns."""
        some = score > -3
        over = np.count_nonzero(some, axis=1) > k
        if not over.any():
            return np.nonzero(some)
        kth = np.full(len(score), -3, np.float32)
        kth[over] = np.partition(score[over], -k, axis=1)[:, -k]
        tie = np.where(over, self.off - SAME * kth, 0).astype(np.float32)
        sure = score > (kth + tie)[:, None]
        band = (score >= (kth - tie)[:, None]) & ~sure & over[:, None]
        room = k - np.count_nonzero(sure, axis=1)
        return np.nonzero(sure | (band & (np.cumsum(band, axis=1, dtype=np.int32) <= room[:, None])))


def measured_bounds(reps: DataFrame, pivots: dict[int, np.ndarray], k: int, floor: float) -> dict[int, tuple[int, int]]:
    """(files, footrule distance) for each length of vector, as a sample's true neighbours of at least ``floor`` ask for.

    About ``TRIED`` vectors of each length are sent to all tasks and compared with every vector. At least LISTS files and FOOTRULE; (0, no bound) where even the whole order
    reaches too few: then all vectors of that length are compared.
    """
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}
    if not sizes:
        return {}
    spark = reps.sparkSession
    share = spark.createDataFrame([(d, min(1.0, TRIED / n)) for d, n in sizes.items()], "dim int, share double")
    picked = reps.join(F.broadcast(share), "dim").where(F.xxhash64("rep", F.lit("tried")).cast("double") <= (F.col("share") - 0.5) * 2.0**64).select("dim", "rep", "perm", "sketch").toArrow()
    shared = spark.sparkContext.broadcast(pivots)
    tried = {}
    for d in sizes:
        t = picked.filter(pa.array(picked.column("dim").to_numpy() == d))
        if len(t):
            o, u = _rows(t.column("perm"), t.column("sketch"), d, pivots, DEPTH)
            tried[d] = (t.column("rep").to_numpy(), o, u)
    schema = pa.schema([("dim", pa.int32()), ("rep", pa.int64()), ("score", pa.float32()), ("to", pa.int64()), ("perm", pa.binary())])

    def run(batches):
        for b in batches:
            dims = b.column(0).to_numpy()
            for d in map(int, np.unique(dims)):
                if d not in tried:
                    continue
                t = b.filter(pa.array(dims == d))
                ids, _, u = tried[d]
                _, v = _rows(t.column(2), t.column(3), d, shared.value, DEPTH)
                to = t.column(1).to_numpy()
                near = Near(u, v)
                score = near.scores(0, slice(None), 1, slice(None))
                score[(score < floor - SKETCH_SLACK - 1) | (ids[:, None] == to[None, :])] = near.OUT
                x, y = near.best(score, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d), pa.int32()), pa.array(ids[x]), pa.array(score[x, y]), t.column(1).take(pa.array(y)), t.column(2).take(pa.array(y)).cast(pa.binary())], schema=schema)

    true = reps.select("dim", "rep", "perm", "sketch").mapInArrow(run, "dim int, rep long, score float, to long, perm binary")
    true = true.where(F.col("score") >= floor - 1).withColumn("__r", F.row_number().over(Window.partitionBy("rep").orderBy(F.col("score").desc(), "to"))).where(F.col("__r") <= k).collect()
    own = {(d, int(i)): o for d, (ids, os, _) in tried.items() for i, o in zip(ids, os)}
    files, moves = {}, {}
    for r in true:
        a, b = own[r.dim, r.rep], np.frombuffer(bytes(r.perm), dtype=_width(pivots))
        files.setdefault(r.dim, []).append(_first_shared(a.tolist(), b.tolist(), DEPTH))
        moves.setdefault(r.dim, []).append(int(footrule(a[None, :PREFIX], b[None, :PREFIX])[0, 0]))
    none = PREFIX * (PREFIX + 1)
    out = {d: (LISTS, FOOTRULE) for d in sizes}
    for d, f in files.items():
        if len(f) >= ENOUGH:
            reached = [sum(x <= n for x in f) / len(f) for n in range(DEPTH + 1)]
            lists = next((n for n in range(LISTS, DEPTH + 1) if reached[n] >= REACHED_NEAR), DEPTH)
            out[d] = (0, none) if reached[DEPTH] < GIVEN_UP else (lists, max(FOOTRULE, int(np.sort(moves[d])[math.ceil(REACHED_NEAR * len(f)) - 1])))
    return out


def _postings(pivots: dict[int, np.ndarray], bounds: dict[int, tuple[int, int]]):
    """The rows once for each of their files; one file for lengths that are compared whole. Of the order its beginning travels along."""
    missing, width = np.iinfo(_width(pivots)).max, np.dtype(_width(pivots)).itemsize

    def run(batches):
        for b in batches:
            dims = b.column(0).to_numpy()
            for d in map(int, np.unique(dims)):
                t = b.filter(pa.array(dims == d))
                o = np.frombuffer(b"".join(t.column(2).to_pylist()), dtype=_width(pivots)).reshape(len(t), DEPTH)
                n = bounds[d][0]
                file = o[:, :n].astype(np.int64) if n else np.zeros((len(t), 1), np.int64)
                row, at = np.nonzero(file != missing)
                head = pa.array([x[: PREFIX * width] for x in t.column(2).to_pylist()], pa.binary())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([t.column(0).take(take), pa.array(file[row, at]), t.column(1).take(take), head.take(take), t.column(3).take(take).cast(pa.binary())], names=["dim", "file", "rep", "perm", "sketch"])

    return run


def _files(pivots: dict[int, np.ndarray], bounds: dict[int, tuple[int, int]]):
    """dim, file, n: how many rows of a batch are posted in each file."""
    missing = np.iinfo(_width(pivots)).max

    def run(batches):
        for b in batches:
            dims = b.column(0).to_numpy()
            for d in map(int, np.unique(dims)):
                perm = b.column(1).filter(pa.array(dims == d)).to_pylist()
                n = bounds[d][0]
                o = np.frombuffer(b"".join(perm), dtype=_width(pivots)).reshape(len(perm), DEPTH)[:, :n].astype(np.int64) if n else np.zeros((len(perm), 1), np.int64)
                file, count = np.unique(o[o != missing], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(file), d), pa.int32()), pa.array(file), pa.array(count)], names=["dim", "file", "n"])

    return run


def _compare(pivots, bounds: dict[int, tuple[int, int]], floor: float, k: int):
    out = pa.schema([("rep", pa.int64()), ("to", pa.int64()), ("score", pa.float32())])

    def run(key, t):
        dim, b1, b2 = key[0].as_py(), key[2].as_py(), key[3].as_py()
        limit = bounds[dim][1]
        t = t.sort_by("rep")
        rep, block = t.column("rep").to_numpy(), t.column("block").to_numpy()
        perm, u = _rows(t.column("perm"), t.column("sketch"), dim, pivots.value, PREFIX)
        near = Near(u)
        left, right = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
        parts = []
        for a, b in [(left, right)] if b1 == b2 else [(left, right), (right, left)]:
            for s in range(0, len(a), 256):
                ai = a[s : s + 256]
                score = near.scores(0, ai, 0, b)
                score[(score < floor - SKETCH_SLACK - 1) | (rep[ai][:, None] == rep[b][None, :])] = near.OUT
                if limit < PREFIX * (PREFIX + 1):
                    score[footrule(perm[ai], perm[b]) > limit] = near.OUT
                x, y = near.best(score, k)
                parts.append((rep[ai[x]], rep[b[y]], score[x, y]))
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)]
        return pa.Table.from_arrays([pa.array(c) for c in cols], schema=out)

    return run


def newest_orders(vectors: DataFrame, id_col: str, vec_col: str, newer: str, near: float) -> tuple[DataFrame, DataFrame, dict[int, np.ndarray]]:
    """(raw, latest, pivots): the input as id, at, v, and of each id the order of the row with the greatest ``at``, written once.

    Ids whose newest vector is null, all zero or not finite are left out of ``latest``. The vectors themselves are not shuffled.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(newer).cast("timestamp").alias("at"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull())
    pivots = choose_pivots(raw, "id", "v", raw.select("id").count(), near)
    indexed = raw.select("id", "at", F.xxhash64("v").alias("h"), "v").mapInArrow(_index_rows(pivots), "id long, at timestamp, h long, dim int, perm binary, sketch binary")
    newest = indexed.groupBy("id").agg(F.max(F.struct("at", "h", "dim", "perm", "sketch")).alias("s")).select("id", "s.*")
    return raw, cut(newest.where(F.col("perm").isNotNull())), pivots


def candidate_pairs(reps: DataFrame, pivots: dict[int, np.ndarray], bounds: dict[int, tuple[int, int]], floor: float, k: int) -> DataFrame:
    """rep, to: for each representative the nearest by sketch, at most k + SPARE, of those that meet it in a file and are near by footrule distance.

    Only so many are kept already while comparing, in every file and every two blocks, so that a dense region never gives all its pairs. Long files are divided
    into blocks; the table of their sizes has one row per file, of which there are at most 2 * MAX_PIVOTS for each length of vector, and is broadcast.
    """
    shared = reps.sparkSession.sparkContext.broadcast(pivots)
    posted = reps.select("dim", "rep", "perm", "sketch").mapInArrow(_postings(pivots, bounds), "dim int, file long, rep long, perm binary, sketch binary")
    sizes = reps.select("dim", "perm").mapInArrow(_files(pivots, bounds), "dim int, file long, n long").groupBy("dim", "file").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    p = posted.join(F.broadcast(sizes), ["dim", "file"])
    p = p.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    p = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p = p.select("dim", "file", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "rep", "perm", "sketch")
    met = p.groupBy("dim", "file", "b1", "b2").applyInArrow(_compare(shared, bounds, floor, k + SPARE), "rep long, to long, score float")
    # two that meet in several files come out of each of them
    once = met.groupBy("rep", "to").agg(F.max("score").alias("score"))
    return once.withColumn("__r", F.row_number().over(Window.partitionBy("rep").orderBy(F.col("score").desc(), "to"))).where(F.col("__r") <= k + SPARE).select("rep", "to")


def similar_links(raw: DataFrame, candidates: DataFrame, floor: float) -> DataFrame:
    """rep_a < rep_b, cosine: the candidates with exact cosine >= ``floor``. Only the vectors of candidates are kept after one shuffle."""
    pairs = cut(candidates.select(F.least("rep", "to").alias("rep_a"), F.greatest("rep", "to").alias("rep_b")).distinct())
    ids = pairs.select(F.col("rep_a").alias("rep")).unionByName(pairs.select(F.col("rep_b").alias("rep"))).distinct()
    v = raw.join(ids, F.col("id") == F.col("rep"), "left_semi").groupBy("id").agg(F.max(F.struct("at", "v"))["v"].alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    u = cut(v.withColumn("n", norm))
    a, b = u.select(F.col("id").alias("rep_a"), F.col("v").alias("va"), F.col("n").alias("na")), u.select(F.col("id").alias("rep_b"), F.col("v").alias("vb"), F.col("n").alias("nb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(a, "rep_a").join(b, "rep_b").select("rep_a", "rep_b", (dot / (F.col("na") * F.col("nb"))).alias("cosine")).where(F.col("cosine") >= floor)


def _file_rows(pivots: dict[int, np.ndarray]):
    schema = pa.schema([("id", pa.int64()), ("at", pa.timestamp("us", "UTC")), ("h", pa.int64()), ("dim", pa.int32()), ("files", pa.list_(pa.int32())), ("vec", pa.binary())])

    def run(batches):
        for b in batches:
            files, vec = [None] * len(b), [None] * len(b)
            for at, d, m, top in _by_length(b.column(3)):
                u = m / top[:, None]
                o = orders(u / np.linalg.norm(u, axis=1, keepdims=True), _with_axes(pivots, d), LONG)
                for r, x, y in zip(at, o, m):
                    files[r], vec[r] = x[x >= 0], y.tobytes()
            lengths = b.column(3).value_lengths().fill_null(0).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(schema.field(1).type), b.column(2), lengths, pa.array(files, pa.list_(pa.int32())), pa.array(vec, pa.binary())], schema=schema)

    return run


def newest_files(vectors: DataFrame, id_col: str, vec_col: str, newer: str) -> DataFrame:
    """id, h, dim, files, vec: of each id the whole order (at most ``LONG``) and the vector of the row with the greatest ``at``, written once; left out as in ``newest_orders``."""
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(newer).cast("timestamp").alias("at"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull())
    pivots = choose_pivots(raw, "id", "v", raw.select("id").count())
    indexed = raw.select("id", "at", F.xxhash64("v").alias("h"), "v").mapInArrow(_file_rows(pivots), "id long, at timestamp, h long, dim int, files array<int>, vec binary")
    newest = indexed.groupBy("id").agg(F.max(F.struct("at", "h", "dim", "files", "vec")).alias("s")).select("id", "s.*")
    return cut(newest.where(F.col("vec").isNotNull()).drop("at"))


def _units(vec: pa.ChunkedArray, dim: int) -> np.ndarray:
    m = np.frombuffer(b"".join(vec.to_pylist()), dtype=np.float32).reshape(len(vec), dim).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def top_k(u: np.ndarray, ids: np.ndarray, v: np.ndarray, to: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of u, row of v, cosine): of each unit row of u the ``k`` of v with the greatest cosine (9 places), ties to the smaller id, its own id left out."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    v32 = v.astype(np.float32)
    for s in range(0, len(u), 128):
        a = u[s : s + 128]
        sim = a.astype(np.float32) @ v32.T
        sim[ids[s : s + 128, None] == to[None, :]] = -2
        kth = np.partition(sim, -k, axis=1)[:, -k] if k < sim.shape[1] else np.full(len(a), -1.5)
        x, y = np.nonzero(sim >= np.maximum(kth - SINGLE, -1.5)[:, None])
        cos = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", a[x[i : i + 65536]], v[y[i : i + 65536]]) for i in range(0, len(x), 65536))]).round(9)
        o = np.lexsort((to[y], -cos, x))
        x, y, cos = x[o], y[o], cos[o]
        keep = np.arange(len(x)) - np.searchsorted(x, x) < k
        out.append((x[keep] + s, y[keep], cos[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _first_shared(a: list[int], b: list[int], most: int = LONG) -> int:
    """In how many files both must be posted to meet; ``most`` + 1 if they never do."""
    at = {f: i for i, f in enumerate(b)}
    return min((max(i, at[f]) + 1 for i, f in enumerate(a) if f in at), default=most + 1)


def wanted_lists(reps: DataFrame, k: int) -> dict[int, int]:
    """For each length of vector the number of files in which ``REACHED`` of the true ``k`` nearest of a sample share one with it; 0 if no number does.

    About ``SAMPLE`` vectors of each length are sent to all tasks and compared with every vector.
    """
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}
    if not sizes:
        return {}
    spark = reps.sparkSession
    share = spark.createDataFrame([(d, min(1.0, SAMPLE / n)) for d, n in sizes.items()], "dim int, share double")
    picked = reps.join(F.broadcast(share), "dim").where(F.xxhash64("rep", F.lit("sample")).cast("double") <= (F.col("share") - 0.5) * 2.0**64).select("dim", "rep", "files", "vec").collect()
    sample: dict[int, list] = {}
    for r in picked:
        sample.setdefault(r.dim, []).append(r)
    units = {d: (np.array([r.rep for r in rs], np.int64), _units(pa.array([bytes(r.vec) for r in rs], pa.binary()), d)) for d, rs in sample.items()}
    schema = pa.schema([("dim", pa.int32()), ("rep", pa.int64()), ("cosine", pa.float64()), ("to", pa.int64()), ("files", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            dims = b.column(0).to_numpy()
            for d in np.unique(dims):
                if int(d) not in units:
                    continue
                t = b.filter(pa.array(dims == d))
                ids, u = units[int(d)]
                x, y, cos = top_k(u, ids, _units(t.column(3), int(d)), t.column(1).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d), pa.int32()), pa.array(ids[x]), pa.array(cos), t.column(1).take(pa.array(y)), t.column(2).take(pa.array(y)).cast(schema.field(4).type)], schema=schema)

    true = reps.select("dim", "rep", "files", "vec").mapInArrow(run, "dim int, rep long, cosine double, to long, files array<int>")
    true = true.withColumn("__r", F.row_number().over(Window.partitionBy("rep").orderBy(F.col("cosine").desc(), "to"))).where(F.col("__r") <= k).collect()
    own = {r.rep: r.files for r in picked}
    depths: dict[int, list[int]] = {}
    for r in true:
        depths.setdefault(r.dim, []).append(_first_shared(own[r.rep], r.files))
    # a length of which nothing was sampled is compared whole
    out = {d: 0 for d in sizes}
    for d, f in depths.items():
        need = int(np.sort(f)[math.ceil(REACHED * len(f)) - 1])
        out[d] = need if need <= LONG else 0
    return out


def _nearest_here(k: int):
    out = pa.schema([("rep", pa.int64()), ("to", pa.int64()), ("cosine", pa.float64())])

    def run(key, t):
        b1, b2 = key[2].as_py(), key[3].as_py()
        rep, block, u = t.column("rep").to_numpy(), t.column("block").to_numpy(), _units(t.column("vec"), key[0].as_py())
        left, right = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
        parts = []
        for a, b in [(left, right)] if b1 == b2 else [(left, right), (right, left)]:
            if len(a) and len(b):
                x, y, cos = top_k(u[a], rep[a], u[b], rep[b], k)
                parts.append(pa.Table.from_arrays([pa.array(rep[a][x]), pa.array(rep[b][y]), pa.array(cos)], schema=out))
        return pa.concat_tables(parts) if parts else out.empty_table()

    return run


def nearest_links(reps: DataFrame, k: int) -> DataFrame:
    """rep, to, cosine: of each representative the ``k`` nearest of those with which it shares one of its first files, as many as ``wanted_lists`` says."""
    lists = wanted_lists(reps, k)
    n = reps.sparkSession.createDataFrame(list(lists.items()), "dim int, lists int")
    p = reps.join(F.broadcast(n), "dim").select("dim", "rep", "vec", F.explode(F.when(F.col("lists") == 0, F.array(F.lit(0))).otherwise(F.slice("files", 1, F.greatest("lists", F.lit(1))))).alias("file"))
    sizes = p.groupBy("dim", "file").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    p = p.join(F.broadcast(sizes), ["dim", "file"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    p = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p = p.select("dim", "file", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "rep", "vec")
    met = p.groupBy("dim", "file", "b1", "b2").applyInArrow(_nearest_here(k), "rep long, to long, cosine double")
    # two that meet in several files come out of each of them
    once = met.repartition("rep").dropDuplicates(["rep", "to"])
    return once.withColumn("__r", F.row_number().over(Window.partitionBy("rep").orderBy(F.col("cosine").desc(), "to"))).where(F.col("__r") <= k).drop("__r")


def nearest_neighbours(vectors: DataFrame, id_col: str = "node_id", vec_col: str = "vector", newer: str = "updated_at", k: int = 5, floor: float | None = 0.9, exact: bool = False) -> DataFrame:
    """node, neighbour, cosine, rank: of every node its ``k`` most similar nodes, as far as their cosine is at least ``floor``; with None whatever it is.

    Of each node only the row with the greatest ``newer`` counts (ties: the greater vector hash, repeated rows count once). Vectors of
    different lengths are not compared; null, all-zero and not finite vectors and null ids have no neighbours. Ties of the cosine go
    to the smaller id. An empty table gives no rows; other columns are ignored.

    Nodes with exactly the same vector are one representative in the index, with copies as neighbours of each other at
    cosine 1; a group of copies with a third of all rows therefore costs no more than its size. The index is approximate (recall is measured
    in the tests), the cosines are exact. With ``exact`` every vector is compared with all of its length, block by block.
    """
    if floor is None and not exact:
        latest = newest_files(vectors, id_col, vec_col, newer)
        groups = cut(latest.groupBy("h", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("files").alias("files"), F.max("vec").alias("vec")))
        near = cut(nearest_links(groups.select("dim", "rep", "files", "vec"), k))
    else:
        least = -1.0 if floor is None else floor
        raw, latest, pivots = newest_orders(vectors, id_col, vec_col, newer, SAME_PIVOT if floor is None else floor)
        groups = cut(latest.groupBy("h", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("perm").alias("perm"), F.max("sketch").alias("sketch")))
        whole = {r.dim: (0, PREFIX * (PREFIX + 1)) for r in groups.select("dim").distinct().collect()} if exact else None
        bounds = whole or measured_bounds(groups, pivots, k, least)
        links = cut(similar_links(raw, candidate_pairs(groups, pivots, bounds, least, k), least))
        near = links.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("to"), "cosine").unionByName(links.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("to"), "cosine"))
    several = groups.where(F.col("n") > 1)
    near = near.unionByName(several.select("rep", F.col("rep").alias("to"), F.lit(1.0).alias("cosine")))
    copies = skew_join(latest.select("id", "h", "dim"), several.select("h", "dim", "rep"), ["h", "dim"]).select("rep", "id")
    single = groups.where(F.col("n") == 1).select("rep", F.col("rep").alias("id"))
    members = cut(copies).unionByName(single)
    first = members.withColumn("__r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("__r") <= k + 1).select(F.col("rep").alias("to"), F.col("id").alias("neighbour"))
    order = [F.col("cosine").desc(), F.col("neighbour")]
    shown = near.join(first, "to").withColumn("__r", F.row_number().over(Window.partitionBy("rep").orderBy(*order))).where(F.col("__r") <= k + 1).select("rep", "neighbour", "cosine")
    out = skew_join(members, shown, ["rep"]).where(F.col("id") != F.col("neighbour"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= k)
    return out.select(F.col("id").alias("node"), "neighbour", "cosine", "rank")


def neighbour_pairs(vectors: DataFrame, k: int = 5, floor: float = 0.9, exact: bool = False) -> DataFrame:
    """node_a < node_b: pairs of which one is among the ``k`` most similar of the other, at cosine >= ``floor``."""
    n = nearest_neighbours(vectors, k=k, floor=floor, exact=exact)
    return n.select(F.least("node", "neighbour").alias("node_a"), F.greatest("node", "neighbour").alias("node_b")).distinct()
