"""Approximate nearest neighbours by shifted space-filling curves.

Every distinct vector is projected to DIMS dimensions, shifted and put on a Hilbert
curve; CURVES curves use projections and shifts of their own.  A curve is cut into
ranges of about RANGE_ROWS keys at quantiles of a bounded sample, and Spark groups vectors
by (curve, range).  There a query meets the vectors whose keys are within its window, and it
goes to every range that its window may reach.  Windows are searched in single precision,
and only their best leave the group; the bests of all groups are merged and reranked in
double precision on the original vectors.

How wide a window must be depends on the data, so it is measured: the true neighbours of at
most PROBES queries are found among all rows, and the window is the least in which, on some
curve, TARGET of them lie, counted in keys of the sample.  A query stands on a curve at its
own place or, as near vectors of isotropic data lie further out, at its projection times
OUTWARD, whichever needs the narrower window.  Isotropic data of many dimensions is the worst
case: a window is a share of the table there (figures stand in the README).  Where the sample
cannot cut finely enough, ranges are dealt to slices by a hash of the id; a query goes to
every slice, with its share of the window in each, so no group grows with the table.

Copies of a vector are one entry with its smallest ids, so a vector that fills a third of
the table takes no more room than another, and ties go to smaller ids.  Vectors of one
direction share their keys; a hash of the vector orders equal keys and cuts between them,
so such a key is dealt to several ranges.  What is fitted: the cut points and the window, on
at most SAMPLE rows and PROBES queries.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part,
also as queries; vectors of different lengths have no inner product, so each length is
searched apart; null ids take no part; fewer candidates than k give fewer rows; rows that
repeat are candidates of their own; a condition that is null is no query; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import U64, durable, mix, table

CURVES, DIMS, BITS = 32, 6, 8
#: Queries whose true neighbours are looked up, and the share of these that windows must hold.
PROBES, TARGET = 128, 0.95
#: How far out a query may stand on the curves, and the least window.
OUTWARD, LEAST = (1.0, 1.5), 16
#: Vectors of a range; parts of a range, in which a query's reach is counted.
RANGE_ROWS, PARTS = 8192, 8
#: Queries searched at once, if they span no more than half a window; candidates kept beyond k for the rerank.
BLOCK, MARGIN = 64, 8
#: Vectors on which the cut points are fitted.
SAMPLE = 20_000
SEED = 7


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys of points with integer coordinates below 2**bits: the Gray-code walk that
    turns coordinates into the transposed index, then its bits interleaved."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            up = (x[i] >> b) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """The projections and shifts, from a seed; unit vectors land inside the cube."""

    def __init__(self, width: int, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dims = min(dims, width)
        self.bits = bits
        self.axes = [np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)]
        self.shifts = rng.uniform(-0.08, 0.08, (curves, dims))
        self.scale = 6 / np.sqrt(width)

    def keys(self, vectors: np.ndarray, outward: float = 1.0) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        top = (1 << self.bits) - 1
        return np.array([hilbert(np.clip(((unit @ a) * (outward / self.scale) + 0.5 + s) * (1 << self.bits), 0, top).astype(np.int64), self.bits) for a, s in zip(self.axes, self.shifts, strict=True)])


def matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def ordered_keys(keys: np.ndarray, vid: np.ndarray) -> np.ndarray:
    """Keys of one curve with a hash of the vector's id below them, so that equal keys differ."""
    return (keys << 15) | (mix(vid.astype(np.int64).view(U64)) >> U64(49)).astype(np.int64)


def nearest(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", window: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which the SQL
    condition ``is_query`` holds, by inner product in double precision.  ``window`` keys on
    either side are met on each curve; by default as many as TARGET asks for."""
    fine = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(F.expr(is_query), F.lit(False)).alias("q")).where(
        F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    fine = fine.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    lengths = fine.groupBy(F.size("v").alias("width")).agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top")).orderBy("width").collect()  # one row a length
    found = [of_width(fine.where(F.size("v") == r["width"]), k, r["width"], r["top"], window) for r in lengths]
    return reduce(DataFrame.unionByName, found) if found else fine.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))


def needed(base: DataFrame, k: int, width: int, top: float, curves: Curves, sample: np.ndarray, total: int) -> tuple[int, float]:
    """The window and the outward factor with which TARGET of the true neighbours of at most
    PROBES queries are met; ``sample`` has sorted keys of each curve."""
    asked = base.where("q").select("vid", "v").orderBy(F.xxhash64("vid")).limit(PROBES).toArrow()  # bounded: PROBES rows
    qid, q = asked.column("vid").to_numpy(), matrix(asked.column("v"), width)
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids = np.zeros((len(unit), 0)), np.zeros((len(unit), 0), np.int64)
        for b in batches:
            x = matrix(b.column(1), width) / top
            score = np.concatenate([score, unit @ x.T], axis=1)
            ids = np.concatenate([ids, np.broadcast_to(b.column(0).to_numpy(), (len(unit), len(x)))], axis=1)
            if score.shape[1] > k + 1:
                pick = np.argpartition(-score, k, axis=1)[:, : k + 1]
                score, ids = np.take_along_axis(score, pick, 1), np.take_along_axis(ids, pick, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(unit), dtype=np.int64), score.shape[1])), pa.array(ids.ravel()), pa.array(score.ravel())], ["probe", "c", "score"])

    near = ranked(base.select("vid", "v").mapInArrow(best, "probe long, c long, score double"), "probe", "c", k + 1).select("probe", "c")
    true = base.select(F.col("vid").alias("c"), "v").join(F.broadcast(near), "c").toArrow()  # bounded: PROBES * (k + 1) rows
    probe, c = true.column("probe").to_numpy(), true.column("c").to_numpy()
    other = c != qid[probe]
    if not other.any():
        return LEAST, OUTWARD[0]
    probe, c, there = probe[other], c[other], curves.keys(matrix(true.column("v"), width)[other])
    windows = []
    for outward in OUTWARD:
        here = curves.keys(q, outward)
        away = np.min([np.abs(np.searchsorted(s, ordered_keys(a, qid))[probe] - np.searchsorted(s, ordered_keys(b, c))) for s, a, b in zip(sample, here, there, strict=True)], axis=0)
        windows.append((int(np.ceil((np.sort(away)[int(np.ceil(TARGET * len(away))) - 1] + 1) * total / sample.shape[1])), outward))
    least, outward = min(windows)
    return max(least, LEAST), outward


def of_width(fine: DataFrame, k: int, width: int, top: float, window: int | None) -> DataFrame:
    """``nearest`` among vectors of one length, whose largest component is ``top``."""

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary()), b.column(2)], ["vec_id", "v", "q"])

    rows = durable(fine.mapInArrow(as_bytes, "vec_id long, v binary, q boolean"))
    base = durable(rows.groupBy("v").agg(F.min("vec_id").alias("vid"), F.max("q").alias("q")))
    smallest = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    members = smallest.join(base.select("v", "vid"), "v").select(F.col("vid").alias("c"), "vec_id")

    total = base.count()
    ranges = max(1, min(-(-total // RANGE_ROWS), SAMPLE // 10))
    slices = max(1, -(-total // (ranges * RANGE_ROWS * 2)))
    curves = Curves(width)
    sample = base.select("v", "vid").sample(min(1.0, SAMPLE / max(total, 1)), SEED).limit(SAMPLE).toArrow()  # bounded: SAMPLE rows
    vid = sample.column("vid").to_numpy()
    seen = np.sort([ordered_keys(keys, vid) for keys in curves.keys(matrix(sample.column("v"), width))], axis=1)
    outward = OUTWARD[0]
    if window is None:
        window, outward = needed(base, k, width, top, curves, seen, total)
    cuts = seen[:, np.arange(1, ranges * PARTS) * len(vid) // (ranges * PARTS)]  # of parts; every PARTS-th is one of ranges
    reach = -(-window * ranges * PARTS // total)
    window = -(-window // slices)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, vid = matrix(b.column(0), width), b.column(1).to_numpy()
            size = np.abs(x).max(axis=1)
            small = pa.array([r.tobytes() for r in (x / size[:, None]).astype(np.float32)], pa.binary())
            asks = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False).astype(bool))
            stands, asked = curves.keys(x), curves.keys(x[asks], outward)
            own = (mix(vid.astype(np.int64).view(U64)) % U64(slices)).astype(np.int32)

            def dealt(curve: int, key: np.ndarray, pick: np.ndarray, part: np.ndarray, slice_: np.ndarray, role: int) -> pa.RecordBatch:
                n = len(pick)
                return pa.RecordBatch.from_arrays([pa.array(np.full(n, curve, np.int32)), pa.array(part.astype(np.int32)), pa.array(slice_.astype(np.int32)), pa.array(key), pa.array(vid[pick]), small.take(pa.array(pick)), pa.array(size[pick] / top), pa.array(np.full(n, role, np.int32))], ["curve", "part", "slice", "key", "vid", "v", "size", "role"])

            for curve in range(CURVES):
                key = ordered_keys(stands[curve], vid)
                yield dealt(curve, key, np.arange(len(key)), np.searchsorted(cuts[curve], key, "right") // PARTS, own, 0)
                key = ordered_keys(asked[curve], vid[asks])
                part = np.searchsorted(cuts[curve], key, "right")
                low, high = np.maximum(part - reach, 0) // PARTS, np.minimum(part + reach, ranges * PARTS - 1) // PARTS
                for at in range(int((high - low).max(initial=-1)) + 1):
                    to = np.flatnonzero(low + at <= high)
                    for slice_ in range(slices):
                        yield dealt(curve, key[to], asks[to], low[to] + at, np.full(len(to), slice_), 1)

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("key").to_numpy(), kind="stable")))
        role, keys, ids = (group.column(c).to_numpy() for c in ("role", "key", "vid"))
        x = matrix(group.column("v"), width, np.float32)
        here = role == 0
        c, cid, size, place = x[here], ids[here], group.column("size").to_numpy()[here], np.searchsorted(keys[here], keys)
        asks = np.flatnonzero(role > 0)
        kept = k + 1 + MARGIN
        found: list[tuple] = []
        stands, at = place[asks], 0 if len(c) else len(asks)
        while at < len(asks):
            q = asks[at : min(at + BLOCK, int(np.searchsorted(stands, stands[at] + window // 2, "right")))]
            at += len(q)
            lo, hi = max(int(place[q[0]]) - window, 0), int(place[q[-1]]) + window + 1
            s = (x[q] @ c[lo:hi].T) * size[lo:hi]
            best = np.argpartition(-s, kept - 1, axis=1)[:, :kept] if s.shape[1] > kept else np.tile(np.arange(s.shape[1]), (len(s), 1))
            found.append((np.repeat(ids[q], best.shape[1]), cid[lo + best.ravel()], np.take_along_axis(s, best, 1).ravel()))
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table({"qv": pa.array(cols[0], pa.int64()), "c": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = (matrix(b.column(2), width) * matrix(b.column(3), width)).sum(axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], ["qv", "c", "score"])

    met = base.select("v", "vid", "q").mapInArrow(spread, "curve int, part int, slice int, key long, vid long, v binary, size double, role int").groupBy("curve", "part", "slice").applyInArrow(meet, "qv long, c long, score double")
    near = ranked(met.groupBy("qv", "c").agg(F.max("score").alias("score")), "qv", "c", k + 1 + MARGIN).select("qv", "c")
    sides = near.join(base.select(F.col("vid").alias("qv"), F.col("v").alias("x")), "qv").join(base.select(F.col("vid").alias("c"), F.col("v").alias("y")), "c")
    exact = sides.select("qv", "c", "x", "y").mapInArrow(rerank, "qv long, c long, score double")
    best_vectors = ranked(exact, "qv", "c", k + 1)
    best_rows = ranked(best_vectors.drop("rank").join(members, "c").select("qv", "vec_id", "score"), "qv", "vec_id", k + 1)
    queries = rows.where("q").select("v", F.col("vec_id").alias("query_id")).join(base.select("v", F.col("vid").alias("qv")), "v").select("query_id", "qv")
    return ranked(queries.join(best_rows.drop("rank"), "qv").where("vec_id <> query_id").select("query_id", "vec_id", "score"), "query_id", "vec_id", k).select("query_id", "rank", "vec_id", "score")


def ranked(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), tie))).where(F.col("rank") <= k)


def op5_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


QUERIES: dict[str, Callable] = {"op5_hilbert_ann": op5_hilbert_ann}
ORACLE: dict[str, str] = {}
