"""Nearest neighbours by inner product, by shifted space-filling curves.

Curves order by position, so positions are made to tell inner products: with ``M`` the largest length,
a candidate ``x`` stands at ``(x / M, sqrt(1 - |x|^2 / M^2))`` and a query at ``(x / |x|, 0)``, both on the
unit sphere, where the nearer candidate is the one with the larger inner product.

Positions are projected onto a few random directions, several times; each projection is put on a
randomly shifted grid and ordered along a Hilbert curve. Every ordering is cut into ranges of equal
size by the quantiles of its candidates' keys. A query looks at the ranges around its own key in every
ordering; in each, exact inner products with the original vectors pick the best, and the best of all
ranges and orderings are merged.

How many ranges to each side (``reach``) is measured, unless given: the true neighbours of ``tuning``
queries, found by a scan, say which reach finds the share ``recall`` of them. Where directions are spread
evenly in many dimensions that is a third of each ordering; where vectors cluster, a range or two.

A range's vectors and the queries that look at it meet in groups of bounded size: both are dealt
into chunks by the actual counts, so equal vectors, which no ordering can part, fill several groups
and none grows with the table.

Edge cases: vectors that are null, empty, zero, of another length than most, or with null or
non-finite components take no part, nor do null ids; of rows that share an id the smallest vector
(component by component) counts; ties in nearness go to the smaller id; tables with fewer candidates
than asked for give all; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import discard, materialize

BITS = 10
CANDIDATES, QUERIES = 32_768, 4_096


def hilbert_keys(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (rows), by Gray-code rotation of axes."""
    x = grid.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            swap = (x[0] ^ x[i]) & low
            flip = (x[i] & q) != 0
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= np.where(flip, 0, swap)
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | row >> bit & 1
    return key


def directions(dims: int, orderings: int, axes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal projections (dims, orderings * axes) and grid shifts in [0, 1)."""
    rng = np.random.default_rng(seed)
    sides = [np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, : min(axes, dims)] for _ in range(orderings)]
    return np.concatenate(sides, 1), rng.random(sum(s.shape[1] for s in sides))


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """vec_id and embedding (doubles) of the vectors that take part, and their length."""
    v = F.col("embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    most = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dims = int(most["n"]) if most else 0
    return rows.where(F.size("embedding") == dims), dims


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, orderings: int = 6, axes: int = 3, ranges: int = 32, reach: int | None = None, recall: float = 0.95, tuning: int = 128, seed: int = 11,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row where ``is_query`` (over vec_id) holds."""
    out = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows, dims = valid(vectors, vec_id, embedding)
    if not dims:
        return spark.createDataFrame([], out)
    rows = materialize(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", is_query.alias("asks"), "embedding"), "curve-vectors")
    axes = min(axes, dims)
    project, shift = directions(dims + 1, orderings, axes, seed)
    columns = project.shape[1]

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dims)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = [length_of(matrix(batch.column(0))).max() for batch in batches if batch.num_rows]
        yield pa.RecordBatch.from_pydict({"most": [max(most, default=0.0)]})

    longest = float(rows.select("embedding").mapInArrow(lengths, "most double").agg(F.max("most")).first()[0] or 0.0) or 1.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s1, s2 = 0, np.zeros(columns), np.zeros(columns)
        for batch in batches:
            y = standing(matrix(batch.column(0)), longest) @ project
            n, s1, s2 = n + len(y), s1 + y.sum(0), s2 + (y * y).sum(0)
        yield pa.RecordBatch.from_pydict({"n": [n], **{f"a{i}": [s1[i]] for i in range(columns)}, **{f"b{i}": [s2[i]] for i in range(columns)}})

    names = [f"{x}{i}" for x in "ab" for i in range(columns)]
    m = rows.select("embedding").mapInArrow(moments, "n long, " + ", ".join(f"{x} double" for x in names)).agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).first()
    count = max(1, int(m["n"] or 0))
    mean = np.array([m[f"a{i}"] or 0.0 for i in range(columns)]) / count
    spread = np.sqrt(np.maximum(np.array([m[f"b{i}"] or 0.0 for i in range(columns)]) / count - mean**2, 1e-18))

    def curve(position: np.ndarray) -> list[np.ndarray]:
        u = 1 / (1 + np.exp(-1.702 * np.clip((position @ project - mean) / spread, -8, 8)))  # near the normal distribution's
        grid = ((u + shift) / 2 * (1 << BITS)).astype(np.int64)
        return [hilbert_keys(grid[:, o * axes : (o + 1) * axes]) for o in range(orderings)]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(key) for key in curve(standing(matrix(batch.column(0)), longest))], names=[f"key{o}" for o in range(orderings)])

    cuts = [i / ranges for i in range(1, ranges)] or [0.5]
    keyed = rows.select("embedding").mapInArrow(keys, ", ".join(f"key{o} long" for o in range(orderings)))
    found = keyed.agg(*[F.percentile_approx(f"key{o}", cuts, 10_000).alias(f"e{o}") for o in range(orderings)]).first()
    edges = [sorted({int(c) for c in found[f"e{o}"] or []}) if ranges > 1 else [] for o in range(orderings)]

    def numbers(position: np.ndarray) -> np.ndarray:
        """The range of each position (rows) in each ordering."""
        return np.stack([np.searchsorted(e, key) for e, key in zip(edges, curve(position), strict=True)], 1).astype(np.int32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2))
            asks = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            centers = np.zeros((len(x), orderings), np.int32)
            centers[asks] = numbers(asking(x[asks]))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), orderings).cast(pa.list_(pa.int32())) for v in (numbers(standing(x, longest)), centers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(asks), pa.array([r.tobytes() for r in x], pa.binary()), *lists], names=["vec_id", "asks", "vector", "ranges", "centers"])

    based = materialize(rows.mapInArrow(place, "vec_id long, asks boolean, vector binary, ranges array<int>, centers array<int>"), "curve-places")
    if reach is None:
        # a window holds some times what is asked for, and what the sample needs
        least = -(-(4 * k * ranges // count + 1) // 2)
        reach = min(ranges, max(least, needed_reach(rows, based, [len(e) for e in edges], k, recall, tuning)))
    discard(rows)
    placed = based.select("vec_id", "vector", "asks", "centers", F.posexplode("ranges").alias("ordering", "range"))
    last = F.get(F.array(*[F.lit(len(e)) for e in edges]), F.col("ordering"))
    placed = placed.select("vec_id", "vector", "ordering", "range", F.when(F.col("asks"), F.get("centers", F.col("ordering"))).alias("center"), last.alias("last"))
    begin = F.greatest(F.least(F.col("center") - reach, F.col("last") - 2 * reach), F.lit(0))
    asked = placed.where("center is not null").select("vec_id", "vector", "ordering", F.explode(F.sequence(begin, F.least(begin + 2 * reach, F.col("last")))).alias("range"))
    sizes = placed.groupBy("ordering", "range").agg(F.count("*").alias("members"), F.lit(0).cast("long").alias("askers"))
    asks = asked.groupBy("ordering", "range").agg(F.lit(0).cast("long").alias("members"), F.count("*").alias("askers"))
    # at most orderings * ranges rows
    counted = F.broadcast(sizes.union(asks).groupBy("ordering", "range").agg(F.sum("members").alias("members"), F.sum("askers").alias("askers")))
    c, q = F.ceil(F.col("members") / CANDIDATES).cast("int"), F.ceil(F.col("askers") / QUERIES).cast("int")
    counted = counted.select("ordering", "range", F.greatest(c, F.lit(1)).alias("c"), F.greatest(q, F.lit(1)).alias("q"))
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    members = placed.join(counted, ["ordering", "range"]).select("ordering", "range", (h % F.col("c")).cast("int").alias("cc"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qc"), F.lit(False).alias("asks"), "vec_id", "vector")
    askers = asked.join(counted, ["ordering", "range"]).select("ordering", "range", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("cc"), (h % F.col("q")).cast("int").alias("qc"), F.lit(True).alias("asks"), "vec_id", "vector")

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        asks_ = group["asks"].to_numpy(bool)
        ids = group["vec_id"].to_numpy(np.int64)
        x = np.frombuffer(b"".join(group["vector"]), np.float64).reshape(len(ids), -1)
        return scan(ids[asks_], x[asks_], ids[~asks_], x[~asks_], k)

    pairs = members.union(askers).groupBy("ordering", "range", "cc", "qc").applyInPandas(nearest, FOUND)
    return ranked(pairs, k).select("query_id", "rank", "vec_id", "score")


FOUND = "query_id long, vec_id long, score double"


def length_of(x: np.ndarray) -> np.ndarray:
    """Lengths of rows; large and small components don't overflow when squared."""
    most = np.maximum(np.abs(x).max(1), 1e-300)
    return np.minimum(most * np.sqrt(((x / most[:, None]) ** 2).sum(1)), 1e300)


def standing(x: np.ndarray, longest: float) -> np.ndarray:
    """Positions of candidates on the unit sphere, one more coordinate than they have."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0))], 1)


def asking(x: np.ndarray) -> np.ndarray:
    """Positions of queries on that sphere."""
    if not len(x):
        return np.zeros((0, x.shape[1] + 1))
    x = x / np.abs(x).max(1, keepdims=True)
    return np.concatenate([x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))], 1)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query, each candidate once."""
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def needed_reach(rows: DataFrame, based: DataFrame, last: list[int], k: int, recall: float, tuning: int) -> int:
    """The least reach at which the share ``recall`` of true neighbours of ``tuning`` queries is seen; last: each ordering's last range.

    The queries are those with the smallest hashes of their ids; each task scans its own candidates.
    """
    some = based.where("asks").orderBy(F.xxhash64("vec_id"), "vec_id").limit(tuning).select("vec_id", "vector", "centers").collect()
    if not some:
        return 0
    qid = np.array([r["vec_id"] for r in some], np.int64)
    qx = np.stack([np.frombuffer(r["vector"], np.float64) for r in some])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_pandas(scan(qid, qx, batch.column(0).to_numpy(), x, k), preserve_index=False)

    true = ranked(rows.select("vec_id", "embedding").mapInArrow(near, FOUND), k).select("query_id", "vec_id")
    # at most ``tuning`` times k rows
    pairs = based.join(F.broadcast(true), "vec_id").select("query_id", "ranges").collect()
    if not pairs:
        return 0
    centers = {r["vec_id"]: r["centers"] for r in some}
    ends = np.array(last)
    at, center = np.array([r["ranges"] for r in pairs]), np.array([centers[r["query_id"]] for r in pairs])
    reach = 0
    while reach < ends.max():
        begin = np.maximum(np.minimum(center - reach, ends - 2 * reach), 0)
        if ((begin <= at) & (at <= begin + 2 * reach)).any(1).mean() >= recall:
            break
        reach += 1
    return reach


def scan(qid: np.ndarray, qx: np.ndarray, cid: np.ndarray, cx: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest candidates of each query."""
    order = np.argsort(cid, kind="stable")
    cid, cx = cid[order], cx[order]
    found = [best_of(qid[a : a + 256], qx[a : a + 256], cid, cx, k) for a in range(0, len(qid) if len(cid) else 0, 256)]
    got = [np.concatenate(z) for z in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame({"query_id": got[0], "vec_id": got[1], "score": got[2]})


def best_of(qid: np.ndarray, qx: np.ndarray, cid: np.ndarray, cx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates in id order, each query's k largest inner products, itself apart; scores as plain sums."""
    s = qx @ cx.T
    s[qid[:, None] == cid[None, :]] = -np.inf
    m = min(k + 8, len(cid))  # a margin for ties and last bits
    top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(cid) else np.broadcast_to(np.arange(len(cid)), s.shape)
    kth = np.take_along_axis(s, top, 1).min(1)
    tied = (s >= kth[:, None] - 1e-12).sum(1) > m  # more equals than the margin holds: sort those rows whole
    out = []
    for i in range(len(qid)):
        pick = np.flatnonzero(s[i] >= np.partition(s[i], -m)[-m] - 1e-12) if tied[i] else np.sort(top[i])
        pick = pick[s[i][pick] > -np.inf]
        exact = np.sum(qx[i] * cx[pick], axis=1)
        o = np.lexsort((cid[pick], -exact))[:k]
        out.append((np.full(len(o), qid[i]), cid[pick][o], exact[o]))
    a, b, c = zip(*out, strict=True)
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)
