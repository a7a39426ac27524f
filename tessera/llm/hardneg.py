"""Hard negatives of anchors, by a vector-approximation file.

Components become whole numbers, so scores are whole numbers too. Every dimension is parted into cells by
quantiles of its values; a vector's approximation is the number of its cell in each dimension, a byte, and the file of all
approximations is what is scanned. A cell's lowest and highest value are looked up in a table; with the anchor's
component they bound that dimension's part of the score, so the sums over dimensions bound the score from below and
above. The bounds of many anchors and many vectors are matrix products of the values looked up.

First an anchor's positives are searched: of the rows of its label, only those whose upper bound reaches the
fifth best lower bound are scored exactly, on the whole vectors. Each positive's score then opens a window for
negatives; of the rows of other labels, only those whose bounds meet the window are left, and of these only
those whose upper bound reaches the fifth best lower bound of rows that are surely inside. What is left is scored
exactly.

Anchors and approximations are dealt into blocks of bounded size, and each block of anchors meets each block of
approximations in one task (for positives: of its label only). Blocks pass on what may be among the best of the block; the
bars are then set again over all blocks.

Of rows with the same label and the same whole numbers only the smallest ids can ever be among the
first ones (their scores are equal for every anchor, and ties go to the smaller id), so the file holds no more than
these: one more than the longest list asked for. Nothing is lost by that, and equal vectors, which no
bounds can tell apart, stay few.

Edge cases: rows with a null label, a null vector, null or non-finite components or a null id take no part, nor do empty vectors and
vectors of another length than most; of rows that share an id the one with the smallest label, then vector, counts; components of which the whole number lies
beyond 2^24 count as 2^24, so that scores fit into 64 bits; anchors without positives, and windows without rows, give no rows;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import discard, materialize, sized_broadcast

#: Rows of a block of approximations, and anchors of a block.
CANDIDATES, ANCHORS = 32_768, 2_048
LIMIT = 1 << 24


def whole_numbers(vectors: DataFrame, is_anchor: Column, scale: int, vec_id: str, embedding: str, label: Column) -> tuple[DataFrame, int]:
    """vec_id, label, anchor and q (32-bit numbers) of the rows that take part, and their length; ``is_anchor`` is over vec_id."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0").where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dims = int(most["n"]) if most else 0
    q = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    rows = rows.where(F.size("v") == dims).groupBy("vec_id").agg(F.min(F.struct("label", q.alias("q"))).alias("r"))
    return rows.select("vec_id", "r.label", is_anchor.alias("anchor"), "r.q"), dims


def cells(rows: DataFrame, dims: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension: the upper border of every cell but the last, and from these a table of cells' lowest and highest values (dims, cells, 2).

    Borders are quantiles; with the lowest and highest value they are ``dims`` times ``count`` numbers.
    """
    cuts = [k / count for k in range(1, count)]
    value = rows.select(F.posexplode("q").alias("d", "x")).groupBy("d")
    found = value.agg(F.percentile_approx("x", cuts, 10_000).alias("cuts"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("d").collect()
    borders = np.array([r["cuts"] for r in found], np.int64).reshape(dims, count - 1)
    low = np.concatenate([np.array([r["low"] for r in found], np.int64)[:, None], borders + 1], 1)
    high = np.concatenate([borders, np.array([r["high"] for r in found], np.int64)[:, None]], 1)
    return borders, np.stack([low, np.maximum(high, low)], 2)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def approximate(rows: DataFrame, borders: np.ndarray) -> DataFrame:
    """vec_id, label, cells: each component's cell, a byte."""
    dims = len(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), dims)
            cell = np.stack([np.searchsorted(borders[d], x[:, d], side="left") for d in range(dims)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in cell], pa.binary())], names=["vec_id", "label", "cells"])

    return rows.select("vec_id", "label", "q").mapInArrow(run, "vec_id long, label long, cells binary")


def bounds(cell: np.ndarray, table: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each anchor (rows) with each approximation (columns)."""
    d = np.arange(cell.shape[1])
    low, high = table[d, cell, 0].astype(float), table[d, cell, 1].astype(float)
    up, down = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def nth_largest(x: np.ndarray, n: int) -> float:
    return float(np.partition(x, len(x) - n)[len(x) - n]) if len(x) >= n else -np.inf


def blocks(file: DataFrame, anchors: DataFrame, by_label: bool) -> tuple[DataFrame, DataFrame]:
    """Both with ``block``, ``group`` (and ``of``, the label or 0): each block of anchors with each of approximations."""
    h, given = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)), anchors.columns
    if by_label:
        n, m = (x.groupBy("label").agg(F.count("*").alias(c)) for x, c in ((file, "n"), (anchors, "m")))
        # a row for each label that has anchors
        sizes = m.join(n, "label").select("label", F.ceil(F.col("n") / CANDIDATES).cast("int").alias("c"), F.ceil(F.col("m") / ANCHORS).cast("int").alias("a"))
        sizes = sized_broadcast(materialize(sizes, "mine-sizes"))
        file, anchors = (x.join(sizes, "label").withColumn("of", F.col("label")) for x in (file, anchors))
    else:
        n, m = file.count(), anchors.count()
        sized = {"c": F.lit(max(1, -(-n // CANDIDATES))), "a": F.lit(max(1, -(-m // ANCHORS))), "of": F.lit(0).cast("long")}
        file, anchors = file.withColumns(sized), anchors.withColumns(sized)
    here, there = (F.explode(F.sequence(F.lit(0), F.col(x) - 1)) for x in "ac")
    f = file.select("of", (h % F.col("c")).cast("int").alias("block"), here.alias("group"), "vec_id", "label", "cells")
    a = anchors.select("of", there.alias("block"), (h % F.col("a")).cast("int").alias("group"), *given)
    return f, a


MET = "anchor_id long, place int, vec_id long, low double, high double, sure boolean"


def meetings(file: DataFrame, anchors: DataFrame, table: np.ndarray, by_label: bool, pick) -> DataFrame:
    """What ``pick`` lets through in each task; it gets an anchor's row, ids and labels of a block, and both bounds."""
    f, a = blocks(file, anchors, by_label)
    key = ["of", "block", "group"]
    dims = len(table)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
            cell = np.frombuffer(b"".join(left.column("cells").to_pylist()), np.uint8).reshape(len(ids), dims)
            for at in range(0, right.num_rows, 64):
                some = right.slice(at, 64)
                low, high = bounds(cell, table, matrix(some.column("q"), dims))
                for row, lo, hi in zip(some.drop_columns(["q"]).to_pylist(), low, high, strict=True):
                    for place, chosen, sure in pick(row, ids, labels, lo, hi):
                        out.append((row["vec_id"], place, ids[chosen], lo[chosen], hi[chosen], sure))
        n = np.array([len(x[2]) for x in out], np.int64)
        join = lambda k, kind: np.concatenate([x[k] for x in out]) if out else np.zeros(0, kind)
        return pa.table(
            {"anchor_id": pa.array(np.repeat(np.array([x[0] for x in out], np.int64), n)), "place": pa.array(np.repeat(np.array([x[1] for x in out], np.int32), n)), "vec_id": pa.array(join(2, np.int64)), "low": pa.array(join(3, float)), "high": pa.array(join(4, float)), "sure": pa.array(join(5, bool))}
        )

    return materialize(f.groupBy(*key).cogroup(a.groupBy(*key)).applyInArrow(meet, MET), "mine-met")


def over_all(met: DataFrame, n: int) -> DataFrame:
    """Of what the blocks pass on, what reaches the n-th best lower bound of sure rows over all blocks."""
    of = W.partitionBy("anchor_id", "place")
    bars = met.where("sure").withColumn("at", F.row_number().over(of.orderBy(F.desc("low"), "vec_id"))).where(F.col("at") <= n)
    bars = bars.groupBy("anchor_id", "place").agg(F.when(F.count("*") == n, F.min("low")).alias("bar"))
    return met.join(bars, ["anchor_id", "place"], "left").where("bar is null or high >= bar").select("anchor_id", "place", "vec_id")


def scored(pairs: DataFrame, anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs with ``score`` and ``label``: the inner product of whole vectors."""
    a = anchors.select(F.col("vec_id").alias("anchor_id"), F.col("q").alias("aq"))
    product = F.aggregate(F.zip_with("aq", "q", lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return pairs.join(rows.select("vec_id", "label", "q"), "vec_id").join(a, "anchor_id").select(*pairs.columns, "label", product.alias("score"))


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256, cell_count: int = 256, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``label`` is over the columns of ``vectors``, ``is_anchor`` over vec_id. An anchor's positives are its best rows of the same label; a
    positive's negatives are the best rows of other labels with scores of ``least`` to ``most`` percent of its own.
    """
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = vectors.sparkSession
    valid, dims = whole_numbers(vectors, is_anchor, scale, vec_id, embedding, label)
    if not dims:
        return spark.createDataFrame([], out)
    valid = materialize(valid, "mine-vectors")
    # rows that can be among the first ones: see above
    alike = W.partitionBy("label", "q").orderBy("vec_id")
    rows = materialize(valid.withColumn("at", F.row_number().over(alike)).where(F.col("at") <= max(positives + 1, negatives)).select("vec_id", "label", "q"), "mine-rows")
    anchors = materialize(valid.where("anchor").select("vec_id", "label", "q"), "mine-anchors")
    discard(valid)
    borders, table = cells(rows, dims, cell_count)
    file = materialize(approximate(rows, borders), "mine-file")

    def nearest(row: dict, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray):
        other = np.flatnonzero((labels == row["label"]) & (ids != row["vec_id"]))
        chosen = other[high[other] >= nth_largest(low[other], positives)]
        yield 0, chosen, np.ones(len(chosen), bool)

    met = meetings(file, anchors, table, True, nearest)
    best = scored(over_all(met, positives), anchors, rows)
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    best = materialize(best.select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "mine-positives")
    discard(met)
    windows = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("windows"))
    asking = materialize(anchors.join(windows, "vec_id"), "mine-asking")

    def between(row: dict, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray):
        other = np.flatnonzero(labels != row["label"])
        lo, hi = low[other], high[other]
        for w in row["windows"]:
            bottom, top = least * w["positive_score"], most * w["positive_score"]
            sure = (100 * lo >= bottom) & (100 * hi <= top)
            may = (100 * hi >= bottom) & (100 * lo <= top) & (hi >= nth_largest(lo[sure], negatives))
            yield w["place"], other[may], sure[may]

    maybe = over_all(meetings(file, asking, table, False, between), negatives)
    hits = scored(maybe, anchors, rows).join(best, ["anchor_id", "place"])
    inside = (least * F.col("positive_score") <= 100 * F.col("score")) & (100 * F.col("score") <= most * F.col("positive_score"))
    order = W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    hits = hits.where(inside).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hits.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle_sql() -> str:
    """The same in DuckDB SQL over the view ``embeddings``, with the registered query's anchors and labels."""
    return """
with v as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: x::double) as e
  from embeddings where label is not null and embedding is not null),
r as (select vec_id, label, list_transform(e, lambda x: floor(256 * x)) as q from v
  where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id as vec_id, a.label = c.label as alike, list_inner_product(a.q, c.q)::bigint as score
  from r a join r c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank
  from p join s on p.anchor_id = s.anchor_id where not s.alike and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5"""
