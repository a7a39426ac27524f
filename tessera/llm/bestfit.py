"""Best-fit packing in bulk-synchronous rounds.

Documents longer than a sequence are cut into whole sequences and a shorter first piece. What is shorter
than a sequence is an item; a sequence that was begun has a gap.

In every round items and gaps are sorted together by size, largest first, into ranges. A sweep over a range
gives every item the successor of its size among the gaps seen and still free: the smallest that holds it.
Where several items want one gap, the one that the sweep meets first has it, and the next ones take the next
larger gaps. What a range leaves over, items first and gaps behind them, is matched across ranges by rank: item number
``i`` of a run of left items has gap number ``i`` of a run of left gaps before it. Then the gaps are made
smaller by what they took, gaps that hold nothing any more are closed, and the round is repeated with the
items that are left. A gap that holds ``k`` of the largest item takes up to ``k`` items in one round, so that
many small items don't take many rounds.

Items longer than every gap begin sequences: the largest of them, as many as their tokens fill, and all that
are longer than half a sequence (no two of these share one).

Edge cases: null or empty text is one end token; a null id is given back as null; rows with the same id,
repeated or not, are packed each; very long texts are tokenized whole; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .bpe import ids_of
from .common import discard, materialize, numbered, range_parts
from .textbytes import slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"
LEFT_ITEM, LEFT_GAP, MATCHED = range(3)
SWEPT = "state int, part int, place long, uid long, length long, seq long, slot int"


def pieces(docs: DataFrame, vocabulary: str, size: int, doc_id: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """The pieces of every document, each with a number of its own (uid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        encoder = ids_of(vocabulary)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, at = encoder.encode(batch.column(1), end_id)
                n = np.diff(at)
                count = -(-n // size)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = (n - 1) % size + 1
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
                length = np.where(piece == 0, first[row], size)
                raw = memoryview(ids.astype("<u4").tobytes())
                begin = at[row] + start
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(uid + np.arange(len(row)))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "uid"],
                )
                uid += len(row)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def sweep(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places in order, gaps (true) and items: matched gaps, their items, and items that found no gap.

    An item has the last gap before it that is still free, as a closing bracket has its opening one: brackets
    at the same depth, in order, are pairs.
    """
    height = np.cumsum(np.where(gap, 1, -1))
    floor = np.minimum(np.minimum.accumulate(height), 0) if len(height) else height
    alone = ~gap & (floor < np.concatenate([[0], floor[:-1]]))
    depth = height - floor + ~gap
    at = np.flatnonzero(~alone)
    at = at[np.argsort(depth[at], kind="stable")]
    pair = gap[at[:-1]] & ~gap[at[1:]] & (depth[at[:-1]] == depth[at[1:]])
    return at[:-1][pair], at[1:][pair], np.flatnonzero(alone)


def left_runs(items: list[int], gaps: list[int]) -> list[tuple[int, int, int]]:
    """What ranges leave over, matched across ranges: (first item, first gap or -1, how many), numbers running over all ranges."""
    runs, free, item, gap = [], [], 0, 0
    for u, g in zip(items, gaps, strict=True):
        while u:
            if free:
                first, n = free.pop()
                k = min(u, n)
                runs.append((item, first + n - k, k))
                if n > k:
                    free.append((first, n - k))
            else:
                k = u
                runs.append((item, -1, k))
            item, u = item + k, u - k
        if g:
            free.append((gap, g))
        gap += g
    return runs


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range, sorted: id, length (of an item), slot (of a gap, from 0; of an item -1)."""
    from pyspark import TaskContext

    parts = [batch for batch in batches if batch.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    ids, length, slot = (rows.column(c).to_numpy() for c in ("id", "length", "slot"))
    gap = slot >= 0
    a, b, alone = sweep(gap)
    free = gap.copy()
    free[a] = False
    rest = np.flatnonzero(free)
    state = np.repeat([MATCHED, LEFT_ITEM, LEFT_GAP], [len(a), len(alone), len(rest)]).astype(np.int32)
    place = np.concatenate([np.zeros(len(a), np.int64), np.arange(len(alone)), np.arange(len(rest))])
    item, of = np.concatenate([b, alone, rest]), np.concatenate([a, alone, rest])
    none = [np.zeros(k, np.int64) for k in (len(alone), len(rest))]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(state), pa.array(np.full(len(state), TaskContext.get().partitionId(), np.int32)), pa.array(place),
            pa.array(np.concatenate([ids[b], ids[alone], none[1]])), pa.array(np.where(state == LEFT_GAP, 0, length[item])),
            pa.array(np.concatenate([ids[a], none[0], ids[rest]])), pa.array(np.where(state == LEFT_ITEM, -1, slot[of]).astype(np.int32)),
        ],
        names=["state", "part", "place", "uid", "length", "seq", "slot"],
    )


def best_fit(items: DataFrame, size: int) -> list[DataFrame]:
    """Tables of uid, seq, offset, which together place all items (uid, length up to size); a sequence is named by its first item's uid."""
    spark = items.sparkSession
    n = items.count()
    left = numbered(items, [F.desc("length"), F.asc("uid")], "fit-sorted", n)
    gaps = spark.createDataFrame([], "seq long, gap long")
    placed: list[DataFrame] = []
    while n:
        g = gaps.agg(F.count("*"), F.sum("gap"), F.max("gap")).first()
        free, most = int(g[1] or 0), int(g[2] or 0)
        over = F.col("length") > most
        i = left.agg(F.count("*"), F.sum("length"), F.min("length"), F.count_if(over), F.sum(F.when(over, F.col("length"))), F.count_if(over & (2 * F.col("length") > size))).first()
        n, tokens, least, long_, long_tokens, halves = (int(x or 0) for x in i)
        if not n:
            break
        begun = 0
        if long_:
            begun = min(long_, max(1, halves, -(-long_tokens // size), -(-(tokens - free) // size)))
            # numbers are in order of length, so the first ``begun`` are the largest
            first = materialize(left.where(F.col("number") < begun).select("uid", F.col("uid").alias("seq"), F.lit(0).cast("long").alias("offset"), "length"), "fit-begun")
            placed.append(first.select("uid", "seq", "offset"))
            gaps = gaps.unionByName(first.select("seq", (size - F.col("length")).alias("gap")))
        rest = left.where(F.col("number") >= begun)
        stat = rest.agg(F.count("*"), F.max("length")).first()
        n, largest = int(stat[0]), int(stat[1] or 1)
        if not n:
            break
        gaps = gaps.where(F.col("gap") >= least)
        held = gaps.count()
        # so many slots that items, not slots, run out, yet never many more slots than items and gaps
        slots = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / largest), F.lit(-(-2 * n // max(1, held))))).cast("int")
        offered = gaps.select("gap", F.col("seq").alias("id"), slots.alias("slots")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        events = offered.select(F.floor(F.col("gap") / F.col("slots")).alias("key"), "id", F.lit(0).cast("long").alias("length"), "slot")
        events = events.unionByName(rest.select(F.col("length").alias("key"), F.col("uid").alias("id"), "length", F.lit(-1).alias("slot")))
        order = [F.desc("key"), F.desc("slot"), F.asc("id")]  # at equal size gaps come first
        ranged = events.repartitionByRange(range_parts(3 * n + held, spark), *order).sortWithinPartitions(*order)
        table = materialize(ranged.select("id", "length", "slot").mapInArrow(swept, SWEPT), "fit-swept")
        found = {r["part"]: r for r in table.groupBy("part").agg(F.count_if(F.col("state") == LEFT_ITEM).alias("items"), F.count_if(F.col("state") == LEFT_GAP).alias("gaps")).collect()}
        parts = sorted(found)
        numbers = Numbers(parts, [found[p]["items"] for p in parts], [found[p]["gaps"] for p in parts])
        over_ranges = table.where(F.col("state") != MATCHED).mapInArrow(numbers.assign, SWEPT + ", meets long, number long")
        one = over_ranges.where((F.col("state") == LEFT_ITEM) & F.col("meets").isNotNull()).select("meets", "uid", "length")
        other = over_ranges.where(F.col("state") == LEFT_GAP).select("meets", "seq", "slot")
        pairs = table.where(F.col("state") == MATCHED).select("uid", "length", "seq", "slot").unionByName(one.join(other, "meets").select("uid", "length", "seq", "slot"))
        # a sequence's gap and what it takes, at most ``size`` rows
        both = gaps.select("seq", "gap", F.lit(None).cast("long").alias("uid"), F.lit(0).cast("long").alias("length"), F.lit(-1).alias("slot"))
        both = both.unionByName(pairs.withColumn("gap", F.lit(None).cast("long")))
        of = W.partitionBy("seq")
        until = of.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
        taken = both.select("seq", "uid", F.max("gap").over(of).alias("gap"), F.sum("length").over(of).alias("took"), F.sum("length").over(until).alias("before"))
        taken = materialize(taken.select("seq", "uid", (size - F.col("gap") + F.col("before")).alias("offset"), (F.col("gap") - F.col("took")).alias("gap")), "fit-taken")
        placed.append(taken.where("uid is not null").select("uid", "seq", "offset"))
        gaps = taken.where("uid is null").select("seq", "gap")
        spent = left
        left = materialize(over_ranges.where((F.col("state") == LEFT_ITEM) & F.col("meets").isNull()).select("uid", "length", "number"), "fit-left")
        discard(table, spent)
    return placed


class Numbers:
    """Numbers of what ranges leave over: gaps' own, and which one each item meets (null: none; ``number`` counts these)."""

    def __init__(self, parts: list[int], items: list[int], gaps: list[int]) -> None:
        self.parts = np.array(parts, np.int64)
        self.items, self.gaps = (np.cumsum([0, *x])[:-1] for x in (items, gaps))
        runs = left_runs(items, gaps)
        self.begin, self.meets = (np.array([r[k] for r in runs], np.int64) for k in (0, 1))
        alone = np.array([r[2] if r[1] < 0 else 0 for r in runs], np.int64)
        self.before = np.cumsum(alone) - alone

    def assign(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state, part, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = np.searchsorted(self.parts, part)
            number = np.where(state == LEFT_GAP, self.gaps[at], self.items[at]) + place
            run = np.clip(np.searchsorted(self.begin, number, side="right") - 1, 0, None)
            gap = state == LEFT_GAP
            if len(self.begin):
                within, meets = number - self.begin[run], self.meets[run]
                alone = ~gap & (meets < 0)
                meets, count = np.where(gap, number, meets + within), np.where(alone, self.before[run] + within, 0)
            else:
                alone, meets, count = np.zeros(len(number), bool), number, number
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(meets, mask=alone), pa.array(count, mask=~alone)], names=[*batch.schema.names, "meets", "number"])


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, doc_id: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs, vocabulary, size, doc_id, text, end_id), "fit-pieces")
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cut.where(F.col("length") == size).select(*out, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut.where(F.col("length") < size)
    placed = best_fit(short.select("uid", "length"), size)
    if not placed:
        return full
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    return full.unionByName(short.join(every.withColumnRenamed("seq", "sequence_id"), "uid").select(*out, "sequence_id", "offset"))
