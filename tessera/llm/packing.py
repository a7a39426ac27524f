"""Mixture-controlled packing: source queues share every window in proportion, by deficit round-robin.

Tokens of every source form a queue. In each round a queue's credit grows by its quantum, its share of
the window by weight; it serves the whole part and carries the rest, its deficit, into the next window.
Without weights a queue's share is its share of all tokens, and every queue ends in the last window.
With weights a queue whose tokens run out leaves the round, and the others share its part by weight:
rounds fall into phases, one for each queue that ends. If queues up to ``s`` serve ``P(s)`` of the ``T``
tokens of a phase, they have served ``floor(t * P(s) / T)`` after ``t`` tokens of it; so the state at any
window is known without running the rounds before it, deficits carry across windows and across
partitions, and every partition cuts its own documents alone. Every window but the last is full.

A source with less than one token a window shares a queue with others of that kind, so at most
``size`` queues exist whatever the number of sources. All arithmetic is on whole numbers of 64 bits, at
any number of tokens below 2^61.

Edge cases: null or empty text is one end token; a null source is a queue of its own; a null id is given
back as null; an empty table gives an empty result; rows with the same id, repeated or not, are packed
each; very long texts are packed whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .bpe import ids_of
from .common import discard, materialize, sized_broadcast
from .textbytes import slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"


def encode_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", end_id: int = 0) -> DataFrame:
    """doc_id, source, part, ahead (tokens of the source before it in its part), n and ids (32-bit or 16-bit, little-endian)."""
    wide = vocabulary_size(vocabulary) > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ahead = TaskContext.get().partitionId(), {}
        encoder = ids_of(vocabulary)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, at = encoder.encode(batch.column(1), end_id)
                n = np.diff(at)
                before = []
                for s, k in zip(batch.column(2).to_pylist(), n.tolist(), strict=True):
                    before.append(ahead.get(s, 0))
                    ahead[s] = before[-1] + k
                raw = ids.astype("<u4" if wide else "<u2").tobytes()
                offsets = pa.py_buffer((at * (4 if wide else 2)).astype(np.int32).tobytes())
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(np.full(len(n), part, np.int32)), pa.array(before, pa.int64()), pa.array(n), binary],
                    names=["doc_id", "source", "part", "ahead", "n", "ids"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source"))
    return rows.mapInArrow(run, "doc_id long, source string, part int, ahead long, n long, ids binary")


def vocabulary_size(path: str) -> int:
    return ids_of(path).tokenizer.get_vocab_size()


def pack(
    docs: DataFrame, vocabulary: str, size: int = 1024, doc_id: str = "doc_id", text: str = "text", source: str = "source", end_id: int = 0, weights: Mapping[str | None, float] | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    ``weights`` are target proportions by source, for as long as a source has tokens; a source without one is
    packed when those with weights have ended. Without ``weights`` sources are mixed as they occur.
    """
    width = 4 if vocabulary_size(vocabulary) > 1 << 16 else 2
    coded = materialize(encode_documents(docs, vocabulary, doc_id, text, source, end_id), "pack-ids")
    parts = materialize(coded.groupBy("source", "part").agg(F.sum("n").alias("tokens")), "pack-parts")
    by_source = parts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = int(by_source.agg(F.sum("tokens")).first()[0] or 0)
    # a source with a token a window: at most ``size`` of them
    large = by_source.where(F.col("tokens") * size >= F.lit(total)).orderBy(F.col("source").asc_nulls_last()).collect()
    sums = [int(r["tokens"]) for r in large]
    shares = None if weights is None else [float(weights.get(r["source"], 0.0)) for r in large]
    if total - sum(sums):
        if (total - sum(sums)) * size >= total or not sums:
            sums.append(total - sum(sums))
            tail = len(sums) - 1
            if shares is not None:
                named = {r["source"] for r in large}
                shares.append(sum(w for s, w in weights.items() if s not in named))
        else:
            tail = int(np.argmax(sums))
            sums[tail] += total - sum(sums)
    else:
        tail = -1
    spark = docs.sparkSession
    known = spark.createDataFrame([(r["source"], k) for k, r in enumerate(large)], "source string, queue int")
    queued = parts.alias("p").join(F.broadcast(known).alias("k"), F.expr("p.source <=> k.source"), "left").select("p.*", F.coalesce("queue", F.lit(tail)).alias("queue"))
    until = W.partitionBy("queue").orderBy("part", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    begins = materialize(queued.select("source", "part", "queue", F.coalesce(F.sum("tokens").over(until), F.lit(0)).alias("begin")), "pack-begins")
    discard(parts)
    c, b = coded.alias("c"), sized_broadcast(begins).alias("b")
    placed = c.join(b, F.expr("c.part = b.part and c.source <=> b.source")).select("c.doc_id", "b.queue", (F.col("b.begin") + F.col("c.ahead")).alias("at"), "c.n", "c.ids")
    schedule = Schedule(sums, size, shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _pieces(batch, schedule, width)

    return placed.mapInArrow(run, PIECES)


def times_over(a: np.ndarray, b: int, n: int) -> np.ndarray:
    """floor(a * b / n) for 0 <= a <= n and 0 <= b <= n < 2^61, in 64 bits: ``a`` in limbs, from the highest."""
    a = np.asarray(a, np.int64)
    if b == n:
        return a
    bits = max(1, 62 - n.bit_length())
    whole, rest = np.zeros_like(a), np.zeros_like(a)  # a * b so far = whole * n + rest
    for k in range(-(-n.bit_length() // bits) - 1, -1, -1):
        limb = a >> (k * bits) & ((1 << bits) - 1)
        # shift what is there by a limb, then add the limb's share
        up, left = np.divmod(rest << bits, n)
        more, over = np.divmod(limb * b, n)
        whole, rest = (whole << bits) + up + more, left + over
        carry = rest >= n
        whole, rest = whole + carry, rest - n * carry
    return whole


class Schedule:
    """What each queue serves in each window.

    phases: tokens each queue serves in each phase; ``below[p][s]`` of them by queues before ``s``.
    """

    def __init__(self, sums: Sequence[int], size: int, shares: Sequence[float] | None = None) -> None:
        self.size, self.total = size, sum(sums)
        self.windows = -(-self.total // size)
        phases = [list(sums)] if shares is None else phases_of(sums, shares)
        self.below = [[0, *accumulate(p)] for p in phases]
        self.starts = np.array([0, *accumulate(sum(p) for p in phases)], np.int64)
        served = np.cumsum([[0] * len(sums), *phases], axis=0, dtype=np.int64)  # by queue, before each phase
        self.queue_starts = served
        self.before_phase = np.concatenate([np.zeros((len(served), 1), np.int64), np.cumsum(served, axis=1)], 1)

    def served(self, windows: np.ndarray, queues: int) -> np.ndarray:
        """Tokens that the first ``queues`` queues have served together before each window."""
        windows = np.asarray(windows, np.int64)
        t = np.where(windows >= self.windows, self.total, windows * self.size)
        phase = np.minimum(np.searchsorted(self.starts, t, side="right") - 1, len(self.below) - 1)
        out = np.empty_like(t)
        for p in np.unique(phase).tolist():
            own = phase == p
            out[own] = self.before_phase[p, queues] + times_over(t[own] - self.starts[p], self.below[p][queues], int(self.starts[p + 1] - self.starts[p]))
        return out

    def before(self, windows: np.ndarray, queue: int) -> np.ndarray:
        """Tokens that a queue has served before each window."""
        return self.served(windows, queue + 1) - self.served(windows, queue)

    def window(self, position: np.ndarray, queue: int) -> np.ndarray:
        """The window that serves each position of a queue: an estimate, then steps."""
        starts = self.queue_starts[:, queue]
        phase = np.clip(np.searchsorted(starts, position, side="right") - 1, 0, len(self.below) - 1)
        part = (position - starts[phase]) / np.maximum(starts[phase + 1] - starts[phase], 1)
        w = ((self.starts[phase] + part * (self.starts[phase + 1] - self.starts[phase])) // self.size).astype(np.int64)
        w = np.clip(w, 0, self.windows - 1)
        while (up := self.before(w + 1, queue) <= position).any():
            w = w + up
        while (down := self.before(w, queue) > position).any():
            w = w - down
        return w


def phases_of(sums: Sequence[int], shares: Sequence[float]) -> list[list[int]]:
    """Tokens by phase and queue: active queues serve by weight until one of them ends."""
    left, out = list(sums), []
    weight = [Fraction(w) for w in shares]
    while any(left):
        active = [s for s, n in enumerate(left) if n and weight[s] > 0]
        if not active:
            return [*out, left]  # what has no weight is mixed as it occurs
        rounds = min(Fraction(left[s]) / weight[s] for s in active)
        phase = [0] * len(left)
        for s in active:
            phase[s] = min(left[s], int(rounds * weight[s]))
            left[s] -= phase[s]
        out.append(phase)
    return out or [left]


def _pieces(batch: pa.RecordBatch, schedule: Schedule, width: int) -> Iterator[pa.RecordBatch]:
    queues = batch.column(1).to_numpy(zero_copy_only=False)
    at, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
    ids = batch.column(4)
    for queue in np.unique(queues).tolist():
        own = np.flatnonzero(queues == queue)
        for some in np.array_split(own, max(1, len(own) // 2048)):
            a, k = at[some], n[some]
            first, last = schedule.window(a, queue), schedule.window(a + k - 1, queue)
            count = last - first + 1
            i = np.repeat(np.arange(len(some)), count)
            w = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(i))
            begin = schedule.before(w, queue)
            lo, hi = np.maximum(begin, a[i]), np.minimum(schedule.before(w + 1, queue), a[i] + k[i])
            keep = hi > lo
            i, w, lo, hi, begin = i[keep], w[keep], lo[keep], hi[keep], begin[keep]
            offset = schedule.served(w + 1, queue) - schedule.served(w, queue) + lo - begin
            start = lo - a[i]
            crcs = np.empty(len(i), np.int64)
            held, raw = -1, b""
            for j, (d, s, e) in enumerate(zip(i.tolist(), start.tolist(), (hi - a[i]).tolist(), strict=True)):
                if d != held:
                    held = d
                    raw = memoryview(np.frombuffer(ids[int(some[d])].as_buffer(), f"<u{width}").astype("<u4").tobytes())
                crcs[j] = zlib.crc32(raw[4 * s : 4 * e])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some[i])), *map(pa.array, (start, hi - lo, crcs, k[i], w, offset, np.full(len(i), queue, np.int32)))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )
