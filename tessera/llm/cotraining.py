"""Quality by co-training: a view of the text's content and a view of the page's metadata.

Each view has a logistic classifier of its own, learned from labelled documents outside the held-out
fold. Over some rounds each names the documents it is most sure of, in the classes' shares, and the
other learns from these pseudo-labels too. Both are then calibrated on labelled documents set apart,
and a last logistic function of the two calibrated logits scores every document.

Pseudo-labels go to any document outside the held-out fold that has no label: every round scores all of
them where their features lie, each task passes on the few it is surest of, and the best of all tasks
reach the driver. No labelled document gets a pseudo-label, so those set apart are never learned from.

Content view: shares of letters, capitals, digits, signs and white space, word lengths, distinct
words, the most frequent word, word 1-grams hashed into 64 buckets. Metadata view: source, language,
length in characters and in lines. At most ``labelled`` labelled vectors, by hash of the id, and ``grow``
pseudo-labelled ones a round and view reach the driver.

Edge cases: null text counts as empty; null source and language are values of their own; a null id is
given back as null and never learned from; rows with the same id, repeated or not, are scored each, and
count once (as the row with the smallest hash of its features) where models learn; ties in confidence go
to the smaller id; without labels of both classes every score is the share of label 1 (0.5 without
labels); very long texts are measured whole; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, hash_thinned, held_out, materialize
from .textbytes import SpanHasher, pieces, slices, word_spans

WORD_BUCKETS, NAME_BUCKETS = 64, 32
VIEWS = "doc_id long, content array<float>, metadata array<float>"

_KINDS = np.zeros((256, 6), np.int64)  # letters, capitals, digits, white space, signs, bytes of other letters
_KINDS[97:123, 0] = 1
_KINDS[65:91, :2] = 1
_KINDS[48:58, 2] = 1
_KINDS[[32, 9, 10, 11, 12, 13], 3] = 1
_KINDS[0x80:, 5] = 1
_KINDS[33:127, 4] = 1 - _KINDS[33:127, :3].max(1)


def views(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id and the feature vectors of both views."""

    def named(values: list, salt: int) -> np.ndarray:
        import zlib

        out = np.zeros((len(values), NAME_BUCKETS))
        known = {v: zlib.crc32(f"{salt}:{v}".encode()) % NAME_BUCKETS for v in set(values)}
        out[np.arange(len(values)), [known[v] for v in values]] = 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                content, sizes = [], []
                for _, _, data, at in pieces(batch.column(1)):
                    c, m = _measure(data, at)
                    content.append(c)
                    sizes.append(m)
                content, sizes = np.concatenate(content), np.concatenate(sizes)
                metadata = np.concatenate([sizes, named(batch.column(2).to_pylist(), 1), named(batch.column(3).to_pylist(), 2)], 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(content), _lists(metadata)], names=["doc_id", "content", "metadata"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(run, VIEWS)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.astype(np.float32).ravel()))


def _measure(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)
    sums = np.stack([np.concatenate([[0], np.cumsum(_KINDS[data, k])]) for k in range(6)], 1)
    kinds = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)[:, None]
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    lines = lines[at[1:]] - lines[at[:-1]] + 1
    s, e, before = word_spans(data, at)
    words = np.diff(before)
    row = np.repeat(np.arange(len(n)), words)
    h = SpanHasher(data)(s, e) if len(s) else np.zeros(0, np.uint64)
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(h)))
    distinct = np.bincount(row[order][begin], minlength=len(n)) if len(h) else np.zeros(len(n), int)
    most = np.zeros(len(n))
    np.maximum.at(most, row[order][begin], run)
    w = np.maximum(words, 1)
    buckets = np.bincount(row * WORD_BUCKETS + (h % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=len(n) * WORD_BUCKETS).reshape(len(n), -1) / w[:, None]
    length = np.bincount(row, (e - s).astype(float), minlength=len(n)) / w
    content = np.concatenate([kinds, np.stack([length / 10, distinct / w, most / w, np.log1p(words) / 10], 1), buckets], 1)
    chars = n - np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])[at[1:]] + np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])[at[:-1]]
    sizes = np.stack([np.log1p(chars) / 10, np.log1p(lines) / 5, np.log1p(chars / lines) / 10], 1)
    return content, sizes


@dataclass
class Linear:
    """A logistic classifier of standardised features, with its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return self.slope * (z @ self.weights[1:] + self.weights[0]) + self.shift


@dataclass
class Model:
    content: Linear
    metadata: Linear
    joint: np.ndarray

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.logit(content), self.metadata.logit(metadata)
        return sigmoid(self.joint[0] + self.joint[1] * a + self.joint[2] * b), sigmoid(a), sigmoid(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    f = np.concatenate([np.ones((len(x), 1)), x], 1)
    penalty = np.full(f.shape[1], ridge)
    penalty[0] = 1e-6
    b = np.zeros(f.shape[1])
    for _ in range(rounds):
        p = sigmoid(f @ b)
        step = np.linalg.solve((f * (p * (1 - p) + 1e-9)[:, None]).T @ f + np.diag(penalty), f.T @ (p - y) + penalty * b)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 3.0) -> Linear:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-4)
    return Linear(mean, scale, logistic(np.clip((x - mean) / scale, -8, 8), y, ridge))


#: For a pupil's view: ids, pseudo-labels and the pupil's vectors.
Given = tuple[np.ndarray, np.ndarray, np.ndarray]


def co_train(known: tuple[np.ndarray, np.ndarray, np.ndarray], choose: Callable[..., list[Given]], rounds: int = 5, grow: int = 200, sure: float = 0.9) -> Model | None:
    """A model from (content, metadata, labels) and what ``choose`` finds in a round; None without both classes.

    ``choose(models, used, downs, ups, sure)`` gives, for the pupil of each view, at most ``downs`` and ``ups``
    documents that the other view's model is surest are of class 0 and 1; none of ``used``, the ids given before.
    """
    content, metadata, y = known
    if len(set(y.tolist())) < 2:
        return None
    apart = np.arange(len(y)) % 4 == 3  # for calibration
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart[:] = True
        learn = apart
    else:
        learn = ~apart
    x = [content, metadata]
    share = y[learn].mean()
    downs, ups = max(1, round(grow * (1 - share))), max(1, round(grow * share))
    given: list[list[Given]] = [[], []]  # by view that learns from them
    used: list[set[int]] = [set(), set()]
    models = [linear(v[learn], y[learn]) for v in x]
    for _ in range(rounds):
        new = choose(models, used, downs, ups, sure)
        for view in (0, 1):
            used[view].update(new[view][0].tolist())
            if len(new[view][0]):
                given[view].append(new[view])
            models[view] = linear(np.concatenate([x[view][learn], *[g[2] for g in given[view]]]), np.concatenate([y[learn], *[g[1] for g in given[view]]]))
    for view, m in enumerate(models):
        b = logistic(m.logit(x[view][apart])[:, None], y[apart], 0.1)
        m.slope, m.shift = float(b[1]), float(b[0])
    logits = np.stack([m.logit(v[apart]) for m, v in zip(models, x, strict=True)], 1)
    return Model(models[0], models[1], logistic(logits, y[apart], 1.0))


def known_labels(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and label of all labelled documents; of several labels the largest."""
    return labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(features: DataFrame, known: DataFrame, labelled: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors and labels of labelled documents outside the held-out fold, by hash of the id."""
    picked = hash_thinned(known.where(~held_out()), labelled).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(labelled)
    rows = features.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min_by(F.struct("content", "metadata"), F.xxhash64("content", "metadata")).alias("x")).select("doc_id", "label", "x.*").collect()
    rows.sort(key=lambda r: (hash_order(r["doc_id"]), r["doc_id"]))
    x = [np.array([r[k] for r in rows], float).reshape(len(rows), -1) if rows else np.zeros((0, 1)) for k in ("content", "metadata")]
    return x[0], x[1], np.array([r["label"] for r in rows], float)


SUREST = "kind int, doc_id long, confidence double, vector array<float>"


def surest(pool: DataFrame) -> Callable[..., list[Given]]:
    """``choose`` of co_train over a table of unlabelled vectors, however large; each id once."""

    def choose(models: list[Linear], used: list[set[int]], downs: int, ups: int, sure: float) -> list[Given]:
        gone = [np.array(sorted(u), np.int64) for u in used]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * 4
            for batch in batches:
                ids = batch.column(0).to_numpy()
                x = [_matrix(batch.column(k)) for k in (1, 2)]
                for pupil in (0, 1):
                    p = sigmoid(models[1 - pupil].logit(x[1 - pupil])).round(9)  # last bits depend on how rows are batched
                    free = ~np.isin(ids, gone[pupil])
                    for up in (0, 1):
                        sureness = p if up else 1 - p
                        at = np.flatnonzero(free & (sureness >= sure))
                        held[2 * pupil + up] = best(held[2 * pupil + up], (ids[at], sureness[at], x[pupil][at]), ups if up else downs)
            for kind, got in enumerate(held):
                if got is not None and len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got[0]), kind, np.int32)), pa.array(got[0]), pa.array(got[1]), _lists(got[2])], names=["kind", "doc_id", "confidence", "vector"])

        # a few hundred rows from each task, the same few from all
        passed = materialize(pool.mapInArrow(run, SUREST), "quality-surest")
        out = []
        for pupil in (0, 1):
            rows = []
            for up, n in ((0, downs), (1, ups)):
                order = [F.desc("confidence"), F.asc("doc_id"), F.asc(F.xxhash64("vector"))]
                once = passed.where(F.col("kind") == 2 * pupil + up).groupBy("doc_id").agg(F.max_by("vector", F.struct("confidence", F.xxhash64("vector"))).alias("vector"), F.max("confidence").alias("confidence"))
                rows += [(r["doc_id"], up, r["vector"]) for r in once.orderBy(*order).limit(n).collect()]
            out.append((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float).reshape(len(rows), len(models[pupil].mean))))
        discard(passed)
        return out

    return choose


def best(held: Given | None, new: Given, n: int) -> Given:
    """Of (ids, confidence, vectors), the n most sure, each id once, ties to the smaller id."""
    ids, sureness, x = new if held is None else (np.concatenate(c) for c in zip(held, new, strict=True))
    order = np.lexsort((ids, -sureness))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:n]
    return ids[order], sureness[order], x[order]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def hash_order(doc_id: int) -> str:
    import hashlib

    return hashlib.md5(str(doc_id).encode()).hexdigest()


SCORED = "doc_id long, score double, content_score double, metadata_score double"


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = 4000, rounds: int = 5, grow: int = 200, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted, content_score, metadata_score.

    Models learn from at most ``labelled`` labelled documents and from ``grow`` pseudo-labels a round and view.
    """
    features = materialize(views(docs), "quality-views")
    marked = known_labels(labels, label)
    known = labelled_sample(features, marked, labelled)
    pool = features.where("doc_id is not null").where(~held_out()).join(marked.select("doc_id"), "doc_id", "left_anti").select("doc_id", "content", "metadata")
    if rounds and len(set(known[2].tolist())) == 2:
        pool = materialize(pool, "quality-pool")
    model = co_train(known, surest(pool), rounds, grow)
    discard(pool)
    share = float(known[2].mean()) if len(known[2]) else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            got = [np.full(n, share)] * 3 if model is None or not n else model.score(_matrix(batch.column(1)), _matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, got)], names=[x.split()[0] for x in SCORED.split(", ")])

    scored = features.mapInArrow(run, SCORED)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "content_score", "metadata_score")
