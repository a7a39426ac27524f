"""Importance resampling, hard negatives and best-fit packing against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bestfit, hardneg, queries, resample

from ..oracle import check, connect
from .test_operators import CLASHES, documents, empty, odd  # noqa: F401

SQL = queries.oracle_sql()


# importance resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall(re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (text or "").encode()))
    return len(w), [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, target, percent=5, least=20):
    """Sorted (doc_id, n_features, weight, score, rank) by counting n-gram by n-gram."""
    found = [(i, *grams(t)) for i, t in docs]
    s = Counter(zlib.crc32(g) % 10000 for *_, f in found for g in f)
    t = Counter(zlib.crc32(g) % 10000 for x in target for g in grams(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for i, n, f in found:
        weight = sum(gain(zlib.crc32(g) % 10000) for g in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_crc_of_spans_and_of_runs():
    rng = random.Random(2)
    words = ["a" * n for n in (0, 1, 47, 48, 49, 500)] + ["".join(rng.choice("abzé漢9") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    starts = ends - [len(x) for x in raw]
    assert resample.crc_of_spans(data, starts, ends).tolist() == [zlib.crc32(x) for x in raw]
    follow = resample.Followed(ends - starts)
    k = np.arange(1, len(raw))
    got = follow(np.array([zlib.crc32(x) for x in raw[:-1]], np.uint32), np.array([zlib.crc32(x) for x in raw[1:]], np.uint32), k)
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(raw[:-1], raw[1:], strict=True)]


@pytest.mark.parametrize("piece", [64, 2 << 20])
def test_buckets_are_those_of_joined_words(monkeypatch, piece):
    texts = ["One two, THREE four", "", "x", "ß9 漢字—b c\x00d e" * 3, None, "w " * 40]
    monkeypatch.setattr(resample, "pieces", lambda column, f=resample.pieces: f(column, piece))
    got = [(int(w), sorted(v[a:b].tolist())) for words, v, at in resample.buckets_of(pa.array(texts), 997) for w, a, b in zip(words, at[:-1], at[1:], strict=True)]
    assert got == [(n, sorted(zlib.crc32(g) % 997 for g in f)) for n, f in map(grams, texts)]


def test_resampling_is_the_sql(spark, sf_dir):
    check(queries.op11_resample(spark, sf_dir), connect(sf_dir), SQL["op11_resample"])


def test_resampling_of_odd_rows(spark, odd, empty):  # noqa: F811
    long = " ".join(f"w{k % 977}" for k in range(300_000))
    extra = [(i, "the of and " * 10, "en", "s", 1) for i in range(400)] + [(900, long, "en", "s", 1), (None, "of and the " * 9, None, None, None), (None, "of and the " * 9, None, None, None), (7, "of and one " * 9, None, None, None)]
    docs = odd.unionByName(spark.createDataFrame(extra, odd.select("doc_id", "text", "lang", "source", "n_chars").schema), allowMissingColumns=True).repartition(5)
    target = spark.createDataFrame([("The of and",), (None,), ("und und one",), ("",)], "text string").withColumn("bucket", F.lit(1))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(resample.resample(docs, target)) == resampled(rows, [r["text"] for r in target.collect()])
    assert rows_of(resample.resample(docs, target.limit(0), percent=50)) == resampled(rows, [], 50)
    assert rows_of(resample.resample(docs, target, percent=100, least_words=0)) == resampled(rows, [r["text"] for r in target.collect()], 100, 0)
    assert resample.resample(empty, target).count() == 0


def test_texts_are_cut_once_for_all_their_rows(spark):
    docs = spark.createDataFrame([(i, f"text number {i % 3}") for i in range(3000)], "doc_id long, text string").repartition(7)
    got = {r["text"]: r["copies"] for r in resample.grouped(docs, "text").collect()}
    assert got == {f"text number {k}": 1000 for k in range(3)}
    plan = resample.grouped(docs, "text")._jdf.queryExecution().toString()
    assert "partial_count" in plan


# hard negatives

def mined(rows, positives=5, negatives=5):
    """By full sorting; rows: vec_id, vector, label, all valid and each id once."""
    ids, labels = np.array([r[0] for r in rows]), np.array([(r[2] + 1) % 10 if r[0] % 7 == 0 else r[2] for r in rows])
    q = np.floor(256 * np.array([r[1] for r in rows], float)).astype(np.int64)
    out = []
    for k in np.flatnonzero(ids % 100 == 0):
        s = q @ q[k]
        order = [j for j in np.lexsort((ids, -s)) if j != k]
        for p in [j for j in order if labels[j] == labels[k]][:positives]:
            inside = [j for j in order if labels[j] != labels[k] and 80 * s[p] <= 100 * s[j] <= 100 * s[p]]
            out += [(int(ids[k]), int(ids[p]), n + 1, int(ids[j]), int(s[p]), int(s[j])) for n, j in enumerate(inside[:negatives])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def mine(df, **how):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 100 == 0, label, **how).collect())


def test_hard_negatives_are_the_sql(spark, sf_dir):
    check(queries.op12_hard_negatives(spark, sf_dir), connect(sf_dir), SQL["op12_hard_negatives"])


@pytest.mark.parametrize("blocks", [(32_768, 2_048), (100, 3)])
def test_hard_negatives_of_clusters_copies_and_ties(spark, monkeypatch, blocks):
    monkeypatch.setattr(hardneg, "CANDIDATES", blocks[0])
    monkeypatch.setattr(hardneg, "ANCHORS", blocks[1])
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(9, 8))
    x = centers[rng.integers(0, 9, 900)] + 0.2 * rng.normal(size=(900, 8))
    x[300:600] = x[300]  # a third of the rows alike, with several labels
    x[700:720] *= -1
    rows = [(i, v.astype(np.float32).tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS).repartition(6)
    assert mine(df) == mined(rows)
    assert mine(df, cell_count=2, positives=3, negatives=7) == mined(rows, 3, 7)


def test_bounds_hold_the_score():
    rng = np.random.default_rng(5)
    x, a = rng.integers(-40, 40, (200, 6)), rng.integers(-40, 40, (20, 6))
    borders = np.sort(rng.integers(-30, 30, (6, 7)), 1)
    low = np.concatenate([np.full((6, 1), -40), borders + 1], 1)
    high = np.concatenate([borders, np.full((6, 1), 40)], 1)
    cell = np.stack([np.searchsorted(borders[d], x[:, d]) for d in range(6)], 1)
    lo, hi = hardneg.bounds(cell, np.stack([low, high], 2), a)
    assert (lo <= a @ x.T).all() and (a @ x.T <= hi).all()


def test_hard_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist(), int(i % 3)) for i in range(250)]
    bad = [
        (1000, None, 1), (1001, [], 1), (1002, [1.0, None, 0.0, 0.0], 1), (1003, [float("nan"), 0.0, 0.0, 0.0], 1), (1004, [float("inf"), 0.0, 0.0, 0.0], 1),
        (1005, [1.0, 2.0], 1), (1100, [1.0, 0.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows + bad + rows[90:110], VECTORS)
    for c in ["score", "q", "v", "anchor", "of", "block", "place", "anchor_id"]:
        df = df.withColumn(c, F.lit("x"))
    assert mine(df.repartition(4)) == mined(rows)
    assert mine(df.where("vec_id < 0")) == [] and mine(spark.createDataFrame([(100, [1.0], 1)], VECTORS)) == []
    huge = [(100, [1e30, 1.0], 1), (1, [1e30, 2.0], 1), (2, [-1e30, 2.0], 2), (3, [9e4, 0.0], 2)]
    assert [r[1:4] for r in mine(spark.createDataFrame(huge, VECTORS))] == [(1, 1, 3)]
    zero = [(100, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2)]
    assert mine(spark.createDataFrame(zero, VECTORS)) == [(100, 1, 1, 2, 0, 0)]


# best-fit packing


def sequences(lengths, size=1024):
    """How many sequences best fit in order of decreasing length takes."""
    count, gaps, n = Counter(lengths), Counter(), 0
    for z in range(size, 0, -1):
        k = count[z]
        for g in range(z, size + 1):
            while k and gaps[g]:
                take = min(k, g // z)
                gaps[g], gaps[g - take * z], k = gaps[g] - 1, gaps[g - take * z] + 1, k - take
        while k:
            take = min(k, size // z)
            n, k = n + 1, k - take
            gaps[size - take * z] += 1
    return n


def packed(rows, size=1024):
    """Checks the pieces; (number of sequences, lengths of what is shorter than a sequence)."""
    at, docs = {}, {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for held in at.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= size
    return len(at), docs


def test_best_fit_of_documents(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = queries.op13_best_fit(spark, sf_dir).collect()
    n, docs = packed(rows)
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    tokenizer.encode_special_tokens = True
    crc = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in rows}
    lengths = []
    for i, t in [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect()]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = sorted({0, len(ids), *range(len(ids) % 1024, len(ids), 1024)})
        assert sorted(docs[i]) == [(k, a, b - a) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            assert crc[i, k] == zlib.crc32(ids[a:b].tobytes())
            lengths.append(b - a)
    assert n <= 1.02 * sequences(lengths)


@pytest.mark.parametrize(
    "lengths",
    [
        [600] * 50, [341] * 300 + [1023, 1, 1, 1], [1] * 3000 + [700] * 9, [512] * 40 + [511] * 40 + [1] * 40,
        [random.Random(1).randrange(1, 1024) for _ in range(1500)], [random.Random(2).randrange(1, 60) for _ in range(2000)], [300] * 500 + [random.Random(3).randrange(1, 1024) for _ in range(150)], [5],
    ],
)
def test_rounds_place_every_item_once(spark, lengths):
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "uid long, length long").repartition(3)
    placed = [r for t in bestfit.best_fit(items, 1024) for r in t.collect()]
    assert sorted(r["uid"] for r in placed) == list(range(len(lengths)))
    at = {}
    for r in placed:
        at.setdefault(r["seq"], []).append((r["offset"], lengths[r["uid"]]))
    for held in at.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(at) <= 1.03 * sequences(lengths) + 1


def test_sweeps_are_brackets():
    rng = random.Random(4)
    for n in (0, 1, 5, 60, 300):
        gap = np.array([rng.random() < 0.5 for _ in range(n)], bool)
        stack, pairs, alone = [], set(), []
        for k, g in enumerate(gap):
            if g:
                stack.append(k)
            elif stack:
                pairs.add((stack.pop(), k))
            else:
                alone.append(k)
        a, b, found = bestfit.sweep(gap)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == pairs and found.tolist() == alone


def test_ranges_left_over_meet_by_rank():
    assert bestfit.left_runs([2, 3, 0, 4], [1, 0, 5, 0]) == [(0, -1, 2), (2, 0, 1), (3, -1, 2), (5, 2, 4)]


def test_best_fit_of_odd_rows(odd, empty):  # noqa: F811
    rows = bestfit.pack(odd, queries.vocabulary(), size=64).collect()
    packed(rows, 64)
    ends = [r for r in rows if r["doc_id"] == 0]
    assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in ends] == [(0, 0, 1, zlib.crc32(b"\2\0\0\0"))]
    assert sum(r["start"] == 0 for r in rows) == odd.count()
    assert bestfit.pack(empty, queries.vocabulary()).count() == 0
