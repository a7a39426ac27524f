"""Near duplicates by a chosen-path join on sets of word n-grams (five words, Jaccard 0.8 or more).

In each run and at each level a document chooses a few of its shingles: those whose hash lies below
a bound inverse to the size of its set, so similar sets choose the same ones with a probability that
grows with their similarity. Documents that choose the same shingle share a bucket. Buckets of up to
``limit`` documents are compared by brute force; larger ones are split by the shingles chosen at the
next level, which each path draws by a hash of its own, so that a pair may go on along any of the
shingles it shares, independently of the others. A bucket that a level hardly split holds sets alike,
which no further level parts; it is compared in blocks, all against all, and so is what is still large
after the last level, so no bucket is ever cut short. Such buckets hold the same sets many times over:
two sets whose largest bucket is the same meet in that one and are not compared again in the others.
Runs repeat with other hashes until the ``recall`` aimed at holds for pairs
at the bound itself; closer pairs are found more surely.

Comparison is by small sketches (one-permutation minima, 4 bits each), with a margin of five standard
errors. It gives loose groups; inside each the sets themselves are compared, in blocks of bounded
size, and links are counted where they are found: pairs are never emitted. Documents with equal sets
are one node throughout.

Edge cases: texts of fewer than five words have one shingle, all their words; texts without words
(null, empty, blank) stand alone, without links; rows that share a doc_id but not a text are joined
on their own sets; a null id counts as the largest one and is given back as null; repeated rows are
copies, ties between rows of one id go to the smaller text_key; very long texts are handled whole; an
empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import discard, materialize, order_id, release, shown_id, sized_broadcast
from .components import components
from .substrings import Words
from .textbytes import PIECE_BYTES, mix, ragged, slices

_U = np.uint64
BINS = 64
NOTHING = 15
LEVELS = 4
LEVEL_BITS, PARENT_BITS = 2, 16
SHINGLE = 5
#: Bytes of text whose sets are made at once.
SLICE = 2 * PIECE_BYTES


class Sets:
    """Distinct shingles of each row: ``tokens`` ordered by row, ``at`` where each row's begin."""

    def __init__(self, column: pa.Array, n: int = SHINGLE) -> None:
        w = Words(column, 4 * n, doubled=False)
        count = w.count
        h = w.quarter  # windows of n words
        s = np.arange(len(h))
        whole = s[s + n <= w.before[w.row + 1]] if len(s) else s
        short = np.flatnonzero((count > 0) & (count < n))
        row = np.concatenate([w.row[whole], short])
        token = np.concatenate([h[whole], w.document_hashes(3)[short]])
        order = np.lexsort((token, row))
        row, token = row[order], token[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
        self.row, self.tokens = row[new], token[new]
        self.at = np.searchsorted(self.row, np.arange(len(count) + 1))
        self.size = np.diff(self.at)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(self.tokens * _U(0xC2B2AE3D27D4EB4F) + _U(9)), dtype=_U)])
        node = mix(sums[self.at[1:]] - sums[self.at[:-1]] + self.size.astype(_U) * _U(0x165667B19E3779F9))
        self.node = node.view(np.int64)

    def sketches(self) -> np.ndarray:
        """Codes (rows, BINS): 4 bits of each bin's smallest token, NOTHING in empty bins."""
        h = mix(self.tokens + _U(0x2545F4914F6CDD1D))
        slot = self.row * BINS + (h >> _U(58)).astype(np.int64)
        value = h & _U((1 << 58) - 1)
        least = np.full(len(self.size) * BINS, np.iinfo(np.uint64).max, _U)
        order = np.lexsort((value, slot))
        slot, value = slot[order], value[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        least[slot[first]] = value[first]
        codes = np.where(least == np.iinfo(np.uint64).max, NOTHING, (mix(least) % _U(NOTHING)).astype(np.uint8)).astype(np.uint8)
        return codes.reshape(-1, BINS)


def runs_for(recall: float, similarity: float, sample: float, levels: int = LEVELS) -> int:
    """Runs until a pair at the bound, one set inside the other, is found with that probability.

    A pair stays together at a level if it does along one of the paths it shares; these are independent.
    """
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-similarity / sample * p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


ABOUT = "doc_id long, text_key long, node long, size int"
PATHS = "key long, node long, size int, sketch binary, deeper array<long>"


def describe(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, node (a hash of its set) and set size (0 without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, SLICE):
                s = Sets(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.node), pa.array(s.size.astype(np.int32))], names=[x.split()[0] for x in ABOUT.split(", ")])

    return rows.mapInArrow(run, ABOUT)


def paths(rows: DataFrame, runs: int, sample: float, seed: int) -> DataFrame:
    """First-level buckets of every set, one row for each shingle chosen in each run, copies in a task once."""
    odd = np.random.default_rng(seed).integers(0, 1 << 63, size=runs, dtype=np.uint64) * _U(2) + _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, 2, SLICE):
                s = Sets(batch.column(2))
                fresh = np.zeros(len(s.size), bool)
                for r, (node, n) in enumerate(zip(s.node.tolist(), s.size.tolist(), strict=True)):
                    if n and node not in seen:
                        fresh[r] = True
                        if len(seen) < 2_000_000:
                            seen.add(node)
                codes = s.sketches()
                packed = codes[:, ::2] << 4 | codes[:, 1::2]
                least = (2.0**64 * np.minimum(1 / (sample * np.maximum(s.size, 1)), 1 - 1e-16)).astype(_U)
                bound = np.where(fresh, least, _U(0))[s.row]
                keys, who, deeper, deeper_n = [], [], [], []
                for k in range(runs):
                    first = np.flatnonzero(s.tokens * odd[k] < bound)
                    if not len(first):
                        continue
                    row, value, root = s.row[first], mix(s.tokens[first] ^ odd[k]), np.arange(len(first))
                    keys.append(value)
                    who.append(row)
                    later, later_root = [], []
                    for level in range(1, LEVELS):
                        path, value = continued(s, least, row, value, level)
                        row, root = row[path], root[path]
                        later.append(value)
                        later_root.append(root)
                    later, later_root = np.concatenate(later), np.concatenate(later_root)
                    deeper.append(later[np.argsort(later_root, kind="stable")])
                    deeper_n.append(np.bincount(later_root, minlength=len(first)))
                if not keys:
                    continue
                row = np.concatenate(who)
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(deeper_n))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(deeper).view(np.int64)))
                sketch = pa.array([packed[r].tobytes() for r in row.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(s.node[row]), pa.array(s.size[row].astype(np.int32)), sketch, lists], names=[x.split()[0] for x in PATHS.split(", ")])

    return rows.mapInArrow(run, PATHS)


def continued(s: Sets, least: np.ndarray, row: np.ndarray, value: np.ndarray, level: int, some: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that paths (their rows and values) choose at a level: number of the path, and value.

    A value holds a hash of the path, PARENT_BITS of the path it continues, and its level.
    """
    path, out = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    own, size = mix(value + _U(level)) | _U(1), s.size[row]
    tag = (value >> _U(64 - PARENT_BITS)) << _U(LEVEL_BITS)
    until = np.cumsum(size)
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(until // some)) + 1):
        if not len(part):
            continue
        n = size[part]
        t = s.tokens[ragged(s.at[row[part]], n)]
        hit = np.flatnonzero(t * np.repeat(own[part], n) < np.repeat(least[row[part]], n))
        who = part[np.searchsorted(np.cumsum(n), hit, side="right")]
        path.append(who)
        out.append((mix(t[hit] ^ own[who]) >> _U(PARENT_BITS + LEVEL_BITS) << _U(PARENT_BITS + LEVEL_BITS)) | tag[who] | _U(level))
    return np.concatenate(path), np.concatenate(out)


def next_level(rows: DataFrame, k: int) -> DataFrame:
    """Paths of level ``k`` continued to the next: one row for each shingle that a path chooses there.

    rows: key, token (the path's value), node, size, sketch, deeper, members.
    """
    parent = F.shiftrightunsigned("token", 64 - PARENT_BITS)

    def wanted(x):
        return (x.bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)) == k + 1) & (F.shiftrightunsigned(x, LEVEL_BITS).bitwiseAND(F.lit((1 << PARENT_BITS) - 1)) == parent)

    chosen = rows.withColumn("next", F.explode(F.filter("deeper", wanted)))
    return chosen.select(F.xxhash64("key", "next").alias("key"), F.col("next").alias("token"), "node", "size", "sketch", "deeper", F.col("members").alias("parent"))


def alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches (broadcast against each other on the last axis) may belong to sets that similar."""
    used = ((a != NOTHING) | (b != NOTHING)).sum(-1)
    same = ((a == b) & (a != NOTHING)).sum(-1)
    return enough(same, used, na, nb, similarity)


def enough(same: np.ndarray, used: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    need = similarity * used - 5 * np.sqrt(np.maximum(similarity * (1 - similarity) * used, 0.25))
    return (same >= need) & (np.minimum(na, nb) >= similarity * np.maximum(na, nb))


EDGES = "a long, b long"


def compare(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges from each document to the first of its group, among documents with one key that look alike.

    rows: key, side (0: against all of the key; 1 and 2: only across), node, size, sketch; each key in one task, together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            kept = t if kept is None else pa.concat_tables([kept, t])
            key = kept.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield edges(kept.slice(0, cut))
                kept = kept.slice(cut)
        if kept is not None and kept.num_rows:
            yield edges(kept)

    def edges(t: pa.Table) -> pa.RecordBatch:
        key, side, node, size = (t.column(c).to_numpy() for c in ("key", "side", "node", "size"))
        raw = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(key), -1)
        codes = np.empty((len(key), BINS), np.uint8)
        codes[:, ::2], codes[:, 1::2] = raw >> 4, raw & 15
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(begin, len(key)))
        left, right = [], []
        for n in np.unique(length[(length > 1) & (length <= 24)]).tolist():
            i, j = np.triu_indices(n, 1)
            base = begin[length == n]
            for some in np.array_split(base, max(1, len(base) * len(i) // 50_000)):
                p, q = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                ok = np.minimum(size[p], size[q]) >= similarity * np.maximum(size[p], size[q])
                p, q = p[ok], q[ok]
                ok = alike(codes[p], codes[q], size[p], size[q], similarity)
                left.append(p[ok])
                right.append(q[ok])
        for b, n in zip(begin[length > 24].tolist(), length[length > 24].tolist(), strict=True):
            # in order of size, only a stretch of sizes can be similar enough
            order = b + np.argsort(size[b : b + n], kind="stable")
            own, sides = codes[order], side[order]
            sizes = size[order]
            until = np.searchsorted(sizes, sizes / similarity, side="right")
            for a in range(0, n, 128):
                e = min(a + 128, n)
                stop = int(until[e - 1])
                same, none = np.zeros((e - a, stop - a), np.uint8), np.zeros((e - a, stop - a), np.uint8)
                for c in range(BINS):
                    x, y = own[a:e, c][:, None], own[a:stop, c][None, :]
                    equal, empty = x == y, (x == NOTHING)
                    none += equal & empty
                    same += equal & ~empty
                ok = enough(same, BINS - none.astype(np.int64), sizes[a:e][:, None], sizes[a:stop][None, :], similarity)
                ok &= (sides[a:e][:, None] == 0) | (sides[a:e][:, None] != sides[a:stop][None, :])
                p, q = np.nonzero(np.triu(ok, 1))
                left.append(order[a + p])
                right.append(order[a + q])
        p = np.concatenate(left) if left else np.zeros(0, np.int64)
        q = np.concatenate(right) if right else np.zeros(0, np.int64)
        root = roots(len(key), p, q)
        linked = np.flatnonzero(root != np.arange(len(key)))
        a, b = node[linked], node[root[linked]]
        pair = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return rows.mapInArrow(run, EDGES)


def roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    while True:
        a, b = root[p], root[q]
        low = np.minimum(a, b)
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


VERIFIED = "node long, links long, leader long"


def verify(rows: DataFrame, similarity: float) -> DataFrame:
    """Links of each node inside its group, counted exactly on the sets, and the first node it is linked with.

    rows: group, side (0 as in compare), node, text; each group in one task, together.
    """
    up, down = _fraction(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            kept = t if kept is None else pa.concat_tables([kept, t])
            group = kept.column("group").to_numpy()
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield from counted(kept.slice(0, cut))
                kept = kept.slice(cut)
        if kept is not None and kept.num_rows:
            yield from counted(kept)

    def counted(t: pa.Table) -> Iterator[pa.RecordBatch]:
        group = t.column("group").to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b, e in zip(begin.tolist(), np.append(begin[1:], len(group)).tolist(), strict=True):
            some = t.slice(b, e - b)
            text = some.column("text").combine_chunks()
            s = Sets(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
            node, side = some.column("node").to_numpy(), some.column("side").to_numpy()
            overlap = overlaps(s)
            ok = overlap * (up + down) >= up * (s.size[:, None] + s.size[None, :])
            ok &= (side[:, None] == 0) | (side[:, None] != side[None, :])
            np.fill_diagonal(ok, False)
            p, q = np.nonzero(np.triu(ok, 1))
            out.append((node, ok.sum(1), node[roots(len(node), p, q)]))
        node, links, leader = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64)), pa.array(leader)], names=["node", "links", "leader"])

    return rows.mapInArrow(run, VERIFIED)


def _fraction(similarity: float) -> tuple[int, int]:
    """similarity as up / down in small whole numbers, so that bounds are compared exactly."""
    from fractions import Fraction

    f = Fraction(similarity).limit_denominator(10_000)
    return f.numerator, f.denominator


def overlaps(s: Sets, columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections, by products of slices of the incidence matrix."""
    n = len(s.size)
    _, token, count = np.unique(s.tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[token]
    col, row = number[token[keep]], s.row[keep]
    out = np.diag(s.size).astype(np.float32)
    total = int(shared.sum())
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for a in range(0, total, columns):
        lo, hi = np.searchsorted(col, [a, a + columns])
        m = np.zeros((n, min(columns, total - a)), np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        out += m @ m.T
    np.fill_diagonal(out, s.size)
    return np.rint(out).astype(np.int64)


def similar_documents(
    docs: DataFrame, similarity: float = 0.8, recall: float = 0.999, limit: int = 1000, block: int = 512, block_shingles: int = 2_000_000, sample: float = 0.7, seed: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, class_id (smallest id of its group of near duplicates), copy_of (smallest id with
    the same set), n_links (other sets at least that similar), n_copies (other rows with the same set),
    text_key (a hash of the text) and first (whether no row of the group has a smaller id, or the same id and a
    smaller text_key).

    Sets are verified in blocks of about ``block`` sets and ``block_shingles`` shingles.
    """
    spark = docs.sparkSession
    told = docs.select(order_id(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = told.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    about = materialize(describe(rows), "join-about")
    named = F.min(F.struct("doc_id", "text_key"))
    firsts = materialize(about.where("size > 0").groupBy("node").agg(named.alias("first"), F.count("*").alias("copies"), F.max("size").alias("size")), "join-firsts")
    paths_ = materialize(paths(rows, runs_for(recall, similarity, sample), sample, seed), "join-paths")
    level = paths_.withColumn("parent", F.lit(None).cast("long")).withColumn("token", F.col("key"))
    columns = ["key", "node", "size", "sketch"]
    edges = []
    for k in range(LEVELS):
        # keys that more than one set has; large ones go on to the next level
        keys = materialize(level.groupBy("key").agg(F.count("*").alias("members"), F.first("parent").alias("parent")).where("members > 1"), f"join-keys-{k}")
        some = keys.where(F.col("members") <= limit)
        small = level.join(some, "key", "left_semi").select(*columns, F.lit(0).alias("side"))
        edges.append(materialize(compare(small.repartition("key").sortWithinPartitions("key"), similarity), f"join-edges-{k}"))
        large = keys.where(F.col("members") > limit)
        if large.limit(1).count() == 0:
            break
        # what the last level hardly split holds sets alike; it is compared as it is, and so is all that is left at the end
        alike_ = F.lit(k == LEVELS - 1) | F.coalesce(F.col("members") * 2 > F.col("parent"), F.lit(False))
        big = level.drop("parent").join(large.withColumn("alike", alike_), "key")
        held = materialize(big.where("alike").select(*columns, "members").withColumn("home", home()), f"join-alike-{k}")
        dealt = in_blocks(unmet(held, limit), "key").select("group", "side", "node", "size", "sketch").withColumnRenamed("group", "key")
        edges.append(materialize(compare(dealt.repartition("key").sortWithinPartitions("key"), similarity), f"join-blocks-{k}"))
        discard(held)
        if k == LEVELS - 1:
            break
        level = materialize(next_level(big.where("not alike"), k), f"join-paths-{k + 1}")
        release(spark)
    discard(paths_)
    found = edges[0]
    for more in edges[1:]:
        found = found.union(more)
    loose = materialize(components(found), "join-loose")
    discard(*edges)
    release(spark)
    # the sets of what may be linked, once each, dealt into groups of bounded size
    joined = materialize(loose.join(firsts, "node").select("node", "root", "first", "size"), "join-loose-sizes")
    sizes = materialize(joined.groupBy("root").agg(F.count("*").alias("members"), F.sum("size").alias("shingles")), "join-sizes")
    parts = F.ceil(F.greatest(F.col("members") / block, F.col("shingles") / block_shingles)).cast("int")
    members = materialize(joined.join(sizes, "root").select("node", "root", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("own")), "join-members")
    linked = sized_broadcast(members)
    texts = rows.join(linked, (F.col("doc_id") == F.col("first_id")) & (F.col("text_key") == F.col("first_key"))).select("node", "root", "parts", "own", "text")
    texts = texts.dropDuplicates(["node"]).withColumn("from", F.lit(0))
    dealt = in_blocks(texts, "root").select("group", "side", "node", "text")
    checked = materialize(verify(dealt.repartition("group").sortWithinPartitions("group"), similarity), "join-checked")
    discard(members, sizes, joined, loose)
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    groups = materialize(components(checked.select(F.col("node").alias("a"), F.col("leader").alias("b"))), "join-groups")
    names = materialize(groups.join(firsts, "node").groupBy("root").agg(F.min("first").alias("class_first")), "join-names")
    near = groups.join(names, "root").select("node", "class_first")
    nodes = materialize(firsts.join(links, "node", "left").join(near, "node", "left").select("node", "first", "copies", "links", F.coalesce("class_first", "first").alias("class_first")), "join-nodes")
    discard(checked, groups, names, firsts)
    none = F.lit(0).cast("long")
    alone = about.where("size = 0").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), none.alias("n_links"), none.alias("n_copies"), F.lit(True).alias("first"))
    rest = about.where("size > 0").join(nodes, "node").select(
        "doc_id", "text_key", F.col("class_first.doc_id").alias("class_id"), F.col("first.doc_id").alias("copy_of"), F.coalesce("links", none).alias("n_links"), (F.col("copies") - 1).cast("long").alias("n_copies"),
        F.expr("doc_id = class_first.doc_id and text_key = class_first.text_key").alias("first"),
    )
    ids = [shown_id(c) for c in ("doc_id", "class_id", "copy_of")]
    return rest.union(alone).select(*ids, "n_links", "n_copies", "text_key", "first")


def home() -> Column:
    """Over rows (key, node, members): the largest bucket of each node. Two nodes of one home meet there."""
    return F.max(F.struct("members", "key")).over(W.partitionBy("node")).getField("key")


def unmet(rows: DataFrame, limit: int) -> DataFrame:
    """Parts of large buckets so that nodes meet unless they do in another bucket: the home of both.

    Of each bucket the most nodes with one home elsewhere don't meet among themselves. Adds parts, own and
    from (in_blocks); buckets where no two nodes have to meet go.
    """
    away = rows.where("home <> key").groupBy("key", "home").count()
    most = away.groupBy("key").agg(F.max(F.struct("count", "home")).alias("most")).select("key", F.col("most.home").alias("met_home"), F.col("most.count").alias("met"))
    met, rest = F.coalesce(F.col("met"), F.lit(0)), F.col("members") - F.coalesce(F.col("met"), F.lit(0))
    a, b = F.ceil(met / limit).cast("int"), F.ceil(rest / limit).cast("int")
    is_met = F.coalesce(F.col("home") == F.col("met_home"), F.lit(False))
    h = F.xxhash64("node")
    dealt = rows.join(most, "key", "left").where(rest > 0).withColumn("a", a).withColumn("parts", a + b)
    own = F.when(is_met, F.pmod(h, F.greatest("a", F.lit(1)))).otherwise(F.col("a") + F.pmod(h, F.greatest(F.col("parts") - F.col("a"), F.lit(1)))).cast("int")
    return dealt.withColumn("own", own).withColumn("from", F.when(is_met, F.col("a")).otherwise(0))


def in_blocks(rows: DataFrame, by: str) -> DataFrame:
    """Deal groups (``by``, in ``parts`` parts, each row in its ``own``) so that every two parts meet once.

    A group in one part stays as it is, side 0. Else each part is a group of its own, side 0, and each two parts
    are one, sides 1 and 2, where only rows of different sides count. A row meets the parts from ``from`` on.
    """
    other = F.explode(F.sequence(F.col("from"), F.col("parts") - 1))
    met = rows.withColumn("other", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return met.withColumn("group", F.xxhash64(F.col(by), low, high)).withColumn("side", side)
