"""Exact removal of repeated passages by level-wise doubling.

A window is ``window`` consecutive words of one document (20 by default). A word is removed if a
window that covers it has the same word sequence as a window that starts earlier: in a document
with a smaller id, or earlier in the same document.

Level 1 looks at windows of a quarter of that length. Of the quarter-windows inside every full
window only the one with the smallest hash, leftmost on ties, is an anchor: equal full windows have
equal anchors at equal places, so nothing is lost and an eighth of the positions is left. Anchors
whose words occur once drop out. Level 2 doubles the length around the anchors that are left, to
the right and to the left; anchors where neither is repeated drop out. Level 3 doubles again: the
full windows of the anchors that are left are compared, and all but the first are removed.

Copies: of documents with the same word sequence only the one with the smallest id takes part, all
words of the others repeat it. Each task settles what repeats within its own rows and passes on one
row a window, so a passage that a third of all documents share moves once from each task.

Texts move once by document id, and those with candidates a second time. Intermediate tables are
written to the shared folder, so lost executors cost their tasks only.

Rows are told apart by id and a hash of their text. Rows that share an id are documents of their own, and
neither has a smaller id, so they lose nothing to each other; a null id counts as the largest one.

Edge cases: null text has no words; documents shorter than a window lose nothing; repeated rows get
the same result each; an empty table gives an empty result; very long texts are handled whole. Columns
of the input are ignored, whatever their names, unless ``carry`` names them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import discard, materialize, order_id, release
from .textbytes import SpanHasher, mix, slices, strings, word_spans

_U = np.uint64
EMPTY = hashlib.sha256(b"").hexdigest()


class Words:
    """Words of the rows of a string column, their hashes, and hashes of windows of doubling lengths."""

    def __init__(self, column: pa.Array, window: int, doubled: bool = True) -> None:
        raw, at = strings(column)
        self.data, self.at = raw[at[0] : at[-1]], at - at[0]
        self.starts, self.ends, self.before = word_spans(self.data, self.at)
        self.count = np.diff(self.before)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.words = self._hash_words()
        self.window, self.base = window, window // 4
        n = len(self.words)
        h = np.zeros(n, _U)
        for k in range(min(self.base, n)):  # fewer words than a quarter have no window
            h[: n - k] = h[: n - k] * _U(0x9E3779B97F4A7C15) + self.words[k:]
        self.quarter = mix(h + _U(1))
        if not doubled:
            return
        self.half = self._doubled(self.quarter, self.base)
        self.full = self._doubled(self.half, 2 * self.base)

    def _hash_words(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        # in runs of rows, so that prefix sums stay short
        out, limit = [], 1 << 21
        row, n = 0, len(self.count)
        while row < n:
            end = max(row + 1, int(np.searchsorted(self.at, self.at[row] + limit, side="right")) - 1)
            end = min(n, end)
            a, b = self.before[row], self.before[end]
            base = self.at[row]
            if b > a:
                out.append(SpanHasher(self.data[base : self.at[end]])(self.starts[a:b] - base, self.ends[a:b] - base))
            row = end
        return np.concatenate(out)

    @staticmethod
    def _doubled(h: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros_like(h)
        if len(h) > length:
            out[:-length] = mix(h[:-length] * _U(0xD1B54A32D192ED03) + h[length:])
        return out

    def document_hashes(self, salt: int) -> np.ndarray:
        """One hash of each row's whole word sequence."""
        out = mix(self.count.astype(_U) + _U(salt))
        place = (np.arange(len(self.words)) - self.before[self.row]).astype(_U)
        each = mix(self.words ^ mix(place * _U(0xA0761D6478BD642F) + _U(salt)))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(each, dtype=_U)])
        return out + sums[self.before[1:]] - sums[self.before[:-1]]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all full windows, and the anchor of each."""
        s = np.arange(len(self.words))
        s = s[s + self.window <= self.before[self.row + 1]] if len(s) else s
        if not len(s):
            return s, s
        place = np.arange(len(self.words))
        value = self.quarter
        wide, need = 1, self.window - self.base + 1
        while wide < need:
            step = min(wide, need - wide)
            v, p = value[step:], place[step:]
            less = v < value[:-step]
            value, place = np.where(less, v, value[:-step]), np.where(less, p, place[:-step])
            wide += step
        return s, place[s]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


ROWS = ["doc", "text_key", "text"]
ANCHORS = "key long, known boolean, many boolean, doc long, pos int, text_key long, left_key long, right_key long"


def _combine(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, text_key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows to keep, in which ``known`` says that the key repeats already here, and ``many`` the same of the one passed on.

    Of copies (equal key and text) only the rows of the smallest id stay: no other copy counts.
    """
    order = np.lexsort((pos, doc, text_key, key))
    k, h, d = key[order], text_key[order], doc[order]
    new_group = np.ones(len(k), bool)
    new_group[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    lead = np.maximum.accumulate(np.where(new_group, np.arange(len(k)), 0))
    order = order[d == d[lead]]
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    size = np.bincount(group) if len(k) else np.zeros(0, int)
    many = new & (size[group] > 1)
    return order, ~new, many


def anchors(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                w = Words(batch.column(2), window)
                _, anchor = w.windows()
                a = np.unique(anchor)
                row = w.row[a]
                ids, texts = (batch.column(c).to_numpy()[row] for c in (0, 1))
                left = np.where(a - w.base >= w.before[row], w.half[np.maximum(a - w.base, 0)], _U(0))
                right = np.where(a + 2 * w.base <= w.before[row + 1], w.half[a], _U(0))
                pos = (a - w.before[row]).astype(np.int32)
                key = w.quarter[a]
                keep, known, many = _combine(key, ids, pos, texts)
                yield pa.RecordBatch.from_arrays(
                    [_signed(key[keep]), pa.array(known), pa.array(many), pa.array(ids[keep]), pa.array(pos[keep]), pa.array(texts[keep]), _signed(left[keep]), _signed(right[keep])],
                    names=[x.split()[0] for x in ANCHORS.split(", ")],
                )

    return docs.mapInArrow(run, ANCHORS)


def repeating(rows: DataFrame) -> DataFrame:
    """Rows whose key occurs in different texts, or twice in one."""
    apart = F.when(F.col("known"), F.xxhash64("doc", "pos", "key")).otherwise(F.col("key"))
    by = W.partitionBy("known", "part")
    spread = rows.withColumn("part", apart)
    kept = spread.withColumn("lo", F.min("text_key").over(by)).withColumn("hi", F.max("text_key").over(by)).withColumn("any_many", F.max("many").over(by))
    return kept.where("known or any_many or lo <> hi")


HALVES = "key long, known boolean, many boolean, doc long, pos int, text_key long, side int"


def halves(found: DataFrame, buffer: int = 400_000) -> DataFrame:
    """Level 2 rows: the half-windows that begin or end a quarter after each repeated anchor, settled within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= buffer:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        doc, pos, text_key, left, right = (t.column(c).to_numpy() for c in ("doc", "pos", "text_key", "left_key", "right_key"))
        key, side = np.concatenate([left, right]), np.repeat(np.array([0, 1], np.int32), len(doc))
        real = np.flatnonzero(key)
        key, side = key[real], side[real]
        at = real % max(1, len(doc))
        keep, known, many = _combine(key, doc[at], pos[at], text_key[at])
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(known), pa.array(many), pa.array(doc[at][keep]), pa.array(pos[at][keep]), pa.array(text_key[at][keep]), pa.array(side[keep])], names=[x.split()[0] for x in HALVES.split(", ")])

    return found.select("doc", "pos", "text_key", "left_key", "right_key").mapInArrow(run, HALVES)


DOCUMENTS = "doc long, text_key long, n_words long, doc_hash long, doc_hash_2 long"


def documents(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                w = Words(batch.column(2), window)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w.count.astype(np.int64)), _signed(w.document_hashes(1)), _signed(w.document_hashes(2))], names=[x.split()[0] for x in DOCUMENTS.split(", ")])

    return docs.mapInArrow(run, DOCUMENTS)


def settle(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Results of copies and of documents without candidates; the text of all others stays.

    texts: row (what is told of a row in the end), doc, text_key, text, copy, right_of, left_of.
    """
    given = texts.schema
    schema = T.StructType([given["row"], given["doc"], given["text_key"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")), T.StructField("kept_sha256", T.StringType()), T.StructField("text", T.StringType()), given["right_of"], given["left_of"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                column = dict(zip(batch.schema.names, batch.columns, strict=True))
                raw, at = strings(column["text"])
                data, at = raw[at[0] : at[-1]], at - at[0]
                s, e, before = word_spans(data, at)
                n = np.diff(before)
                copy = column["copy"].to_numpy(zero_copy_only=False).astype(bool) & (n >= window)
                open_ = ~copy & ~(column["right_of"].is_null().to_numpy(zero_copy_only=False) & column["left_of"].is_null().to_numpy(zero_copy_only=False))
                digests = [None if o else EMPTY if c else hashlib.sha256(b" ".join(data[at[r] : at[r + 1]].tobytes().split())).hexdigest() for r, (o, c) in enumerate(zip(open_.tolist(), copy.tolist(), strict=True))]
                removed = pa.array(np.where(copy, n, 0), mask=open_)
                keep = open_ | (with_text & ~copy)
                text = column["text"].take(pa.array(np.arange(len(n)), mask=~keep))
                made = [column["row"], column["doc"], column["text_key"], pa.array(n), removed, pa.array(digests, pa.string()), text, column["right_of"], column["left_of"]]
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return texts.mapInArrow(run, schema)


WINDOWS = "key long, check long, doc long, text_key long, pos int, known boolean"


def full_windows(candidates: DataFrame, window: int) -> DataFrame:
    """Level 3 rows: full windows of the anchors that are left; ``known``: one that starts earlier is in the same task.

    What starts earlier in the same row is always there.
    """

    def marked(w: Words, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(w.words) + 1, bool)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out[w.before[np.repeat(np.arange(len(size)), size)] + values] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                w = Words(batch.column(2), window)
                s, anchor = w.windows()
                right, left = marked(w, batch.column(3)), marked(w, batch.column(4))
                good = (right[anchor] & (anchor + 2 * w.base <= s + window)) | (left[anchor] & (anchor - w.base >= s))
                s = s[good]
                row = w.row[s]
                doc, text_key = (batch.column(c).to_numpy()[row] for c in (0, 1))
                key = w.full[s]
                check = mix(w.quarter[s] ^ mix(w.half[s + w.window // 2] + _U(77)))
                order = np.lexsort((s, doc, check, key))
                key, check, doc, text_key, row, s = (x[order] for x in (key, check, doc, text_key, row, s))
                same = np.zeros(len(key), bool)
                same[1:] = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
                again = same.copy()
                again[1:] &= row[1:] == row[:-1]
                known = (doc != doc[lead]) | again
                pos = (s - w.before[row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_signed(key), _signed(check), pa.array(doc), pa.array(text_key), pa.array(pos), pa.array(known)], names=[x.split()[0] for x in WINDOWS.split(", ")])

    return candidates.mapInArrow(run, WINDOWS)


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = False, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text and ``carried``.

    ``kept_text`` is the text itself where nothing is removed, else the kept words joined by one space;
    ``carried`` is a struct of the columns that ``carry`` names, as they are in that row.
    """
    if window % 4 or window < 8:
        raise ValueError("window: a multiple of 4, at least 8")
    spark = docs.sparkSession
    told = [F.col(doc_id).cast("long").alias("doc_id"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else [])]
    whole = docs.select(F.struct(*told).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = whole.select("row", order_id("row.doc_id").alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    rows = whole.select(*ROWS)
    own = ["doc", "text_key"]
    # copies, and level 1 and 2
    about = materialize(documents(rows, window), "repeat-documents")
    same = ["doc_hash", "doc_hash_2", "n_words"]
    first = materialize(about.groupBy(*same).agg(F.min("doc").alias("first")), "repeat-first")
    level_1 = materialize(repeating(anchors(rows, window)).select("doc", "pos", "text_key", "left_key", "right_key"), "repeat-level-1")
    release(spark)
    level_2 = repeating(halves(level_1))
    marks = materialize(
        level_2.groupBy(*own).agg(F.collect_set(F.when(F.col("side") == 1, F.col("pos"))).alias("right_of"), F.collect_set(F.when(F.col("side") == 0, F.col("pos"))).alias("left_of")),
        "repeat-level-2",
    )
    discard(level_1)
    copies = about.join(first, same).where("doc <> first").select(*own, F.lit(True).alias("copy")).distinct()
    state = materialize(marks.join(copies, own, "full_outer"), "repeat-state")
    discard(marks, about, first)
    release(spark)
    # texts meet their candidates
    joined = whole.join(state, own, "left").select("row", *own, "text", F.coalesce("copy", F.lit(False)).alias("copy"), "right_of", "left_of")
    settled = materialize(settle(joined, window, with_text), "repeat-settled")
    discard(state)
    release(spark)
    # level 3
    open_ = settled.where("kept_sha256 is null")
    full = full_windows(open_.select(*ROWS, "right_of", "left_of"), window)
    apart = F.when(F.col("known"), F.xxhash64("doc", "pos")).otherwise(F.col("key"))
    least = F.min("doc").over(W.partitionBy("known", "part", "check"))
    later = full.withColumn("part", apart).withColumn("first", least).where("known or doc <> first")
    removals = materialize(later.groupBy(*own).agg(F.collect_set("pos").alias("starts")), "repeat-removals")
    release(spark)
    cut = cut_out(open_.select("row", *ROWS).join(removals, own, "left").select("row", "text", "starts"), window, with_text)
    given = ["row.doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []), *(["row.carried"] if carry else [])]
    done = settled.where("kept_sha256 is not null").withColumn("kept_text", F.coalesce("text", F.lit("")))
    return done.select(*given).unionByName(cut.select(*given))


def cut_out(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Texts without the words that windows at the given starts cover; texts: row, text, starts."""
    counts = [T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")]
    schema = T.StructType([texts.schema["row"], *counts, T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                got = []
                for t, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    raw = (t or "").encode()
                    words = raw.split()
                    gone = np.zeros(len(words) + window + 1, np.int32)
                    at = np.array(starts or [], np.int64)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                    out = np.cumsum(gone)[: len(words)] > 0
                    kept = b" ".join(words if not len(at) else [x for x, o in zip(words, out.tolist(), strict=True) if not o])
                    got.append((len(words), int(out.sum()), hashlib.sha256(kept).hexdigest(), t if not len(at) else kept.decode()))
                n, removed, digest, text = zip(*got, strict=True)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(text, pa.string())] * with_text, names=schema.names)

    return texts.mapInArrow(run, schema)
