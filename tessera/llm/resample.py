"""Importance resampling of documents towards a target distribution, by hashed n-grams of words.

A document's weight is the sum, over its n-grams, of how much likelier the n-gram's bucket is in the target
texts than in the documents. Weights depend on texts alone, so rows are grouped by their full text first:
every different text is cut into features once, its counts enter the totals times its number of rows, and its weight
is joined back to its rows. Noise that hangs on the document's id is added after that (Gumbel noise: the
highest noisy weights are a sample without replacement), and the highest scores are drawn.

Buckets are CRC-32 of the n-gram's bytes. CRC is linear, so the value of words joined by spaces follows from
the values of the words and their lengths, and no n-gram is ever built.

Edge cases: null and empty text have no features and weight 0; a null id counts as empty text in the noise,
comes last among ties and is given back as null; rows with the same id, repeated or not, are documents of their own and may each
be drawn; very long texts are handled whole; without target texts, or without documents, all counts of that
side are 0; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, materialize, numbered, order_id, shown_id
from .textbytes import pieces, slices, word_spans

#: Bytes that part words: all of ASCII but digits and, after lower-casing, letters.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:0x80] = True
OUTSIDE[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B))] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint32
_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    """CRC-32 register after one byte, by the register's low byte."""
    c = np.arange(256, dtype=_U)
    for _ in range(8):
        c = np.where(c & _U(1), (c >> _U(1)) ^ _U(_POLYNOMIAL), c >> _U(1))
    return c


_TABLE = _byte_table()


@lru_cache(maxsize=4096)
def _moved(n: int) -> np.ndarray:
    """What a CRC register's four bytes turn into after ``n`` zero bytes: four tables of 256, to be joined by exclusive or."""
    if n == 0:
        return np.stack([np.arange(256, dtype=_U) << _U(8 * k) for k in range(4)])
    half = _moved(n // 2)
    out = _apply(half, half)
    return (out >> _U(8)) ^ _TABLE[out & _U(255)] if n % 2 else out


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & _U(255)] ^ tables[1][c >> _U(8) & _U(255)] ^ tables[2][c >> _U(16) & _U(255)] ^ tables[3][c >> _U(24)]


def crc_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = 48) -> np.ndarray:
    """CRC-32 of spans of bytes: by columns of bytes, and long spans one by one."""
    length = ends - starts
    out = np.empty(len(starts), _U)
    order = np.argsort(-length, kind="stable")
    n_long = int((length > long).sum())
    for k in order[:n_long].tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    order = order[n_long:]
    ahead, sizes = starts[order], length[order]
    c = np.full(len(order), 0xFFFFFFFF, _U)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, side="left"))  # spans longer than k
        x = c[:n]
        c[:n] = (x >> _U(8)) ^ _TABLE[(x ^ data[ahead[:n] + k]) & _U(255)]
    out[order] = c ^ _U(0xFFFFFFFF)
    return out


class Followed:
    """CRC-32 of a text with one of some spans behind it."""

    def __init__(self, length: np.ndarray) -> None:
        self.kinds, self.of = np.unique(length, return_inverse=True)
        self.tables = np.stack([_moved(int(n)) for n in self.kinds]) if len(self.kinds) else np.zeros((0, 4, 256), _U)

    def __call__(self, first: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
        """at: which of the lengths given at first those of ``second`` are."""
        k, t = self.of[at], self.tables
        return t[k, 0, first & _U(255)] ^ t[k, 1, first >> _U(8) & _U(255)] ^ t[k, 2, first >> _U(16) & _U(255)] ^ t[k, 3, first >> _U(24)] ^ second


def buckets_of(column: pa.Array, buckets: int, n: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of rows: words of each row, its features' buckets one after another, and where each row's begin."""
    for _, _, data, at in pieces(column):
        data = LOWER[data]
        starts, ends, before = word_spans(data, at, OUTSIDE)
        words = np.diff(before)
        word = crc_of_spans(data, starts, ends)
        follow = Followed(ends - starts)
        space, shift = _U(zlib.crc32(b" ")), _moved(1)
        row = np.repeat(np.arange(len(words)), words)
        every, rows, run = [word], [row], word
        for k in range(1, n):
            # runs of k + 1 words: a run of k, a space, and the word behind
            here = np.flatnonzero(row[k:] == row[:-k]) if len(row) > k else np.zeros(0, np.int64)
            longer = np.zeros(len(word), _U)
            longer[here] = follow(_apply(shift, run[here]) ^ space, word[here + k], here + k)
            every.append(longer[here])
            rows.append(row[here])
            run = longer
        owner = np.concatenate(rows)
        order = np.argsort(owner, kind="stable")
        values = (np.concatenate(every)[order] % _U(buckets)).astype(np.int64)
        yield words, values, np.searchsorted(owner[order], np.arange(len(words) + 1))


def features(texts: DataFrame, buckets: int) -> DataFrame:
    """Of key, text, copies: key, copies, words, n_features, buckets (their numbers in order, 16 or 32 bits each, little-endian)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                words, n, raw = [], [], []
                for w, values, at in buckets_of(batch.column(1), buckets):
                    owner = np.repeat(np.arange(len(w)), np.diff(at))
                    values = values[np.lexsort((values, owner))].astype(kind)  # sorted, they take less room
                    words.append(w)
                    n.append(np.diff(at))
                    raw += [values[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                if words:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(words)), pa.array(np.concatenate(n)), pa.array(raw, pa.binary())], names=["key", "copies", "words", "n_features", "buckets"])

    return texts.select("key", "text", "copies").mapInArrow(run, "key binary, copies long, words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: features of all rows, each text's times its copies."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            copies = batch.column(0).to_numpy()
            for k, raw in zip(copies.tolist(), batch.column(1), strict=True):
                total += k * np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return found.select("copies", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def text_key(text: str = "text") -> Column:
    """A text's name, where its rows are joined to what was found out about it: SHA-256, null as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def grouped(docs: DataFrame, text: str) -> DataFrame:
    """key, text, copies: rows grouped by their full text; a group of any size is one row of each task before it is moved."""
    same = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    return same.select(text_key().alias("key"), "text", "copies")


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """By bucket: the gain of a feature, in thousandths. The one thing of the counts that reaches the driver, ``buckets`` numbers."""
    spark = source.sparkSession
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).orderBy("bucket").collect()
    s, t = (np.array([r[k] for r in rows], np.int64) for k in "st")
    up = (t + 1).astype(float) * float(s.sum() + buckets)
    return np.floor(1000 * np.log(up / ((s + 1).astype(float) * float(t.sum() + buckets)))).astype(np.int64)


def noise(doc_id: str, seed: int) -> Column:
    """Gumbel noise of an id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Per row: doc_id, n_features, weight, score, rank (from 1 in order of drawing; null where not drawn).

    ``percent`` of the documents with at least ``least_words`` words are drawn.
    """
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    found = materialize(features(grouped(docs, text), buckets), "resample-features")
    wanted = features(grouped(target, target_text), buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets), buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[np.frombuffer(raw.as_buffer(), kind)].sum()) for raw in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["key", "words", "n_features", "weight"])

    weights = found.select("key", "words", "n_features", "buckets").mapInArrow(weigh, "key binary, words long, n_features long, weight long")
    rows = docs.select(order_id(doc_id).alias("id"), text_key(text).alias("key"), noise(doc_id, seed).alias("noise"))
    # a text of very many rows: Spark splits such a side of a join between its tasks
    scored = rows.join(weights, "key").select("id", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"), (F.col("words") >= least_words).alias("eligible"))
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    discard(found)
    eligible = scored.where("eligible")
    # the score below which nobody is drawn, approximately; whether it lets enough through is counted
    share = max(0.0, 1 - percent / 100 - 0.01)
    stat = eligible.agg(F.count("*"), F.percentile_approx("score", share, 1000)).first()
    drawn = percent * int(stat[0]) // 100
    bar = F.lit(True) if stat[1] is None else F.col("score") >= int(stat[1])
    above = eligible.where(bar).count()
    if above < drawn:
        bar, above = F.lit(True), int(stat[0])
    ahead = F.col("eligible") & bar
    ranked = numbered(scored.where(ahead), [F.desc("score"), F.asc("id"), F.asc("row")], "resample-ranks", above)
    ranked = ranked.withColumn("rank", F.when(F.col("number") < drawn, F.col("number") + 1))
    rest = scored.where(~ahead).withColumn("rank", F.lit(None).cast("long"))
    out = ["id", "n_features", "weight", "score", "rank"]
    return ranked.select(out).unionByName(rest.select(out)).select(shown_id("id").alias("doc_id"), *out[1:])


def oracle_sql() -> str:
    """The same in DuckDB SQL over the views ``documents`` and ``benchmark``, with the registered query's parameters.

    CRC-32 is a fold over the bytes of each different n-gram, by the table of 256 registers.
    """
    return r"""
with recursive steps as (select i as b, i::bigint as c, 0 as k from range(256) t(i)
  union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc as (select list(c order by b) as t from steps where k = 8),
texts as (select 'd' as side, doc_id, coalesce(text, '') as text from documents union all select 'b', null, coalesce(text, '') from benchmark),
kinds as (select side, text, count(*) as copies from texts group by side, text),
cut as (select side, text, copies, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from kinds),
grams as (select side, text, copies, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as g from cut),
counted as (select side, text, any_value(copies) as copies, g, count(*) as n from grams group by side, text, g),
names as (select g, hex(encode(g)) as h from (select distinct g from counted)),
hashed as (select g, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from names, crc),
placed as (select side, text, copies, bucket, sum(n) as n from counted join hashed using (g) group by side, text, copies, bucket),
sums as (select bucket, coalesce(sum(copies * n) filter (side = 'd'), 0) as s, coalesce(sum(copies * n) filter (side = 'b'), 0) as t from placed group by bucket),
totals as (select coalesce(sum(s), 0) as big_s, coalesce(sum(t), 0) as big_t from sums),
gains as (select bucket, floor(1000 * ln(((t + 1)::double * (big_s + 10000)::double) / ((s + 1)::double * (big_t + 10000)::double)))::bigint as gain from sums, totals),
weights as (select text, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from placed join gains using (bucket) where side = 'd' group by text),
words as (select text, len(w) as n_words from cut where side = 'd'),
noisy as (select doc_id, text, floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as noise from texts where side = 'd'),
scored as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + noise as score, n_words >= 20 as fit
  from noisy join words using (text) left join weights using (text)),
ranked as (select *, row_number() over (partition by fit order by score desc, doc_id) as place, count(*) over (partition by fit) as fitting from scored)
select doc_id, n_features, weight, score, case when fit and place <= 5 * fitting // 100 then place end as rank from ranked"""
