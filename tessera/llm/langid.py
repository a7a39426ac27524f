"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled: its emission score sums learned weights of the word itself, its
affixes and its byte 3-grams, and of the languages whose lexicon of frequent words holds it; learned
transitions tie neighbouring words together. Forward-backward gives each word's distribution over
languages, so code-switched text splits into runs; a document gets the language with the largest
mean probability, which is its score.

Training maximises the conditional likelihood on sequences that switch between texts of different
languages, cut from a bounded sample: at most ``per_language`` documents of each value of lang, by hash
of the id, outside the held-out fold; fewer of each, but one at least, where there are more than
``max_languages`` values, so that rows are bounded over all of them and no language is left out. Weights
are fitted on ``sequences`` such sequences of 64 words for each language, 1500 at least.

Long texts are handled in blocks of words: transfer matrices of all blocks are built side by side,
messages are passed from block to block, then all blocks are completed side by side. The result is
that of the plain recursion over the whole text.

Edge cases: null text and text without letters are ``und`` with score 0, and so is everything if
there is no labelled row to learn from; ties go to the first language in code point order; equal
texts get equal results; a null id is given back as null and never learned from; rows that share an id
are predicted each by their own text; very long texts are handled whole; an empty table gives an empty
result; columns of the input are ignored, whatever their names, unless ``carry`` names them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import held_out
from .textbytes import SpanHasher, mix, pieces, slices, word_spans

UNKNOWN = "und"
TABLE_BITS = 17
BLOCK = 32
#: Sequences fitted at once.
CHUNK = 1500
LETTER = re.compile(r"[^\W\d_]")

NO_LETTER = np.ones(256, bool)
NO_LETTER[97:123] = False
NO_LETTER[65:91] = False
NO_LETTER[0x80:] = False


@dataclass
class Model:
    """languages in code point order; weights by feature and language; lexicon hashes with their languages."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_of: np.ndarray  # (entries, languages): 1 where the language's lexicon has the word
    by_lexicon: np.ndarray  # (languages, languages)
    transitions: np.ndarray  # log scores


def word_features(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole-word hashes, indices of word and affix features, and of the 3-grams at each byte of ``data``."""
    hasher = SpanHasher(data)
    mask = np.uint64((1 << TABLE_BITS) - 1)
    whole = hasher(s, e)
    spans = [(s, np.minimum(s + k, e)) for k in (2, 3)] + [(np.maximum(e - k, s), e) for k in (2, 3, 4)]
    fixed = np.empty((len(s), 1 + len(spans)), np.int32)
    fixed[:, 0] = whole & mask
    for k, (a, b) in enumerate(spans, 1):
        fixed[:, k] = mix(hasher(a, b) + np.uint64(k * 7919)) & mask
    letters = np.full(len(data) + 2, 32, np.int64)
    letters[1:-1] = np.where(NO_LETTER[data], 32, data)
    grams = ((letters[:-2] << 16 | letters[1:-1] << 8 | letters[2:]) * 0x9E3779B1 >> 11) & int(mask)
    return whole, fixed, grams.astype(np.int32)


def emissions(model: Model, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Log scores (words, languages)."""
    whole, fixed, grams = word_features(data, s, e)
    out = model.weights[fixed[:, 0]]
    for k in range(1, fixed.shape[1]):
        out = out + model.weights[fixed[:, k]]
    at = np.stack([s, e], 1).ravel()
    by_byte = np.concatenate([model.weights[grams], np.zeros((1, out.shape[1]), out.dtype)])
    out += np.add.reduceat(by_byte, at, axis=0)[::2]
    if len(model.lexicon):
        place = np.minimum(np.searchsorted(model.lexicon, whole), len(model.lexicon) - 1)
        hit = np.flatnonzero(model.lexicon[place] == whole)
        out[hit] += (model.lexicon_of[place[hit]] @ model.by_lexicon).astype(out.dtype)
    return out


def posteriors(scores: np.ndarray, at: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward: probabilities (words, languages); row r has the words at[r] to at[r + 1]."""
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    a = np.exp(transitions - transitions.max())
    emit = np.exp((scores - scores.max(1, keepdims=True)).astype(np.float64))
    emit = np.maximum(emit, 1e-30)
    length = np.diff(at)
    blocks = -(-length // BLOCK)
    row_of = np.repeat(np.arange(len(length)), blocks)
    first = np.cumsum(blocks) - blocks
    ordinal = np.arange(len(row_of)) - first[row_of]
    index = (at[:-1][row_of] + ordinal * BLOCK)[None, :] + np.arange(BLOCK)[:, None]
    real = index < at[1:][row_of][None, :]
    e = np.ones((BLOCK, len(row_of), k))
    e[real] = emit[index[real]]
    # transfer matrices of whole blocks
    m = np.broadcast_to(np.eye(k), (len(row_of), k, k)).copy()
    for t in range(BLOCK):
        step = (m.reshape(-1, k) @ a).reshape(m.shape) * e[t][:, None, :]
        step /= step.sum((1, 2), keepdims=True)
        m = step if real[t].all() else np.where(real[t][:, None, None], step, m)
    # messages between blocks
    into, outof = np.full((len(row_of), k), 1 / k), np.full((len(row_of), k), 1 / k)
    order = np.argsort(-blocks, kind="stable")
    counts = np.searchsorted(-blocks[order], -np.arange(1, blocks.max() + 1), side="right")  # rows with at least that many
    for o in range(1, int(blocks.max())):
        b = first[order[: counts[o]]] + o
        v = (into[b - 1][:, None, :] @ m[b - 1])[:, 0]
        into[b] = v / v.sum(1, keepdims=True)
    for o in range(int(blocks.max()) - 1, 0, -1):
        b = first[order[: counts[o]]] + o
        v = (m[b] @ outof[b][:, :, None])[:, :, 0]
        outof[b - 1] = v / v.sum(1, keepdims=True)
    ahead = np.empty_like(e)
    v = into
    for t in range(BLOCK):
        step = (v @ a) * e[t]
        step /= step.sum(1, keepdims=True)
        v = ahead[t] = np.where(real[t][:, None], step, v)
    back = outof
    for t in range(BLOCK - 1, -1, -1):
        ahead[t] *= back
        step = (back * e[t]) @ a.T
        step /= step.sum(1, keepdims=True)
        back = np.where(real[t][:, None], step, back)
    out = np.empty((n, k))
    out[index[real]] = ahead[real]
    return out / out.sum(1, keepdims=True)


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null(""))


def train(texts: list[tuple[str, str]], length: int = 64, sequences: int = 375, rounds: int = 12, lexicon_words: int = 400, seed: int = 5) -> Model | None:
    """A model from (language, text) pairs, fitted on ``sequences`` a language; None if there are none with words."""
    languages = sorted({x for x, _ in texts})
    pools = []
    for name in languages:
        column = lowered(pa.array([t for x, t in texts if x == name], pa.string()))
        data, s, e = [], [], []
        shift = 0
        for _, _, d, at in pieces(column):
            a, b, _ = word_spans(d, at, NO_LETTER)
            data.append(d)
            s.append(a + shift)
            e.append(b + shift)
            shift += len(d)
        pools.append((np.concatenate(data), np.concatenate(s), np.concatenate(e)) if data else (np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)))
    keep = [i for i, p in enumerate(pools) if len(p[1])]
    if not keep:
        return None
    languages, pools = [languages[i] for i in keep], [pools[i] for i in keep]
    k = len(languages)
    feats = [word_features(*p) for p in pools]
    lexicon, lexicon_of = _lexicon([f[0] for f in feats], lexicon_words)
    rng = np.random.default_rng(seed)
    picked_lang, picked_word = _switching(rng, [len(p[1]) for p in pools], max(1500, sequences * k), length)
    flat_lang, flat_word = picked_lang.T.ravel(), picked_word.T.ravel()  # sequence after sequence
    n = len(flat_lang)
    fixed = np.empty((n, feats[0][1].shape[1]), np.int32)
    whole = np.empty(n, np.uint64)
    gram_word, gram_index = [], []
    for i in range(k):
        mine = np.flatnonzero(flat_lang == i)
        w = flat_word[mine]
        fixed[mine], whole[mine] = feats[i][1][w], feats[i][0][w]
        s, e = pools[i][1][w], pools[i][2][w]
        size = e - s
        gram_word.append(np.repeat(mine, size))
        before = np.cumsum(size) - size
        gram_index.append(feats[i][2][np.repeat(s - before, size) + np.arange(int(size.sum()))])
    gram_word, gram_index = np.concatenate(gram_word), np.concatenate(gram_index)
    place = np.minimum(np.searchsorted(lexicon, whole), max(0, len(lexicon) - 1))
    known = lexicon[place] == whole if len(lexicon) else np.zeros(n, bool)
    rows = np.concatenate([np.repeat(np.arange(n), fixed.shape[1]), gram_word])
    index = np.concatenate([fixed.ravel(), gram_index])
    size = 1 << TABLE_BITS
    weights, by_lexicon, transitions = np.zeros((size, k)), np.zeros((k, k)), np.zeros((k, k))
    sums = [np.full_like(x, 1e-2) for x in (weights, by_lexicon, transitions)]
    inner = np.ones(n, bool)
    inner[length - 1 :: length] = False
    pair = np.zeros((k, k))
    np.add.at(pair, (flat_lang[:-1][inner[:-1]], flat_lang[1:][inner[:-1]]), 1)
    # gradients are sums over sequences, taken a few at a time: with more languages fewer, so that memory stays
    step = max(1, min(CHUNK, CHUNK * 8 // k)) * length
    chunks = []
    for a in range(0, n, step):
        b = min(n, a + step)
        mine = np.flatnonzero((rows >= a) & (rows < b))
        chunks.append((a, b, (rows[mine] - a).astype(np.int32), index[mine].astype(np.int32)))
    del rows, index
    for _ in range(rounds):
        grads = [-0.05 * weights, -0.05 * by_lexicon, pair - 0.05 * transitions]
        for a, b, rows, index in chunks:
            at = np.arange(0, b - a + 1, length)
            lex = np.where(known[a:b, None], lexicon_of[place[a:b]], 0.0) if len(lexicon) else np.zeros((b - a, k))
            scores = np.stack([np.bincount(rows, weights[index, j], b - a) for j in range(k)], 1) + lex @ by_lexicon
            p = posteriors(scores, at, transitions)
            d = np.eye(k)[flat_lang[a:b]] - p
            for j in range(k):
                grads[0][:, j] += np.bincount(index, d[rows, j], size)
            grads[1] += lex.T @ d
            grads[2] -= _pairs(scores, p, transitions, inner[a:b], at)
        for x, g, q in zip((weights, by_lexicon, transitions), grads, sums, strict=True):
            q += g * g
            x += 0.5 * g / np.sqrt(q)
    return Model(languages, weights.astype(np.float32), lexicon, lexicon_of, by_lexicon, transitions)


def _pairs(scores: np.ndarray, p: np.ndarray, transitions: np.ndarray, inner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Expected transitions of sequences of equal length, by the recursion over all of them at once."""
    k = scores.shape[1]
    length = int(at[1])
    e = np.exp(scores - scores.max(1, keepdims=True)).reshape(-1, length, k) + 1e-30
    a = np.exp(transitions - transitions.max())
    ahead = np.empty_like(e)
    v = np.full((len(e), k), 1 / k)
    for t in range(length):
        v = (v @ a) * e[:, t]
        v /= v.sum(1, keepdims=True)
        ahead[:, t] = v
    out, back = np.zeros((k, k)), np.ones((len(e), k))
    for t in range(length - 1, 0, -1):
        right = back * e[:, t]
        joint = ahead[:, t - 1][:, :, None] * a[None] * right[:, None, :]
        out += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back = right @ a.T
        back /= back.sum(1, keepdims=True)
    return out


def _lexicon(words: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words of each language, and which languages have each."""
    frequent = []
    for w in words:
        u, c = np.unique(w, return_counts=True)
        frequent.append(u[np.lexsort((u, -c))][: min(most, int((c >= 3).sum()))])
    every = np.unique(np.concatenate(frequent))
    return every, np.stack([np.isin(every, f) for f in frequent], 1).astype(float)


def _switching(rng: np.random.Generator, sizes: list[int], sequences: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Language and word number (length, sequences): runs of 4 to 40 words, mostly one or two a sequence."""
    lang, word = np.empty((length, sequences), np.int64), np.empty((length, sequences), np.int64)
    for j in range(sequences):
        t = 0
        stay = rng.random() < 0.5
        while t < length:
            run = length if stay else int(rng.integers(4, 40))
            i = int(rng.integers(len(sizes)))
            run = min(run, length - t, sizes[i])
            begin = int(rng.integers(sizes[i] - run + 1))
            lang[t : t + run, j], word[t : t + run, j] = i, np.arange(begin, begin + run)
            t += run
    return lang, word


#: Characters of a text that are learned from; what reaches the driver is at most this times ``per_language`` times ``max_languages``.
LONGEST = 1 << 14


def sample(docs: DataFrame, per_language: int, max_languages: int, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", longest: int = LONGEST) -> list[tuple[str, str]]:
    """The bounded sample of labelled texts to learn from: one text an id and language, of a longer one than ``longest`` a stretch.

    Where a stretch begins follows from the id's hash. All texts are predicted whole, these too.
    """
    known = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang")).where("lang is not null").where(~held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return []
    if len(counts) > max_languages:
        per_language = max(1, per_language * max_languages // len(counts))
    # a share of each language that holds several times the documents wanted, so that few rows are ranked
    unit = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 8.0 * per_language / n))])
    known = known.where(unit <= share[F.col("lang")]).distinct()
    order = W.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    picked = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("doc_id", F.col("lang").alias("picked_lang"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.join(F.broadcast(picked), "doc_id").where("lang = picked_lang and text is not null")
    begin = F.lit(1) + F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - longest, F.lit(0)) + 1).cast("int")
    stretch = F.substring(F.col("text"), begin, F.lit(longest))
    once = rows.groupBy("doc_id", "lang").agg(F.min_by(stretch, F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    return [(r["lang"], r["text"]) for r in sorted(once.toLocalIterator(), key=lambda r: (r["doc_id"], r["lang"]))]


PREDICTED = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("n_words", T.LongType()), ("switches", T.LongType())]


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per row: doc_id, lang_pred, score, n_words, switches (neighbouring words of different languages).

    ``row``, if ``carry`` names columns, is a struct of these, as they are in that row.
    """
    told = [F.col(doc_id).cast("long").alias("doc_id"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else [])]
    inside = text in carry and isinstance(docs.schema[text].dataType, T.StringType)  # no text moves twice
    rows = docs.select(*told, *([] if inside else [F.col(text).cast("string").alias("text")]))
    own = len(told)
    schema = T.StructType([*rows.schema[:own], *(T.StructField(*x) for x in PREDICTED)])

    def texts(batch: pa.RecordBatch) -> pa.Array:
        return batch.column("row").field(text) if inside else batch.column("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, texts(whole)):
                names, score, words, turns = _documents(texts(batch), model)
                yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(names, pa.string()), *map(pa.array, (score, words, turns))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _documents(column: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    n = len(column)
    score, words, turns = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    names = [UNKNOWN] * n
    if model is None:
        return names, score, words, turns
    for row, end, data, at in pieces(lowered(column)):
        s, e, before = word_spans(data, at, NO_LETTER)
        count = np.diff(before)
        words[row:end] = count
        if not len(s):
            continue
        p = posteriors(emissions(model, data, s, e), before, model.transitions)
        has = np.flatnonzero(count)
        mean = np.add.reduceat(p, before[has], axis=0) / count[has][:, None]
        best = mean.argmax(1)
        label = p.argmax(1)
        change = np.zeros(len(s), np.int64)
        change[1:] = label[1:] != label[:-1]
        change[before[has]] = 0
        turns[row + has] = np.add.reduceat(change, before[has])
        plain = np.add.reduceat(np.concatenate([data < 0x80, [False]]).astype(np.int64), np.stack([s, e], 1).ravel())[::2]
        ascii_words = np.add.reduceat(plain, before[has])
        for r, b, q, ascii_ in zip(has.tolist(), best.tolist(), mean[np.arange(len(has)), best].tolist(), ascii_words.tolist(), strict=True):
            # without an ASCII letter, what is there may be signs of other scripts
            if ascii_ or LETTER.search(data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace")):
                names[row + r], score[row + r] = model.languages[b], min(1.0, q)
            else:
                words[row + r] = 0
    return names, score, words, turns


SPANS = "doc_id long, start long, end long, lang string, words long, score double"


def spans(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of words with one label: byte range in the lower-cased UTF-8 text, words and mean probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for row, _, data, at in pieces(lowered(batch.column(1))):
                    s, e, before = word_spans(data, at, NO_LETTER)
                    if not len(s):
                        continue
                    p = posteriors(emissions(model, data, s, e), before, model.transitions)
                    label = p.argmax(1)
                    doc = np.searchsorted(before, np.arange(len(s)), side="right") - 1
                    new = np.ones(len(s), bool)
                    new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                    b = np.flatnonzero(new)
                    last = np.append(b[1:], len(s)) - 1
                    mean = np.add.reduceat(p.max(1), b) / (last - b + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row + doc[b]]), pa.array(s[b] - at[doc[b]]), pa.array(e[last] - at[doc[b]]), pa.array([model.languages[i] for i in label[b]]), pa.array(last - b + 1), pa.array(mean)],
                        names=[x.split()[0] for x in SPANS.split(", ")],
                    )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SPANS)


def language_id(docs: DataFrame, per_language: int = 250, max_languages: int = 48, sequences: int = 375, carry: Sequence[str] = ()) -> DataFrame:
    """Learn from the bounded sample, then predict every row; ``carry`` as in identify."""
    model = train(sample(docs, per_language, max_languages), sequences=sequences)
    found = identify(docs, model, carry=carry)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "switches", *(["row"] if carry else []))
