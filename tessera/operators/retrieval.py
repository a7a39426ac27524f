"""Hybrid search over a batch of questions: BM25 terms and phrases, cosine, combination, rescoring.

All questions of a batch are one job: a ``query_id`` column runs through every step. Filters stand
below each top-k, where Catalyst can't move them by itself. Ties go to the smallest
(document_id, version, chunk_key).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from ..functions.text import context_text, estimate, normalized, search_text, tokens
from ..functions.words import worded
from ..schemas import CANDIDATES_PER_RESULT, MAX_RESULTS, PARENT_BYTES
from ..session import parts

#: fixed values: the ranking function's defaults and the weights of its parts
K1, B = 1.2, 0.75
PHRASE_BOOST, FIRST_WEIGHT, RESCORE_WEIGHT = 3.0, 0.2, 1.0
DIGITS = 6

KEY = ["document_id", "version", "chunk_key"]


def query_terms(queries: DataFrame) -> DataFrame:
    """With ``terms``, the distinct words to match, and ``phrase``, the words in order.

    A question of nothing but asking words is matched by its own words, and has no phrase.
    """
    return queries.select("*", F.array_distinct(tokens(search_text(F.col("question")))).alias("terms"), tokens(normalized(F.col("question"))).alias("phrase"))


def lengths(chunks: DataFrame) -> DataFrame:
    """(key, n_tokens); a chunk without a text has no length."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.list_value_length(batch.column(len(KEY)))], names=[*KEY, "n_tokens"])

    made = StructType([*chunks.select(*KEY).schema, *StructType.fromDDL("n_tokens int")])
    return worded(chunks, F.col("text_content"), KEY, counted, made).union(chunks.where("text_content is null").select(*KEY, F.lit(None).cast("int")))


#: Words that a Python worker looks at together, whole chunks at a time.
WORDS_AT_ONCE = 1 << 18


def runs(batch: pa.RecordBatch, words: int, borders: np.ndarray | None = None, limit: int = WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose lists (column ``words``) hold about ``limit`` words, one row at least; cut only before rows that ``borders`` names, if given."""
    before = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(words)).fill_null(0).to_numpy())])
    cuts = np.arange(1, batch.num_rows + 1) if borders is None else np.append(borders[borders > 0], batch.num_rows)
    row = 0
    while row < batch.num_rows:
        fits = int(np.searchsorted(before[cuts], before[row] + limit, side="right")) - 1
        end = int(cuts[max(fits, int(np.searchsorted(cuts, row, side="right")))])
        yield batch.slice(row, end - row)
        row = end


def grouped(batch: pa.RecordBatch, row: np.ndarray, place: np.ndarray, code: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """Postings of words at these rows and places of a batch (key, words), in order of them; ``code`` is a word's place in ``words``."""
    count = pc.list_value_length(batch.column(len(KEY))).to_numpy()
    own = row * len(words) + code
    order = np.argsort(own, kind="stable")
    own = own[order]
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    of, ends = row[order][at], np.append(at, len(own))
    keys = [batch.column(k).take(pa.array(of)) for k in range(len(KEY))]
    terms = words.take(pa.array(code[order[at]]))
    positions = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[order]))
    return pa.RecordBatch.from_arrays([*keys, pa.array(count[of].astype(np.int32)), terms, pa.array(np.diff(ends)), positions], names=POSTED)


POSTED = [*KEY, "n_tokens", "term", "tf", "positions"]


def placed(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a batch (key, words), with their rows and their places there."""
    lists = batch.column(len(KEY))
    count = pc.list_value_length(lists).to_numpy()
    row = np.repeat(np.arange(len(count)), count)
    return lists.flatten(), row, (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)


def word_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of chunks (key, words): a row for each word of a chunk, with its places in order."""
    for whole in batches:
        for batch in runs(whole, len(KEY)):
            flat, row, place = placed(batch)
            coded = flat.dictionary_encode()
            yield grouped(batch, row, place, coded.indices.to_numpy(), coded.dictionary)


def asked_places(terms: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``word_places`` gives of these words alone, and for each chunk a row without a term, with its length."""
    asked = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in runs(whole, len(KEY)):
                count, none = pc.list_value_length(batch.column(len(KEY))), [pa.nulls(batch.num_rows, t) for t in (pa.string(), pa.int64(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], count, *none], names=POSTED)
                flat, row, place = placed(batch)
                code = pc.index_in(flat, value_set=asked).fill_null(-1).to_numpy()
                met = np.flatnonzero(code >= 0)
                yield grouped(batch, row[met], place[met], code[met], asked)

    return run


def postings(chunks: DataFrame) -> DataFrame:
    """(key, n_tokens, term, tf, positions) of every chunk's body; positions count from 0.

    Each chunk's words are found and grouped where it lies, a bounded number of them at a time: no row of it moves.
    """
    return worded(chunks, F.col("text_content"), KEY, word_places, _posted(chunks))


def _posted(chunks: DataFrame) -> StructType:
    return StructType([*chunks.select(*KEY).schema, *StructType.fromDDL("n_tokens int, term string, tf long, positions array<int>")])


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: documents and their mean length, over the whole index whoever may see it."""
    return lengths(chunks).agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avg_len"))


@dataclass(frozen=True)
class Index:
    """What searches read: postings by term, statistics of the whole corpus (one row), chunks with vectors.

    ``term_parts`` is into how many parts terms are dealt where postings are stored; 0 if they aren't.
    """

    postings: DataFrame
    stats: DataFrame
    chunks: DataFrame
    term_parts: int = 0

    def of(self, terms: DataFrame, *columns: str) -> DataFrame:
        """Postings of the given terms: only their parts of a stored index are read."""
        rows = self.postings
        if not self.term_parts:
            return rows.join(F.broadcast(terms), "term").select(*columns)
        dealt = F.broadcast(terms.withColumn("part", part_of("term", self.term_parts)))
        return rows.join(dealt, ["part", "term"]).select(*columns)


def part_of(term: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def index(chunks: DataFrame) -> Index:
    """An index that is computed as it is read."""
    return Index(postings(chunks), corpus_stats(chunks), chunks)


def batch_index(chunks: DataFrame, queries: DataFrame, path: str) -> Index:
    """What one batch of questions asks of an index: postings of its words, written by one pass over the texts.

    Every chunk is read and counts in the statistics, but words that nobody asks for are neither sorted nor stored. It costs
    a fraction of ``store_index``, which pays where many batches search the same chunks.
    """
    # a batch has a plan's few steps, so these are as many words as their questions have
    terms = [r[0] for r in query_terms(queries).select(F.explode("terms")).distinct().collect()]
    schema = _posted(chunks)
    worded(chunks, F.col("text_content"), KEY, asked_places(sorted(terms)), schema).write.parquet(path)
    held = chunks.sparkSession.read.schema(schema).parquet(path)
    # a chunk without a text counts, but has no length
    stats = chunks.agg(F.count("*").alias("n_docs")).crossJoin(held.where("term is null").agg(F.avg("n_tokens").alias("avg_len")))
    return Index(held.where("term is not null"), stats, chunks)


def store_index(chunks: DataFrame, path: str, term_parts: int = 64) -> Index:
    """Write an index once, for any number of searches, and give what reads it.

    Postings are stored in parts by term, inside these in order of terms, so that a search reads the parts of its
    terms and in these the row groups that hold them. A frequent term's postings are dealt over several files.
    """
    spark = chunks.sparkSession
    chunks.write.parquet(f"{path}/chunks")
    held = spark.read.schema(chunks.schema).parquet(f"{path}/chunks")
    spread_key = F.pmod(F.xxhash64(*KEY), F.lit(8))
    rows = postings(held).withColumn("part", part_of("term", term_parts)).repartition("part", spread_key).sortWithinPartitions("part", "term")
    rows.write.partitionBy("part").parquet(f"{path}/postings")
    corpus_stats(held.select(*KEY, "text_content")).write.parquet(f"{path}/stats")
    return open_index(spark, path, chunks.schema, rows.schema, term_parts)


def open_index(spark: SparkSession, path: str, chunks: StructType, rows: StructType, term_parts: int) -> Index:
    stats = spark.read.schema("n_docs long, avg_len double").parquet(f"{path}/stats")
    return Index(spark.read.schema(rows).parquet(f"{path}/postings"), stats, spark.read.schema(chunks).parquet(f"{path}/chunks"), term_parts)


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def matches(index: Index, queries: DataFrame, allowed: DataFrame | None = None, phrases: bool = True) -> DataFrame:
    """(query_id, key, bm_or, matched, n_terms, bm_phrase) of allowed chunks with a term of the question.

    Only postings of asked terms are read; statistics are those of the whole index, whoever may see it. Chunks
    that may not be seen go before anything is scored, and phrases are looked for only in chunks that hold every
    term, by the positions of their words.
    """
    q = query_terms(queries).where(F.size("terms") > 0).select("query_id", "phrase", "terms", F.size("terms").alias("n_terms"))
    # a batch has a plan's few steps, so these are as many rows as their questions have words
    asked = q.select("query_id", "n_terms", F.explode("terms").alias("term"))
    terms = asked.select("term").distinct()
    stats = F.broadcast(index.stats)
    counts = index.of(terms, "term", *KEY, "n_tokens", "tf")
    df = F.broadcast(counts.groupBy("term").agg(F.count("*").alias("df")))
    seen = counts if allowed is None else counts.join(allowed.select(*KEY).distinct(), KEY, "left_semi")
    scored = seen.join(df, "term").crossJoin(stats).select(*KEY, "term", (idf(F.col("n_docs"), F.col("df")) * saturation(F.col("tf"), F.col("n_tokens"), F.col("avg_len"))).alias("part"))
    found = scored.join(F.broadcast(asked), "term").groupBy("query_id", *KEY).agg(F.sum("part").alias("bm_or"), F.count("*").alias("matched"), F.first("n_terms").alias("n_terms"))
    if not phrases:
        return found.withColumn("bm_phrase", F.lit(0.0))
    phrase = q.where(F.size("phrase") > 0).select("query_id", F.col("phrase").alias("words"))
    whole = found.where("matched = n_terms").select("query_id", *KEY).join(F.broadcast(phrase.select("query_id")), "query_id", "left_semi")
    spoken = phrase.select("query_id", F.explode(F.array_distinct("words")).alias("term"))
    places = index.of(terms, "term", *KEY, "n_tokens", "positions").join(F.broadcast(spoken), "term").join(whole, ["query_id", *KEY], "left_semi")
    held = places.groupBy("query_id", *KEY).agg(F.first("n_tokens").alias("n_tokens"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"))
    told = held.join(F.broadcast(phrase), "query_id").withColumn("tf", occurrences(F.col("places"), F.col("words"))).where("tf > 0")
    # a phrase weighs as the sum of its terms' weights, at the phrase's own frequency
    weights = asked.join(df, "term").crossJoin(stats).groupBy("query_id").agg(F.sum(idf(F.col("n_docs"), F.col("df"))).alias("idf"), F.first("avg_len").alias("avg_len"))
    heard = told.join(F.broadcast(weights), "query_id").select("query_id", *KEY, (F.col("idf") * saturation(F.col("tf"), F.col("n_tokens"), F.col("avg_len"))).alias("bm_phrase"))
    return found.join(heard, ["query_id", *KEY], "left").withColumn("bm_phrase", F.coalesce("bm_phrase", F.lit(0.0)))


def occurrences(places: Column, words: Column) -> Column:
    """How often words follow one another, from a map of each word's positions: starts that all of them allow."""
    offsets = F.transform(words, lambda w, i: F.transform(F.element_at(places, w), lambda p: p - i))
    return F.size(F.aggregate(F.slice(offsets, F.lit(2), F.greatest(F.size(offsets) - 1, F.lit(0))), F.get(offsets, F.lit(0)), lambda held, own: F.array_intersect(held, own)))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where either is null or zero."""
    x, y = a.cast("array<double>"), b.cast("array<double>")

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)

    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def best(rows: DataFrame, score: str, k: int | Column, rank: str = "rank") -> DataFrame:
    """The k best of each question by rounded score, with their rank."""
    order = W.partitionBy("query_id").orderBy(F.desc(score), *KEY)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def nearest(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, cosine, cos, rank) of the k chunks nearest to each question's vector, exactly; ranked by the rounded ``cos``.

    A batch holds a plan's few steps, so each chunk is compared with each of them where it lies.
    """
    q = F.broadcast(queries.where("vector is not null").select("query_id", F.col("vector").alias("q_vector")))
    rows = index.where("vector is not null").select(*KEY, "vector").join(q, F.size("vector") == F.size("q_vector"))
    rows = rows.select("query_id", *KEY, cosine(F.col("vector"), F.col("q_vector")).alias("cosine")).where("cosine is not null")
    return best(rows.withColumn("cos", F.round("cosine", DIGITS)), "cos", k)


def hybrid_search(index: Index, allowed: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """(query_id, rank, key, first_score, final_score).

    index: all chunks (they give the statistics); allowed: keys of those that may be seen; queries:
    query_id, question, vector. Lexical and vector candidates are combined; the best
    30 * top_k are scored again, where chunks with all terms count with their full lexical score.
    """
    if not 1 <= top_k <= MAX_RESULTS:
        raise ValueError(f"top_k: 1 to {MAX_RESULTS}")
    wide = CANDIDATES_PER_RESULT * top_k
    keys = allowed.select(*KEY).distinct()
    lexical = matches(index, queries, keys).withColumn("lex", F.col("bm_or") + PHRASE_BOOST * F.col("bm_phrase"))
    seen = index.chunks.select(*KEY, "vector").join(keys, KEY, "left_semi")
    vector = nearest(seen, queries, wide).withColumn("near", (1 + F.col("cosine")) / 2).select("query_id", *KEY, "near")
    both = lexical.join(vector, ["query_id", *KEY], "full_outer")
    both = both.withColumn("first_score", F.round(F.coalesce("lex", F.lit(0.0)) + F.coalesce("near", F.lit(0.0)), DIGITS))
    candidates = best(both, "first_score", wide, "first_rank")
    again = FIRST_WEIGHT * F.col("first_score") + RESCORE_WEIGHT * F.when(F.col("matched") == F.col("n_terms"), F.col("bm_or")).otherwise(0.0)
    scored = candidates.withColumn("final_score", F.round(F.coalesce(again, FIRST_WEIGHT * F.col("first_score")), DIGITS))
    return best(scored, "final_score", top_k).select("query_id", F.col("rank").cast("int").alias("rank"), *KEY, "first_score", "final_score")


def checked_again(hits: DataFrame, allowed_now: DataFrame) -> DataFrame:
    """Hits that the tables as they are now still allow."""
    return hits.join(allowed_now.select(*KEY).distinct(), KEY, "left_semi")


#: What a chunk shows of itself in a result, where the table of chunks has it.
SHOWN = ["file_md5", "text_content", "context_prefix", "org_tag", "is_public", "parent_id", "heading_path", "source_spans", "token_count", "kind", "table_id", "row_range", "column_paths"]


def presented(hits: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Hits as they are shown: with the chunk's text, places and labels, its file's name, and its owner as text.

    files: those that may be seen now (id, user_id, file_md5, file_name, org_tag, is_public). Hits whose file isn't among
    them, or isn't the chunk's, go.
    """
    shown = [c for c in SHOWN if c in chunks.columns]
    f = files.select(F.col("id").alias("document_id"), F.col("user_id").alias("owner_id"), F.col("file_md5").alias("owner_md5"), "file_name", *[c for c in ("org_tag", "is_public") if c not in shown])
    # hits are at most top_k of each question
    rows = chunks.select(*KEY, "user_id", *shown).join(F.broadcast(hits), KEY).join(f, "document_id").where("owner_id = user_id and owner_md5 = file_md5")
    return rows.withColumn("user_id", F.col("user_id").cast("string")).drop("owner_id", "owner_md5")


def greedy(items: Column, budget: int, most: int | None = None) -> Column:
    """Of (id, cost) in order, the ids taken by skipping what doesn't fit what is left."""
    taken = F.array().cast("array<string>")
    start = F.struct(F.lit(budget).cast("long").alias("left"), taken.alias("ids"))

    def take(s: Column, x: Column) -> Column:
        fits = x["cost"] <= s["left"]
        if most is not None:
            fits = fits & (F.size(s["ids"]) < most)
        return F.struct(F.when(fits, s["left"] - x["cost"]).otherwise(s["left"]).alias("left"), F.when(fits, F.concat(s["ids"], F.array(x["id"].cast("string")))).otherwise(s["ids"]).alias("ids"))

    return F.aggregate(items, start, take, lambda s: s["ids"])


def attach_parents(hits: DataFrame, parents: DataFrame, budget: int = PARENT_BYTES) -> DataFrame:
    """Hits (query_id, rank, document_id, version, parent_id, user_id, ...) with parent_text, parent_spans,
    parent_row_range and parent_column_paths, or nulls.

    parents: document_id, version, chunk_id, user_id, is_parent, context_prefix, body_text, source_spans, row_range,
    column_paths. A parent of the same owner with a body and a place costs its bytes once, at its first hit; what
    doesn't fit what is left is skipped.
    """
    usable = F.coalesce(F.col("is_parent") & (F.trim("body_text") != "") & (F.size("source_spans") > 0), F.lit(False))
    p = parents.where(usable).select(
        "document_id", "version", F.col("chunk_id").alias("parent_id"), F.col("user_id").alias("parent_owner"),
        F.struct(context_text(F.col("context_prefix"), F.col("body_text")).alias("text"), "source_spans", "row_range", "column_paths").alias("parent"),
    )
    place = ["document_id", "version", "parent_id"]
    own = F.coalesce(F.col("parent_owner").cast("string") == F.col("user_id").cast("string"), F.lit(False))
    ref = F.concat_ws("/", F.col("document_id").cast("string"), "version", "parent_id")
    # texts are joined to hits when it is known which stay: none is sorted with them
    dealt = hits.repartition(parts(hits), "query_id")
    priced = dealt.select("query_id", "rank", *place, "user_id").join(p.select(*place, "parent_owner", estimate(F.col("parent.text")).alias("cost")), place)
    first = priced.where(own).groupBy("query_id", ref.alias("ref")).agg(F.min("rank").alias("at"), F.first("cost").alias("cost"))
    chosen = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", F.col("ref").alias("id"), "cost"))).alias("items")).select("query_id", greedy(F.col("items"), budget).alias("chosen"))
    taken = dealt.join(chosen, "query_id", "left").withColumn("taken", F.coalesce(F.array_contains("chosen", ref), F.lit(False))).drop("chosen")
    out = taken.join(p, place, "left").withColumn("parent", F.when(own & F.col("taken"), F.col("parent")))
    given = [("text", "parent_text"), ("source_spans", "parent_spans"), ("row_range", "parent_row_range"), ("column_paths", "parent_column_paths")]
    return out.select(*hits.columns, *[F.col(f"parent.{a}").alias(b) for a, b in given])
