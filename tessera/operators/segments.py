"""An index that grows by immutable segments: postings in blocks that searches skip, access as bitmaps, vectors in cells.

A segment is written once, for a batch of chunks, and never changed. Its chunks are numbered; 64 numbers
in a row are a block, so one 64-bit number tells something about each chunk of a block.

* ``chunks``: what the chunks are, with their number (doc) and block.
* ``postings``: a row for each term and block, in parts by term: how many chunks, and of their frequencies and lengths those
  that no other chunk of the block beats in both (so the block's greatest score is known, whatever the mean length); and, in columns a search reads only for blocks it can't skip,
  the chunks (a byte each), their frequencies, lengths and places.
* ``access``: for owners, tags, public chunks and models, the bits of each block that has any.
* ``vectors``: by cell (nearest centroid), what is left of the unit vector in bytes, and how far off that is at most.

A manifest names the segments, the tombstones (chunks of segments that are gone) and the bits of chunks
that may be read just now; each change writes the next manifest, readers take the last whole one. One
writer at a time is taken for granted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import tokens
from ..sources.store import names_in, packed
from .access import gated
from .retrieval import B, DIGITS, K1, KEY, best, cosine, idf, part_of, query_terms, runs, saturation

BLOCK = 64
TERM_PARTS = 16
#: Rows from which centroids are learned, how many there are at most, and queries to tune the number of probes with.
SAMPLE, CELLS, TUNING = 20_000, 64, 64
MANIFEST = "kind string, name string, n_docs long, n_tokens long"
POSTING = "term string, block long, n int, peaks array<struct<tf:int,len:int>>, docs binary, tfs binary, lens binary, places binary"
VECTOR = "doc long, block long, cell int, code binary, scale float, off float"
HELD = {"postings": f"{POSTING}, part int", "vectors": VECTOR}


@dataclass(frozen=True)
class Viewer:
    """Who searches: their chunks, public ones and those of their tags, with vectors of one model."""

    user_id: int
    tags: Sequence[str]
    model: str


def written_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of chunks (doc, words): sorted by term, block and chunk, cut where term or block change; a bounded number of words, or one block, at a time."""
    for whole in batches:
        number = whole.column(0).to_numpy() // BLOCK
        for batch in runs(whole, 1, np.flatnonzero(np.diff(number)) + 1):
            lists = batch.column(1)
            count = pc.list_value_length(lists).to_numpy()
            words = lists.flatten()
            if not len(words):
                continue
            doc = np.repeat(batch.column(0).to_numpy(), count)
            place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
            length = np.repeat(count, count)
            coded = words.dictionary_encode()
            term = coded.indices.to_numpy()
            order = np.lexsort((place, doc, term))
            term, doc, place, length = term[order], doc[order], place[order].astype("<u4"), length[order]
            new_doc = np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])
            at = np.flatnonzero(new_doc)  # where a chunk's own run of the term begins
            tf = np.diff(np.append(at, len(term)))
            t, d, n = term[at], doc[at], length[at]
            block = d // BLOCK
            first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (block[1:] != block[:-1])]))
            ends = np.append(first[1:], len(t))
            offsets = (d % BLOCK).astype(np.uint8)
            tfs, lens = tf.astype("<u4"), n.astype("<u4")
            from_, to = at[first], np.append(at, len(term))[ends]
            # from the largest frequency down, lengths below all before: a group's own begin anew, as each group counts from further below
            group = np.repeat(np.arange(len(first)), ends - first)
            down = np.lexsort((n, -tf, group))
            low = n[down] - group[down] * (1 << 40)
            peak = down[np.concatenate([[True], low[1:] < np.minimum.accumulate(low)[:-1]])]
            many = np.searchsorted(group[peak], np.arange(len(first) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(x[peak].astype(np.int32)) for x in (tf, n)], ["tf", "len"])
            cut = lambda x, a, b: pa.array([x[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary.take(pa.array(t[first])), pa.array(block[first]), pa.array((ends - first).astype(np.int32)), pa.ListArray.from_arrays(pa.array(many), pairs),
                    cut(offsets, first, ends), cut(tfs, first, ends), cut(lens, first, ends), cut(place, from_, to),
                ],
                names=["term", "block", "n", "peaks", "docs", "tfs", "lens", "places"],
            )


def units(column: pa.Array) -> np.ndarray:
    """Vectors as rows of length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest_cell(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centers.T - (centers * centers).sum(1) / 2, 1)


def learned_centers(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centers of a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        cell = nearest_cell(x, centers)
        for c in range(len(centers)):
            own = x[cell == c]
            if len(own):
                centers[c] = own.mean(0)
    return centers


def is_vector(v: Column) -> Column:
    """Neither null nor empty, of finite numbers, and not zero: what a cosine needs."""
    x = v.cast("array<double>")
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))


class Segments:
    """An index in a folder; chunks are KEY, user_id, file_md5, model_version, org_tag, is_public, text_content, vector."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # the manifest

    def manifest(self) -> list[tuple]:
        """What there is: as many rows as there are segments and sets of tombstones."""
        whole = [g for g in names_in(self.spark, f"{self.root}/manifest") if "_SUCCESS" in names_in(self.spark, f"{self.root}/manifest/{g}")]
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{whole[-1]}").collect()] if whole else []

    def _commit(self, rows: list[tuple]) -> None:
        n = len(names_in(self.spark, f"{self.root}/manifest"))
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifest/{n:08}")

    def _names(self, kind: str) -> list[str]:
        return [name for k, name, *_ in self.manifest() if k == kind]

    def _read(self, kind: str, what: str, names: list[str] | None = None) -> DataFrame:
        """A table of all segments, each row with its segment."""
        # tables in folders by a value have no file where they have no row
        read = self.spark.read.schema(HELD[what]) if what in HELD else self.spark.read
        parts = [read.parquet(f"{self.root}/{kind}/{n}/{what}").withColumn("segment", F.lit(n)) for n in (self._names(kind) if names is None else names)]
        if not parts:
            raise ValueError("the index is empty")
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    # changes

    def append(self, chunks: DataFrame) -> str:
        """A segment of new chunks; gives its name."""
        name = uuid.uuid4().hex
        n_docs, n_tokens = self._write(chunks, name)
        self._commit([*self.manifest(), ("segments", name, n_docs, n_tokens)])
        return name

    def _write(self, chunks: DataFrame, name: str) -> tuple[int, int]:
        at = f"{self.root}/segments/{name}"
        rows = chunks.select(*KEY, "user_id", "file_md5", "model_version", "org_tag", "is_public", "text_content", "vector", F.size(tokens(F.coalesce("text_content", F.lit("")))).alias("n_tokens"))
        packed(rows.withColumn("doc", F.monotonically_increasing_id()).withColumn("block", F.floor(F.col("doc") / BLOCK))).parquet(f"{at}/chunks")
        held = self.spark.read.parquet(f"{at}/chunks")
        posted = held.select("doc", tokens(F.coalesce("text_content", F.lit(""))).alias("words")).mapInArrow(written_blocks, POSTING).withColumn("part", part_of("term", TERM_PARTS))
        # postings are several times their text when they move: each task writes those of its own blocks
        packed(posted.sortWithinPartitions("part", "term", "block")).partitionBy("part").parquet(f"{at}/postings")
        marks = F.array(
            F.struct(F.lit("owner").alias("attr"), F.col("user_id").cast("string").alias("value")), F.struct(F.lit("tag").alias("attr"), F.col("org_tag").alias("value")),
            F.struct(F.lit("public").alias("attr"), F.col("is_public").cast("string").alias("value")), F.struct(F.lit("model").alias("attr"), F.col("model_version").alias("value")),
        )
        bits = held.select("block", self._bit(), F.explode(marks).alias("m")).where("m.value is not null")
        bits.groupBy(F.col("m.attr").alias("attr"), F.col("m.value").alias("value"), "block").agg(F.bit_or("bit").alias("bits")).repartition("attr").sortWithinPartitions("attr", "value").write.parquet(f"{at}/access")
        self._write_vectors(held, at)
        n = held.agg(F.count("*"), F.sum("n_tokens")).first()
        return int(n[0]), int(n[1] or 0)

    @staticmethod
    def _bit() -> Column:
        return F.expr(f"shiftleft(1L, cast(doc % {BLOCK} as int))").alias("bit")

    def centers(self) -> np.ndarray | None:
        if not names_in(self.spark, f"{self.root}/centers"):
            return None
        return np.array([r["center"] for r in self.spark.read.parquet(f"{self.root}/centers").orderBy("cell").collect()], float)

    def _write_vectors(self, held: DataFrame, at: str) -> None:
        rows = held.where(is_vector(F.col("vector"))).select("doc", "block", "vector")
        centers = self.centers()
        if centers is None:
            # the cells are learned once, from a sample with the smallest hashes
            some = rows.orderBy(F.xxhash64("vector"), "doc").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
            if len(some):
                x = units(some)
                centers = learned_centers(x, max(1, min(CELLS, len(x) // 16)))
                self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.parquet(f"{self.root}/centers")

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = units(batch.column(2))
                cell = nearest_cell(x, centers)
                rest = x - centers[cell]
                scale = np.maximum(np.abs(rest).max(1) / 127, 1e-30).astype(np.float32)
                code = np.rint(rest / scale[:, None]).astype(np.int8)
                off = np.sqrt(((rest - code * scale[:, None].astype(float)) ** 2).sum(1)) * 1.0001 + 1e-9
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(off.astype(np.float32))],
                    names=["doc", "block", "cell", "code", "scale", "off"],
                )

        if centers is None:
            self.spark.createDataFrame([], VECTOR).write.parquet(f"{at}/vectors")
            return
        same = rows.where(F.size("vector") == centers.shape[1])
        same.mapInArrow(coded, VECTOR).repartition("cell", F.pmod(F.col("block"), F.lit(4))).sortWithinPartitions("cell", "block").write.partitionBy("cell").parquet(f"{at}/vectors")

    def delete(self, documents: DataFrame) -> None:
        """Chunks of the given documents (document_id) go."""
        self.delete_chunks(self.live().join(documents.select("document_id").distinct(), "document_id", "left_semi"))

    def delete_chunks(self, gone: DataFrame) -> None:
        """Live chunks (rows of ``live``) go: a set of tombstones, no segment is written."""
        name = uuid.uuid4().hex
        gone.select("segment", "doc", "block", "n_tokens").write.parquet(f"{self.root}/tombstones/{name}/chunks")
        n = self.spark.read.parquet(f"{self.root}/tombstones/{name}/chunks").agg(F.count("*"), F.sum("n_tokens")).first()
        if n[0]:
            self._commit([*self.manifest(), ("tombstones", name, int(n[0]), int(n[1] or 0))])

    def replace(self, chunks: DataFrame) -> str:
        """The chunks of these documents instead of those there were."""
        if self._names("segments"):
            self.delete(chunks)
        return self.append(chunks)

    def merge(self, smaller: int) -> list[str]:
        """Segments of less than so many live chunks become one; others aren't touched. Gives the names of those that went."""
        lost = {r["segment"]: r["n"] for r in self._dead().groupBy("segment").agg(F.count("*").alias("n")).collect()}
        small = [name for kind, name, n, _ in self.manifest() if kind == "segments" and n - lost.get(name, 0) < smaller]
        if len(small) < 2:
            return []
        name = uuid.uuid4().hex
        n_docs, n_tokens = self._write(self.live().where(F.col("segment").isin(small)).drop("segment", "doc", "block", "n_tokens"), name)
        kept = self._dead().where(~F.col("segment").isin(small))
        stones = uuid.uuid4().hex
        kept.write.parquet(f"{self.root}/tombstones/{stones}/chunks")
        n = kept.agg(F.count("*"), F.sum("n_tokens")).first()
        rows = [r for r in self.manifest() if r[0] == "segments" and r[1] not in small] + [("segments", name, n_docs, n_tokens)]
        self._commit(rows + ([("tombstones", stones, int(n[0]), int(n[1] or 0))] if n[0] else []))
        return small

    def open_to(self, files: DataFrame, states: DataFrame) -> None:
        """Which chunks may be read just now: of complete files, in the active version. To be called when versions are published."""
        name = uuid.uuid4().hex
        rows = gated(self.live().select("segment", "doc", "block", *KEY, "user_id", "file_md5"), files, states)
        rows.select("segment", "block", self._bit()).groupBy("segment", "block").agg(F.bit_or("bit").alias("bits")).write.parquet(f"{self.root}/open/{name}/chunks")
        self._commit([r for r in self.manifest() if r[0] != "open"] + [("open", name, 0, 0)])

    # what is there

    def opened(self) -> DataFrame:
        """Live chunks that may be read just now, whoever asks."""
        names = self._names("open")
        bits = self.spark.read.parquet(f"{self.root}/open/{names[0]}/chunks")
        return self.live().join(bits, ["segment", "block"]).where(F.expr(f"shiftright(bits, cast(doc % {BLOCK} as int)) & 1 = 1")).drop("bits")

    def _dead(self) -> DataFrame:
        names = self._names("tombstones")
        empty = self.spark.createDataFrame([], "segment string, doc long, block long, n_tokens int")
        return empty if not names else self.spark.read.schema(empty.schema).parquet(*[f"{self.root}/tombstones/{n}/chunks" for n in names])

    def live(self) -> DataFrame:
        """Chunks that aren't gone, with segment, doc and block."""
        rows = self._read("segments", "chunks")
        return rows.join(self._dead().select("segment", "doc"), ["segment", "doc"], "left_anti") if self._names("tombstones") else rows

    def statistics(self) -> tuple[int, float]:
        """Chunks and their mean length, from the manifest."""
        sign = {"segments": 1, "tombstones": -1}
        rows = self.manifest()
        n = sum(sign.get(k, 0) * d for k, _, d, _ in rows)
        return n, sum(sign.get(k, 0) * t for k, _, _, t in rows) / max(1, n)

    def visible(self, viewer: Viewer | None) -> DataFrame | None:
        """segment, block, bits: what a search may find; nothing where all is. Bitmaps are met, no chunk is looked at."""
        dead = self._dead().select("segment", "block", self._bit()).groupBy("segment", "block").agg(F.bit_or("bit").alias("gone")) if self._names("tombstones") else None
        if viewer is None:
            if dead is None:
                return None
            blocks = self._read("segments", "chunks").select("segment", "block").distinct()
            return blocks.join(dead, ["segment", "block"], "left").select("segment", "block", F.bitwise_not(F.coalesce("gone", F.lit(0).cast("long"))).alias("bits")).where("bits <> 0")
        attr, value = F.col("attr"), F.col("value")
        own = ((attr == "owner") & (value == str(viewer.user_id))) | ((attr == "public") & (value == "true"))
        seen = own | ((attr == "tag") & value.isin(list(viewer.tags))) if viewer.tags else own
        model = (attr == "model") & (value == viewer.model)
        rows = self._read("segments", "access").where(seen | model)
        both = rows.groupBy("segment", "block").agg(F.bit_or(F.when(seen, F.col("bits"))).alias("a"), F.bit_or(F.when(model, F.col("bits"))).alias("m"))
        bits = F.coalesce(F.col("a").bitwiseAND(F.col("m")), F.lit(0).cast("long"))
        out = both.select("segment", "block", bits.alias("bits"))
        names = self._names("open")
        if names:
            readable = self.spark.read.parquet(f"{self.root}/open/{names[0]}/chunks").withColumnRenamed("bits", "readable")
            out = out.join(readable, ["segment", "block"]).select("segment", "block", F.col("bits").bitwiseAND(F.col("readable")).alias("bits"))
        if dead is not None:
            out = out.join(dead, ["segment", "block"], "left").select("segment", "block", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("gone", F.lit(0).cast("long")))).alias("bits"))
        return out.where("bits <> 0")

    # words

    def postings(self, terms: DataFrame, *columns: str) -> DataFrame:
        """Blocks of the given terms; only their parts are read, and of these only the columns asked for."""
        dealt = F.broadcast(terms.withColumn("part", part_of("term", TERM_PARTS)))
        return self._read("segments", "postings").select("part", "segment", "term", "block", *columns).join(dealt, ["part", "term"]).drop("part")

    def bm25(self, queries: DataFrame, k: int, viewer: Viewer | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, rank, key, score) of each question's best chunks, and (query_id, blocks, read).

        A block's greatest possible score is known without reading it. Blocks that promise most are read first; the k-th best
        score found there is the bar that others have to reach to be read at all.
        """
        asked = query_terms(queries).where(F.size("terms") > 0).select("query_id", F.explode("terms").alias("term"))
        terms = asked.select("term").distinct()
        n_docs, average = self.statistics()
        heads = self.postings(terms, "n", "peaks")
        df = heads.groupBy("term").agg(F.sum("n").cast("long").alias("df"))
        if self._names("tombstones"):
            # blocks with tombstones have to be looked into: frequencies are those of what is there
            dead = self._dead().select("segment", "block", self._bit()).groupBy("segment", "block").agg(F.bit_or("bit").alias("bits"))
            met = self.postings(terms, "docs").join(dead, ["segment", "block"]).select("term", "docs", "bits")
            lost = met.mapInArrow(counted, "term string, n long")
            df = df.unionByName(lost.select("term", (-F.col("n")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
        weight = df.where("df > 0").select("term", idf(F.lit(float(n_docs)), F.col("df")).alias("weight"))
        weighted = self._kept(asked.join(weight, "term").select("query_id", "term", "weight"))
        q = F.broadcast(weighted)
        most = F.col("weight") * F.array_max(F.transform("peaks", lambda x: saturation(x["tf"], x["len"], F.lit(average))))
        promise = heads.join(q, "term").groupBy("query_id", "segment", "block").agg(F.sum(most).alias("most"), F.count("*").alias("blocks"))
        allowed = self.visible(viewer)
        if allowed is not None:
            allowed = self._kept(allowed)
            promise = promise.join(allowed, ["segment", "block"])
        else:
            promise = promise.withColumn("bits", F.lit(-1).cast("long"))
        promise = self._kept(promise.withColumn("at", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("most"), "segment", "block"))))

        def exact(blocks: DataFrame) -> DataFrame:
            rows = self.postings(terms, "docs", "tfs", "lens").join(q, "term").join(blocks.select("query_id", "segment", "block", "bits"), ["query_id", "segment", "block"])
            parts = rows.select("query_id", "segment", "block", "bits", "weight", "docs", "tfs", "lens").mapInArrow(scorer(average), "query_id long, segment string, doc long, part double")
            scores = parts.groupBy("query_id", "segment", "doc").agg(F.round(F.sum("part"), DIGITS).alias("score"))
            return self._kept(scores)

        first = promise.where(F.col("at") <= 2 + k // 16)
        found = exact(first)
        order = W.partitionBy("query_id").orderBy(F.desc("score"))
        bar = found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query_id", F.col("score").alias("bar"))
        # a margin for the last digit
        more = promise.where(F.col("at") > 2 + k // 16).join(F.broadcast(bar), "query_id", "left").where(F.col("bar").isNull() | (F.col("most") + 1e-6 >= F.col("bar")))
        more = self._kept(more)
        # ties at the end are broken by the keys: chunks that can be among the first k
        every = found.unionByName(exact(more))
        close = every.withColumn("n", F.rank().over(order)).where(F.col("n") <= k)
        named = close.join(self._read("segments", "chunks").select("segment", "doc", *KEY), ["segment", "doc"])
        counts = promise.groupBy("query_id").agg(F.sum("blocks").alias("blocks"))
        read = first.select("query_id", "blocks").unionByName(more.select("query_id", "blocks")).groupBy("query_id").agg(F.sum("blocks").alias("read"))
        return best(named, "score", k).select("query_id", F.col("rank").cast("int").alias("rank"), *KEY, "score"), counts.join(read, "query_id")

    def _kept(self, rows: DataFrame) -> DataFrame:
        """A small table of a search that several of its steps read."""
        path = f"{self.root}/searches/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # vectors

    def probes(self, k: int, recall: float = 0.95, viewer: Viewer | None = None) -> int:
        """How many cells have to be looked at so that the share ``recall`` of true neighbours is found, under a filter.

        Measured on some of the vectors that are there: where the cells of their exact neighbours stand in their own order of cells.
        """
        centers = self.centers()
        if centers is None:
            return 1
        live = self.live().where(is_vector(F.col("vector")))
        some = live.orderBy(F.xxhash64("segment", "doc")).limit(TUNING).select(F.monotonically_increasing_id().alias("query_id"), "vector")
        some = self._kept(some)
        found, _ = self.nearest(some, k, len(centers), viewer)
        cells = self._read("segments", "vectors").select("segment", "doc", "cell")
        met = found.join(self._read("segments", "chunks").select("segment", "doc", *KEY), KEY).join(cells, ["segment", "doc"]).join(some, "query_id").select("vector", "cell").toArrow()
        if not met.num_rows:
            return len(centers)
        score = units(met["vector"].combine_chunks()) @ centers.T
        own = np.take_along_axis(score, met["cell"].to_numpy()[:, None].astype(int), 1)
        place = (score > own).sum(1) + 1
        return int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)])

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None, viewer: Viewer | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, rank, key, cos, cosine) of the nearest chunks in the cells probed, and (query_id, vectors, scored).

        What is left in bytes says a vector's cosine up to a bound; only vectors whose upper bound reaches the k-th best lower bound
        are compared as they are. With as many probes as cells the result is exact. Questions are a plan's few steps.
        """
        centers = self.centers()
        asked = queries.where(is_vector(F.col("vector"))).select("query_id", "vector").collect()
        size = 0 if centers is None else centers.shape[1]
        asked = [r for r in asked if len(r["vector"]) == size]
        shown = "query_id long, rank int, document_id long, version string, chunk_key string, cos double, cosine double"
        if not asked:
            return self.spark.createDataFrame([], shown), self.spark.createDataFrame([], "query_id long, vectors long, scored long")
        x = units(pa.array([r["vector"] for r in asked], pa.list_(pa.float64())))
        ids = np.array([r["query_id"] for r in asked], np.int64)
        probes = len(centers) if probes is None else min(probes, len(centers))
        order = np.argsort(-(x @ centers.T), 1, kind="stable")[:, :probes]
        probed = np.zeros((len(ids), len(centers)), bool)
        np.put_along_axis(probed, order, True, 1)
        rows = self._read("segments", "vectors").where(F.col("cell").isin([int(c) for c in np.flatnonzero(probed.any(0))]))
        allowed = self.visible(viewer)
        rows = rows.withColumn("bits", F.lit(-1).cast("long")) if allowed is None else rows.join(allowed, ["segment", "block"])

        def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, bits = batch.column(1).to_numpy(), batch.column(6).to_numpy()
                keep = np.flatnonzero(bits >> (doc % BLOCK) & 1)
                if not len(keep):
                    continue
                some = batch.take(pa.array(keep))
                doc, cell = some.column(1).to_numpy(), some.column(2).to_numpy()
                code = np.frombuffer(b"".join(some.column(3).to_pylist()), np.int8).reshape(len(doc), -1)
                near = centers[cell] + code * some.column(4).to_numpy()[:, None].astype(float)
                cos = x @ near.T
                off = some.column(5).to_numpy().astype(float) + 1e-9
                for a, b in zip(*_part(probed[:, cell]), strict=True):
                    if len(b):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), ids[a])), some.column(0).take(pa.array(b)), pa.array(doc[b]), pa.array(cos[a, b] - off[b]), pa.array(cos[a, b] + off[b])], names=["query_id", "segment", "doc", "low", "high"])

        near = rows.select("segment", "doc", "cell", "code", "scale", "off", "bits").mapInArrow(bounded, "query_id long, segment string, doc long, low double, high double")
        near = self._kept(near)
        bar = near.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("low")))).where(F.col("n") == k).select("query_id", F.col("low").alias("bar"))
        # results are ranked by six digits: what may be equal in these stays
        close = near.join(F.broadcast(bar), "query_id", "left").where(F.col("bar").isNull() | (F.col("high") + 1e-6 >= F.col("bar"))).select("query_id", "segment", "doc")
        close = self._kept(close)
        q = F.broadcast(queries.select("query_id", F.col("vector").alias("q_vector")))
        held = self._read("segments", "chunks").select("segment", "doc", *KEY, "vector").join(close, ["segment", "doc"]).join(q, "query_id")
        scored = held.select(F.col("query_id").cast("long").alias("query_id"), *KEY, cosine(F.col("vector"), F.col("q_vector")).alias("cosine")).withColumn("cos", F.round("cosine", DIGITS))
        counts = near.groupBy("query_id").agg(F.count("*").alias("vectors")).join(close.groupBy("query_id").agg(F.count("*").alias("scored")), "query_id")
        return best(scored, "cos", k).select("query_id", F.col("rank").cast("int").alias("rank"), *KEY, "cos", "cosine"), counts


def _part(mask: np.ndarray) -> tuple[range, list[np.ndarray]]:
    return range(len(mask)), [np.flatnonzero(row) for row in mask]


def bits_of(docs: np.ndarray, bits: int) -> np.ndarray:
    """Which of a block's chunks (bytes) a bitmap holds."""
    return (np.uint64(bits & (1 << 64) - 1) >> docs.astype(np.uint64) & np.uint64(1)).astype(bool)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, n: chunks of blocks that their bitmap holds."""
    for batch in batches:
        n = [int(bits_of(np.frombuffer(d, np.uint8), b).sum()) for d, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["term", "n"])


def scorer(average: float):
    """Reads blocks: each chunk's part of the score, of those the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, seg, doc, part = [], [], [], []
            for query, segment, block, bits, weight, docs, tfs, lens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d = np.frombuffer(docs, np.uint8)
                own = bits_of(d, bits)
                tf, n = np.frombuffer(tfs, "<u4")[own].astype(float), np.frombuffer(lens, "<u4")[own].astype(float)
                q.append(np.full(len(tf), query, np.int64))
                seg += [segment] * len(tf)
                doc.append(block * BLOCK + d[own].astype(np.int64))
                part.append(weight * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / average))))
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q)), pa.array(seg, pa.string()), pa.array(np.concatenate(doc)), pa.array(np.concatenate(part))], names=["query_id", "segment", "doc", "part"])

    return run
