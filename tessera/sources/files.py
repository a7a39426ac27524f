"""Raw files in and artifacts out: guarded reads, imports of folders, versioned writes, index rows."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import artifact_key
from ..schemas import COMPLETE, EMBED_BATCH, MAX_FILE_BYTES, MAX_TEXT_CHARS
from .parse import Document, parse_html

# fixed values: limits of an archive
MAX_ENTRIES, ARCHIVE_FACTOR = 10_000, 8
# fixed value: schema of stored documents
ARTIFACT_SCHEMA = "document-v1"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, file_name, size, md5, content) of a folder tree."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"), F.md5("content").alias("md5"), "content")


def guarded(files: DataFrame, most: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files that may be parsed, files set aside with ``fault``): empty, too large, or an archive that unpacks to too much."""

    @F.pandas_udf("string")
    def archive_fault(content: pd.Series) -> pd.Series:
        return content.map(lambda raw: unpack_fault(raw, ARCHIVE_FACTOR * most))

    fault = F.when(F.col("size") <= 0, "empty").when(F.col("size") > most, "too large").when(F.substring(F.hex("content"), 1, 8) == "504B0304", archive_fault("content"))
    rows = files.withColumn("fault", fault)
    return rows.where("fault is null").drop("fault"), rows.where("fault is not null").drop("content")


def unpack_fault(raw: bytes, most: int) -> str | None:
    try:
        entries = zipfile.ZipFile(io.BytesIO(raw)).infolist()
    except zipfile.BadZipFile:
        return "broken archive"
    if len(entries) > MAX_ENTRIES:
        return "too many entries"
    if sum(e.file_size for e in entries) > most:
        return "unpacks to too much"
    return "encrypted" if any(e.flag_bits & 1 for e in entries) else None


def to_import(found: DataFrame, files: DataFrame, user_id: int) -> DataFrame:
    """Files of a folder (path, md5, ...) that the user hasn't completed before; of one content, the file of the first path.

    Contents are compared by MD5 and move once, after what goes is known.
    """
    done = files.where((F.col("status") == COMPLETE) & (F.col("user_id") == user_id)).select(F.col("file_md5").alias("md5"))
    first = found.groupBy("md5").agg(F.min("path").alias("path")).join(done, "md5", "left_anti")
    return found.join(first, ["md5", "path"], "left_semi").select("md5", *[c for c in found.columns if c != "md5"])


def write_artifacts(parsed: DataFrame, path: str, version: str) -> DataFrame:
    """Parsed documents (document_id, user_id, ...) as Parquet, a folder for each version; gives document_id, key and SHA-256.

    The parse runs once: keys and digests are read from what was written. A version's folder is written once and never
    changed; readers find it by the published pointer, which names the key and has the digests: ``sha256`` of the whole,
    ``shown_sha256`` of what a preview needs (``sources.artifacts`` reads no more than that).
    """
    from .store import packed

    spark, at = parsed.sparkSession, f"{path}/version={version}"
    body = F.to_json(F.struct("blocks", "tables", "parents", "children"))
    user, document = F.col("user_id").cast("long"), F.col("document_id").cast("long")
    envelope = F.struct(document.alias("document_id"), user.alias("user_id"), F.lit(version).alias("version"), F.lit(ARTIFACT_SCHEMA).alias("schema_version"))
    named = parsed.withColumns({"sha256": F.sha2(body, 256), "shown_sha256": shown_digest(F.col("blocks")), "key": artifact_key(user, document, F.lit(version)), "envelope": envelope})
    packed(named).parquet(at)
    return spark.read.parquet(at).select("document_id", "key", "sha256", "shown_sha256")


def shown_digest(blocks: Column) -> Column:
    """SHA-256 of what a preview is made of."""
    return F.sha2(F.to_json(F.arrays_zip(blocks["text"].alias("text"), blocks["table_id"].alias("table_id"), blocks["table_caption"].alias("table_caption")), {"ignoreNullFields": "false"}), 256)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Stage chunk rows of a version; their identity is checked before anything is written."""
    bad = chunks.where("not coalesce(document_id is not null and version <> '' and length(chunk_id) <= 128 and chunk_id = data.chunk_id and parent_id = data.parent_id, false)").limit(1).count()
    if bad:
        raise ValueError("a chunk's identity differs from its payload")
    chunks.write.mode("append").partitionBy("version").parquet(path)


Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dims: int = 64) -> Embedder:
    """Deterministic vectors: signed counts of hashed words, of length one."""

    def embed(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                row[h % dims] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def embedded(chunks: DataFrame, embedder: Callable[[], Embedder], model: str, dims: int, text: str = "embedding_text") -> DataFrame:
    """Rows with ``vector`` and ``model_version``, in batches of 32; the embedder is made once in each task.

    Vectors of another length or with values that aren't finite fail the batch.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", vector array<float>, model_version string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = embedder()
        for batch in batches:
            for k in range(0, batch.num_rows, EMBED_BATCH):
                rows = batch.slice(k, EMBED_BATCH)
                some = rows.column(rows.schema.names.index(text)).fill_null("").to_pylist()
                got = np.asarray(embed(some), np.float32)
                if got.shape != (len(some), dims) or not np.isfinite(got).all():
                    raise ValueError("the embedder's vectors don't fit")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dims), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, vectors, pa.array([model] * len(some))], names=[*rows.schema.names, "vector", "model_version"])

    return chunks.mapInArrow(run, schema)


def acknowledged(sent: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids that were sent but aren't stored, or are stored twice: an index write is complete when there are none."""
    counts = stored.groupBy("vector_id").agg(F.count("*").alias("n"))
    return sent.select("vector_id").join(counts, "vector_id", "left").where("n is null or n <> 1")


def append_index(rows: DataFrame, path: str, dims: int) -> DataFrame:
    """Append embedded chunks (vector_id, vector, ...) to an index and give them as they are stored.

    Vectors of another length or with values that aren't finite stop it before anything is appended; afterwards every id
    has to be there once, else it fails. Rows are made once: they are staged beside the index, where no reader looks.
    """
    from .store import remove

    spark, staged = rows.sparkSession, f"{path}/_staged/{uuid.uuid4().hex}"
    sound = (F.size("vector") == dims) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    try:
        rows.write.parquet(staged)
        sent = spark.read.schema(rows.schema).parquet(staged)
        if not sent.where(~F.coalesce(sound, F.lit(False)) | (F.coalesce("vector_id", F.lit("")) == "")).isEmpty():
            raise ValueError("a vector or an id doesn't fit the index")
        sent.write.mode("append").parquet(path)
        stored = spark.read.schema(rows.schema).parquet(path)
        if not acknowledged(sent, stored).isEmpty():
            raise RuntimeError("the index didn't acknowledge every chunk once")
        return stored
    finally:
        remove(spark, staged)


def converted(fetch: Callable[[bytes], tuple[int, bytes]], most: int = 8 * MAX_TEXT_CHARS) -> Callable[[bytes], Document]:
    """A parser for files that a service turns into XHTML; ``fetch`` gives its status and answer.

    Redirects aren't followed, other answers than success are failures, and so is output beyond ``most`` bytes.
    """

    def parse(raw: bytes) -> Document:
        status, answer = fetch(raw)
        if 300 <= status < 400:
            raise ValueError("the converter redirects")
        if status != 200:
            raise ValueError(f"the converter answers {status}")
        if len(answer) > most:
            raise ValueError("the converter gives too much")
        return parse_html(answer)

    return parse
