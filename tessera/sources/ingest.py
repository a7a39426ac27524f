"""From files to what searches find, as one plan: parse, chunk, stage, embed, index, publish."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.chunking import parse_and_chunk
from ..operators.segments import Segments
from .files import Embedder, embedded
from .store import Versions


def ingest(
    versions: Versions, index: Segments, files: DataFrame, owners: DataFrame, embedder: Callable[[], Embedder], version: str, model: str, dims: int, parse: Callable[[DataFrame], DataFrame] = parse_and_chunk
) -> str:
    """Ingest a version of files (document_id, file_name, content); gives the batch's name.

    owners: document_id, user_id, file_md5, org_tag, is_public; a document without an owner isn't indexed, and so is
    marked failed. Children are what is embedded and searched. A document is published once the index holds as many chunks
    of it as were staged; chunks of versions that aren't active are hidden by the index's bits, which are set anew at
    the end (``index.open_to`` with the tables of files), and go with ``retire``.
    """

    def into_index(staged: DataFrame) -> DataFrame:
        children = staged.where("not is_parent").select("document_id", "version", F.col("chunk_id").alias("chunk_key"), F.col("data.context_prefix").alias("prefix"), F.col("data.embedding_text").alias("embedding_text"), F.col("data.body_text").alias("text_content"))
        # a text moves once: what is embedded is made of it again behind the join
        joined = F.concat("prefix", "text_content")
        lean = children.withColumn("same", F.coalesce(F.col("embedding_text") == joined, F.lit(False))).withColumn("embedding_text", F.when(~F.col("same"), F.col("embedding_text")))
        owned = lean.join(owners.select("document_id", "user_id", "file_md5", "org_tag", "is_public"), "document_id")
        owned = owned.withColumn("embedding_text", F.when(F.col("same"), joined).otherwise(F.col("embedding_text"))).drop("same", "prefix")
        name = index.append(embedded(owned, embedder, model, dims))
        held = index.live().where(F.col("segment") == name).groupBy("document_id").agg(F.count("*").alias("n"))
        sent = children.groupBy("document_id").agg(F.count("*").alias("n"))
        return sent.join(held, ["document_id", "n"], "left_semi")

    return versions.process(files, parse, into_index, version)


def retire(versions: Versions, index: Segments) -> None:
    """Let chunks of versions that are neither active nor under way go from the store and from the index."""
    versions.discard()
    s = versions.states()
    live = s.select("document_id", F.col("active_version").alias("version")).union(s.where("status <> 'failed'").select("document_id", "pending_version")).where("version <> ''")
    index.delete_chunks(index.live().join(live, ["document_id", "version"], "left_anti"))
