"""Stored documents read back by identity: what a pointer names is found by key, checked, and set aside where it differs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import artifact_key
from ..operators.chunking import preview_of
from .files import ARTIFACT_SCHEMA, shown_digest
from .store import packed

# fixed value: bytes of a stored document that a preview reads, with room for its envelope
MOST_BYTES = (64 << 20) + 4096

#: What a preview reads of a stored document: three fields of its blocks. Parsed chunks, cells and spans aren't touched.
SHOWN = "key string, envelope struct<document_id:bigint,user_id:bigint,version:string,schema_version:string>, blocks array<struct<text:string,table_id:string,table_caption:string>>, version string"


def stored_previews(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(document_id, user_id, version, text, fault) of the documents that pointers (document_id, user_id, version, shown_sha256) name.

    Either ``text`` or ``fault`` is null. A document is faulty that is ``missing`` under its key, is stored more than
    once (``repeated``), carries another ``identity`` (document, owner, version) or schema, is ``too large``, has
    another ``digest`` than its pointer, or has no text (``blank``); the first of these is named. A pointer with a null
    part, or without a digest, finds nothing that equals it. Pointers given twice are answered once.

    Folders of versions that no pointer names aren't opened: they are pruned by the join. A key with very many
    copies is counted where these lie. Digest and text are made where a document lies, so that who asks for faults only
    moves no texts.
    """
    asked = wanted.select(F.col("document_id").cast("long").alias("document_id"), F.col("user_id").cast("long").alias("user_id"), F.col("version").cast("string").alias("version"), F.col("shown_sha256").alias("asked")).distinct()
    asked = asked.withColumn("key", artifact_key(F.col("user_id"), F.col("document_id"), F.col("version")))
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.coalesce(F.octet_length(b["text"]), F.lit(0)))
    fits = ~F.coalesce(size > MOST_BYTES, F.lit(False))
    text = preview_of(F.col("blocks"))
    stored = spark.read.schema(SHOWN).parquet(path).select(
        "version", "key", "envelope", fits.alias("fits"), F.when(fits, shown_digest(F.col("blocks"))).alias("digest"), F.when(fits, F.coalesce(text, F.lit("")) == "").alias("blank"), F.when(fits, text).alias("text")
    )
    stored = stored.join(asked.select("version", "key"), ["version", "key"], "left_semi")
    # of a key with several copies none is shown
    held = stored.groupBy("version", "key").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("envelope", "fits", "digest", "blank", "text")])
    rows = asked.join(held, ["version", "key"], "left")
    e = F.col("envelope")
    same = (e["document_id"] == F.col("document_id")) & (e["user_id"] == F.col("user_id")) & (e["version"] == F.col("version")) & (e["schema_version"] == ARTIFACT_SCHEMA)
    fault = (
        F.when(F.col("copies").isNull(), "missing")
        .when(F.col("copies") > 1, "repeated")
        .when(~F.coalesce(same, F.lit(False)), "identity")
        .when(~F.col("fits"), "too large")
        .when(~F.coalesce(F.col("digest") == F.col("asked"), F.lit(False)), "digest")
        .when(F.col("blank"), "blank")
    )
    found = rows.withColumn("fault", fault)
    return found.select("document_id", "user_id", "version", F.when(F.col("fault").isNull(), F.col("text")).alias("text"), "fault")


def likely(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Rows (version, key) of the named ones and few others, found where they lie: by one of 16 million marks, 2 MB that all tasks get."""
    mark = F.pmod(F.xxhash64("version", "key"), F.lit(1 << 24))
    place, number = F.bitmap_bit_position(mark), F.bitmap_bucket_number(mark)
    marks = named.groupBy(number.alias("_number")).agg(F.bitmap_construct_agg(place).alias("_marks"))
    there = rows.withColumns({"_number": number, "_place": place}).join(F.broadcast(marks), "_number")
    byte = F.conv(F.hex(F.substring("_marks", F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return there.where(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1).select(rows.columns)


def set_aside(spark: SparkSession, path: str, answers: DataFrame, quarantine: str) -> None:
    """Copy the stored rows of faulty answers, whole and with their fault, to a folder of their own, for whoever repairs them.

    What is stored isn't changed: other pointers may be right about it. A missing document has no row to set aside.
    """
    bad = answers.where("fault is not null").select("version", artifact_key(F.col("user_id"), F.col("document_id"), F.col("version")).alias("key"), "fault").distinct()
    whole = spark.read.parquet(path).drop("version").withColumn("version", F.regexp_extract(F.input_file_name(), "/version=([^/]*)/[^/]*$", 1))
    packed(likely(whole, bad).join(bad, ["version", "key"])).mode("append").parquet(quarantine)


__all__ = ["MOST_BYTES", "set_aside", "stored_previews"]
