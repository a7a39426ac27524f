"""Shared helpers: scratch tables in the cluster's shared folder, sized joins, held-out folds."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder, ship

#: Rows up to which a lookup table counts as small enough to broadcast.
BROADCAST_ROWS = 200_000


#: What stands for a null id inside operators: null counts as the largest id.
NO_ID = (1 << 63) - 1


def order_id(doc_id: str = "doc_id") -> Column:
    """The id as a number that is never null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def shown_id(name: str) -> Column:
    """An order_id as it is given back."""
    return F.when(F.col(name) < NO_ID, F.col(name)).alias(name)


def materialize(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write a frame to a scratch table in the shared folder and read it back: cuts the lineage.

    The table survives lost executors, and its two uses cost one computation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tessera/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing still to be computed reads; frames of other kinds stay as they are."""
    for df in tables:
        path = getattr(df, "_tessera_scratch", None)
        if path:
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of plans nobody refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialized table for broadcast if its counted rows stay within the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hash_thinned(df: DataFrame, wanted: int, doc_id: str = "doc_id") -> DataFrame:
    """The rows with the smallest hashes of their id, several times as many as wanted, for an order by that hash.

    So only few rows of a large table are ranked, and as many at any size.
    """
    total = df.count()
    unit = F.conv(F.substring(F.md5(F.col(doc_id).cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32
    return df if total <= 8 * wanted else df.where(unit <= 8.0 * wanted / total)


def range_parts(rows: int, spark: SparkSession, most: int = 500_000) -> int:
    """Ranges for a sorted table: at least the session's shuffle partitions, and none of many more than ``most`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def numbered(df: DataFrame, order: list[Column], what: str, rows: int) -> DataFrame:
    """The rows with ``number``, their place from 0 in a total order: sorted in ranges, ranges counted, counts added up.

    No task holds more than its range; only one count a range reaches the driver. ``order`` has to tell rows apart
    as far as their numbers matter.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(range_parts(rows, spark), *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_within", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = materialize(ranged, what)
    before, at = [], 0
    for r in sorted(ranged.groupBy("_part").count().collect()):
        before.append((r["_part"], at))
        at += r["count"]
    known = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
    out = ranged.join(known, "_part").withColumn("number", F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")
    out._tessera_scratch = ranged._tessera_scratch
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
