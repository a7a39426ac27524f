"""Queries that run a stream to its end, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .. import roles
from ..session import shared_folder
from ..streaming import tasks as T, topic, turns

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scratch(spark) -> str:
    """A folder of this run's own, in the session's shared folder where it names one."""
    return f"{shared_folder(spark).rstrip('/')}/tessera-stream/{uuid.uuid4().hex}"


def events(spark, sf_dir) -> DataFrame:
    """The events as a stream of five micro-batches; the last delivers a tenth of them again."""
    rows, at = roles.table(spark, sf_dir, "events"), f"{scratch(spark)}/events"
    for k in range(4):
        rows.where(F.col("event_id") % 4 == k).write.mode("append").parquet(at)
    rows.where("event_id % 10 = 1").write.mode("append").parquet(at)
    # each part of the table writes a file of its own: a micro-batch takes as many as the table has parts
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", rows.rdd.getNumPartitions()).parquet(at)


@query("select distinct event_id % 500 + 1 as document_id, 'v' || event_id % 3 as version from events where event_id % 10 <> 3")
def stream_tasks(spark, sf_dir) -> DataFrame:
    """Tasks as JSON messages, some of them broken, consumed to the end; what is done is read back."""
    e = F.col("event_id")
    task = F.to_json(F.struct((e % 500 + 1).alias("document_id"), F.col("user_id"), F.lit("m").alias("file_md5"), F.concat(F.lit("v"), (e % 3).cast("string")).alias("version")))
    messages = events(spark, sf_dir).select(F.when(e % 10 == 3, '{"document_id":').otherwise(task).alias("value"))
    at = scratch(spark)
    T.consume(messages, lambda t: t.select("document_id", "version"), f"{at}/done", f"{at}/failed", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/done").select("document_id", "version")


@query("""with t as (select distinct event_id % 500 + 1 as document_id, 'v' || event_id % 3 as version from events where event_id % 10 <> 3)
select document_id, version, case when document_id % 50 = 7 then 'no parser' end as error from t""")
def stream_failures(spark, sf_dir) -> DataFrame:
    """Tasks that fail for good are kept apart from those that are done, each once whatever is delivered again."""
    e = F.col("event_id")
    task = F.to_json(F.struct((e % 500 + 1).alias("document_id"), F.col("user_id"), F.lit("m").alias("file_md5"), F.concat(F.lit("v"), (e % 3).cast("string")).alias("version")))
    messages = events(spark, sf_dir).select(F.when(e % 10 == 3, "broken").otherwise(task).alias("value"))
    at = scratch(spark)
    T.consume(messages, lambda t: t.select("document_id", "version", F.when(F.col("document_id") % 50 == 7, "no parser").alias("error")), f"{at}/done", f"{at}/failed", f"{at}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{at}/done").select("document_id", "version", F.lit(None).cast("string").alias("error"))
    return done.union(spark.read.parquet(f"{at}/failed").select("document_id", "version", "error"))


@query("select event_id % 400 as document_id, count(distinct event_id // 400 % 9) filter (event_id // 400 % 9 < 7)::int as uploaded, count(distinct event_id // 400 % 9) filter (event_id // 400 % 9 < 7) = 7 as complete from events group by 1")
def stream_upload_sessions(spark, sf_dir) -> DataFrame:
    """Upload parts in any order through the stateful session operator; the last state of each document."""
    e = F.col("event_id")
    parts = events(spark, sf_dir).select((e % 400).alias("document_id"), (F.floor(e / 400) % 9).cast("int").alias("chunk_index"), F.lit(7).alias("total"))
    at = scratch(spark)
    T.upload_sessions(parts).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.SESSION).parquet(f"{at}/out")
    return rows.groupBy("document_id").agg(F.max("uploaded").alias("uploaded"), F.max(F.col("event") == "complete").alias("complete"))


@query("select distinct user_id, event_type from events")
def stream_deduplicated(spark, sf_dir) -> DataFrame:
    """Each request once."""
    at = scratch(spark)
    T.once(events(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"]).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(f"{at}/out")


def run_to_end(stream: DataFrame, at: str, schema: str) -> DataFrame:
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{at}/out")


@query("""select user_id::varchar as key, count(*)::int as messages, 1 as partitions, true as in_order, count(distinct event_id)::int as events from (select event_id, user_id from events union all select event_id, user_id from events where event_id % 10 = 1) group by user_id""")
def topic_round_trip(spark, sf_dir) -> DataFrame:
    """The events' stream into a topic, and from there, in bounded micro-batches, restarted in between, into a table: nothing lost, repeated or out of order."""
    topic.register(spark)
    at = scratch(spark)
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct("event_id")).alias("value"))
    for _ in range(2):  # the second run finds nothing new
        e.writeStream.format("topic").option("path", f"{at}/topic").option("partitions", 3).option("query", "events").option("checkpointLocation", f"{at}/written").trigger(availableNow=True).start().awaitTermination()
    messages = spark.readStream.format("topic").option("path", f"{at}/topic").option("maxOffsetsPerTrigger", 20_000).load()
    for _ in range(2):
        out = run_to_end(messages, at, topic.SCHEMA)
    seen = out.withColumn("event_id", F.get_json_object("value", "$.event_id").cast("long"))
    # a key's messages of one file come in the file's order
    return seen.groupBy("key").agg(F.count("*").cast("int").alias("messages"), F.countDistinct("topic_partition").cast("int").alias("partitions"), (F.countDistinct("offset") == F.count("*")).alias("in_order"), F.countDistinct("event_id").cast("int").alias("events"))


@query("""with t as (select user_id % 200 as c, event_id % 40 as t, min(event_id) as first, count(*) as n, count(*) filter (event_id % 3 = f) as same from
 (select *, first_value(event_id % 3) over (partition by user_id % 200, event_id % 40 order by event_id) as f from events) group by all)
select c::varchar as conversation_id, 't' || t as turn_id, row_number() over (partition by c order by first) as turn_no, n::int as times, (n - same)::int as conflicts from t""")
def stream_appended_turns(spark, sf_dir) -> DataFrame:
    """Turns that come again, as they were or otherwise: numbered once, with state that ends."""
    turns.use_rocksdb(spark)
    at, e = scratch(spark), F.col("event_id")
    rows = roles.table(spark, sf_dir, "events")
    n = rows.agg(F.max("event_id")).first()[0] // 3 + 1
    for k in range(3):  # in order of their ids, the stream started anew each time
        rows.where(F.floor(e / n) == k).write.mode("append").parquet(f"{at}/events")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/events")
        said = stream.select((F.col("user_id") % 200).cast("string").alias("conversation_id"), F.concat(F.lit("t"), (e % 40).cast("string")).alias("turn_id"), e.alias("seq"), (e % 3).cast("string").alias("digest"))
        writer = turns.appended(said, 86_400_000).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
        writer.outputMode("append").trigger(once=True).start().awaitTermination()
    out = spark.read.schema(turns.APPENDED).parquet(f"{at}/out")
    return out.groupBy("conversation_id", "turn_id", "turn_no").agg(F.count("*").cast("int").alias("times"), F.count_if(F.col("outcome") == "conflict").cast("int").alias("conflicts"))
