"""Topics by offsets, and state that ends."""

import json
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.streaming import tasks, topic, turns


@pytest.fixture(scope="module")
def messages(spark):
    topic.register(spark)
    return spark.createDataFrame([(f"k{i % 7}" if i % 11 else None, f"m{i:04}") for i in range(500)], "key string, value string").coalesce(1)


def read(spark, at):
    return spark.read.format("topic").option("path", at).load()


def test_messages_keep_their_order_by_key_and_offsets_have_no_holes(spark, messages, tmp_path):
    at = str(tmp_path / "t")
    for k in range(2):
        messages.where(F.col("value") < "m0250" if k == 0 else F.col("value") >= "m0250").write.format("topic").option("path", at).option("partitions", 3).mode("append").save()
    rows = read(spark, at).collect()
    assert sorted(r["value"] for r in rows) == [f"m{i:04}" for i in range(500)]
    by = {}
    for r in rows:
        by.setdefault(r["topic_partition"], []).append(r)
    for held in by.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == list(range(len(held)))
        for key in {r["key"] for r in held}:
            own = [r["value"] for r in held if r["key"] == key]
            assert own == sorted(own)
    where = {r["key"]: set() for r in rows}
    for r in rows:
        where[r["key"]].add(r["topic_partition"])
    assert all(len(p) == 1 for p in where.values())
    with pytest.raises(Exception, match="only appended"):
        messages.write.format("topic").option("path", at).mode("overwrite").save()


def test_a_batch_that_is_committed_again_or_fails_adds_nothing(tmp_path):
    t = topic.Topic({"path": str(tmp_path / "t"), "partitions": "2"})
    batch = lambda n: iter([pa.record_batch({"key": [f"k{i}" for i in range(n)], "value": ["v"] * n})])
    t.commit([t.stage(batch(10)), None], "q-0")
    t.commit([t.stage(batch(10))], "q-0")  # delivered again after a restart
    t.drop([t.stage(batch(5))])  # a task of its batch failed
    assert sum(t.ends().values()) == 10 and t.names("staging") == []
    # the driver dies after the note, before anything is moved
    staged, ends = t.stage(batch(6)), t.ends()
    moves = []
    for p, name, n in staged.files:
        moves.append((name, f"p={p}/{ends[str(p)]:020}-{n}.parquet"))
    t.write_json("commits/q-1.json", moves)
    t.write_json("last.json", "q-1")
    again = topic.Topic({"path": str(tmp_path / "t")})
    assert sum(again.ends().values()) == 16 and again.partitions() == 2


def test_a_reader_that_fails_goes_on_where_it_was(spark, messages, tmp_path):
    at = str(tmp_path / "t")
    messages.write.format("topic").option("path", at).mode("append").save()
    stream = spark.readStream.format("topic").option("path", at).load()
    seen, runs = [], []

    def take(rows, number):
        runs.append(number)
        if len(runs) == 1:
            raise RuntimeError("no room")
        seen.extend(r["value"] for r in rows.collect())

    def run():
        stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)

    with pytest.raises(Exception, match="no room"):
        run()
    run()
    assert sorted(seen) == [f"m{i:04}" for i in range(500)]
    messages.where("value < 'm0005'").write.format("topic").option("path", at).mode("append").save()
    run()
    assert seen[500:] and sorted(seen[500:]) == [f"m{i:04}" for i in range(5)] and runs[0] == runs[1]


def test_micro_batches_are_bounded_over_all_partitions(tmp_path):
    options = {"path": str(tmp_path / "t"), "partitions": "3", "maxOffsetsPerTrigger": "40"}
    t = topic.Topic(options)
    t.commit([t.stage(iter([pa.record_batch({"key": [f"k{i}" for i in range(200)], "value": [str(i) for i in range(200)]})]))], "a")
    reader, at, seen = topic.TopicStreamReader(options), None, []
    at = reader.initialOffset()
    while (to := reader.latestOffset()) != at:
        rows = [v for part in reader.partitions(at, to) for batch in reader.read(part) for v in batch.column(3).to_pylist()]
        assert 0 < len(rows) <= 42
        seen, at = seen + rows, to
    assert sorted(seen, key=int) == [str(i) for i in range(200)]


def run_to_end(stream, out, at):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(once=True).start().awaitTermination()


def test_turns_are_appended_once_and_conflicts_are_told(spark, tmp_path):
    turns.use_rocksdb(spark)
    schema = "conversation_id string, turn_id string, seq long, digest string"
    for k, rows in enumerate([[("c", "t1", 1, "a"), ("c", "t2", 2, "b"), ("d", "t1", 1, "a")], [("c", "t1", 3, "a"), ("c", "t2", 4, "x"), ("c", "t3", 5, "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run_to_end(turns.appended(stream, 3_600_000), str(tmp_path / "out"), str(tmp_path / "check"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == 3 * (k + 1)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("c", "t1", 1, "appended"), ("c", "t1", 1, "repeated"), ("c", "t2", 2, "appended"), ("c", "t2", 2, "conflict"), ("c", "t3", 3, "appended"), ("d", "t1", 1, "appended")]


def test_a_quiet_key_is_forgotten(spark, tmp_path):
    turns.use_rocksdb(spark)
    stream = lambda: turns.heard(spark.readStream.schema("key string, seq long").parquet(str(tmp_path / "in")), 2_000)
    for k, rows in enumerate([[("a", 1), ("a", 2)], [("a", 3)]]):
        spark.createDataFrame(rows, "key string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_to_end(stream(), str(tmp_path / "out"), str(tmp_path / "check"))
        time.sleep(4 * (k == 0))
    got = {r["seq"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == "new" and got[2] == "repeated" and set(got) == {1, 2, 3}


def test_a_consumer_keeps_no_table_and_tries_a_lone_task_again(spark, tmp_path):
    tries = []
    for k in range(3):
        rows = [(json.dumps({"document_id": d, "user_id": 1, "file_md5": "m", "version": "v"}),) for d in range(3 * k + 1, 3 * k + 4)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))

    def work(t):
        ids = sorted(r["document_id"] for r in t.collect())
        tries.append(ids)
        if 5 in ids and tries.count([5]) < 2:
            raise RuntimeError("busy")
        return t.select("document_id", "version")

    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    tasks.consume(stream, work, str(tmp_path / "done"), str(tmp_path / "failed"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["document_id"] for r in spark.read.parquet(str(tmp_path / "done")).collect()) == list(range(1, 10))
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_state_is_asked_once_for_each_turn_of_a_batch():
    class Held(dict):
        asked = 0

        def exists(self):
            return bool(self)

        def get(self):
            return self[0]

        def update(self, value):
            self[0] = value

        def containsKey(self, key):
            self.asked += 1
            return key in self

        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self[key] = value

    class Handle:
        getValueState = getMapState = lambda self, *a, **k: Held()

    a = turns.Appender(0)
    a.init(Handle())
    rows = pd.DataFrame({"turn_id": ["t2", "t1"] * 50, "seq": range(100), "digest": ["x", "y"] * 49 + ["z", None]})
    out = pd.concat(a.handleInputRows(("c",), iter([rows[50:], rows[:50]]), None))
    assert a.said.asked == 2 and out["turn_no"].tolist() == [1, 2] * 50
    assert out["outcome"].tolist() == ["appended"] * 2 + ["repeated"] * 96 + ["conflict"] * 2
    again = pd.concat(a.handleInputRows(("c",), iter([pd.DataFrame({"turn_id": ["t3", "t1", "t3"], "seq": [7, 8, 9], "digest": ["n", "y", "m"]})]), None))
    assert [tuple(r) for r in again.to_numpy()] == [("c", "t3", 3, "appended"), ("c", "t1", 2, "repeated"), ("c", "t3", 3, "conflict")]


def test_events_are_written_by_as_many_tasks_as_the_table_has_parts(spark, tmp_path, monkeypatch):
    from tessera.plans import stream_queries as Q

    spark.range(400).select(F.col("id").alias("event_id")).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    parts = spark.read.parquet(str(tmp_path / "events.parquet")).rdd.getNumPartitions()
    seen = []
    monkeypatch.setattr(Q, "scratch", lambda _: str(tmp_path / "made"))
    stream = Q.events(spark, str(tmp_path))
    stream.writeStream.foreachBatch(lambda rows, k: seen.append(rows.count())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [100] * 4 + [40] and parts > 1 and len(list((tmp_path / "made" / "events").glob("*.parquet"))) == 5 * parts
