"""Task streams: at-least-once consumption with retries, upload sessions, leases."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import COMPLETE, DELETING, MERGING, UPLOADING

TASK = "document_id bigint, user_id bigint, file_md5 string, version string"
ATTEMPTS = 3
MERGE_LEASE_MS = 300_000


def parsed_tasks(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages with ``task`` and ``poison``: JSON that doesn't hold a task's identity is marked, not failed."""
    task = F.from_json(F.col(column).cast("string"), TASK, {"mode": "PERMISSIVE"})
    return messages.withColumn("task", task).withColumn("poison", F.coalesce(F.col("task.document_id") <= 0, F.lit(True)) | F.coalesce(F.col("task.version") == "", F.lit(True)))


def keyed(tasks: DataFrame) -> DataFrame:
    """Tasks as messages: the key keeps a document's tasks in one partition."""
    return tasks.select(F.concat_ws(":", F.col("user_id").cast("string"), F.col("document_id").cast("string"), "file_md5").alias("key"), F.to_json(F.struct("document_id", "user_id", "file_md5", "version")).alias("value"))


def consume(messages: DataFrame, work: Callable[[DataFrame], DataFrame], done: str, failed: str, checkpoint: str, delay: float = 0.0, attempts: int = ATTEMPTS):
    """Start a query that works on each batch's tasks; gives the running query.

    Poison messages are left out, and a task (document_id, version) counts once: the stream remembers what it has seen,
    and what other consumers have done is read from ``done``. ``work`` gives rows with document_id and version; rows with
    a text in ``error``, if it has that column, are tasks that failed for good. Work that raises is tried again, later
    each time; tasks it can't do together are then parted until those that fail are alone, and only these are failed.
    A batch writes folders of its own, whole, so that a batch that is delivered again leaves what was there.
    """
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        tasks = rows
        known = existing(spark, done)
        if known is not None:
            others = known.where(F.col("consumer") != name).select("document_id", "version")
            tasks = tasks.join(others, ["document_id", "version"], "left_anti")
        tasks, held = tasks.persist(), []
        try:
            good, bad = settled(tasks, work, delay, attempts, held)
            for part, path in ((good, done), (bad, failed)):
                at = f"{path}/consumer={name}/batch={number}"
                for k, frame in enumerate(part):
                    frame.write.mode("append" if k else "overwrite").parquet(at)
        finally:
            for frame in (tasks, *held):
                frame.unpersist()

    tasks = parsed_tasks(messages).where("not poison").select("task.*").dropDuplicates(["document_id", "version"])
    return tasks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(tasks: DataFrame, work: Callable[[DataFrame], DataFrame], delay: float, attempts: int, held: list[DataFrame], depth: int = 0) -> tuple[list[DataFrame], list[DataFrame]]:
    """Results and failures of tasks; those that fail together are halved by hash, once tried as often as allowed.

    A task that is alone is tried as often again. ``held`` gets what is kept until the results are written.
    """
    error, n = "", tasks.count() if depth else 0
    for attempt in range(1, (attempts if depth == 0 or n == 1 else 1) + 1):
        try:
            out = work(tasks).persist()
            held.append(out)
            out.count()
            if "error" not in out.columns:
                return [out], []
            return [out.where("error is null").drop("error")], [out.where("error is not null").select("document_id", "version", F.substring("error", 1, 1000).alias("error"))]
        except Exception as e:  # noqa: BLE001  any failure of the work counts as one of its tasks
            error = str(e)[:1000]
            time.sleep(delay * attempt)
    n = n or tasks.count()
    if n <= 1 or depth > 60:
        return [], [tasks.select("document_id", "version", F.lit(error).alias("error"))]
    half = F.pmod(F.xxhash64("document_id", "version", F.lit(depth)), F.lit(2))
    low, high = (settled(tasks.where(half == k), work, delay, attempts, held, depth + 1) for k in (0, 1))
    return low[0] + high[0], low[1] + high[1]


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that may not have been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if there else None


SESSION_STATE = "parts array<int>, total int, done boolean"
SESSION = "document_id bigint, uploaded int, total int, event string"


def upload_sessions(parts: DataFrame) -> DataFrame:
    """Progress of uploads as a stream: (document_id, uploaded, total, event); event is part, repeated or complete.

    parts: document_id, chunk_index, total. Parts come in any order; a session is complete once.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, total, done = state.get if state.exists else ([], 0, False)
        seen = set(held)
        out = []
        for batch in batches:
            for index, n in zip(batch["chunk_index"].tolist(), batch["total"].tolist(), strict=True):
                total = int(n)
                event = "repeated" if index in seen or not 0 <= index < total else "part"
                if event == "part":
                    seen.add(int(index))
                if len(seen) == total and not done:
                    event, done = "complete", True
                out.append((key[0], len(seen), total, event))
        state.update((sorted(seen), total, done))
        yield pd.DataFrame(out, columns=["document_id", "uploaded", "total", "event"])

    return parts.groupBy("document_id").applyInPandasWithState(step, SESSION, SESSION_STATE, "append", GroupStateTimeout.NoTimeout)


UPLOAD_STATE = "parts array<int>, total int, status int, until bigint"
UPLOAD = "document_id bigint, seq bigint, outcome string, uploaded int"


def uploads(events: DataFrame) -> DataFrame:
    """Whole upload sessions as a stream: (document_id, seq, outcome, uploaded) of each event.

    events: document_id, seq, kind, chunk_index, total, at (milliseconds). Kinds: ``part`` (a part that is there is
    replaced: it counts again only once its bytes are), ``merge`` (wants all parts and the lease, which another merge takes
    over once it has run out), ``verified`` and ``corrupt`` (what the merge found: the file is complete, or all parts
    have to come again), ``delete``. Events of a batch are taken in order of seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, total, status, until = state.get if state.exists else ([], 0, UPLOADING, 0)
        parts, out = set(held), []
        for e in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            outcome = "rejected"
            if e.kind == "part" and status == COMPLETE or e.kind == "merge" and status == COMPLETE:
                outcome = "complete"
            elif e.kind == "part" and status == UPLOADING:
                total = int(e.total)
                if 0 <= e.chunk_index < total:
                    outcome = "replaced" if e.chunk_index in parts else "part"
                    parts.add(int(e.chunk_index))
            elif e.kind == "merge" and (status == UPLOADING or status == MERGING and e.at >= until):
                ready = total > 0 and len(parts) == total
                outcome = "merging" if ready else "incomplete"
                if ready:
                    status, until = MERGING, int(e.at) + MERGE_LEASE_MS
            elif e.kind == "merge" and status == MERGING:
                outcome = "busy"
            elif e.kind == "verified" and status == MERGING:
                status, outcome = COMPLETE, "complete"
            elif e.kind == "corrupt" and status == MERGING:
                parts, status, outcome = set(), UPLOADING, "reset"
            elif e.kind == "delete":
                status, outcome = DELETING, "deleting"
            out.append((key[0], int(e.seq), outcome, len(parts)))
        state.update((sorted(parts), total, status, until))
        yield pd.DataFrame(out, columns=["document_id", "seq", "outcome", "uploaded"])

    return events.groupBy("document_id").applyInPandasWithState(step, UPLOAD, UPLOAD_STATE, "append", GroupStateTimeout.NoTimeout)


LEASE_STATE = "attempts int, leased boolean, due bigint"
LEASE = "document_id bigint, action string, attempts int"


def backoff_ms(attempts: int) -> int:
    """As long as a failed delivery waits before it is handed out again."""
    return 1000 * min(2 ** min(max(attempts, 1), 6), 60)


def leases(events: DataFrame, lease_ms: int = 30_000) -> DataFrame:
    """The outbox as a stream: (document_id, action, attempts); action is claim, ack, retry or expired.

    events: document_id, kind (enqueue, ack, fail). Enqueueing a document that is queued changes nothing. A
    lease that isn't answered in time is handed out again at once, a failed delivery after its backoff. Answers
    for a document that holds no lease change nothing. The timers run on the clock, so the stream goes on
    until it is stopped; with a trigger of availableNow it would not end either.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None  # attempts, whether leased, when its timer is due
        now, out = state.getCurrentProcessingTimeMs(), []
        if state.hasTimedOut:
            attempts, leased, _ = held
            if leased:
                attempts += 1
                out.append((key[0], "expired", attempts))
            out.append((key[0], "claim", attempts))
            held = (attempts, True, now + lease_ms)
        for batch in batches:
            for kind in batch["kind"].tolist():
                if kind == "enqueue" and held is None:
                    held = (0, True, now + lease_ms)
                    out.append((key[0], "claim", 0))
                elif kind == "ack" and held is not None and held[1]:
                    out.append((key[0], "ack", held[0]))
                    held = None
                elif kind == "fail" and held is not None and held[1]:
                    held = (held[0] + 1, False, now + backoff_ms(held[0] + 1))
                    out.append((key[0], "retry", held[0]))
        if held is not None:
            state.update(held)
            state.setTimeoutDuration(max(held[2] - now, 1))  # each call clears the timer
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["document_id", "action", "attempts"])

    return events.groupBy("document_id").applyInPandasWithState(step, LEASE, LEASE_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def once(requests: DataFrame, keys: list[str], at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream without repeated requests; with an event time only as long as the delay is remembered."""
    return requests.dropDuplicates(keys) if at is None else requests.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
