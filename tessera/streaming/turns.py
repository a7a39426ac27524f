"""State that ends: turns appended once, with conflicts found, and requests remembered for a time.

Both keep one state for each key in several variables with a time to live, so that a key that falls silent
leaves nothing behind. They need the RocksDB state store (``use_rocksdb``), and, as time alone gives them work, a trigger
of their own: ``availableNow`` never ends, ``once`` takes what is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

APPENDED = "conversation_id string, turn_id string, turn_no long, outcome string"
HEARD = "key string, seq long, outcome string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Appender(StatefulProcessor):
    """Turns (turn_id, seq, question, answer) of a conversation: numbered as they come, each turn_id once.

    A turn that comes again as it was is ``repeated``, one that comes again otherwise is a ``conflict``; both get the
    number there is. What was said is remembered as a digest, for ``ttl_ms`` after it was said.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "turn_no long")
        self.said = handle.getMapState("said", "turn_id string", "turn_no long, digest string", ttlDurationMs=self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = last = int(self.last.get()[0]) if self.last.exists() else 0
        said = pd.concat(list(rows)).sort_values(["seq", "digest"], ignore_index=True)
        # state is asked and told once for each turn_id of the batch, however often it came
        first, known = said.drop_duplicates("turn_id"), {}
        for turn, digest in zip(first["turn_id"].tolist(), first["digest"].tolist(), strict=True):
            if self.said.containsKey((turn,)):
                known[turn] = self.said.getValue((turn,))
            else:
                last += 1
                known[turn] = (last, digest)
                self.said.updateValue((turn,), known[turn])
        told = [known[t] for t in said["turn_id"].tolist()]
        number = np.array([int(k[0]) for k in told], np.int64)
        same = [k[1] == d for k, d in zip(told, said["digest"].tolist(), strict=True)]
        outcome = np.where((number > before) & ~said.duplicated("turn_id").to_numpy(), "appended", np.where(same, "repeated", "conflict"))
        self.last.update((last,))
        yield pd.DataFrame({"conversation_id": key[0], "turn_id": said["turn_id"], "turn_no": number, "outcome": outcome})

    def close(self) -> None:
        pass


def appended(turns: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """A stream of turns (conversation_id, turn_id, seq, digest) as (conversation_id, turn_id, turn_no, outcome)."""
    return turns.groupBy("conversation_id").transformWithStateInPandas(Appender(ttl_ms), APPENDED, "Append", "ProcessingTime" if ttl_ms else "None")


class Listener(StatefulProcessor):
    """Requests (seq) of a key: the first is ``new``, others are ``repeated`` until ``quiet_ms`` have passed without one."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        seqs = sorted(x for batch in rows for x in batch["seq"].tolist())
        # a batch sees its rows before the timers that have run out
        until = int(self.until.get()[0]) if self.until.exists() else None
        known = until is not None and until > now
        if until is not None:
            self.handle.deleteTimer(until)
        self.handle.registerTimer(now + self.quiet_ms)
        self.until.update((now + self.quiet_ms,))
        yield pd.DataFrame([(key[0], s, "repeated" if known or k else "new") for k, s in enumerate(seqs)], columns=["key", "seq", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and int(self.until.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "seq": pd.Series([], dtype="int64"), "outcome": pd.Series([], dtype=str)})

    def close(self) -> None:
        pass


def heard(requests: DataFrame, quiet_ms: int) -> DataFrame:
    """A stream of requests (key, seq) as (key, seq, outcome); a key is forgotten once it has been quiet for so long."""
    return requests.groupBy("key").transformWithStateInPandas(Listener(quiet_ms), HEARD, "Append", "ProcessingTime")
