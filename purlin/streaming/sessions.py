"""Conversations as keyed state of a stream: bounded memory, a time to live on the event clock, and the table of live ones.

State is a value per conversation in the state store (RocksDB, so it may outgrow memory); an event-time timer ends it when the
watermark passes its last access and time to live. Every change is a row: ``open`` with the state, or ``expired``. ``LiveTable``
keeps the last row of each conversation and applies the capacity, which no key can see alone, when it is read.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from purlin.operators.registry import evicted
from purlin.sources.store import Store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "conv_id bigint, event string, messages bigint, recent array<string>, summary string, last_access timestamp"
STATE = "messages bigint, turns array<bigint>, recent array<string>, summary string, last_us bigint"


class Memory:
    """The last messages of a conversation, and the tail of a summary of those before.

    Rows come in any order of turns; only what can still reach the summary's last characters is held.
    """

    def __init__(self, recent: int, chars: int, n: int = 0, held: list[tuple[int, str]] | None = None, summary: str = ""):
        self.recent, self.chars, self.n, self.held, self.summary = recent, chars, n, list(held or []), summary
        self.size = sum(len(m) + 1 for _, m in self.held)

    def add(self, turn: int, message: str) -> None:
        insort(self.held, (turn, message), key=lambda m: m[0])
        self.n += 1
        self.size += len(message) + 1
        newest = sum(len(m) + 1 for _, m in self.held[-self.recent :])
        while len(self.held) > self.recent and self.size - newest - len(self.held[0][1]) - 1 > self.chars:
            self._drop()

    def _drop(self) -> None:
        _, message = self.held.pop(0)
        self.size -= len(message) + 1
        self.summary = (self.summary + "\n" + message).lstrip("\n")[-self.chars :]

    def settle(self) -> None:
        while len(self.held) > self.recent:
            self._drop()


class Conversations(StatefulProcessor):
    def __init__(self, recent: int, chars: int, ttl_seconds: int):
        self.recent, self.chars, self.ttl_ms = recent, chars, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("memory", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, turns, recent, summary, last = self.state.get() if self.state.exists() else (0, [], [], "", 0)
        memory = Memory(self.recent, self.chars, n, list(zip(turns, recent, strict=True)), summary)
        for batch in rows:
            stamps = batch["ts"].dt.as_unit("us").astype("int64").tolist()
            for turn, role, text, us in zip(batch["turn"].tolist(), batch["role"], batch["text"], stamps, strict=True):
                memory.add(turn, f"{role}: {text}")
                last = max(last, us)
        memory.settle()
        held = [m for _, m in memory.held]
        self.state.update((memory.n, [t for t, _ in memory.held], held, memory.summary, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.ttl_ms + 1)
        yield self._row(key, "open", memory.n, held, memory.summary, last)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, _, recent, summary, last = self.state.get()
        self.state.clear()
        yield self._row(key, "expired", n, list(recent), summary, last)

    @staticmethod
    def _row(key: Any, event: str, n: int, recent: list[str], summary: str, last: int) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [key[0]], "event": [event], "messages": [n], "recent": [recent], "summary": [summary], "last_access": [pd.Timestamp(last, unit="us")]})

    def close(self) -> None:
        pass


def conversation_events(turns: DataFrame, recent: int = 4, summary_chars: int = 400, ttl_seconds: int = 21_600, delay: str = "0 seconds") -> DataFrame:
    """Rows of ``EVENT`` from a stream of turns: conv_id, turn, role, text, ts. Null turns come first."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = turns.select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), "role", "text", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return timed.groupBy("conv_id").transformWithStateInPandas(Conversations(recent, summary_chars, ttl_seconds), EVENT, "Update", "EventTime")


class LiveTable:
    """The last event of every conversation, from committed batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``; a batch committed before changes nothing."""
        if any(c.get("batch") == batch_id for c in self.store.commits()):
            return
        self.store.stage("events", f"{batch_id:012d}", batch)
        self.store.publish(f"{batch_id:012d}", batch=batch_id)

    def current(self) -> DataFrame:
        rows = self.store.read("events", EVENT)
        # within a batch a conversation that expired may have been opened again
        order = F.struct("__commit", "last_access", F.col("event") == "expired")
        return rows.groupBy("conv_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("conv_id", "__commit")]), order).alias("e")).select("conv_id", "e.*").where("event = 'open'")

    def live(self, now: Column, ttl_seconds: int = 21_600, most: int = 1000) -> DataFrame:
        """Conversations within the time to live, of those the latest ``most``."""
        return evicted(self.current(), now, ttl_seconds, most)
