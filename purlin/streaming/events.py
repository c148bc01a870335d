"""Event-time windows that run on batch and streaming frames, and conversation memory with an idle timeout."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purlin.streaming.sessions import Memory


def with_event_time(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``ts`` as a timestamp with a watermark; parquet's zoneless timestamps can't carry one."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay) if events.isStreaming else timed


def tumbling_counts(events: DataFrame, width: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, events, total) per window."""
    grouped = with_event_time(events, delay).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, events): runs of a user's events with less than ``gap`` between."""
    grouped = with_event_time(events, delay).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


MEMORY = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("messages", T.LongType()), T.StructField("recent", T.ArrayType(T.StringType())), T.StructField("summary", T.StringType())])


def conversation_memory(turns: DataFrame, recent: int = 4, summary_chars: int = 400, ttl_ms: int = 3_600_000) -> DataFrame:
    """Keyed state per conversation: the last messages, and the tail of a summary of those before; dropped when idle.

    ``sessions.conversation_events`` does the same on the event clock.
    """
    state = T._parse_datatype_string("n bigint, turns array<bigint>, recent array<string>, summary string")

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        n, turns, last, summary = held.get if held.exists else (0, [], [], "")
        memory = Memory(recent, summary_chars, n, list(zip(turns, last, strict=True)), summary)
        for batch in batches:
            for turn, role, text in batch[["turn", "role", "text"]].itertuples(index=False):
                memory.add(int(turn), f"{role}: {text}")
        memory.settle()
        last = [m for _, m in memory.held]
        held.update((memory.n, [t for t, _ in memory.held], last, memory.summary))
        held.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "messages": [memory.n], "recent": [last], "summary": [memory.summary]})

    return turns.groupBy("conv_id").applyInPandasWithState(update, MEMORY, state, "update", "ProcessingTimeTimeout")
