"""Structured Streaming: request intake, inbox dedup, live progress, retries. The same operators as in batch, with bounded state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlens.operators.ops import MAX_ATTEMPTS, new_messages
from ledgerlens.operators.verify import job_progress
from ledgerlens.sources.requests import normalize_requests, parse_messages


def request_stream(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normalised requests, rejects) of a stream of JSON strings in column value."""
    good, bad = parse_messages(raw)
    return normalize_requests(good), bad


def inbox_dedup(messages: DataFrame, event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each (source_system, message_id) once within the delay, which bounds the state; the stored inbox covers older ones."""
    timed = messages.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    return timed.dropDuplicatesWithinWatermark(["source_system", "message_id"])


def against_inbox(read_inbox: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that passes on only messages that the stored inbox hasn't processed."""
    return lambda batch, epoch: write(new_messages(batch, read_inbox()), epoch)


def live_progress(events: DataFrame) -> DataFrame:
    """Job states from document events, for update mode."""
    return job_progress(events)


def retries(failures: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Failures (job_id, at) of a stream as retry or dead-letter rows; attempts are counted per job in state that expires a day after its last failure."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        attempts, last = state.get[0] if state.exists else 0, 0
        for pdf in batches:
            rows = []
            for at in sorted(pdf["at"]):
                attempts, last = attempts + 1, int(at.timestamp() * 1000)
                dead = attempts >= max_attempts
                rows.append((key[0], attempts, "DLQ" if dead else "RETRY", None if dead else 30 * 2 ** (attempts - 1), at))
            yield pd.DataFrame(rows, columns=["job_id", "attempt", "status", "delay_seconds", "at"])
        state.update((attempts,))
        state.setTimeoutTimestamp(max(last + 24 * 3600 * 1000, state.getCurrentWatermarkMs() + 1))

    timed = failures.withWatermark("at", "1 hour")
    return timed.groupBy("job_id").applyInPandasWithState(step, "job_id long, attempt int, status string, delay_seconds long, at timestamp", "attempts int", "append", GroupStateTimeout.EventTimeTimeout)
