"""Retries that fall due by a timer: each failure of a job is answered when its delay has passed in event time.

The state of a job is its number of failures and the retries that wait; a timer for each wakes the job when the watermark has passed
it. A failure beyond the last attempt goes to the dead-letter queue at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ledgerlens.operators.ops import MAX_ATTEMPTS

#: Seconds of the first delay, which doubles with every further failure.
FIRST_DELAY = 30
#: transformWithState keeps its state in this store only.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = StructType([StructField("job_id", LongType()), StructField("attempt", IntegerType()), StructField("status", StringType()), StructField("due_ms", LongType())])


class RetryTimers(StatefulProcessor):
    def __init__(self, max_attempts: int = MAX_ATTEMPTS):
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n int")
        self.waiting = handle.getMapState("waiting", "due long", "attempts string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.failures.get()[0] if self.failures.exists() else 0
        dead = []
        for at in sorted(ms for pdf in rows for ms in pdf["at_ms"]):
            n += 1
            if n >= self.max_attempts:
                dead.append((key[0], n, "DLQ", at))
                continue
            due = int(at) + 1000 * FIRST_DELAY * 2 ** (n - 1)
            before = self.waiting.getValue((due,))[0] + "," if self.waiting.containsKey((due,)) else ""
            self.waiting.updateValue((due,), (f"{before}{n}",))
            self.handle.registerTimer(due)
        self.failures.update((n,))
        yield pd.DataFrame(dead, columns=OUTPUT.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.containsKey((due,)):
            attempts = self.waiting.getValue((due,))[0]
            self.waiting.removeKey((due,))
            yield pd.DataFrame([(key[0], int(n), "RETRY", due) for n in attempts.split(",")], columns=OUTPUT.fieldNames())

    def close(self) -> None:
        pass


def only(timed: DataFrame, wanted: Column, event_time: str) -> DataFrame:
    """The wanted rows of a stream with a watermark. The condition reads the event time and so isn't pushed below the watermark: rows that
    it removes move time on as well."""
    return timed.filter(F.when(F.col(event_time).isNotNull(), wanted))


def due_retries(failures: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """job_id, attempt, status, due_ms from failures (job_id, at_ms) of a stream with a watermark: RETRY rows once they fall due, DLQ rows at once.

    Failures of one micro-batch count in order of time. The session must use STATE_STORE."""
    return failures.groupBy("job_id").transformWithStateInPandas(RetryTimers(max_attempts), OUTPUT, "Append", "EventTime")
