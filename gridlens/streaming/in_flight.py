"""Attempts that were marked in flight and never ended, found as the log streams in."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the status of an attempt whose end nobody has seen.
UNCERTAIN = "uncertain_interrupted"
LOG = "prompt_id long, attempt long, event string, at timestamp"
OUT = "prompt_id long, attempt long, started timestamp, status string, reason string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InFlight(StatefulProcessor):
    """Of each prompt the attempt in flight. It is dropped when it ends or someone acknowledges it, and reported and dropped when
    another one starts or the timeout has passed."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "attempt long, started timestamp, due long")

    def close(self) -> None:
        pass

    def _forget(self) -> None:
        due = self.open.get()[2]
        if due in set(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.open.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r.at, r.attempt, r.event != "start")):
            held = self.open.get() if self.open.exists() else None
            if row.event == "start":
                if held and held[0] == row.attempt:
                    continue  # the same mark again
                if held:
                    self._forget()
                    yield Row(prompt_id=key[0], attempt=held[0], started=held[1], status=UNCERTAIN, reason="another attempt started")
                due = int(row.at.timestamp() * 1000) + self.timeout_ms
                self.open.update((row.attempt, row.at, due))
                self.handle.registerTimer(due)
            elif held and held[0] == row.attempt:
                self._forget()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.open.exists():
            held = self.open.get()
            if held[2] <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield Row(prompt_id=key[0], attempt=held[0], started=held[1], status=UNCERTAIN, reason="timeout")


def use_rocksdb(spark: SparkSession) -> None:
    """State of any size on disk, with change logs in the checkpoint; what the processor needs."""
    spark.conf.set(_STORE, _ROCKS)


def uncertain(log: DataFrame, timeout: timedelta = timedelta(hours=1), late: str = "10 minutes") -> DataFrame:
    """(prompt_id, attempt, started, status, reason) of attempts in a streamed log(prompt_id, attempt, event, at) that were not
    ended ("end") or acknowledged ("acknowledge") in time.

    Times are those of the log: an attempt is overdue once the watermark, late behind the latest row, is timeout past its start. Rows
    of one batch are taken in order of time; rows behind the watermark are dropped by Spark's rule, and rows without a
    prompt, attempt or time are left out. State holds one attempt a prompt, and nothing of prompts at rest.
    """
    use_rocksdb(log.sparkSession)
    known = log.where("prompt_id IS NOT NULL AND attempt IS NOT NULL AND at IS NOT NULL AND event IN ('start', 'end', 'acknowledge')")
    return known.withWatermark("at", late).groupBy("prompt_id").transformWithState(statefulProcessor=InFlight(timeout // timedelta(milliseconds=1)), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
