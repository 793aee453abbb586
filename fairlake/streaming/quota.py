"""Sliding quota per client as a stateful stream: requests wait for the watermark and are decided in order of time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of the clients; a checkpoint holds for one number of them.
PARTS = 512
OUTPUT = "client_id string, event_id long, micros long, allowed boolean"


class QuotaProcessor(StatefulProcessor):
    """Per part of the clients: requests that the watermark has not passed, and each client's admitted times of the last window, ``limit`` at most.

    A timer goes off when the watermark passes the oldest waiting request; then all that it has passed are decided,
    oldest first. When nothing waits, a timer at the end of the last window clears the state. Each call into the state costs far more than a
    request, so a part holds many clients, and its requests of a batch are one row
    of the state.
    """

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.width = limit, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "client_id array<string>, micros array<long>, event_id array<long>")  # a row per batch
        self.admitted = handle.getListState("admitted", "client_id array<string>, micros array<long>")

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            if len(batch):
                self.waiting.appendValue(tuple(batch[c].tolist() for c in ("client_id", "micros", "event_id")))
                self._wake(int(batch["micros"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((t, e, client) for chunk in self.waiting.get() for client, t, e in zip(*chunk)) if self.waiting.exists() else []
        live: dict[str, list[int]] = {}
        for chunk in self.admitted.get() if self.admitted.exists() else []:
            for client, t in zip(*chunk):
                live.setdefault(client, []).append(t)
        out = []
        for t, event, client in waiting:
            if t > passed:
                break
            times = [x for x in live.get(client, ()) if t - x < self.width]
            allowed = len(times) < self.limit
            if allowed:
                times.append(t)
            live[client] = times
            out.append((client, event, t, allowed))
        rest = waiting[len(out):]
        kept = [(client, x) for client, times in live.items() for x in times if passed - x < self.width]
        for state, rows in ((self.waiting, [(client, t, event) for t, event, client in rest]), (self.admitted, kept)):
            if rows:
                state.put([tuple(list(column) for column in zip(*rows))])
            else:
                state.clear()
        if rest:
            self._wake(rest[0][0])
        elif kept:
            self._wake(max(x for _, x in kept) + self.width)
        if out:
            yield pd.DataFrame(out, columns=["client_id", "event_id", "micros", "allowed"])

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """Timers and lists need the RocksDB store; a query keeps the setting that holds when it starts."""
    former = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if former is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, former)


def decide_requests(requests: DataFrame, limit: int, window_seconds: int, late_after: str, client: str = "client_id", ts: str = "ts",
                    tie: str = "event_id") -> DataFrame:
    """``client_id, event_id, micros, allowed`` for each request of a stream: at most ``limit`` admitted per client in any window.

    A request is decided when the watermark, the newest time of all clients less ``late_after``, has passed it; until then it
    waits, so requests may come in any order within that delay and the decisions are those of ``oplog.quota_audit`` over all
    requests, however the stream is cut. Later ones are dropped and counted by the query (``catalog.late_rows``). A
    client's state is its requests of the delay and ``limit`` times, and ends a window after the last admitted request of its part; clients
    lie in ``PARTS`` parts by a hash, and one task decides a part's requests of one delay.
    """
    rows = requests.where(F.col(client).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(client).cast("string").alias("client_id"), F.col(ts).cast("timestamp").alias("ts"), F.col(tie).alias("event_id"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("micros")).withWatermark("ts", late_after)
    return rows.withColumn("part", F.pmod(F.xxhash64("client_id"), F.lit(PARTS))).groupBy("part").transformWithStateInPandas(
        QuotaProcessor(limit, window_seconds), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def stream_decisions(requests: DataFrame, table: str, checkpoint: str, limit: int, window_seconds: int, late_after: str) -> StreamingQuery:
    """Appends the decisions about everything present to a Parquet table, exactly once per request."""
    with _state_store(requests.sparkSession):
        return decide_requests(requests, limit, window_seconds, late_after).writeStream.format("parquet").option("path", table).option(
            "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
