"""The stateful quota against the batch audit, for any cut and order within the delay."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairlake.operators.oplog import quota_audit
from fairlake.streaming import catalog, quota

SCHEMA = "client_id STRING, ts TIMESTAMP, event_id LONG"


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_batch_and_state_ends(spark, tmp_path, parts):
    rng, start = random.Random(parts), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(rng.choice("aab") if i < 250 else "c", start + timedelta(seconds=20 * i), i) for i in range(300)]
    size = -(-len(rows) // parts)
    shuffled = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.randrange(400))))  # out of order by less than the delay
    for k in range(0, len(rows), size):
        spark.createDataFrame(shuffled[k:k + size], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = quota.stream_decisions(stream, str(tmp_path / "out"), str(tmp_path / "mark"), 3, 300, "10 minutes")
    query.awaitTermination()
    closed = rows[-1][1] - timedelta(minutes=10)
    batch = quota_audit(spark.createDataFrame(rows, SCHEMA), 3, 300)
    want = {r.event_id: r.allowed for r in batch.where(F.col("ts") <= F.lit(closed)).collect()}
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.event_id: r.allowed for r in got} == want and len(got) == len(want) and 0 < sum(want.values()) < len(want)
    assert catalog.late_rows(query) == 0
    spark.createDataFrame([("a", start, 900), ("z", start + timedelta(hours=9), 901)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = quota.stream_decisions(stream, str(tmp_path / "out"), str(tmp_path / "mark"), 3, 300, "10 minutes")
    query.awaitTermination()
    assert catalog.late_rows(query) == 1 and spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_state_calls_follow_parts_not_clients():
    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def __getattr__(self, name):
            calls.append(name)
            return {"exists": lambda: bool(self.rows), "get": lambda: iter(self.rows), "appendValue": self.rows.append, "appendList": self.rows.extend,
                    "put": lambda rows: self.__dict__.update(rows=list(rows)), "clear": lambda: self.__dict__.update(rows=[])}[name]

    class Handle:
        def getListState(self, name, schema):
            return State()

        def registerTimer(self, millis):
            calls.append("timer")

    class Times:
        def getCurrentWatermarkInMs(self):
            return 3000

    rows = pd.DataFrame([(f"c{i % 500}", 1_000_000 * (i // 500), i) for i in range(2500)], columns=["client_id", "micros", "event_id"])
    processor = quota.QuotaProcessor(2, 60)
    processor.init(Handle())
    list(processor.handleInputRows((1,), iter([rows]), Times()))
    decided = pd.concat(list(processor.handleExpiredTimer((1,), Times(), None)))
    assert len(decided) == 2000 and decided["allowed"].sum() == 1000 and set(decided["client_id"]) == {f"c{i}" for i in range(500)}
    assert len(calls) < 20  # for 500 clients
