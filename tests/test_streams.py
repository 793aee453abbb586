"""Tables in buckets, the catalog that follows changes, windowed measures, alerts and repeats with a watermark."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fairlake.sources import bucketed
from fairlake.streaming import catalog, ingest

CHANGES = "record_key STRING, version INT, deleted BOOLEAN, body STRING"


def write_parts(spark, rows, schema, path, parts):
    """Files that arrive one after the other."""
    size = -(-len(rows) // parts)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k:k + size], schema).coalesce(1).write.mode("append").parquet(path)


def newest(rows):
    best = {}
    for key, version, deleted, body in rows:
        if key is not None and (key not in best or best[key][0] < version):
            best[key] = (version, deleted, body)
    return {k: (v, b) for k, (v, deleted, b) in best.items() if not deleted}


@pytest.mark.parametrize("parts", [1, 4])
def test_catalog_does_not_depend_on_batches_or_order(spark, tmp_path, parts):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(40)}", v, rng.random() < 0.25, f"b{v}") for v in range(200)] + [(None, 500, False, "no key")]
    rng.shuffle(rows)
    source, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    write_parts(spark, rows, CHANGES, source, parts)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
    catalog.sync_catalog(stream, table, mark, buckets=8, keep=2).awaitTermination()
    got = {r.record_key: (r.version, r.body) for r in catalog.read_catalog(spark, table).collect()}
    assert got == newest(rows)
    assert len(bucketed.pointers(spark, table)) == min(parts, 2)


def test_late_change_does_not_bring_a_deleted_record_back(spark, tmp_path):
    handle = catalog.catalog_writer(str(tmp_path / "t"), buckets=4)
    for n, row in enumerate([("a", 1, False, "x"), ("a", 3, True, None), ("a", 2, False, "old"), ("b", 1, False, "y")]):
        handle(spark.createDataFrame([row], CHANGES), n)
    assert [r.record_key for r in catalog.read_catalog(spark, str(tmp_path / "t")).collect()] == ["b"]
    assert [r.version for r in catalog.read_catalog(spark, str(tmp_path / "t"), 1).collect()] == [1]  # before the deletion


def test_a_batch_writes_only_its_buckets_and_can_be_repeated(spark, tmp_path):
    path, merge = str(tmp_path / "t"), bucketed.latest_rows(("k",), ("v",))
    first = spark.createDataFrame([(i, 0, "a" * 50) for i in range(2000)], "k INT, v INT, s STRING")
    assert len(bucketed.rewrite(first, path, 1, ("k",), merge, 16)) == 16
    one = spark.createDataFrame([(7, 1, "new")], "k INT, v INT, s STRING")
    for _ in range(2):  # a batch that is repeated after a failure
        assert len(bucketed.rewrite(one, path, 2, ("k",), merge, 16)) == 1
        assert bucketed.read_table(spark, path).count() == 2000
        assert bucketed.read_table(spark, path).where("k = 7").first()["s"] == "new"
    written = [sum(f.stat().st_size for f in Path(path, "data", f"version={v}").rglob("*.parquet")) for v in (1, 2)]
    assert written[1] < written[0] / 5
    assert bucketed.read_table(spark, path, 1).where("k = 7").first()["v"] == 0
    bucketed.rewrite(one.withColumn("v", F.lit(2)), path, 3, ("k",), merge, 16)
    assert bucketed.prune(spark, path, 1) == 2  # the bucket's first two versions
    assert bucketed.read_table(spark, path).count() == 2000 and len(bucketed.pointers(spark, path)) == 1
    with pytest.raises(ValueError):
        bucketed.read_table(spark, path, 1)


def test_buckets_that_become_empty_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 1), (2, 1)], "k INT, v INT")
    bucketed.rewrite(rows.where("false"), path, 1, ("k",), bucketed.latest_rows(("k",), ("v",)), 4)
    assert bucketed.read_table(spark, path).collect() == []
    bucketed.rewrite(rows, path, 2, ("k",), bucketed.latest_rows(("k",), ("v",)), 4)
    bucketed.rewrite(rows.where("k = 1"), path, 3, ("k",), lambda current, batch: current.join(batch, "k", "left_anti"), 4)
    assert [tuple(r) for r in bucketed.read_table(spark, path).collect()] == [(2, 1)]


OUTCOMES = "ts TIMESTAMP, kind STRING, failed BOOLEAN, size_bytes BIGINT, millis BIGINT"


def outcomes(n=400):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    return [(start + timedelta(minutes=5 * i), rng.choice("ab"), rng.random() < 0.3, i, i % 50) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 5])
def test_stream_metrics_equal_batch_and_late_rows_are_counted(spark, tmp_path, parts):
    rows = outcomes()
    write_parts(spark, rows, OUTCOMES, str(tmp_path / "in"), parts)
    stream = spark.readStream.schema(OUTCOMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    metrics = catalog.pipeline_metrics(stream, "1 hour", late_after="2 hours")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    ingest.append_available(metrics, out, mark)
    closed = rows[-1][0] - timedelta(hours=2)
    want = catalog.pipeline_metrics(spark.createDataFrame(rows, OUTCOMES), "1 hour").where(F.col("window_end") <= F.lit(closed))
    got = spark.read.parquet(out)
    assert got.count() == want.count() > 50 and got.exceptAll(want).isEmpty()
    spark.createDataFrame([rows[0], rows[-1]], OUTCOMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # one is too late
    query = metrics.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    assert catalog.late_rows(query) == 1
    assert spark.read.parquet(out).where(F.col("window_start") == F.lit(datetime(2024, 1, 1))).agg(F.sum("files")).first()[0] == 12


def test_alerts_rearm_only_below_the_lower_limit(spark):
    values = {"a": [10, 50, 49, 30, 60, 24, 45, None, 44, 50, 0, 0, 46], "b": [45, 45], "c": [44, 44], "d": [30, 50]}
    rows = [(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "kind STRING, window_start INT, v INT").repartition(4)
    got = {(r.kind, r.window_start) for r in catalog.alerts(df, F.col("v"), 45, 25).collect()}
    assert got == {("a", 1), ("a", 6), ("a", 12), ("b", 0), ("d", 1)}
    assert catalog.alerts(df.where("false"), F.col("v"), 45, 25).collect() == []


def test_repeats_within_a_delay_collapse_and_their_state_ends(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=i // 2), f"p{i // 2 % 500}", "created") for i in range(2000)]
    write_parts(spark, rows, "ts TIMESTAMP, path STRING, kind STRING", str(tmp_path / "in"), 5)
    stream = spark.readStream.schema("ts TIMESTAMP, path STRING, kind STRING").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.dedupe_events(stream, within="60 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    # the pairs a minute apart collapse; of those 500 minutes apart, some meet an entry that the batch has not ended yet
    assert 900 < got.count() <= 1000 and got.select("path").distinct().count() == 500
    assert got.count() == got.select("ts", "path").distinct().count()
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal < 200
