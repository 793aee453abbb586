"""Sources, sinks and streaming jobs; streams run over what is there and then end."""

import uuid

from pyspark.sql import functions as F

from fairlake.functions import paths as P
from fairlake.operators.manifest import summarize_manifest
from fairlake.plans.record_queries import TS
from fairlake.plans.registry import ORACLES, query, spark_text, table, view
from fairlake.plans.views import VIEWS
from fairlake.session import shared_dir
from fairlake.sources import bucketed, io
from fairlake.streaming import catalog as C
from fairlake.streaming import ingest as K
from fairlake.streaming import quota


def _event_stream(spark, d, view_name):
    """A derived view over the events table, read as a stream."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"events_{uuid.uuid4().hex}"
    stream.createOrReplaceTempView(name)
    return spark.sql(spark_text(VIEWS[view_name].replace("@events", name), d))


def _appended(spark, stream, name):
    base = shared_dir(spark, name)
    K.append_available(stream, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table")


@query("a01_scan_files")
def scan_files(spark, d):
    found = io.scan_files(spark, d)
    return found.select(P.base_name("path").alias("file_name"), P.extension("path").alias("extension"), "size_bytes")


@query("a02_watch_files")
def watch_files(spark, d):
    found = _appended(spark, io.watch_files(spark, d, files_per_batch=5), "watch")
    return found.select(P.base_name("path").alias("file_name"), "size_bytes")


@query("a04_load_schema_registry", """
SELECT schema_id, source, title, md5(body) AS body FROM (SELECT *, CASE WHEN doc_id % 9 = 2 THEN body || ']' ELSE body END AS text FROM $schema_layers s) x
WHERE json_valid(text)""".replace("title,", "text ->> '$.title' AS title,"))
def load_schema_registry(spark, d):
    texts = view(spark, d, "schema_layers").withColumn("body", F.expr("CASE WHEN doc_id % 9 = 2 THEN body || ']' ELSE body END"))
    return io.parse_schemas(texts.drop("title", "description")).select("schema_id", "source", "title", F.md5("body").alias("body"))


@query("a06_versioned_snapshot", """
SELECT dataset_id, count(*) AS file_count, CAST(sum(file_size_bytes) AS BIGINT) AS total_size_bytes FROM $tree_files t GROUP BY dataset_id""")
def versioned_snapshot(spark, d):
    path = shared_dir(spark, "snapshot")
    summary = summarize_manifest(view(spark, d, "tree_files")).drop("file_types")
    io.write_snapshot(summary.where("file_count > 2"), path, 1)
    io.write_snapshot(summary, path, 2)
    return io.read_snapshot(spark, path)


_ROUTED = """SELECT event_id, kind, ts, size_bytes, CASE WHEN kind = 'moved' THEN dest_path ELSE src_path END AS path,
  CASE kind WHEN 'created' THEN CASE WHEN is_directory THEN 'init_dataset' ELSE 'ingest' END WHEN 'moved' THEN 'ingest' WHEN 'modified' THEN 'check_completion' END AS action
  FROM $fs_events e"""


@query("k01_route_events", f"SELECT event_id, path, action FROM ({_ROUTED}) r")
def route_events(spark, d):
    routed = K.route_events(_event_stream(spark, d, "fs_events"))
    return _appended(spark, routed.select("event_id", "path", "action"), "routes")


@query("k02_backfill", "SELECT kind, count(*) AS n FROM $fs_events e GROUP BY kind")
def backfill(spark, d):
    base = shared_dir(spark, "backfill")

    def handle(batch, batch_id):
        batch.select("event_id", "kind").write.mode("overwrite").parquet(f"{base}/table/batch={batch_id}")

    stream = _event_stream(spark, d, "fs_events")
    # The continuous job finds nothing new: the checkpoint knows what was taken.
    running = K.backfill_then_stream(stream, f"{base}/checkpoint", handle, "1 second")
    running.processAllAvailable()
    running.stop()
    return spark.read.parquet(f"{base}/table").groupBy("kind").agg(F.count("*").alias("n"))


@query("k03_finalize_on_change", f"""
SELECT project_key, dataset_key, experiment_id, completeness_score FROM ({ORACLES["h05_finalize"]}) z
WHERE dataset_key IN (SELECT split_part(src_path, '/', -3) FROM $fs_events e WHERE kind = 'modified')""")
def finalize_on_change(spark, d):
    base = shared_dir(spark, "finalize")
    # The event tree files datasets under other projects; give the events the folders that the records have.
    folders = view(spark, d, "contextual").select(F.col("dataset_key").alias("folder"), "project_key")
    routed = K.route_events(_event_stream(spark, d, "fs_events")).where("action = 'check_completion'")
    placed = routed.join(folders, F.split_part("path", F.lit("/"), F.lit(-3)) == F.col("folder")).withColumn(
        "path", F.concat_ws("/", F.lit("/data"), "project_key", "folder", F.lit(".metadata"), F.lit("experiment_contextual.json")))

    def records():
        return view(spark, d, "records").withColumn("body", F.parse_json("raw"))

    K.finalize_on_change(placed.drop("folder", "project_key"), f"{base}/table", f"{base}/checkpoint", records, TS).awaitTermination()
    return spark.read.parquet(f"{base}/table").select(
        "project_key", "dataset_key", "experiment_id", F.round("completeness_score", 9).alias("completeness_score"))


def _manifest_rows(events):
    routed = K.route_events(events).where("action = 'ingest'")
    return routed.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("dataset_id"), P.base_name("path").alias("file_name"),
        F.col("size_bytes").alias("file_size_bytes"), "kind", "event_id")


@query("k04_stream_manifest", f"""
SELECT dataset_id, file_name, arg_max(size_bytes, event_id) AS file_size_bytes, arg_max(kind, event_id) AS kind FROM (
  SELECT *, dirname(path) AS dataset_id, parse_filename(path) AS file_name FROM ({_ROUTED}) r WHERE action = 'ingest') x
GROUP BY dataset_id, file_name""".replace("dirname(path)", "regexp_replace(path, '/[^/]*$', '')"))
def stream_manifest(spark, d):
    base = shared_dir(spark, "manifest")
    rows = _manifest_rows(_event_stream(spark, d, "fs_events"))
    K.stream_manifest(rows, f"{base}/table", f"{base}/checkpoint", ["event_id"]).awaitTermination()
    return bucketed.read_table(spark, f"{base}/table")


@query("k05_settled_events", f"""
SELECT event_id, path FROM ({_ROUTED}) r WHERE ts <= (SELECT max(ts) FROM @events) - INTERVAL 10 DAY
  AND path IN (SELECT dest_path FROM $fs_events e WHERE kind = 'moved')""")
def settled_events(spark, d):
    now = table(spark, d, "events").agg(F.max("ts")).first()[0]
    listing = view(spark, d, "fs_events").where("kind = 'moved'").select(F.col("dest_path").alias("path")).distinct()
    routed = K.route_events(_event_stream(spark, d, "fs_events"))
    ripe = K.settled(routed, F.lit(now).cast("timestamp_ntz"), 10 * 86400, listing)
    return _appended(spark, ripe.select("event_id", "path"), "settled")


@query("k06_repeated_events", f"SELECT DISTINCT path, kind FROM ({_ROUTED}) r")
def repeated_events(spark, d):
    routed = K.route_events(_event_stream(spark, d, "fs_events"))
    return _appended(spark, K.dedupe_events(routed).select("path", "kind"), "dedupe")


@query("k07_stream_quota", """
WITH RECURSIVE e AS (SELECT event_id, client_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY client_id ORDER BY ts, event_id) AS rn FROM $requests r),
run AS (
  SELECT event_id, client_id, rn, [t] AS kept, true AS allowed FROM e WHERE rn = 1
  UNION ALL
  SELECT event_id, client_id, rn, CASE WHEN len(live) < 5 THEN live || [t] ELSE live END, len(live) < 5 FROM (
    SELECT e.event_id, e.client_id, e.rn, e.t, list_filter(run.kept, lambda x: e.t - x < 172800000000) AS live
    FROM run JOIN e ON e.client_id = run.client_id AND e.rn = run.rn + 1) s)
SELECT event_id, client_id, allowed FROM run""")
def stream_quota(spark, d):
    base = shared_dir(spark, "quota")
    requests = _event_stream(spark, d, "requests").select("client_id", "ts", "event_id")
    K.stream_quota(requests, f"{base}/table", f"{base}/state", f"{base}/checkpoint", 5, 172800).awaitTermination()
    return spark.read.parquet(f"{base}/table").where("NOT carried").select("event_id", "client_id", "allowed")


@query("l02_sync_catalog", """
SELECT record_key, version, content_hash, raw FROM (SELECT *, turn_kind = 4 AS deleted FROM (SELECT *, version % 5 AS turn_kind FROM $history h) t) x
WHERE NOT deleted QUALIFY version = max(version) OVER (PARTITION BY record_key) AND version = (
  SELECT max(version) FROM $history o WHERE o.record_key = x.record_key)""")
def sync_catalog(spark, d):
    base = shared_dir(spark, "catalog")
    changes = view(spark, d, "history").select("record_key", "version", "content_hash", "raw", (F.col("version") % 5 == 4).alias("deleted"))
    changes.repartition(3, F.col("version") % 3).write.parquet(f"{base}/changes")  # three files, each with a part of every record's versions
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/changes")
    C.sync_catalog(stream, f"{base}/table", f"{base}/checkpoint", keep=2).awaitTermination()
    return C.read_catalog(spark, f"{base}/table")


def _in_time_order(spark, rows, path, files=3):
    """A stream over files that arrived one after the other, in the order of ``ts``."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.unix_millis(F.min("ts")), F.unix_millis(F.max("ts"))).first()
    part = F.floor((F.unix_millis("ts") - first) * files / (last - first + 1))
    for k in range(files):
        rows.where(part == k).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _outcomes(requests):
    return requests.select("ts", F.col("endpoint").alias("kind"), (F.col("outcome") != "success").alias("failed"),
                           F.col("event_id").alias("size_bytes"), F.floor("latency_ms").alias("millis"))


_METRICS = """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, endpoint AS kind,
  count(*) AS files, count(*) FILTER (WHERE outcome <> 'success') AS failures, CAST(sum(event_id) AS BIGINT) AS size_bytes,
  CAST(sum(floor(latency_ms)) AS BIGINT) AS millis, CAST(max(floor(latency_ms)) AS BIGINT) AS longest_millis FROM $requests r WHERE ts IS NOT NULL GROUP BY ALL"""


def _plain(metrics):
    return metrics.withColumn("window_start", F.col("window_start").cast("string")).withColumn("window_end", F.col("window_end").cast("string"))


_AS_TEXT = "strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end"


@query("l04_pipeline_metrics", f"SELECT * EXCLUDE (window_start, window_end), {_AS_TEXT} FROM ({_METRICS}) m")
def pipeline_metrics(spark, d):
    return _plain(C.pipeline_metrics(_outcomes(view(spark, d, "requests")), "6 hours"))


@query("l04_stream_metrics", f"""SELECT * EXCLUDE (window_start, window_end), {_AS_TEXT} FROM ({_METRICS}) m
WHERE window_end <= (SELECT max(ts) - INTERVAL 1 DAY FROM @events)""")
def stream_metrics(spark, d):
    base = shared_dir(spark, "metrics")
    stream = _in_time_order(spark, view(spark, d, "requests").select("ts", "endpoint", "outcome", "event_id", "latency_ms"), f"{base}/requests")
    K.append_available(C.pipeline_metrics(_outcomes(stream), "6 hours", late_after="1 day"), f"{base}/table", f"{base}/checkpoint")
    return _plain(spark.read.parquet(f"{base}/table"))


@query("l05_alerts", f"""
WITH RECURSIVE m AS (SELECT *, failures * 100 // files AS v, row_number() OVER (PARTITION BY kind ORDER BY window_start) AS rn FROM ({_METRICS}) x),
run AS (SELECT kind, rn, window_start, v, v >= 45 AS busy, v >= 45 AS raised FROM m WHERE rn = 1
  UNION ALL SELECT m.kind, m.rn, m.window_start, m.v, CASE WHEN run.busy THEN m.v >= 25 ELSE m.v >= 45 END, NOT run.busy AND m.v >= 45
  FROM run JOIN m ON m.kind = run.kind AND m.rn = run.rn + 1)
SELECT kind, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(v AS BIGINT) AS value FROM run WHERE raised""")
def alerts(spark, d):
    metrics = C.pipeline_metrics(_outcomes(view(spark, d, "requests")), "6 hours")
    raised = C.alerts(metrics, F.floor(F.col("failures") * 100 / F.col("files")), 45, 25)
    return raised.select("kind", F.col("window_start").cast("string").alias("window_start"), "value")


@query("k07_quota_by_client", ORACLES["k07_stream_quota"] + """
WHERE event_id IN (SELECT event_id FROM @events WHERE ts <= (SELECT max(ts) - INTERVAL 1 DAY FROM @events))""".replace("@", ""))
def quota_by_client(spark, d):
    base = shared_dir(spark, "quota-state")
    stream = _in_time_order(spark, view(spark, d, "requests").select("client_id", "ts", "event_id"), f"{base}/requests")
    quota.stream_decisions(stream, f"{base}/table", f"{base}/checkpoint", 5, 172800, "1 day").awaitTermination()
    return spark.read.parquet(f"{base}/table").select("event_id", "client_id", "allowed")
