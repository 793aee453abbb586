"""Request and task logs derived from the events table."""

from pyspark.sql import functions as F

from fairlake.operators import oplog as L
from fairlake.plans.registry import query, table, view


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("j01_endpoint_stats", """
SELECT endpoint, count(*) AS count, round(sum(latency_ms), 6) AS total_time, round(avg(latency_ms), 6) AS avg_time,
  min(latency_ms) AS min_time, max(latency_ms) AS max_time FROM $requests r GROUP BY endpoint""")
def endpoint_stats(spark, d):
    return _rounded(L.endpoint_stats(view(spark, d, "requests")), "total_time", "avg_time")


@query("j02_slow_requests", """
SELECT event_id, endpoint, latency_ms AS duration_ms, ts FROM $requests r WHERE latency_ms > 1000
ORDER BY ts DESC, event_id DESC LIMIT 10""")
def slow_requests(spark, d):
    return L.slow_requests(view(spark, d, "requests"))


_LOOKUPS = """SELECT event_type AS cache_type, CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'click' THEN value < 8
  ELSE value < 40 END AS hit FROM @events"""


def _lookups(spark, d):
    hit = F.when(F.col("event_type") == "click", F.col("value") < 8).when(F.col("event_type") != "signup", F.col("value") < 40)
    return table(spark, d, "events").select(F.col("event_type").alias("cache_type"), hit.alias("hit"))


@query("j03_cache_hit_rates", f"""
SELECT cache_type, h AS hits, m AS misses, CASE WHEN h + m > 0 THEN round(h / CAST(h + m AS DOUBLE), 9) ELSE 0 END AS hit_rate FROM (
  SELECT cache_type, count(*) FILTER (WHERE hit) AS h, count(*) FILTER (WHERE NOT hit) AS m FROM ({_LOOKUPS}) l GROUP BY cache_type) x""")
def cache_hit_rates(spark, d):
    return L.hit_rates(_lookups(spark, d)).withColumn("hit_rate", F.round("hit_rate", 9))


@query("j04_suggestions", f"""
SELECT 'slow_endpoint' AS type, endpoint AS subject, round(avg(latency_ms * 9), 6) AS measured, 'cache or speed up ' || endpoint AS suggestion
FROM $requests r GROUP BY endpoint HAVING avg(latency_ms * 9) > 1000
UNION ALL SELECT 'low_cache_hit_rate', cache_type, round(coalesce(avg(CASE WHEN hit THEN 1.0 WHEN NOT hit THEN 0.0 END), 0), 6),
  'longer lifetime or better keys for ' || cache_type FROM ({_LOOKUPS}) l GROUP BY cache_type
HAVING coalesce(avg(CASE WHEN hit THEN 1.0 WHEN NOT hit THEN 0.0 END), 0) < 0.5""")
def suggestions(spark, d):
    stats = L.endpoint_stats(view(spark, d, "requests").withColumn("latency_ms", F.col("latency_ms") * 9))
    return _rounded(L.suggestions(stats, L.hit_rates(_lookups(spark, d))), "measured")


_PERCENTILES = """SELECT p AS percentile, list_extract(v, CAST(floor(CAST(p AS DOUBLE) / 100 * (len(v) - 1)) AS BIGINT) + 1) AS value
FROM (SELECT list(latency_ms ORDER BY latency_ms) AS v FROM $requests r) x, (VALUES (50), (90), (95), (99)) t(p)"""


@query("j05_latency_percentiles", _PERCENTILES)
def latency_percentiles(spark, d):
    return L.latency_percentiles(view(spark, d, "requests"))


@query("j06_latency_stats", """
SELECT min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(avg(latency_ms), 6) AS average_ms FROM $requests r""")
def latency_stats(spark, d):
    return _rounded(L.latency_stats(view(spark, d, "requests")), "average_ms")


@query("j07_status_distribution", """
SELECT status_code, count(*) AS n, round(count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM @events), 9) AS percent
FROM $requests r GROUP BY status_code""")
def status_distribution(spark, d):
    return L.status_distribution(view(spark, d, "requests")).withColumn("percent", F.round("percent", 9))


@query("j08_success_rate", """
SELECT count(*) AS total_requests, count(*) FILTER (WHERE outcome <> 'success') AS total_failures,
  round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE outcome = 'success') / count(*), 9) AS success_rate_percent FROM $requests r""")
def success_rate(spark, d):
    return L.success_rate(view(spark, d, "requests")).withColumn("success_rate_percent", F.round("success_rate_percent", 9))


@query("j08_outcome_counts", "SELECT outcome, count(*) AS n FROM $requests r GROUP BY outcome")
def outcome_counts(spark, d):
    return L.outcome_counts(view(spark, d, "requests"))


@query("j09_critical_errors", """
SELECT event_id, ts, endpoint, outcome, latency_ms FROM $requests r WHERE outcome <> 'success' ORDER BY ts, event_id LIMIT 20""")
def critical_errors(spark, d):
    return L.critical_errors(view(spark, d, "requests")).select("event_id", "ts", "endpoint", "outcome", "latency_ms")


@query("j10_run_report", f"""
SELECT (SELECT run_id FROM $requests r WHERE run_id IS NOT NULL ORDER BY ts, event_id LIMIT 1) AS run_id,
  count(*) AS total_requests, count(*) FILTER (WHERE outcome <> 'success') AS total_failures,
  round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE outcome = 'success') / count(*), 9) AS success_rate_percent,
  min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(avg(latency_ms), 6) AS average_ms,
  {", ".join(f"(SELECT value FROM ({_PERCENTILES}) p WHERE percentile = {p}) AS p{p}_ms" for p in (50, 90, 95, 99))}
FROM $requests r""")
def run_report(spark, d):
    report = L.run_report(view(spark, d, "requests"))
    return report.withColumn("success_rate_percent", F.round("success_rate_percent", 9)).withColumn("average_ms", F.round("average_ms", 6))


@query("j11_task_listing", """
SELECT task_id, task_type, status, created_at FROM $tasks t WHERE task_type = 'click' AND status = 'failed'
ORDER BY created_at DESC, task_id LIMIT 25""")
def task_listing(spark, d):
    return L.list_tasks(view(spark, d, "tasks"), "click", "failed", 25).select("task_id", "task_type", "status", "created_at")


@query("j12_task_counts", "SELECT status, count(*) AS n FROM $tasks t GROUP BY status")
def task_counts(spark, d):
    return L.task_counts(view(spark, d, "tasks"))


@query("j13_task_retention", """
SELECT task_id, status, created_at FROM $tasks t WHERE status IN ('pending', 'running')
  OR created_at >= (SELECT max(ts) FROM @events) - INTERVAL 200 HOUR""")
def task_retention(spark, d):
    now = table(spark, d, "events").agg(F.max("ts")).scalar()
    return L.retain(view(spark, d, "tasks"), now, hours=200).select("task_id", "status", "created_at")


@query("j14_access_audit", """
SELECT event_id, method, path, permission, permission IS NULL OR role = 'admin' OR (role = 'editor' AND permission IN ('read', 'write'))
  OR (role = 'viewer' AND permission = 'read') AS allowed FROM (
SELECT *, CASE WHEN method = 'GET' AND path IN ('/api/v1/projects', '/api/v1/health') THEN 'read'
   WHEN method = 'POST' AND path = '/api/v1/rescan' THEN 'manage'
   WHEN method = 'POST' AND path = '/api/v1/datasets/{dataset_id}/finalize' THEN 'write'
   WHEN method = 'PUT' AND path = '/api/v1/datasets/{dataset_id}/metadata/{metadata_type}' THEN 'write'
   WHEN method = 'GET' AND path = '/api/v1/datasets/{dataset_id}/metadata/{metadata_type}' THEN 'read' END AS permission FROM (
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'PUT' ELSE 'POST' END AS method,
    CASE event_type WHEN 'signup' THEN '/api/v1/projects' WHEN 'view' THEN '/api/v1/health' WHEN 'purchase' THEN '/api/v1/rescan'
      WHEN 'click' THEN '/api/v1/datasets/{dataset_id}/metadata/{metadata_type}' ELSE '/api/v1/datasets/{dataset_id}/finalize' END AS path,
    CASE user_id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' WHEN 2 THEN 'viewer' WHEN 3 THEN 'guest' ELSE 'editor' END AS role FROM @events) a) b""")
def access_audit(spark, d):
    path = F.expr("""CASE event_type WHEN 'signup' THEN '/api/v1/projects' WHEN 'view' THEN '/api/v1/health' WHEN 'purchase' THEN '/api/v1/rescan'
      WHEN 'click' THEN '/api/v1/datasets/{dataset_id}/metadata/{metadata_type}' ELSE '/api/v1/datasets/{dataset_id}/finalize' END""")
    roles = F.expr("""CASE user_id % 5 WHEN 0 THEN array('viewer', 'admin') WHEN 1 THEN array('editor') WHEN 2 THEN array('viewer')
      WHEN 3 THEN array('guest') ELSE array('viewer', 'editor') END""")
    method = F.expr("CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'PUT' ELSE 'POST' END")
    requests = table(spark, d, "events").select("event_id", method.alias("method"), path.alias("path"), roles.alias("roles"))
    return L.access_audit(requests).drop("roles")


@query("j15_quota_audit", """
WITH RECURSIVE e AS (SELECT event_id, client_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY client_id ORDER BY ts, event_id) AS rn FROM $requests r),
run AS (
  SELECT event_id, client_id, rn, [t] AS kept, true AS allowed FROM e WHERE rn = 1
  UNION ALL
  SELECT event_id, client_id, rn, CASE WHEN len(live) < 3 THEN live || [t] ELSE live END, len(live) < 3 FROM (
    SELECT e.event_id, e.client_id, e.rn, e.t, list_filter(run.kept, lambda x: e.t - x < 86400000000) AS live
    FROM run JOIN e ON e.client_id = run.client_id AND e.rn = run.rn + 1) s)
SELECT event_id, client_id, allowed FROM run""")
def quota_audit(spark, d):
    requests = view(spark, d, "requests").select("event_id", "client_id", "ts")
    return L.quota_audit(requests, limit=3, window_seconds=86400).select("event_id", "client_id", "allowed")


@query("j16_error_rows", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Exception' ELSE outcome END AS error_type, endpoint || ' gave ' || status_code AS message,
  CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END AS context, CASE WHEN event_id % 5 > 1 THEN 'http ' || status_code END AS cause
FROM $requests r WHERE outcome <> 'success'""")
def error_rows(spark, d):
    log = view(spark, d, "requests").where("outcome <> 'success'").select(
        "event_id", F.when(F.col("event_id") % 4 != 0, F.col("outcome")).alias("error_type"),
        F.concat("endpoint", F.lit(" gave "), "status_code").alias("message"),
        F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("context"),
        F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 > 1, F.concat(F.lit("http "), "status_code")).alias("cause"))
    return L.error_rows(log, keep=["event_id"])
