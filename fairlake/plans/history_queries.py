"""Record history derived from conversations: one record per conversation, one version per turn."""

from pyspark.sql import functions as F

from fairlake.operators import history as H
from fairlake.plans.registry import query, table, view
from fairlake.sources import io

_LAST = "(SELECT max(version) FROM $history m WHERE m.record_key = h.record_key)"


def _newest(history):
    return history.groupBy("record_key").agg(F.max("version").alias("_last"))


@query("a08_change_log", """
SELECT hash, author, date, message FROM (SELECT string_split(line, '|') AS p, p[1] AS hash, p[2] AS author, p[3] AS date, p[4] AS message FROM (
  SELECT md5(text) || '|' || role || '|' || (1700000000 + turn) || '|' || replace(replace(text, chr(10), ' '), ',', '|') AS line FROM @conversations) x) y
WHERE len(p) = 4""")
def change_log(spark, d):
    text = F.translate("text", "\n,", " |")
    lines = table(spark, d, "conversations").select(F.concat_ws(
        "|", F.md5("text"), "role", (F.lit(1700000000) + F.col("turn")).cast("string"), text).alias("value"))
    return io.parse_change_log(lines)


@query("i01_commit", f"""
WITH hist AS (SELECT record_key, version, commit_ts, content_hash, author FROM $history h WHERE version < {_LAST}),
snap AS (SELECT record_key, content_hash, row_number() OVER (PARTITION BY record_key ORDER BY version DESC) AS r,
  count(*) OVER (PARTITION BY record_key) AS n, conv_id FROM $history h),
now AS (SELECT record_key, content_hash FROM snap WHERE r = CASE WHEN conv_id % 3 = 0 AND n > 1 THEN 2 ELSE 1 END),
last AS (SELECT record_key, max(version) AS v, arg_max(content_hash, version) AS c FROM hist GROUP BY record_key)
SELECT record_key, version, commit_ts, content_hash, author FROM hist
UNION ALL SELECT now.record_key, coalesce(v + 1, 0), 1800000000, content_hash, 'system' FROM now LEFT JOIN last ON now.record_key = last.record_key
WHERE c IS DISTINCT FROM content_hash""")
def commit(spark, d):
    h = view(spark, d, "history").join(_newest(view(spark, d, "history")), "record_key")
    hist = h.where("version < _last").select("record_key", "version", "commit_ts", "content_hash", "author")
    wanted = F.when((F.col("conv_id") % 3 == 0) & (F.col("_last") > 0), F.col("_last") - 1).otherwise(F.col("_last"))
    now = h.where(F.col("version") == wanted).select("record_key", "content_hash")
    return H.commit(hist, now, "update", "system", F.lit(1800000000).cast("bigint"))


@query("i02_snapshot_diff", """
WITH a AS (SELECT record_key, arg_max(content_hash, version) AS h FROM $history x WHERE version <= 2 AND role_ok GROUP BY record_key),
b AS (SELECT record_key, arg_max(content_hash, version) AS h FROM $history x WHERE version <= 3 OR author = 'assistant' GROUP BY record_key)
SELECT coalesce(a.record_key, b.record_key) AS record_key, CASE WHEN a.record_key IS NULL THEN 'added' WHEN b.record_key IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.record_key = b.record_key WHERE a.h IS DISTINCT FROM b.h""".replace("AND role_ok", "AND author <> 'assistant'"))
def snapshot_diff(spark, d):
    h = view(spark, d, "history")
    a = H.restore(h.where("version <= 2 AND author <> 'assistant'"))
    b = H.restore(h.where("version <= 3 OR author = 'assistant'"))
    return H.snapshot_diff(a, b)


@query("i03_record_history", """
SELECT record_key, version, content_hash, author FROM $history h WHERE record_key = (SELECT max(record_key) FROM $history m)""")
def record_history(spark, d):
    h = view(spark, d, "history")
    return H.record_history(h, h.agg(F.max("record_key")).scalar()).select("record_key", "version", "content_hash", "author")


@query("i04_validity", """
SELECT record_key, version, commit_ts AS valid_from, coalesce(lead(commit_ts) OVER (PARTITION BY record_key ORDER BY version), -1) AS valid_to FROM $history h""")
def validity(spark, d):
    return H.with_validity(view(spark, d, "history")).select("record_key", "version", "valid_from", F.coalesce("valid_to", F.lit(-1)).alias("valid_to"))


@query("i04_as_of", """
SELECT record_key, max(version) AS version, arg_max(content_hash, version) AS content_hash FROM $history h WHERE commit_ts <= 1700007250 GROUP BY record_key""")
def as_of(spark, d):
    return H.as_of(view(spark, d, "history"), F.lit(1700007250)).select("record_key", "version", "content_hash")


@query("i05_tag", "SELECT 'release-1' AS tag, 'first release' AS message, max(commit_ts) AS commit_ts FROM $history h")
def tag(spark, d):
    return H.tag(view(spark, d, "history"), "release-1", "first release")


@query("i06_restore", """
SELECT record_key, max(version) AS version, arg_max(author, version) AS author, arg_max(raw, version) AS raw FROM $history h WHERE version <= 2 GROUP BY record_key""")
def restore(spark, d):
    return H.restore(view(spark, d, "history"), at_version=2).select("record_key", "version", "author", "raw")


@query("i07_untracked_files", """
SELECT doc_id, path FROM $files f WHERE NOT EXISTS (SELECT 1 FROM @labels l JOIN $files g ON l.doc_id = g.doc_id WHERE g.path = f.path)""")
def untracked_files(spark, d):
    f = view(spark, d, "files").select("doc_id", "path")
    tracked = f.join(table(spark, d, "labels"), "doc_id").select("path")
    return H.untracked(f, tracked, ["path"])


_DIFF = """
SELECT coalesce(n.record_key, o.record_key) AS record_key, coalesce(n.version, o.version) AS version, coalesce(n.key, o.key) AS field,
  n.value IS DISTINCT FROM o.value AS is_modified,
  n.value IS NOT NULL AND n.value NOT IN ('null', '""', '[]', '{}', '"To be filled"') AS is_completed,
  coalesce(n.key, o.key) = 'n' AND coalesce(n.version, o.version) % 4 = 1 AS has_error,
  coalesce(n.key, o.key) IN ('title', 'note') AS is_required, coalesce(n.key, o.key) = 'role' AS is_system
FROM (SELECT record_key, version, key, CAST(value AS VARCHAR) AS value FROM $history h, json_each(h.raw)) n
FULL JOIN (SELECT h.record_key, h.version + 1 AS version, key, CAST(value AS VARCHAR) AS value FROM $history h, json_each(h.raw)
   WHERE h.version < (SELECT max(version) FROM $history m WHERE m.record_key = h.record_key)) o
ON n.record_key = o.record_key AND n.version = o.version AND n.key = o.key"""


def _diff(spark, d):
    h = view(spark, d, "history").withColumn("body", F.parse_json("raw"))
    pairs = H.consecutive_versions(h).withColumn(
        "bad", F.when(F.col("version") % 4 == 1, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>")))
    return H.field_diff(pairs, required=["title", "note"], system=["role"], errors="bad")


@query("h11_field_diff", f"SELECT *, NOT is_completed AS is_empty FROM ({_DIFF}) x")
def field_diff(spark, d):
    return _diff(spark, d)


@query("h12_diff_totals", f"""
SELECT record_key, version, count(*) AS total, count(*) FILTER (WHERE is_modified AND NOT is_system) AS modified,
  count(*) FILTER (WHERE is_completed) AS completed, count(*) FILTER (WHERE has_error) AS errors, count(*) FILTER (WHERE is_required) AS required,
  count(*) FILTER (WHERE is_required AND is_completed) AS required_completed, count(*) FILTER (WHERE is_system) AS system
FROM ({_DIFF}) x GROUP BY record_key, version""")
def diff_totals(spark, d):
    return H.diff_stats(_diff(spark, d))


@query("h13_primary_status", f"""
SELECT record_key, version, field, CASE WHEN is_system THEN 'system' WHEN has_error THEN 'error' WHEN is_completed THEN 'completed'
  WHEN is_required THEN 'required' WHEN is_modified THEN 'modified' ELSE 'empty' END AS status FROM ({_DIFF}) x""")
def primary_status(spark, d):
    return _diff(spark, d).select("record_key", "version", "field", H.primary_status().alias("status"))
