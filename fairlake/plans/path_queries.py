"""Path, name and identifier rules over derived file trees and page URLs."""

from pyspark.sql import functions as F

from fairlake.functions import paths as P
from fairlake.plans.registry import query, table, view


@query("b01_ignore_filter", """
SELECT doc_id, path,
  (list_has_any([contains(path, x) FOR x IN ['.git','.dvc','__pycache__','.DS_Store','node_modules','.venv','venv','env','dist',
     'build','.next','.tmp','.swp','.swo','~','.bak','.template_schemas']], [true])
   OR (contains(path, '.metadata') AND (suffix(path, '.json') OR suffix(path, '.md') OR suffix(path, '.txt')))) AS ignored
FROM $files f""")
def ignore_filter(spark, d):
    return view(spark, d, "files").select("doc_id", "path", P.is_ignored("path").alias("ignored"))


@query("b02_classify_directories", """
WITH dirs AS (
  SELECT '/data/' || project_key || '/' || dataset_key AS path FROM $dataset_dirs a
  UNION ALL SELECT '/data/' || project_key FROM $project_dirs b
  UNION ALL SELECT '/data/d_' || l_partkey FROM @lineitem c
  UNION ALL SELECT '/data/p_1/sub/n_' || l_suppkey FROM @lineitem e),
parts AS (SELECT path, split_part(path, '/', -1) AS n, split_part(path, '/', -2) AS p FROM dirs)
SELECT role, count(*) AS dirs, count(DISTINCT path) AS paths FROM (
  SELECT path, CASE WHEN n[1] = '.' OR n = '__pycache__' THEN 'hidden' WHEN n[1:2] = 'p_' THEN 'project'
    WHEN n[1:2] = 'd_' AND p[1:2] = 'p_' THEN 'dataset' WHEN n[1:2] = 'd_' THEN 'orphan_dataset'
    WHEN p[1:2] = 'p_' THEN 'legacy_dataset' ELSE 'other' END AS role FROM parts) r GROUP BY role""")
def classify_directories(spark, d):
    ds = view(spark, d, "dataset_dirs").select(F.concat(F.lit("/data/"), "project_key", F.lit("/"), "dataset_key").alias("path"))
    pr = view(spark, d, "project_dirs").select(F.concat(F.lit("/data/"), "project_key").alias("path"))
    li = table(spark, d, "lineitem")
    orphan = li.select(F.concat(F.lit("/data/d_"), "l_partkey").alias("path"))
    other = li.select(F.concat(F.lit("/data/p_1/sub/n_"), "l_suppkey").alias("path"))
    per_path = (
        ds.unionAll(pr).unionAll(orphan).unionAll(other)
        .groupBy("path").agg(F.count("*").alias("n"))
    )
    return (
        per_path.groupBy(P.classify_dir("path").alias("role"))
        .agg(F.sum("n").alias("dirs"), F.count("*").alias("paths"))
    )


@query("b03_inside_metadata", """
SELECT doc_id, position('.metadata' IN path) > 0 AS inside FROM $files f""")
def inside_metadata(spark, d):
    return view(spark, d, "files").select("doc_id", P.in_metadata("path").alias("inside"))


@query("b04_clean_titles", """
SELECT project_key, dataset_key, regexp_replace(project_key, '^p_', '') AS project_title,
  regexp_replace(dataset_key, '^d_', '') AS dataset_title FROM $dataset_dirs x""")
def clean_titles(spark, d):
    return view(spark, d, "dataset_dirs").select(
        "project_key", "dataset_key",
        P.strip_prefix("project_key", "p_").alias("project_title"),
        P.strip_prefix("dataset_key", "d_").alias("dataset_title"))


@query("b05_folder_tests", """
SELECT doc_id, starts_with(list_last(string_split(dir, '/')), 'p_') AS project,
  starts_with(list_extract(string_split(dir, '/'), -2), 'p_') AS dataset
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '/data/' || project_key ELSE dataset_path END AS dir FROM $files f) x""")
def folder_tests(spark, d):
    place = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/data/"), "project_key")).otherwise(F.col("dataset_path"))
    return view(spark, d, "files").select(
        "doc_id", P.is_project(place).alias("project"), P.is_dataset(place).alias("dataset"))


@query("b06_file_parts", """
SELECT doc_id, parse_filename(path) AS file_name,
  CASE WHEN regexp_matches(parse_filename(path), '.\\.[^.]+$') THEN split_part(parse_filename(path), '.', -1) ELSE '' END AS file_extension,
  replace(path, dataset_path || '/', '') AS file_path FROM $files f""")
def file_parts(spark, d):
    return view(spark, d, "files").select("doc_id", P.file_parts("path", "dataset_path").alias("p")).select("doc_id", "p.*")


_KNOWN_MIME = """(VALUES ('txt','text/plain'),('csv','text/csv'),('json','application/json'),('xml','application/xml'),
  ('html','text/html'),('htm','text/html'),('css','text/css'),('js','application/javascript'),('py','text/x-python'),
  ('md','text/markdown'),('pdf','application/pdf'),('jpg','image/jpeg'),('jpeg','image/jpeg'),('png','image/png'),
  ('gif','image/gif'),('svg','image/svg+xml'),('zip','application/zip'),('tar','application/x-tar'),
  ('gz','application/gzip'),('bz2','application/x-bzip2')) t(ext, mime)"""


@query("b07_mime_type", f"""
SELECT doc_id, coalesce(mime, 'application/octet-stream') AS mime_type
FROM $files f LEFT JOIN {_KNOWN_MIME} ON lower(regexp_extract(path, '\\.([^./]+)$', 1)) = ext""")
def mime_type(spark, d):
    return view(spark, d, "files").select("doc_id", P.mime_type(P.suffix("path")).alias("mime_type"))


@query("b08_compression", """
SELECT doc_id, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'gz' THEN 'gzip' WHEN 'bz2' THEN 'bzip2'
  WHEN 'zip' THEN 'zip' WHEN 'tar' THEN 'tar' WHEN '7z' THEN '7zip' WHEN 'rar' THEN 'rar' ELSE 'none' END AS compression
FROM $files f""")
def compression(spark, d):
    return view(spark, d, "files").select("doc_id", P.compression(P.suffix("path")).alias("compression"))


@query("b09_mode_string", """
SELECT doc_id, CASE (mode // 4096) % 16 WHEN 8 THEN '-' WHEN 4 THEN 'd' WHEN 10 THEN 'l' ELSE '?' END ||
  array_to_string([CASE WHEN (mode // (1 << (8 - i))) % 2 = 0 AND NOT (i % 3 = 2 AND (mode // (1 << (11 - i // 3))) % 2 = 1) THEN '-'
    WHEN i % 3 < 2 THEN 'rw'[i % 3 + 1]
    WHEN (mode // (1 << (11 - i // 3))) % 2 = 0 THEN 'x'
    WHEN (mode // (1 << (8 - i))) % 2 = 0 THEN 'SST'[i // 3 + 1] ELSE 'sst'[i // 3 + 1] END FOR i IN range(9)], '') AS permissions
FROM $files f""")
def mode_string(spark, d):
    return view(spark, d, "files").select("doc_id", P.mode_string("mode").alias("permissions"))


@query("b10_format_size", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(power(l_linenumber, 20 - l_quantity % 13) * (l_quantity - 1) AS BIGINT) AS n FROM @lineitem l)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n, CASE WHEN n = 0 THEN '0 B' ELSE
  (n // CAST(power(1024, u) AS BIGINT)) || '.0 ' || ['B','KB','MB','GB','TB'][u + 1] END AS human
FROM (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2
  WHEN n < 1099511627776 THEN 3 ELSE 4 END AS u FROM s) x""")
def format_size(spark, d):
    n = (F.pow("l_linenumber", 20 - F.col("l_quantity") % 13) * (F.col("l_quantity") - 1)).cast("bigint")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n.alias("n"), P.format_size(n).alias("human"))


_NAMES = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN ' .. ' || split_part(url, '/', 4) || '. '
  WHEN 2 THEN ' ... ' WHEN 3 THEN replace(url, '/', '\\') ELSE split_part(url, '/', 3) || '|"é ü*' END AS name FROM @pages"""


def _names(spark, d):
    name = F.expr(r"""CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN ' .. ' || split_part(url, '/', 4) || '. '
      WHEN 2 THEN ' ... ' WHEN 3 THEN replace(url, '/', '\\') ELSE split_part(url, '/', 3) || '|"é ü*' END""")
    return table(spark, d, "pages").select("page_id", name.alias("name"))


@query("b11_sanitize_filename", f"""
SELECT page_id, CASE WHEN s = '' THEN 'unnamed_file' ELSE s END AS safe FROM (
  SELECT page_id, trim(translate(name, '<>:"/\\|?*', '_________'), ' .') AS s FROM ({_NAMES}) n) x""")
def sanitize_filename(spark, d):
    return _names(spark, d).select("page_id", P.sanitize_filename("name").alias("safe"))


@query("b12_upload_name", f"""
SELECT page_id, regexp_replace(name, '[^\\pL\\pM\\pN_.-]', '_', 'g') AS safe FROM ({_NAMES}) n""")
def upload_name(spark, d):
    return _names(spark, d).select("page_id", P.upload_name("name").alias("safe"))


_IDS = """SELECT page_id, CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN repeat(split_part(url, '/', 3), 6)
  WHEN 2 THEN url WHEN 3 THEN replace(split_part(url, '/', 3), '.', '_') WHEN 4 THEN split_part(url, '/', 3)
  WHEN 5 THEN 'd_' || md5(html) ELSE 'a..b' END AS id FROM @pages"""


@query("b13_identifier_check", f"""
SELECT page_id, CASE WHEN id = '' THEN 'empty' WHEN length(id) > 100 THEN 'too_long'
  WHEN regexp_matches(id, '\\.\\.|/|\\\\') THEN 'traversal'
  WHEN NOT regexp_full_match(id, '[a-zA-Z0-9_-]+') THEN 'charset' END AS reason FROM ({_IDS}) i""")
def identifier_check(spark, d):
    ids = F.expr("""CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN repeat(split_part(url, '/', 3), 6)
      WHEN 2 THEN url WHEN 3 THEN replace(split_part(url, '/', 3), '.', '_') WHEN 4 THEN split_part(url, '/', 3)
      WHEN 5 THEN 'd_' || md5(html) ELSE 'a..b' END""")
    return table(spark, d, "pages").select("page_id", P.id_error(ids).alias("reason"))


@query("b14_type_whitelist", """
WITH t AS (SELECT record_key, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN repeat(metadata_type, 3) WHEN 2 THEN '../' || metadata_type
  ELSE metadata_type END AS kind FROM $records r)
SELECT record_key, kind, CASE WHEN kind = '' THEN 'empty' WHEN length(kind) > 50 THEN 'too_long' WHEN kind LIKE '%/%' THEN 'traversal'
   WHEN kind NOT IN ('project_descriptive','dataset_administrative','dataset_structural','experiment_contextual','instrument_technical','complete_metadata')
   THEN 'not_allowed' END AS metadata_error,
  CASE WHEN kind = '' THEN 'empty' WHEN length(kind) > 50 THEN 'too_long' WHEN kind LIKE '%/%' THEN 'traversal'
   WHEN kind NOT IN ('project','dataset_administrative','dataset_structural','experiment_contextual','instrument_technical','complete_metadata','contextual')
   THEN 'not_allowed' END AS schema_error FROM t""")
def type_whitelist(spark, d):
    kind = F.expr("""CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN repeat(metadata_type, 3)
      WHEN 2 THEN '../' || metadata_type ELSE metadata_type END""")
    return view(spark, d, "records").select("record_key", kind.alias("kind")).select(
        "record_key", "kind", P.type_error("kind", "metadata").alias("metadata_error"),
        P.type_error("kind", "schema").alias("schema_error"))


@query("b15_payload_check", """
SELECT record_key, CASE WHEN NOT json_valid(raw) THEN 'not_json' WHEN json_type(raw) <> 'OBJECT' THEN 'not_object'
  WHEN strlen(raw) > 900 THEN 'too_large' END AS reason
FROM (SELECT record_key, CASE doc_id % 7 WHEN 0 THEN '[' || raw || ']' WHEN 1 THEN raw || '}' ELSE raw END AS raw FROM $records r) x""")
def payload_check(spark, d):
    raw = F.expr("CASE doc_id % 7 WHEN 0 THEN '[' || raw || ']' WHEN 1 THEN raw || '}' ELSE raw END")
    return view(spark, d, "records").select("record_key", P.payload_error(raw, max_bytes=900).alias("reason"))


@query("b16_path_containment", """
WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'x/../../' || lang WHEN 1 THEN './a//' || lang || '/.' WHEN 2 THEN path
   WHEN 3 THEN '../../../../../' || source ELSE 'v1..2/' || lang END AS raw, dataset_path AS base FROM $files f),
n AS (SELECT doc_id, base, '/' || array_to_string(list_reduce(
    list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter(string_split(CASE WHEN raw[1] = '/' THEN raw ELSE base || '/' || raw END, '/'),
      lambda x: x NOT IN ('', '.')), lambda x: [x])),
    lambda acc, x: CASE WHEN x[1] = '..' THEN acc[1:length(acc) - 1] ELSE acc || x END), '/') AS norm FROM p)
SELECT doc_id, norm AS resolved, CASE WHEN contains(norm, '..') THEN 'traversal'
  WHEN norm <> base AND NOT starts_with(norm, base || '/') THEN 'outside' END AS reason FROM n""")
def path_containment(spark, d):
    raw = F.expr("""CASE doc_id % 5 WHEN 0 THEN 'x/../../' || lang WHEN 1 THEN './a//' || lang || '/.' WHEN 2 THEN path
      WHEN 3 THEN '../../../../../' || source ELSE 'v1..2/' || lang END""")
    return view(spark, d, "files").select(
        "doc_id", P.normalize_path(raw, "dataset_path").alias("resolved"),
        P.path_error(raw, "dataset_path").alias("reason"))


@query("b17_minimum_size", """
SELECT count(*) AS n, count(*) FILTER (WHERE strlen(text) < 10) AS too_small, CAST(sum(CASE WHEN strlen(text) >= 10 THEN strlen(text) END) AS BIGINT) AS bytes
FROM @documents""")
def minimum_size(spark, d):
    from fairlake.operators.files import large_enough
    f = view(spark, d, "files").select("size_bytes", large_enough("size_bytes").alias("ok"))
    return f.agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("too_small"),
                 F.sum(F.when(F.col("ok"), F.col("size_bytes"))).cast("bigint").alias("bytes"))


@query("b18_fact_completeness", """
SELECT doc_id, CASE WHEN coalesce(fn, '') = '' THEN 'file_name' WHEN coalesce(fp, '') = '' THEN 'file_path'
  WHEN coalesce(sz, 0) = 0 THEN 'file_size_bytes' WHEN coalesce(ck, '') = '' THEN 'checksum' END AS missing FROM (
  SELECT doc_id, CASE WHEN doc_id % 6 <> 0 THEN parse_filename(path) END AS fn, CASE doc_id % 7 WHEN 0 THEN '' ELSE path END AS fp,
    CASE WHEN doc_id % 5 = 0 THEN 0 ELSE size_bytes END AS sz, CASE WHEN doc_id % 4 <> 0 THEN md5(content) END AS ck FROM $files f) x""")
def fact_completeness(spark, d):
    from fairlake.operators.files import file_fact_error
    f = view(spark, d, "files").select(
        "doc_id",
        F.when(F.col("doc_id") % 6 != 0, P.base_name("path")).alias("file_name"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("path")).alias("file_path"),
        F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("size_bytes")).alias("file_size_bytes"),
        F.when(F.col("doc_id") % 4 != 0, F.md5("content")).alias("checksum"))
    return f.select("doc_id", file_fact_error().alias("missing"))


@query("b19_humanize", """
SELECT record_key, array_to_string(list_transform(list_filter(string_split(replace(name, '_', ' '), ' '), lambda w: w <> ''),
  lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label
FROM (SELECT record_key, metadata_type || '__' || replace(record_key, ':', '_X_') AS name FROM $records r) x""")
def humanize(spark, d):
    name = F.concat("metadata_type", F.lit("__"), F.replace("record_key", F.lit(":"), F.lit("_X_")))
    return view(spark, d, "records").select("record_key", P.humanize(name).alias("label"))


@query("b20_uuid_like", """
SELECT record_key, coalesce(regexp_full_match(raw ->> '$.experiment_identifier_run_id', '[0-9a-fA-F-]{36}'), false) AS uuid_like
FROM $contextual c""")
def uuid_like(spark, d):
    run_id = F.try_variant_get(F.parse_json("raw"), "$.experiment_identifier_run_id", "string")
    return view(spark, d, "contextual").select("record_key", P.is_uuid_like(run_id).alias("uuid_like"))


@query("b21_format_policy", """
SELECT doc_id, list_contains(['jpg','jpeg','png','tiff','tif','pdf','txt','csv','json','xml'], lower(regexp_extract(path, '\\.([^./]+)$', 1)))
  AND size_bytes <= 4000 AS accepted FROM $files f""")
def format_policy(spark, d):
    formats = ["jpg", "jpeg", "png", "tiff", "tif", "pdf", "txt", "csv", "json", "xml"]
    return view(spark, d, "files").select(
        "doc_id", P.policy_ok(P.extension("path"), "size_bytes", formats, 4000).alias("accepted"))


@query("b22_ignore_globs", """
SELECT doc_id, (parse_filename(path) GLOB '*.tmp' OR parse_filename(path) GLOB '*.log' OR parse_filename(path) GLOB 'doc_1?.csv') AS matched
FROM $files f""")
def ignore_globs(spark, d):
    return view(spark, d, "files").select(
        "doc_id", P.matches_glob("path", ["*.tmp", "*.log", "doc_1?.csv"]).alias("matched"))


@query("b23_client_identity", """
SELECT event_id, CASE WHEN fwd <> '' THEN trim(regexp_extract(fwd, '^[^,]*')) WHEN real_ip <> '' THEN real_ip WHEN peer IS NULL THEN 'unknown' ELSE peer END AS client
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' 10.0.0.' || user_id || ' , 10.1.1.1' WHEN 1 THEN '' END AS fwd,
  CASE event_id % 3 WHEN 0 THEN '10.2.0.' || user_id WHEN 1 THEN '' END AS real_ip,
  CASE WHEN event_id % 5 <> 0 THEN '10.3.0.' || user_id END AS peer FROM @events) x""")
def client_identity(spark, d):
    e, uid = F.col("event_id"), F.col("user_id").cast("string")
    fwd = F.when(e % 4 == 0, F.concat(F.lit(" 10.0.0."), uid, F.lit(" , 10.1.1.1"))).when(e % 4 == 1, "")
    real = F.when(e % 3 == 0, F.concat(F.lit("10.2.0."), uid)).when(e % 3 == 1, "")
    peer = F.when(e % 5 != 0, F.concat(F.lit("10.3.0."), uid))
    return table(spark, d, "events").select("event_id", P.client_id(fwd, real, peer).alias("client"))
