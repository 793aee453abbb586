"""Content hashing, scanners and manifests over derived file trees."""

from pyspark.sql import functions as F

from fairlake.functions import paths as P
from fairlake.operators import files as S
from fairlake.operators import manifest as M
from fairlake.plans.registry import query, table, view

RUN_TS = "2024-03-01T00:00:00"

_EXT = "regexp_extract(parse_filename(path), '^.+(\\.[^.]+)$', 1)"


@query("c01_checksums", """
SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM @documents""")
def checksums(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", *[S.checksum("text", a).alias(a) for a in ("sha256", "sha1", "md5")])


@query("c03_pluggable_scanner", f"""
SELECT path, strlen(content) AS size_bytes, {_EXT} AS extension, md5(content) AS checksum FROM $files f""")
def pluggable_scanner(spark, d):
    import hashlib

    def scan(row):
        data = row["content"].encode()
        name = row["path"].rsplit("/", 1)[-1]
        dot = name.rfind(".")
        return {"size_bytes": len(data), "checksum": hashlib.md5(data).hexdigest(),
                "extension": name[dot:] if 0 < dot < len(name) - 1 else ""}

    return S.apply_scanner(view(spark, d, "files").select("path", "content"), scan).select(
        "path", "size_bytes", "extension", "checksum")


@query("c04_standardize_facts", f"""
SELECT path, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE size_bytes END AS size_bytes, {_EXT} AS extension,
  'application/octet-stream' AS mime_type, 'unknown' AS encoding, '-rw-r--r--' AS permissions, '{RUN_TS}' AS accessed_time,
  '{RUN_TS}' AS created_time, modified_time, '' AS checksum, coalesce(owner, 'unknown') AS owner, 'unknown' AS "group",
  'none' AS compression, 'none' AS encryption FROM $files f""")
def standardize_facts(spark, d):
    facts = view(spark, d, "files").select(
        "path", F.when(F.col("doc_id") % 5 != 0, F.col("size_bytes")).cast("bigint").alias("size_bytes"), "modified_time", "owner")
    return S.standardize(facts, RUN_TS)


@query("c05_scan_failures", """
SELECT path, CASE WHEN lang = 'en' THEN strlen(content) ELSE 0 END AS size_bytes,
  CASE WHEN lang = 'en' THEN md5(content) ELSE '' END AS checksum FROM $files f""")
def scan_failures(spark, d):
    import hashlib

    def scan(row):
        if row["lang"] != "en":
            raise OSError("unreadable")
        data = row["content"].encode()
        return {"size_bytes": len(data), "checksum": hashlib.md5(data).hexdigest()}

    return S.apply_scanner(view(spark, d, "files").select("path", "lang", "content"), scan).select(
        "path", "size_bytes", "checksum")


def _manifest(spark, d):
    files = view(spark, d, "files").withColumn("created_time", F.col("modified_time"))
    facts = S.scan_content(files, RUN_TS)
    dataset = F.regexp_extract("path", "^(/data/[^/]+/[^/]+)", 1)
    return M.to_manifest(facts.withColumn("dataset_path", dataset), RUN_TS)


@query("d01_manifest_rows", f"""
SELECT dataset_path AS dataset_id, parse_filename(path) AS file_name, 'raw_data' AS role, replace(path, dataset_path || '/', '') AS file_path,
  ltrim({_EXT}, '.') AS file_extension, strlen(content) AS file_size_bytes, sha256(content) AS checksum, 'SHA256' AS checksum_algorithm,
  'file' AS file_type_os, modified_time AS file_modified_utc, modified_time AS file_created_utc, '{RUN_TS}' AS file_accessed_utc,
  coalesce(owner, 'unknown') AS file_owner, 'unknown' AS file_group, 'unknown' AS file_encoding, 'none' AS file_encryption,
  CASE {_EXT} WHEN '.gz' THEN 'gzip' WHEN '.7z' THEN '7zip' ELSE 'none' END AS file_compression,
  CASE lower({_EXT}) WHEN '.txt' THEN 'text/plain' WHEN '.csv' THEN 'text/csv' WHEN '.json' THEN 'application/json' WHEN '.gz' THEN 'application/gzip'
    WHEN '.png' THEN 'image/png' WHEN '.md' THEN 'text/markdown' ELSE 'application/octet-stream' END AS file_mime_type,
  'validated' AS file_validation_status, '{RUN_TS}' AS file_processing_date FROM $files f""")
def manifest_rows(spark, d):
    return _manifest(spark, d).drop("file_permissions")


_CUR = """SELECT dataset_path AS dataset_id, parse_filename(path) AS file_name, min(size_bytes) AS file_size_bytes, min(md5(content)) AS checksum,
  max(CASE WHEN l.toxic = 1 THEN 'seen ' || f.doc_id END) AS file_description, min(owner) AS file_owner
  FROM $files f JOIN @labels l ON f.doc_id = l.doc_id GROUP BY ALL"""


def _current_and_new(spark, d):
    f = view(spark, d, "files").withColumn("file_name", P.base_name("path")).withColumnRenamed("dataset_path", "dataset_id")
    current = f.join(table(spark, d, "labels"), "doc_id").groupBy("dataset_id", "file_name").agg(
        F.min("size_bytes").alias("file_size_bytes"), F.min(F.md5("content")).alias("checksum"),
        F.max(F.when(F.col("toxic") == 1, F.concat(F.lit("seen "), "doc_id"))).alias("file_description"),
        F.min("owner").alias("file_owner"))
    new = f.select("dataset_id", "file_name", F.col("size_bytes").alias("file_size_bytes"),
                   F.md5("content").alias("checksum"), F.col("owner").alias("file_owner"), "doc_id")
    return current, new


@query("d02_upsert_manifest", f"""
WITH cur AS ({_CUR}),
new AS (SELECT dataset_path AS dataset_id, parse_filename(path) AS file_name, arg_max(size_bytes, doc_id) AS s, arg_max(md5(content), doc_id) AS c,
  arg_max(owner, doc_id) FILTER (WHERE owner IS NOT NULL) AS o FROM $files f GROUP BY ALL)
SELECT coalesce(n.dataset_id, c.dataset_id) AS dataset_id, coalesce(n.file_name, c.file_name) AS file_name,
  coalesce(s, file_size_bytes) AS file_size_bytes, coalesce(n.c, checksum) AS checksum, file_description, coalesce(o, file_owner) AS file_owner
FROM cur c FULL JOIN new n ON c.dataset_id = n.dataset_id AND c.file_name = n.file_name""")
def upsert_manifest(spark, d):
    current, new = _current_and_new(spark, d)
    return M.upsert_manifest(current, new, order=["doc_id"])


@query("d03_insert_if_absent", f"""
WITH cur AS ({_CUR}),
new AS (SELECT dataset_path AS dataset_id, parse_filename(path) AS file_name, size_bytes, md5(content) AS c, owner,
  row_number() OVER (PARTITION BY dataset_path, parse_filename(path) ORDER BY doc_id) AS rn FROM $files f)
SELECT dataset_id, file_name, file_size_bytes, checksum, file_description, file_owner FROM cur
UNION ALL SELECT dataset_id, file_name, size_bytes, c, NULL, owner FROM new n WHERE rn = 1
  AND NOT EXISTS (SELECT 1 FROM cur c WHERE c.dataset_id = n.dataset_id AND c.file_name = n.file_name)""")
def insert_if_absent(spark, d):
    current, new = _current_and_new(spark, d)
    return M.append_new(current, new, order=["doc_id"])


def _joined(df):
    return df.withColumn("file_types", F.array_join("file_types", ","))


@query("d04_dataset_rollup", """
SELECT dataset_id, count(*) AS file_count, CAST(sum(file_size_bytes) AS BIGINT) AS total_size_bytes,
  string_agg(DISTINCT file_extension, ',' ORDER BY file_extension) AS file_types FROM $tree_files t GROUP BY dataset_id""")
def dataset_rollup(spark, d):
    return _joined(M.summarize_manifest(view(spark, d, "tree_files")))


@query("d05_dataset_summary", """
WITH live AS (SELECT dataset_id, count(*) AS n FROM $tree_files t GROUP BY ALL),
stored AS (SELECT dataset_id, count(*) AS file_count, CAST(sum(file_size_bytes) AS BIGINT) AS total_size_bytes,
  string_agg(DISTINCT file_extension, ',' ORDER BY file_extension) AS file_types
  FROM $tree_files t WHERE l_linestatus = 'F' GROUP BY dataset_id)
SELECT d.project_key || '/' || d.dataset_key AS dataset_id, coalesce(s.file_count, l.n, 0) AS file_count,
  coalesce(s.total_size_bytes, 0) AS total_size_bytes, coalesce(s.file_types, '') AS file_types
FROM $dataset_dirs d LEFT JOIN live l ON l.dataset_id = d.project_key || '/' || d.dataset_key
LEFT JOIN stored s ON s.dataset_id = l.dataset_id""")
def dataset_summary(spark, d):
    tree = view(spark, d, "tree_files")
    rollup = M.summarize_manifest(tree.where("l_linestatus = 'F'"))
    datasets = view(spark, d, "dataset_dirs").select(F.concat_ws("/", "project_key", "dataset_key").alias("dataset_id"))
    return _joined(M.dataset_summary(datasets, tree, rollup))


@query("d06_append_uploads", """
SELECT dataset_path AS dataset_id, parse_filename(path) AS file_name, 'uploaded_file' AS role, '.metadata/' || parse_filename(path) AS file_path,
  coalesce(owner, '') AS file_description, ltrim(regexp_extract(parse_filename(path), '^.+(\\.[^.]+)$', 1), '.') AS file_extension, size_bytes AS file_size_bytes,
  'file' AS file_type_os, modified_time AS file_created_utc, modified_time AS file_modified_utc FROM $files f
UNION ALL SELECT dataset_id, file_name, 'raw_data', file_name, NULL, file_extension, file_size_bytes, 'file', NULL, NULL FROM $tree_files t""")
def append_uploads(spark, d):
    manifest = view(spark, d, "tree_files").select(
        "dataset_id", "file_name", F.lit("raw_data").alias("role"), F.col("file_name").alias("file_path"),
        "file_extension", "file_size_bytes", F.lit("file").alias("file_type_os"))
    uploads = view(spark, d, "files").select(
        F.col("dataset_path").alias("dataset_id"), P.base_name("path").alias("file_name"), F.col("owner").alias("comment"),
        "size_bytes", F.col("modified_time").alias("uploaded_at"))
    return M.append_uploads(manifest, uploads)


_UPLOADS = "SELECT page_id AS seq, 'd_' || (page_id % 3) AS dataset_id, split_part(url, '/', 4) || '.html' AS file_name, strlen(html) AS size_bytes, url FROM @pages"
_TAKEN = """SELECT DISTINCT 'd_' || (page_id % 2) AS dataset_id,
  split_part(url, '/', 4) || CASE WHEN page_id % 40 = 0 THEN '' ELSE '_' || (page_id * 7 % 40) END || '.html' AS file_name FROM @pages"""
_ALLOCATED = f"""
WITH up AS ({_UPLOADS}), taken AS ({_TAKEN}),
used AS (SELECT dataset_id, split_part(split_part(file_name, '.', 1), '_', 1) || '.html' AS file_name,
  list(CASE WHEN contains(file_name, '_') THEN CAST(split_part(split_part(file_name, '.', 1), '_', 2) AS BIGINT) ELSE 0 END) AS nums FROM taken GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, file_name ORDER BY seq) AS k FROM up),
slot AS (SELECT k.*, list_filter(range(0, k + coalesce(len(nums), 0)), lambda x: NOT list_contains(coalesce(nums, []), x))[k] AS s
  FROM k LEFT JOIN used u ON k.dataset_id = u.dataset_id AND k.file_name = u.file_name),
named AS (SELECT *, CASE WHEN s = 0 THEN file_name ELSE split_part(file_name, '.', 1) || '_' || s || '.html' END AS stored_name FROM slot)
"""


def _uploads(spark, d):
    pages = table(spark, d, "pages")
    lang = F.split_part("url", F.lit("/"), F.lit(4))
    up = pages.select(F.col("page_id").alias("seq"), F.concat(F.lit("d_"), F.col("page_id") % 3).alias("dataset_id"),
                      F.concat(lang, F.lit(".html")).alias("file_name"),
                      F.octet_length("html").cast("bigint").alias("size_bytes"), "url")
    number = F.when(F.col("page_id") % 40 == 0, "").otherwise(F.concat(F.lit("_"), F.col("page_id") * 7 % 40))
    taken = pages.select(F.concat(F.lit("d_"), F.col("page_id") % 2).alias("dataset_id"),
                         F.concat(lang, number, F.lit(".html")).alias("file_name")).distinct()
    return up, taken


@query("d07_unique_names", _ALLOCATED + "SELECT seq, dataset_id, file_name, stored_name FROM named")
def unique_names(spark, d):
    up, taken = _uploads(spark, d)
    return M.dedupe_names(up, taken).select("seq", "dataset_id", "file_name", "stored_name")


@query("a09_ingest_uploads", _ALLOCATED + """SELECT dataset_id, stored_name AS file_name, 'uploaded_file' AS role, '.metadata/' || stored_name AS file_path,
  url AS file_description, 'html' AS file_extension, size_bytes AS file_size_bytes, '2024-03-01' AS file_created_utc FROM named
UNION ALL SELECT dataset_id, file_name, 'raw_data', file_name, NULL, 'html', 0, NULL FROM taken""")
def ingest_uploads(spark, d):
    up, taken = _uploads(spark, d)
    manifest = taken.select("dataset_id", "file_name", F.lit("raw_data").alias("role"), F.col("file_name").alias("file_path"),
                            F.lit("html").alias("file_extension"), F.lit(0).cast("bigint").alias("file_size_bytes"))
    up = up.withColumn("comment", F.col("url")).withColumn("uploaded_at", F.lit("2024-03-01"))
    return M.ingest_uploads(up, manifest, taken).select(
        "dataset_id", "file_name", "role", "file_path", "file_description", "file_extension", "file_size_bytes", "file_created_utc")


_ROOTS = """SELECT dataset_path AS root FROM $files f JOIN @labels l ON f.doc_id = l.doc_id WHERE l.quality = 1
  UNION SELECT '/data/' || project_key FROM $files f WHERE lang = 'fr'
  UNION SELECT dataset_path || '/deep' FROM $files f"""


def _roots(spark, d):
    f = view(spark, d, "files")
    labelled = f.join(table(spark, d, "labels").where("quality = 1"), "doc_id").select(F.col("dataset_path").alias("root"))
    projects = f.where("lang = 'fr'").select(F.concat(F.lit("/data/"), "project_key").alias("root"))
    return labelled.union(projects).union(f.select(F.concat("dataset_path", F.lit("/deep")).alias("root"))).distinct()


_NEAREST = f"""SELECT f.doc_id, f.path, f.size_bytes, arg_max(root, length(root)) AS dataset_root FROM $files f
  LEFT JOIN ({_ROOTS}) r ON starts_with(f.path, r.root || '/') GROUP BY ALL"""


@query("d08_nearest_dataset_root", f"SELECT doc_id, path, dataset_root FROM ({_NEAREST}) n")
def nearest_dataset_root(spark, d):
    return M.nearest_root(view(spark, d, "files").select("doc_id", "path"), _roots(spark, d))


@query("d09_ingest_outcomes", f"""
SELECT doc_id, CASE WHEN reason IS NULL THEN 'processed' ELSE 'skipped' END AS status, reason FROM (
SELECT doc_id, CASE WHEN dataset_root IS NULL THEN 'no_dataset'
  WHEN regexp_matches(path, 'env|build|~|\\.git|\\.tmp|\\.bak') OR (contains(path, '.metadata') AND regexp_matches(path, '\\.(txt|json|md)$')) THEN 'ignored'
  WHEN size_bytes < 10 THEN 'too_small' END AS reason FROM ({_NEAREST}) n) x""")
def ingest_outcomes(spark, d):
    placed = M.nearest_root(view(spark, d, "files").select("doc_id", "path", "size_bytes"), _roots(spark, d))
    return M.ingest_outcomes(placed).select("doc_id", "status", "reason")


@query("d10_dataset_files", """
SELECT file_name, file_size_bytes, l_linenumber FROM $tree_files t WHERE dataset_id = (
  SELECT min(project_key || '/' || dataset_key) FROM $dataset_dirs d WHERE o_orderstatus = 'F')""")
def dataset_files(spark, d):
    chosen = view(spark, d, "dataset_dirs").where("o_orderstatus = 'F'").agg(
        F.min(F.concat_ws("/", "project_key", "dataset_key"))).scalar()
    return M.dataset_files(view(spark, d, "tree_files"), chosen).select("file_name", "file_size_bytes", "l_linenumber")
