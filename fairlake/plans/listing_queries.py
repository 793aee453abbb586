"""Project and dataset listings over a tree derived from customers, orders and line items."""

from pyspark.sql import functions as F

from fairlake.operators import listings as L
from fairlake.plans.registry import query, table, view

_RECORDS = """SELECT project_key, dataset_key, 'complete_metadata' AS metadata_type FROM $dataset_dirs a WHERE o_orderstatus = 'F'
  UNION ALL SELECT project_key, dataset_key, 'dataset_structural' FROM $dataset_dirs b WHERE EXISTS (SELECT 1 FROM @lineitem l WHERE l.l_orderkey = b.o_orderkey)
  UNION ALL SELECT project_key, dataset_key, 'dataset_administrative' FROM $dataset_dirs c WHERE o_orderpriority < '4'
  UNION ALL SELECT project_key, '', 'project_descriptive' FROM $project_dirs e WHERE c_mktsegment <> 'BUILDING'"""


def _records(spark, d):
    dirs = view(spark, d, "dataset_dirs")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))

    def typed(df, kind):
        return df.select("project_key", "dataset_key", F.lit(kind).alias("metadata_type"))

    projects = view(spark, d, "project_dirs").where("c_mktsegment <> 'BUILDING'").withColumn("dataset_key", F.lit(""))
    return (
        typed(dirs.where("o_orderstatus = 'F'"), "complete_metadata")
        .unionAll(typed(dirs.join(lines, "o_orderkey", "left_semi"), "dataset_structural"))
        .unionAll(typed(dirs.where("o_orderpriority < '4'"), "dataset_administrative"))
        .unionAll(typed(projects, "project_descriptive"))
    )


_STATUS = f"""SELECT d.*, coalesce(s.status, 'V0_Initial') AS metadata_status FROM $dataset_dirs d LEFT JOIN (
  SELECT project_key, dataset_key, CASE max(CASE metadata_type WHEN 'complete_metadata' THEN 2 WHEN 'dataset_structural' THEN 1 ELSE 0 END)
    WHEN 2 THEN 'V2_Finalized' WHEN 1 THEN 'V1_Ingested' ELSE 'V0_Initial' END AS status FROM ({_RECORDS}) r GROUP BY ALL) s
  ON d.project_key = s.project_key AND d.dataset_key = s.dataset_key"""


@query("h01_list_projects", """
SELECT p.project_key AS project_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS project_title, '/data/' || p.project_key AS path,
  count(*) FILTER (WHERE dataset_key IS NOT NULL AND dataset_key NOT LIKE '.%') AS folder_count, count(*) FILTER (WHERE starts_with(dataset_key, 'd_')) AS dataset_count
FROM $project_dirs p LEFT JOIN $dataset_dirs d ON p.project_key = d.project_key GROUP BY ALL""")
def list_projects(spark, d):
    projects = view(spark, d, "project_dirs")
    titles = projects.where("c_mktsegment <> 'BUILDING'").select("project_key", F.col("c_name").alias("project_title"))
    return L.list_projects(projects.select("project_key"), view(spark, d, "dataset_dirs"), titles, "/data")


@query("h02_list_datasets", f"""
SELECT project_key, dataset_key AS dataset_id, CASE WHEN o_orderpriority < '3' THEN 'Order ' || o_orderkey END AS dataset_title,
  '/data/' || project_key || '/' || dataset_key AS path, metadata_status FROM ({_STATUS}) s WHERE starts_with(dataset_key, 'd_')""")
def list_datasets(spark, d):
    dirs = view(spark, d, "dataset_dirs")
    titles = dirs.where("o_orderpriority < '3'").select(
        "project_key", "dataset_key", F.concat(F.lit("Order "), "o_orderkey").alias("dataset_title"))
    return L.list_datasets(dirs, _records(spark, d), titles, "/data")


@query("h03_metadata_status", f"SELECT project_key, dataset_key, metadata_status FROM ({_STATUS}) s")
def metadata_status(spark, d):
    return L.metadata_status(view(spark, d, "dataset_dirs"), _records(spark, d)).select("project_key", "dataset_key", "metadata_status")


@query("h15_status_label", f"""
SELECT dataset_key, CASE metadata_status WHEN 'V2_Finalized' THEN 'V2: Finalised' WHEN 'V1_Ingested' THEN 'V1: Ingested' ELSE 'V0: Initial' END AS label
FROM ({_STATUS}) s""")
def status_label(spark, d):
    status = L.metadata_status(view(spark, d, "dataset_dirs"), _records(spark, d))
    return status.select("dataset_key", L.status_label("metadata_status").alias("label"))


@query("e11_project_id_fallback", """
SELECT d.dataset_key, d.project_key, CASE WHEN c_mktsegment = 'BUILDING' OR c_custkey % 5 = 0 THEN d.project_key ELSE md5(c_name) END AS project_id
FROM $dataset_dirs d LEFT JOIN $project_dirs p ON d.project_key = p.project_key""")
def project_id_fallback(spark, d):
    ids = view(spark, d, "project_dirs").where("c_mktsegment <> 'BUILDING'").select(
        "project_key", F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.md5("c_name")).alias("project_identifier"))
    return L.resolve_project_id(view(spark, d, "dataset_dirs").select("project_key", "dataset_key"), ids)


@query("e12_missing_records", f"""
WITH wanted AS (SELECT project_key, '' AS dataset_key, 'project_descriptive' AS metadata_type FROM $project_dirs p
  UNION ALL SELECT project_key, dataset_key, t FROM $dataset_dirs d, (VALUES ('dataset_administrative'), ('dataset_structural')) k(t) WHERE dataset_key NOT LIKE '.%')
SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM ({_RECORDS}) r WHERE r.project_key = w.project_key AND r.dataset_key = w.dataset_key
  AND r.metadata_type = w.metadata_type)""")
def missing_records(spark, d):
    return L.missing_records(view(spark, d, "project_dirs"), view(spark, d, "dataset_dirs"), _records(spark, d))


@query("catalog_report", f"""
WITH st AS (SELECT project_key, count(*) AS datasets, count(*) FILTER (WHERE metadata_status = 'V0_Initial') AS initial,
    count(*) FILTER (WHERE metadata_status = 'V1_Ingested') AS ingested, count(*) FILTER (WHERE metadata_status = 'V2_Finalized') AS finalized
  FROM ({_STATUS}) s WHERE starts_with(dataset_key, 'd_') GROUP BY project_key),
fl AS (SELECT project_key, count(*) AS files, CAST(sum(file_size_bytes) AS BIGINT) AS bytes, string_agg(DISTINCT file_extension, ',' ORDER BY file_extension) AS extensions
  FROM $tree_files t WHERE starts_with(dataset_key, 'd_') GROUP BY project_key)
SELECT p.project_key, coalesce(datasets, 0) AS datasets, coalesce(initial, 0) AS initial, coalesce(ingested, 0) AS ingested, coalesce(finalized, 0) AS finalized,
  coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, coalesce(extensions, '') AS extensions
FROM $project_dirs p LEFT JOIN st ON p.project_key = st.project_key LEFT JOIN fl ON p.project_key = fl.project_key""")
def catalog_report(spark, d):
    return L.catalog_report(view(spark, d, "project_dirs").select("project_key"), view(spark, d, "dataset_dirs"),
                            view(spark, d, "tree_files"), _records(spark, d))
