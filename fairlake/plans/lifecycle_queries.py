"""Ingest of record files, retention, migration and prefilled values, beside the SQL that must give the same rows."""

from pyspark.sql import functions as F

from fairlake.operators import lifecycle as L
from fairlake.operators import quality as Q
from fairlake.plans.record_queries import TS
from fairlake.plans.registry import ORACLES, query, table, view
from fairlake.plans.validation_queries import _records
from fairlake.session import shared_dir
from fairlake.sources import ingest_catalog as I

_PROJECTS = "SELECT record_key, project_key, metadata_type, raw FROM $project_descriptive a UNION ALL SELECT record_key, project_key, metadata_type, raw FROM $project_admin b"


def _writer(root):
    """Writes a file per record, in the tasks."""
    def write(batches):
        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            for kind, name, raw in zip(batch["kind"], batch["name"], batch["raw"]):
                system, inner = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
                system.create_dir(f"{inner}/{kind}", recursive=True)
                with system.open_output_stream(f"{inner}/{kind}/{name}.json") as out:
                    out.write(raw.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return write


@query("l01_ingest_catalog", f"""
SELECT replace(record_key, ':', '/') AS record_key, sha256(CASE WHEN second THEN raw2 ELSE raw END) AS digest, CASE WHEN second THEN 'b' ELSE 'a' END AS root,
  CAST(CASE WHEN second THEN 2 ELSE 1 END AS BIGINT) AS copies, json_valid(CASE WHEN second THEN raw2 ELSE raw END) AS readable, 0 AS read_again
FROM (SELECT *, length(project_key) % 2 = 0 AS second, CASE WHEN record_key LIKE 'pra%' THEN raw || '}}' ELSE replace(raw, 'P', 'Q') END AS raw2 FROM ({_PROJECTS}) p) x""")
def ingest_catalog(spark, d):
    base = shared_dir(spark, "ingest")
    rows = view(spark, d, "project_descriptive").unionByName(view(spark, d, "project_admin")).select("record_key", "project_key", "raw")
    kind, name = F.split_part("record_key", F.lit(":"), F.lit(1)), F.split_part("record_key", F.lit(":"), F.lit(2))

    def write(df, root):
        df.select(kind.alias("kind"), name.alias("name"), "raw").mapInPandas(_writer(root), "n long").agg(F.sum("n")).collect()

    other = F.when(F.col("record_key").startswith("pra"), F.concat("raw", F.lit("}"))).otherwise(F.replace("raw", F.lit("P"), F.lit("Q")))
    write(rows, f"{base}/a")
    write(rows.where(F.length("project_key") % 2 == 0).withColumn("raw", other), f"{base}/b")
    roots = [f"{base}/a", f"{base}/b"]
    I.ingest_catalog(spark, roots, f"{base}/catalog", 8)
    again = I.ingest_catalog(spark, roots, f"{base}/catalog", 8)
    return I.catalog_records(spark, f"{base}/catalog").select(
        "record_key", "digest", F.substring_index("root", "/", -1).alias("root"), "copies", F.col("body").isNotNull().alias("readable"), F.lit(again).alias("read_again"))


_SCHEDULE = """CASE o_orderkey % 9 WHEN 0 THEN '10 years' WHEN 1 THEN 'P5Y6M' WHEN 2 THEN 'indefinitely' WHEN 3 THEN '18 Months' WHEN 4 THEN '5 yrs and 3 months'
  WHEN 5 THEN 'P1Y2M10D' WHEN 6 THEN 'until ' || o_orderpriority WHEN 7 THEN '90 days' ELSE ' ' END"""


@query("l06_retention_due", f"""
WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start_date, {_SCHEDULE} AS schedule FROM @orders),
d AS (SELECT *, CASE o_orderkey % 9 WHEN 0 THEN 120 WHEN 1 THEN 66 WHEN 3 THEN 18 WHEN 4 THEN 63 WHEN 5 THEN 14 WHEN 7 THEN 0 END AS months,
  CASE o_orderkey % 9 WHEN 5 THEN 10 WHEN 7 THEN 90 ELSE 0 END AS days,
  CASE o_orderkey % 9 WHEN 2 THEN 'unlimited' WHEN 6 THEN 'unknown' WHEN 8 THEN 'none' ELSE 'limited' END AS retention FROM r),
e AS (SELECT o_orderkey, retention, CAST(start_date + to_months(months) AS DATE) + days AS due_date FROM d)
SELECT o_orderkey, retention, strftime(due_date, '%Y-%m-%d') AS due_date, coalesce(due_date <= DATE '2002-06-30', false) AS due FROM e""")
def retention_due(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("start_date"), F.expr(_SCHEDULE).alias("schedule"))
    due = L.retention_due(orders, F.lit("2002-06-30").cast("date"))
    return due.select("o_orderkey", "retention", F.date_format("due_date", "yyyy-MM-dd").alias("due_date"), "due")


STEPS = [
    L.Step("dataset_structural", "1", "2", rename={"dataset_title": "title"}, default={"language": '"en"'}),
    L.Step("dataset_structural", "2", "3", convert={"n": "bigint"}, drop=("dataset_keywords",), default={"n": '"7"'}),
    L.Step("dataset_structural", "1", "1b"), L.Step("dataset_structural", "1b", "2"), L.Step("dataset_structural", "3", "4"),
]


@query("l07_migrate", """
SELECT record_key, CASE v WHEN '0' THEN '0' ELSE '3' END AS migrated_version,
  CASE v WHEN '1' THEN raw ->> '$.dataset_title' ELSE NULL END AS title, CASE WHEN v = '0' OR v = '3' THEN raw ->> '$.dataset_title' WHEN v = '2' THEN raw ->> '$.dataset_title' END AS dataset_title,
  CASE WHEN v = '1' THEN 'en' END AS language, CASE WHEN v IN ('1', '2') THEN '7' END AS n,
  v IN ('0', '3') AND json_extract(raw, '$.dataset_keywords') IS NOT NULL AS has_keywords, CASE WHEN v = '0' THEN 'no way to 3' ELSE '' END AS problems
FROM (SELECT *, CAST(doc_id % 4 AS VARCHAR) AS v FROM $dataset_structural s) x""")
def migrate(spark, d):
    rows = view(spark, d, "dataset_structural").select("record_key", F.col("metadata_type").alias("schema_id"), (F.col("doc_id") % 4).cast("string").alias("version"),
                                                       F.parse_json("raw").alias("body"))
    done = L.migrate(rows, STEPS, {"dataset_structural": "3"})
    get = lambda n: F.try_variant_get("body", f"$.{n}", "string").alias(n)
    return done.select("record_key", "migrated_version", get("title"), get("dataset_title"), get("language"), get("n"),
                       F.try_variant_get("body", "$.dataset_keywords", "variant").isNotNull().alias("has_keywords"), F.array_join("problems", ",").alias("problems"))


_SAMPLES = """SELECT 's' || (s_suppkey % 7) AS sample_id, CASE n_regionkey % 2 WHEN 0 THEN 'lims' ELSE 'biobank' END AS source, n_regionkey % 2 AS precedence,
  CAST(DATE '2024-01-01' + CAST(s_suppkey % 28 AS INT) AS DATE) AS valid_from, CASE WHEN s_suppkey % 3 <> 0 THEN 'Platform ' || s_suppkey END AS sequencing_platform,
  'Title ' || s_nationkey AS experiment_title FROM @supplier JOIN @nation ON s_nationkey = n_nationkey"""
_FIELDS = ("sequencing_platform", "experiment_title")


@query("l08_prefill", f"""
WITH r AS (SELECT record_key, raw, 's' || (doc_id % 9) AS sample_id, CAST(DATE '2024-01-01' + CAST(doc_id % 40 AS INT) AS DATE) AS day FROM $contextual c),
s AS ({_SAMPLES}),
b AS (SELECT record_key, f.field, f.value, source, precedence, valid_from FROM r JOIN s ON r.sample_id = s.sample_id AND valid_from <= day,
  unnest([{{'field': 'sequencing_platform', 'value': sequencing_platform}}, {{'field': 'experiment_title', 'value': experiment_title}}]) u(f) WHERE f.value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY record_key, f.field ORDER BY precedence, valid_from DESC, f.value DESC, source DESC) = 1),
o AS (SELECT record_key, field, raw ->> ('$.' || field) AS own, coalesce(json_type(raw, '$.' || field), 'NULL') AS kind FROM r, unnest(['sequencing_platform', 'experiment_title']) u(field))
SELECT o.record_key, o.field, CASE WHEN empty AND value IS NOT NULL THEN value ELSE own END AS value, CASE WHEN empty THEN source END AS source
FROM (SELECT *, kind = 'NULL' OR trim(own) = '' OR own = 'To be filled' AS empty FROM o) o LEFT JOIN b ON b.record_key = o.record_key AND b.field = o.field""")
def prefill(spark, d):
    rows = view(spark, d, "contextual").select("record_key", F.expr("'s' || (doc_id % 9)").alias("sample_id"),
                                               F.expr("date_add(DATE'2024-01-01', CAST(doc_id % 40 AS INT))").alias("experiment_date"), F.parse_json("raw").alias("body"))
    suppliers, nations = table(spark, d, "supplier"), table(spark, d, "nation")
    samples = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.expr("'s' || (s_suppkey % 7)").alias("sample_id"), F.when(F.col("n_regionkey") % 2 == 0, "lims").otherwise("biobank").alias("source"),
        (F.col("n_regionkey") % 2).alias("precedence"), F.expr("date_add(DATE'2024-01-01', CAST(s_suppkey % 28 AS INT))").alias("valid_from"),
        F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("Platform "), "s_suppkey")).alias("sequencing_platform"),
        F.concat(F.lit("Title "), "s_nationkey").alias("experiment_title"))
    done = L.prefill(rows, samples, _FIELDS)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.try_variant_get("body", f"$.{f}", "string").alias("value"),
                                        F.try_element_at("filled", F.lit(f)).alias("source")) for f in _FIELDS]))
    return done.select("record_key", each.alias("x")).select("record_key", "x.*")


_LINKS = """[{'place': 0, 'link': 'i_' || (doc_id % 5)}, {'place': 1, 'link': CASE WHEN doc_id % 3 <> 2 THEN 'i_' || ((doc_id + 2) % 5) END},
  {'place': 2, 'link': CASE WHEN doc_id % 4 = 0 THEN 'lost_' || (doc_id % 2) END}, {'place': 3, 'link': 'i_' || (doc_id % 5)}]"""


@query("l09_instruments", f"""
WITH done AS ({ORACLES["h05_finalize"]}),
links AS (SELECT project_key, dataset_key, l.link AS link, min(l.place) AS place FROM $contextual c, unnest({_LINKS}) u(l) WHERE l.link IS NOT NULL GROUP BY ALL),
inst AS (SELECT 'i_' || s_suppkey AS id, '{{"instrument_identifier":"i_' || s_suppkey || '","name":"' || s_name || '"}}' AS body FROM @supplier WHERE s_suppkey < 5 AND s_suppkey <> 3)
SELECT d.project_key, d.dataset_key, '[' || coalesce(string_agg(body, ',' ORDER BY place) FILTER (WHERE body IS NOT NULL), '') || ']' AS instruments,
  coalesce(string_agg(link, ',' ORDER BY place) FILTER (WHERE body IS NULL), '') AS unknown, CAST(5 + 1 AS INT) AS components
FROM done d LEFT JOIN links l ON l.project_key = d.project_key AND l.dataset_key = d.dataset_key LEFT JOIN inst ON id = link GROUP BY d.project_key, d.dataset_key""")
def instruments(spark, d):
    done = Q.finalize(_records(spark, d), TS)
    k = F.col("doc_id")
    name = lambda n: F.concat(F.lit("i_"), n % 5)
    links = F.array(name(k), F.when(k % 3 != 2, name(k + 2)), F.when(k % 4 == 0, F.concat(F.lit("lost_"), k % 2)), name(k))
    contextual = view(spark, d, "contextual").select("project_key", "dataset_key", F.to_variant_object(F.struct(links.alias("instrument_used_link"))).alias("body"))
    known = table(spark, d, "supplier").where("s_suppkey < 5 AND s_suppkey <> 3").select(
        F.concat(F.lit("i_"), "s_suppkey").alias("instrument_id"),
        F.to_variant_object(F.struct(F.concat(F.lit("i_"), "s_suppkey").alias("instrument_identifier"), F.col("s_name").alias("name"))).alias("body"))
    parts = F.try_variant_get(F.parse_json("document"), "$.metadata_components", "variant")
    whole = Q.with_instruments(done, contextual, known)
    return whole.select("project_key", "dataset_key", F.to_json(F.try_variant_get(parts, "$.instruments", "variant")).alias("instruments"),
                        F.array_join("unknown_instruments", ",").alias("unknown"), F.size(F.map_keys(F.try_variant_get(parts, "$", "map<string,variant>"))).alias("components"))
