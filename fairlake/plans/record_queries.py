"""Record updates, templates, gates and scores over the derived records."""

from pyspark.sql import functions as F

from fairlake.functions import variants as J
from fairlake.operators import quality as Q
from fairlake.operators import records as G
from fairlake.operators import registry as R
from fairlake.operators import templates as E
from fairlake.plans.registry import query, table, view
from fairlake.plans.validation_queries import _ALL, _NODES, _SID, _WIN, _letters, _member_rows, _records
from fairlake.sources import io

TS = "2024-03-01T00:00:00"
_OPEN = "('null', '\"\"', '0', 'false', '[]', '{}')"
_CANON = "array_to_string(list_sort(string_split({0}, '')), '')"


def _plain(v):
    return f"CASE WHEN json_type({v}) = 'DOUBLE' THEN rtrim(rtrim(CAST({v} AS VARCHAR), '0'), '.') ELSE CAST({v} AS VARCHAR) END"


@query("a03_load_records", """
SELECT record_key, json_valid(text) AS readable, CASE WHEN json_valid(text) THEN text ->> '$.dataset_title' END AS title
FROM (SELECT record_key, CASE doc_id % 6 WHEN 1 THEN raw || '}' WHEN 3 THEN '{"dataset_title": "cut' ELSE raw END AS text FROM $records r) x""")
def load_records(spark, d):
    text = F.expr("""CASE doc_id % 6 WHEN 1 THEN raw || '}' WHEN 3 THEN '{"dataset_title": "cut' ELSE raw END""")
    parsed = io.parse_records(view(spark, d, "records").select("record_key", text.alias("raw")))
    return parsed.select("record_key", "readable", J.text("body", "dataset_title").alias("title"))


@query("a05_request_log", """
SELECT event_id, line ->> '$.details.run_id' AS run_id, line ->> '$.details.endpoint' AS endpoint, line ->> '$.details.status_code' AS status_code,
  line ->> '$.details.latency_ms' AS latency_ms, line ->> '$.details.outcome' AS outcome FROM $request_lines r
WHERE json_valid(line) AND line ->> '$.name' = 'api_stresser' AND line ->> '$.message' = 'API request completed'""")
def request_log(spark, d):
    log = io.parse_request_log(view(spark, d, "request_lines"), "line")
    return log.select("event_id", "run_id", "endpoint", F.col("status_code").cast("string").alias("status_code"),
                      F.col("latency_ms").cast("string").alias("latency_ms"), "outcome")


def _updates(spark, d):
    return view(spark, d, "record_updates").withColumn("body", F.parse_json("raw"))


_MERGED = f"""SELECT record_key, key AS field, {_plain('value')} AS v FROM (
  SELECT r.record_key, e.key, e.value FROM $records r, json_each(r.raw) e
  WHERE NOT EXISTS (SELECT 1 FROM $record_updates u WHERE u.record_key = r.record_key AND list_contains(json_keys(u.raw), e.key))
  UNION ALL SELECT u.record_key, e.key, e.value FROM $record_updates u, json_each(u.raw) e) m"""


@query("g01_merge_records", f"SELECT record_key, field, {_CANON.format('v')} AS value FROM ({_MERGED}) m")
def merge_records(spark, d):
    return _member_rows(G.merge_records(_records(spark, d), _updates(spark, d)))


_STAMPS = f"""
WITH o AS (SELECT r.record_key, r.metadata_type, r.raw AS old, u.raw AS upd FROM $records r JOIN $record_updates u ON r.record_key = u.record_key),
m AS (SELECT *, coalesce(json_extract(upd, '$.created_by'), json_extract(old, '$.created_by')) AS cb, json_extract(old, '$.created_date') AS cd FROM o)
SELECT record_key, CASE WHEN NOT aud THEN CAST(cb AS VARCHAR) WHEN cb IS NULL OR CAST(cb AS VARCHAR) IN {_OPEN} THEN coalesce(CAST(json_extract(old, '$.created_by') AS VARCHAR), '"system"') ELSE CAST(cb AS VARCHAR) END AS created_by,
  CASE WHEN NOT aud THEN CAST(cd AS VARCHAR) ELSE coalesce(CAST(cd AS VARCHAR), '"{TS}"') END AS created_date,
  CASE WHEN aud THEN '"{TS}"' ELSE CAST(json_extract(old, '$.last_modified_date') AS VARCHAR) END AS last_modified_date
FROM (SELECT *, metadata_type NOT LIKE 'dataset%' AS aud FROM m) x"""


@query("g02_audit_stamps", _STAMPS)
def audit_stamps(spark, d):
    stamped = G.stamp_audit(G.merge_records(_records(spark, d), _updates(spark, d)), TS)
    return stamped.select("record_key", *[F.to_json(J.field("body", n)).alias(n) for n in ("created_by", "created_date", "last_modified_date")])


_PROTECTED = """((metadata_type = 'project_descriptive' AND field = 'project_identifier')
  OR (metadata_type = 'dataset_structural' AND field IN ('dataset_identifier', 'associated_project_identifier'))
  OR (metadata_type = 'dataset_administrative' AND field IN ('dataset_identifier_link', 'associated_project_identifier'))
  OR (metadata_type = 'experiment_contextual' AND field IN ('experiment_template_type', 'experiment_identifier_run_id', 'dataset_identifier_link')))"""


@query("g03_protected_identifiers", f"""
SELECT m.record_key, m.field, {_CANON.format(f"CASE WHEN {_PROTECTED} AND json_extract(r.raw, m.field) IS NOT NULL THEN {_plain('json_extract(r.raw, m.field)')} ELSE v END")} AS value
FROM ({_MERGED}) m JOIN $records r ON m.record_key = r.record_key""")
def protected_identifiers(spark, d):
    return _member_rows(G.protect_ids(G.merge_records(_records(spark, d), _updates(spark, d))))


_MINTED = ("substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12)")


def _mint(expr):
    return _MINTED.replace("{h}", f"sha256({expr})")


@query("g04_migrate_contextual", f"""
SELECT record_key, CASE WHEN coalesce(raw ->> '$.experiment_template_type', '') = '' AND starts_with(rid, 'exp_') AND len(p) >= 4 THEN array_to_string(p[4:], '_')
   ELSE raw ->> '$.experiment_template_type' END AS template, coalesce(raw ->> '$.experiment_name', '') AS experiment_name,
  CASE WHEN regexp_full_match(coalesce(rid, ''), '[0-9a-fA-F-]{{36}}') THEN rid ELSE {_mint("record_key")} END AS run_id
FROM (SELECT *, string_split(rid, '_') AS p FROM (SELECT *, raw ->> '$.experiment_identifier_run_id' AS rid FROM $contextual c) y) x""")
def migrate_contextual(spark, d):
    ctx = view(spark, d, "contextual").withColumn("body", F.parse_json("raw"))
    done = G.migrate_contextual(ctx)
    return done.select("record_key", J.text("body", "experiment_template_type").alias("template"),
                       J.text("body", "experiment_name").alias("experiment_name"), J.text("body", "experiment_identifier_run_id").alias("run_id"))


@query("g05_records_with_schema", f"""
WITH r AS (SELECT record_key, {_SID} AS schema_id FROM $records r)
SELECT record_key, schema_id, CASE schema_id WHEN 'project_descriptive' THEN 'Project' ELSE array_to_string(list_transform(
  string_split(replace(replace(schema_id, 'contextual/', ''), '_schema', ''), '_'), lambda w: upper(w[1]) || w[2:]), ' ') END AS schema_title, 'packaged' AS schema_source FROM r""")
def records_with_schema(spark, d):
    return G.records_with_schema(_records(spark, d), R.packaged_registry(spark)).select(
        "record_key", "schema_id", "schema_title", "schema_source")


@query("g06_record_lookup", """
SELECT record_key, md5(raw) AS raw FROM $records r WHERE (metadata_type = 'dataset_structural' AND dataset_key = 'd_' || (SELECT max(doc_id) FROM @documents))
  OR (metadata_type = 'project_descriptive' AND project_key = 'p_' || (SELECT min(source) FROM @documents))""")
def record_lookup(spark, d):
    docs = table(spark, d, "documents")
    r = view(spark, d, "records")
    newest = docs.agg(F.concat(F.lit("d_"), F.max("doc_id"))).scalar()
    first = docs.agg(F.concat(F.lit("p_"), F.min("source"))).scalar()
    found = G.get_record(r, newest, "dataset_structural").unionByName(G.get_record(r, first, "project_descriptive"))
    return found.select("record_key", F.md5("raw").alias("raw"))


_STAMPED = f"""(SELECT s.record_key, r0.metadata_type, '{{' || string_agg('"' || field || '":' || v, ',') || '}}' AS raw FROM (
  SELECT m.record_key, m.field, m.v FROM ({_MERGED}) m JOIN $records q ON q.record_key = m.record_key
    WHERE q.metadata_type LIKE 'dataset%' OR m.field NOT IN ('created_by', 'created_date', 'last_modified_by', 'last_modified_date')
  UNION ALL SELECT a.record_key, u.f, CASE u.f WHEN 'created_by' THEN a.created_by WHEN 'created_date' THEN a.created_date WHEN 'last_modified_by' THEN '"system"' ELSE '"{TS}"' END
    FROM ({_STAMPS}) a JOIN $records q ON q.record_key = a.record_key, unnest(['created_by', 'created_date', 'last_modified_by', 'last_modified_date']) u(f)
    WHERE q.metadata_type NOT LIKE 'dataset%') s JOIN $records r0 ON r0.record_key = s.record_key GROUP BY s.record_key, r0.metadata_type)"""


@query("g07_validated_updates", _NODES.replace("$records r", _STAMPED + " r") + f"""
SELECT recs.record_key, coalesce(k, 0) = 0 AS accepted, coalesce(k, 0) AS violations FROM recs
LEFT JOIN (SELECT record_key, count(*) AS k FROM ({_ALL}) a GROUP BY record_key) b ON recs.record_key = b.record_key""")
def validated_updates(spark, d):
    judged = G.judge_updates(_records(spark, d), _updates(spark, d), TS)
    return judged.select("record_key", F.col("valid").alias("accepted"), F.size("violations").cast("bigint").alias("violations"))


@query("e01_default_records", f"""
SELECT data_root, schema_id, f.key AS field, CASE f.key WHEN 'project_identifier' THEN '"To be filled"' WHEN 'dataset_identifier' THEN '"To be filled"'
  WHEN 'experiment_template_type' THEN '"To be filled"' WHEN 'my_field__name' THEN '"To be filled"' WHEN 'n' THEN '0'
  WHEN 'box' THEN '{{"cell":"To be filled","w":0.0}}' WHEN 'rows' THEN '[]' END AS value
FROM ({_WIN}) w, json_each(w.body, '$.properties') f WHERE rn = 1""")
def default_records(spark, d):
    reg = R.resolve_schemas(view(spark, d, "schema_layers"), tie=("doc_id",))
    members = F.explode(J.members("defaults")).alias("field", "value")
    return E.default_records(reg).select("data_root", "schema_id", members).withColumn("value", F.to_json("value"))


@query("e02_patterned_placeholders", f"""
SELECT 'p_' || c_custkey AS project_key, 'https://orcid.org/0000-0000-0000-0000' AS orcid, 'placeholder@example.com' AS email, 'To be filled' AS affiliation FROM @customer""")
def patterned_placeholders(spark, d):
    done = E.init_projects(view(spark, d, "project_dirs"), TS)
    person = J.field("body", "principal_investigator")
    return done.select("project_key", *[J.text(person, n).alias(n) for n in ("orcid", "email", "affiliation")])


@query("e03_init_projects", f"""
SELECT 'p_' || c_custkey AS project_key, {_mint("'p_' || c_custkey")} AS project_identifier, CAST(c_custkey AS VARCHAR) AS project_title, 'Planning' AS project_status,
  '{TS}' AS created_date, 'system' AS created_by, 17 AS fields FROM @customer""")
def init_projects(spark, d):
    done = E.init_projects(view(spark, d, "project_dirs"), TS)
    return done.select("project_key", *[J.text("body", n).alias(n) for n in ("project_identifier", "project_title", "project_status", "created_date", "created_by")],
                       F.size(J.members("body")).alias("fields"))


@query("e04_init_project_admin", f"""
SELECT 'p_' || c_custkey AS project_key, {_mint("'p_' || c_custkey")} AS project_identifier_link, 'Public' AS default_access_level, 'To be filled' AS default_license, 18 AS fields FROM @customer""")
def init_project_admin(spark, d):
    done = E.init_project_admin(E.init_projects(view(spark, d, "project_dirs"), TS), TS)
    return done.select("project_key", *[J.text("body", n).alias(n) for n in ("project_identifier_link", "default_access_level", "default_license")],
                       F.size(J.members("body")).alias("fields"))


def _new_datasets(spark, d):
    projects = E.init_projects(view(spark, d, "project_dirs"), TS)
    segment = view(spark, d, "project_dirs").select("project_key", "c_mktsegment")
    # A file may hold a table in one row group, which is one task; bodies are made in all.
    spread = projects.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "project_key")
    admins = E.init_project_admin(spread, TS).join(segment, "project_key").where("c_mktsegment <> 'MACHINERY'")
    admins = admins.withColumn("body", G.with_members(F.col("body"), {
        "default_license": F.col("c_mktsegment").cast("variant"),
        "default_anonymization_method": F.when(F.col("c_mktsegment") == "BUILDING", F.parse_json(F.lit("null")))}))
    datasets = view(spark, d, "dataset_dirs").select("project_key", "dataset_key").join(
        projects.select("project_key", F.col("project_identifier").alias("project_id")), "project_key")
    return E.project_admin_for(datasets, projects, admins)


@query("e05_init_datasets", f"""
SELECT d.project_key, d.dataset_key, t AS metadata_type, CASE WHEN t = 'dataset_structural' THEN regexp_replace(d.dataset_key, '^d_', '') END AS title,
  {_mint("d.project_key || '/' || d.dataset_key")} AS dataset_id, CASE WHEN t = 'dataset_structural' THEN {_mint("d.project_key")} END AS project_id,
  CASE WHEN t = 'dataset_structural' THEN 18 ELSE 19 END AS fields
FROM $dataset_dirs d, (VALUES ('dataset_structural'), ('dataset_administrative')) k(t)""")
def init_datasets(spark, d):
    done = E.init_datasets(_new_datasets(spark, d), TS)
    return done.select(
        "project_key", "dataset_key", "metadata_type", J.text("body", "dataset_title").alias("title"),
        F.coalesce(J.text("body", "dataset_identifier"), J.text("body", "dataset_identifier_link")).alias("dataset_id"),
        J.text("body", "associated_project_identifier").alias("project_id"), F.size(J.members("body")).alias("fields"))


@query("e06_project_admin_lookup", """
SELECT d.project_key, d.dataset_key, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS default_license
FROM $dataset_dirs d JOIN $project_dirs p ON d.project_key = p.project_key""")
def project_admin_lookup(spark, d):
    return _new_datasets(spark, d).select("project_key", "dataset_key", J.text("admin", "default_license").alias("default_license"))


@query("e07_inherited_defaults", """
SELECT d.project_key, d.dataset_key, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment ELSE 'To be filled' END AS license, 'Public' AS access_level,
  'To be filled' AS anonymization_method FROM $dataset_dirs d JOIN $project_dirs p ON d.project_key = p.project_key""")
def inherited_defaults(spark, d):
    done = E.init_datasets(_new_datasets(spark, d), TS).where("metadata_type = 'dataset_administrative'")
    return done.select("project_key", "dataset_key", *[J.text("body", n).alias(n) for n in ("license", "access_level", "anonymization_method")])


_TEMPLATED = """SELECT 'p_' || source AS project_key, 'd_' || doc_id AS dataset_key, CASE lang WHEN 'en' THEN 'genomics_sequencing' WHEN 'fr' THEN 'microscopy_imaging'
  WHEN 'de' THEN 'unheard_of' END AS template, CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS experiment_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'ds_' || doc_id END AS dataset_link
  FROM @documents"""


def _contextual(spark, d):
    docs = table(spark, d, "documents")
    chosen = docs.selectExpr(
        "'p_' || source AS project_key", "'d_' || doc_id AS dataset_key",
        "CASE lang WHEN 'en' THEN 'genomics_sequencing' WHEN 'fr' THEN 'microscopy_imaging' WHEN 'de' THEN 'unheard_of' END AS template",
        "CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS experiment_id",
        "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'ds_' || doc_id END AS dataset_link")
    return E.init_contextual(chosen, TS)


@query("e08_init_contextual", f"""
SELECT project_key, dataset_key, CASE WHEN template IN ('genomics_sequencing', 'microscopy_imaging') THEN 'contextual/' || template ELSE 'experiment_contextual_schema' END AS schema_id,
  CASE WHEN template IN ('genomics_sequencing', 'microscopy_imaging') THEN template ELSE 'system_default' END AS template,
  CASE WHEN template IN ('genomics_sequencing', 'microscopy_imaging') THEN '' ELSE 'To be filled' END AS experiment_name,
  CASE WHEN dataset_link <> '' THEN dataset_link WHEN template IN ('genomics_sequencing', 'microscopy_imaging') THEN NULL ELSE 'To be filled' END AS dataset_identifier_link
FROM ({_TEMPLATED}) t""")
def init_contextual(spark, d):
    return _contextual(spark, d).select(
        "project_key", "dataset_key", "schema_id", J.text("body", "experiment_template_type").alias("template"),
        J.text("body", "experiment_name").alias("experiment_name"), J.text("body", "dataset_identifier_link").alias("dataset_identifier_link"))


@query("e09_run_id_field", f"""
SELECT project_key, dataset_key, coalesce(experiment_id, {_mint("project_key || '/' || dataset_key || '/experiment'")}) AS run_id FROM ({_TEMPLATED}) t""")
def run_id_field(spark, d):
    return _contextual(spark, d).select("project_key", "dataset_key", J.text("body", "experiment_identifier_run_id").alias("run_id"))


@query("e10_dataset_link_backfill", f"""
SELECT c.record_key, CASE WHEN (c.raw -> '$.dataset_identifier_link') IS NOT NULL AND CAST(c.raw -> '$.dataset_identifier_link' AS VARCHAR) NOT IN {_OPEN} THEN c.raw ->> '$.dataset_identifier_link'
  WHEN coalesce(s.raw ->> '$.dataset_identifier', '') <> '' THEN s.raw ->> '$.dataset_identifier' ELSE c.raw ->> '$.dataset_identifier_link' END AS link
FROM $contextual c LEFT JOIN $dataset_structural s ON c.dataset_key = s.dataset_key""")
def dataset_link_backfill(spark, d):
    ctx = view(spark, d, "contextual").withColumn("body", F.parse_json("raw"))
    struct = view(spark, d, "dataset_structural").withColumn("body", F.parse_json("raw"))
    return E.fill_dataset_link(ctx, struct).select("record_key", J.text("body", "dataset_identifier_link").alias("link"))


@query("e13_minted_ids", f"""
SELECT o_orderkey, {_mint("project_key || '/' || dataset_key")} AS dataset_id FROM $dataset_dirs d""")
def minted_ids(spark, d):
    from fairlake.functions.ids import mint_id
    return view(spark, d, "dataset_dirs").select("o_orderkey", mint_id("project_key", "dataset_key").alias("dataset_id"))


_GATE = """SELECT n.record_key, NOT EXISTS (SELECT 1 FROM unnest(n.required) u(k) WHERE k NOT IN ('created_by', 'created_date', 'last_modified_by', 'last_modified_date', 'experiment_template_type')
   AND (json_type(n.v, k) IS NULL OR json_type(n.v, k) = 'NULL' OR (json_type(n.v, k) = 'VARCHAR' AND (trim(n.v ->> k) = '' OR n.v ->> k = 'To be filled')))) AS complete, n.v ->> 'experiment_identifier_run_id' AS run_id
  FROM n WHERE path = '' AND metadata_type = 'experiment_contextual'"""


@query("h04_completion_gate", _NODES + f"SELECT record_key, complete, CASE WHEN complete THEN run_id END AS experiment_id FROM ({_GATE}) g")
def completion_gate(spark, d):
    return Q.completion_gate(_records(spark, d).where("metadata_type = 'experiment_contextual'")).select("record_key", "complete", "experiment_id")


_COUNTS = """SELECT r.record_key, count(*) FILTER (WHERE counted) AS total_fields,
  count(*) FILTER (WHERE scalar AND CAST(value AS VARCHAR) NOT IN ('null', 'false', '0', '0.0', '""', '"To be filled"')) AS filled_fields
  FROM (SELECT record_key, j.value, j.type NOT IN ('OBJECT', 'ARRAY') AS scalar, j.fullkey <> '$' AND (j.type NOT IN ('OBJECT', 'ARRAY') OR j.fullkey NOT LIKE '%]') AS counted
    FROM $records r, json_tree(r.raw) j) r GROUP BY r.record_key"""


@query("h06_completeness", f"SELECT record_key, total_fields, filled_fields, round(filled_fields / CAST(total_fields AS DOUBLE), 9) AS score FROM ({_COUNTS}) c")
def completeness(spark, d):
    return Q.completeness(_records(spark, d)).select(
        "record_key", F.col("total_fields").cast("bigint").alias("total_fields"), F.col("filled_fields").cast("bigint").alias("filled_fields"),
        F.round(Q.completeness_score(), 9).alias("score"))


@query("h07_quality", f"""
SELECT c.record_key, round(CASE WHEN l.quality = 1 THEN 0.8 * s + 0.2 ELSE 0.6 * s END, 9) AS quality FROM (SELECT *, filled_fields / CAST(total_fields AS DOUBLE) AS s FROM ({_COUNTS}) x) c
JOIN $contextual k ON c.record_key = k.record_key JOIN @labels l ON k.doc_id = l.doc_id""")
def quality(spark, d):
    ctx = view(spark, d, "contextual").withColumn("body", F.parse_json("raw")).join(table(spark, d, "labels"), "doc_id")
    return Q.completeness(ctx).select(
        "record_key", F.round(Q.quality(Q.completeness_score(), F.col("quality") == 1), 9).alias("quality"))


@query("h05_finalize", _NODES + f"""
, c AS ({_COUNTS}), g AS ({_GATE})
SELECT x.project_key, x.dataset_key, g.run_id AS experiment_id, round(score, 9) AS completeness_score, round(score * 0.8 + 0.2, 9) AS quality_score FROM (
  SELECT k.record_key, k.project_key, k.dataset_key, (c1.filled_fields + c2.filled_fields + c3.filled_fields + c4.filled_fields + c5.filled_fields + linked + 9) /
    CAST(c1.total_fields + c2.total_fields + c3.total_fields + c4.total_fields + c5.total_fields + added + 20 AS DOUBLE) AS score
  FROM (SELECT q.*, CASE WHEN empty_link AND coalesce(st.raw ->> '$.dataset_identifier', '') <> '' THEN 1 ELSE 0 END AS linked,
      CASE WHEN linked = 1 AND json_extract(q.raw, '$.dataset_identifier_link') IS NULL THEN 1 ELSE 0 END AS added
    FROM (SELECT *, coalesce(raw ->> '$.dataset_identifier_link', '') IN ('', '0', 'false') AS empty_link FROM $contextual x) q
    JOIN $records st ON st.record_key = 'dss:' || q.doc_id) k
  JOIN $dataset_admin a ON a.dataset_key = k.dataset_key JOIN c c1 ON c1.record_key = k.record_key JOIN c c2 ON c2.record_key = a.record_key
  JOIN c c3 ON c3.record_key = 'dss:' || k.doc_id JOIN c c4 ON c4.record_key = replace(k.project_key, 'p_', 'prd:') JOIN c c5 ON c5.record_key = replace(k.project_key, 'p_', 'pra:')) x
JOIN g ON g.record_key = x.record_key WHERE g.complete AND g.run_id <> ''""")
def finalize(spark, d):
    done = Q.finalize(_records(spark, d), TS)
    return done.select("project_key", "dataset_key", "experiment_id", F.round("completeness_score", 9).alias("completeness_score"),
                       F.round("quality_score", 9).alias("quality_score"))


@query("a07_export_documents", f"""
SELECT project_key, dataset_key, '{{"project_key":"' || project_key || '","dataset_key":"' || dataset_key || '","orders":' || count(*) || '}}' AS document
FROM $dataset_dirs d GROUP BY project_key, dataset_key""")
def export_documents(spark, d):
    rows = view(spark, d, "dataset_dirs").groupBy("project_key", "dataset_key").agg(F.count("*").alias("orders"))
    return io.to_documents(rows, ["project_key", "dataset_key"])


_SECTIONS = """
, sections(mt, section, words) AS (VALUES
  ('experiment_contextual', 'experiment_info', 'experiment_|protocol_|^experimenters$'), ('experiment_contextual', 'sample_info', 'sample_|batch_'),
  ('experiment_contextual', 'instrumentation', 'instrument_|software_|sequencing_|microscope_|imaging_|objective_|reagent_'),
  ('experiment_contextual', 'quality_data', 'quality_|qc_|data_|links_|raw_'), ('experiment_contextual', 'notes_metadata', 'notes|observations|created_|modified_|identifier'),
  ('dataset_administrative', 'basic_info', 'title|description|identifier|version'), ('dataset_administrative', 'people_organizations', 'creator|contributor|contact|organization|affiliation'),
  ('dataset_administrative', 'dates_lifecycle', 'date|created|modified|published'), ('dataset_administrative', 'access_rights', 'license|rights|access|embargo'),
  ('dataset_structural', 'structure', 'format|type|structure|schema'), ('dataset_structural', 'files_storage', 'file|path|storage|location'),
  ('dataset_structural', 'technical', 'encoding|compression|checksum|size'),
  ('project_descriptive', 'general', ''), ('project_administrative', 'general', '')),
fl AS (SELECT recs.record_key, recs.metadata_type, r.rule_path AS name, coalesce(list_contains(root.required, r.rule_path), false) AS req,
  coalesce(CAST(json_extract(raw, r.rule_path) AS VARCHAR) NOT IN ('null', '""', '[]', '{}', '"To be filled"'), false) AS done,
  r.rule_path = 'created_by' AND recs.record_key LIKE '%7' AS err
  FROM recs JOIN rules r ON r.sid = recs.sid AND r.rule_path <> '' AND NOT contains(r.rule_path, '.') JOIN rules root ON root.sid = recs.sid AND root.rule_path = ''),
sp AS (SELECT record_key, metadata_type, section, count(*) AS fields, count(*) FILTER (WHERE done) AS completed, count(*) FILTER (WHERE req) AS required,
  count(*) FILTER (WHERE req AND done) AS required_completed, count(*) FILTER (WHERE err) AS errors
  FROM fl JOIN sections s ON s.mt = fl.metadata_type AND regexp_matches(fl.name, s.words) GROUP BY ALL)
"""


def _progress(spark, d):
    bad = F.when(F.col("record_key").endswith("7"), F.array(F.lit("created_by"))).otherwise(F.array().cast("array<string>"))
    return Q.section_progress(_records(spark, d).withColumn("bad", bad), errors="bad")


def _long(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("bigint"))
    return df


@query("h08_section_progress", _NODES + _SECTIONS + """
SELECT record_key, section, fields, completed, required, round(completed * 100 / CAST(fields AS DOUBLE), 6) AS progress,
  CASE WHEN required > 0 THEN round(required_completed * 100 / CAST(required AS DOUBLE), 6) ELSE 100 END AS required_progress FROM sp""")
def section_progress(spark, d):
    return _long(_progress(spark, d), "fields", "completed", "required").select(
        "record_key", "section", "fields", "completed", "required", F.round("progress", 6).alias("progress"),
        F.round("required_progress", 6).alias("required_progress"))


@query("h09_overall_progress", _NODES + _SECTIONS + """
SELECT record_key, round(sum(completed) * 100 / CAST(sum(fields) AS DOUBLE), 6) AS progress, CASE WHEN sum(errors) > 1 THEN CAST(sum(errors) AS BIGINT) || ' fields have errors'
  WHEN sum(errors) = 1 THEN '1 field have errors' WHEN sum(required) = sum(required_completed) THEN 'All required fields completed'
  WHEN sum(required) - sum(required_completed) = 1 THEN '1 required field remaining'
  ELSE CAST(sum(required) - sum(required_completed) AS BIGINT) || ' required fields remaining' END AS message FROM sp GROUP BY record_key""")
def overall_progress(spark, d):
    return Q.progress(_progress(spark, d)).select("record_key", F.round("progress", 6).alias("progress"), "message")


@query("h10_section_state", _NODES + _SECTIONS + """
SELECT record_key, section, CASE WHEN errors > 0 THEN 'error' WHEN required > required_completed THEN 'required_empty' ELSE 'complete' END AS state FROM sp""")
def section_state(spark, d):
    return _progress(spark, d).select("record_key", "section", "state")
