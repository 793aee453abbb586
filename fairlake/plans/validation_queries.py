"""Schema registries derived from documents, and validation of the derived records."""

import json

from pyspark.sql import functions as F

from fairlake import schemas as S
from fairlake.operators import registry as R
from fairlake.operators import validation as V
from fairlake.plans.registry import query, view

_WIN = "SELECT *, row_number() OVER (PARTITION BY data_root, schema_id ORDER BY priority, doc_id) AS rn FROM $schema_layers s"


@query("f01_resolve_schemas", f"SELECT data_root, schema_id, source, priority, doc_id, md5(body) AS body FROM ({_WIN}) w WHERE rn = 1")
def resolve_schemas(spark, d):
    won = R.resolve_schemas(view(spark, d, "schema_layers"), tie=("doc_id",))
    return won.select("data_root", "schema_id", "source", "priority", "doc_id", F.md5("body").alias("body"))


@query("f02_schema_report", f"""
SELECT data_root, schema_id, bool_or(source = 'explicit') AS has_explicit, bool_or(source = 'local') AS has_local, bool_or(source = 'custom') AS has_custom,
  bool_or(source = 'packaged') AS has_packaged, max(CASE WHEN rn = 1 THEN source END) AS resolution_source FROM ({_WIN}) w GROUP BY data_root, schema_id""")
def schema_report(spark, d):
    return R.schema_report(view(spark, d, "schema_layers"), tie=("doc_id",))


@query("f03_contextual_schemas", f"""
SELECT data_root, split_part(schema_id, '/', 2) AS schema_id, coalesce(title, split_part(schema_id, '/', 2)) AS schema_title, description AS schema_description, source
FROM ({_WIN}) w WHERE rn = 1 AND schema_id LIKE 'contextual/%'""")
def contextual_schemas(spark, d):
    return R.contextual_schemas(view(spark, d, "schema_layers"), tie=("doc_id",))


_SID = """CASE metadata_type WHEN 'experiment_contextual' THEN CASE WHEN raw ->> '$.experiment_template_type' IN
    ('genomics_sequencing', 'microscopy_imaging', 'anndata_mudata_object') THEN 'contextual/' || (raw ->> '$.experiment_template_type')
    ELSE 'experiment_contextual_schema' END
  WHEN 'project_descriptive' THEN metadata_type ELSE metadata_type || '_schema' END"""


def _records(spark, d):
    # A file may hold a table in one row group, which is one task. The work on bodies is spread over all tasks, by a fixed
    # number: merged to the usual bytes a task, records would again be few tasks.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return view(spark, d, "records").repartition(n, "record_key").withColumn("body", F.parse_json("raw"))


@query("f04_schema_dispatch", f"SELECT record_key, {_SID} AS schema_id FROM $records r")
def schema_dispatch(spark, d):
    return R.dispatch(_records(spark, d), R.packaged_registry(spark), ["title"]).select("record_key", "schema_id")


def _sql_list(values):
    return "NULL" if values is None else "[" + ", ".join("'" + json.dumps(v).replace("'", "''") + "'" for v in values) + "]"


def _sql_names(values):
    return "NULL" if not values else "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _rule_rows(sid, schema, path=""):
    def text(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"

    def number(v):
        return "NULL" if v is None else repr(float(v))

    yield (f"('{sid}', '{path}', {text(schema.get('type'))}, {_sql_list(schema.get('enum'))}, "
           f"{_sql_list([schema['const']] if 'const' in schema else None)}, {text(schema.get('pattern'))}, "
           f"{number(schema.get('minimum'))}, {number(schema.get('maximum'))}, {_sql_names(schema.get('required'))}, {text(schema.get('format'))}, "
           f"{number(schema.get('minItems'))}, {number(schema.get('maxItems'))}, {number(schema.get('minLength'))}, {number(schema.get('maxLength'))}, "
           f"{_sql_names(list(schema.get('properties', {})))}, {'true' if schema.get('additionalProperties') is False else 'false'})")
    dot = path + "." if path else ""
    for name, sub in schema.get("properties", {}).items():
        yield from _rule_rows(sid, sub, dot + name)
    if "items" in schema:
        yield from _rule_rows(sid, schema["items"], dot + "[]")


_SCHEMAS = {f"contextual/{k}": v for k, v in S.BY_TEMPLATE.items()} | {
    S.SCHEMA_FILES["project" if k == "project_descriptive" else k]: v for k, v in S.BY_TYPE.items()}
_RULES = ",\n".join(r for sid, s in _SCHEMAS.items() for r in _rule_rows(sid, s))
_CONDITIONS = ", ".join(
    f"('{sid}', '{f}', {_sql_list(v.get('enum') or [v['const']])}, '{rule['then']['required'][0]}')"
    for sid, s in _SCHEMAS.items() for rule in s.get("allOf", []) for f, v in rule["if"]["properties"].items())

_NODES = f"""
WITH recs AS MATERIALIZED (SELECT record_key, metadata_type, raw, {_SID} AS sid FROM $records r),
rules(sid, rule_path, type, enum, const, pattern, minimum, maximum, required, format, min_items, max_items, min_length, max_length, names, closed) AS (VALUES {_RULES}),
nodes AS MATERIALIZED (SELECT record_key, metadata_type, recs.sid, ltrim(regexp_replace(j.fullkey[2:], '\\[(\\d+)\\]', '.\\1', 'g'), '.') AS path,
  ltrim(regexp_replace(j.fullkey[2:], '\\[\\d+\\]', '.[]', 'g'), '.') AS rule_path, j.type AS t, j.value AS v FROM recs, json_tree(recs.raw) j),
n AS MATERIALIZED (SELECT nodes.*, r.* EXCLUDE (sid, rule_path), CASE r.type WHEN 'string' THEN t = 'VARCHAR' WHEN 'integer' THEN t LIKE '%BIGINT' OR (t = 'DOUBLE' AND TRY_CAST(v AS DOUBLE) % 1 = 0)
    WHEN 'number' THEN t LIKE '%BIGINT' OR t = 'DOUBLE' ELSE upper(r.type) = t END AS typed,
  CASE WHEN t = 'VARCHAR' THEN v ->> '$' END AS s, CASE WHEN t LIKE '%BIGINT' OR t = 'DOUBLE' THEN TRY_CAST(v AS DOUBLE) END AS x
  FROM nodes JOIN rules r ON nodes.sid = r.sid AND nodes.rule_path = r.rule_path)
"""
_BAD = {
    "type": "SELECT record_key, metadata_type, path AS field_path, 'type' AS rule FROM n WHERE NOT typed",
    "enum": "SELECT record_key, metadata_type, path, 'enum' FROM n WHERE NOT list_contains(enum, CAST(v AS VARCHAR))",
    "const": "SELECT record_key, metadata_type, path, 'const' FROM n WHERE NOT list_contains(const, CAST(v AS VARCHAR))",
    "pattern": "SELECT record_key, metadata_type, path, 'pattern' FROM n WHERE NOT regexp_matches(s, pattern)",
    "range": "SELECT record_key, metadata_type, path, 'range' FROM n WHERE x < minimum OR x > maximum",
    "required": """SELECT record_key, metadata_type, CASE WHEN path = '' THEN k ELSE path || '.' || k END, 'required' FROM n, unnest(required) u(k)
      WHERE t = 'OBJECT' AND NOT list_contains(json_keys(v), k)""",
    "conditional": f"""SELECT record_key, metadata_type, need, 'conditional' FROM recs JOIN (VALUES {_CONDITIONS}) c(sid, field, allowed, need) ON recs.sid = c.sid
      WHERE (json_extract(raw, field) IS NULL OR list_contains(allowed, CAST(json_extract(raw, field) AS VARCHAR)))
      AND NOT list_contains(json_keys(raw), need)""",
    "items": """SELECT record_key, metadata_type, path, 'items' FROM n WHERE t = 'ARRAY'
      AND (json_array_length(v) < min_items OR json_array_length(v) > max_items)""",
    "length": "SELECT record_key, metadata_type, path, 'length' FROM n WHERE length(s) < min_length OR length(s) > max_length",
    "additional": """SELECT record_key, metadata_type, CASE WHEN path = '' THEN k ELSE path || '.' || k END, 'additional' FROM n, unnest(json_keys(v)) u(k)
      WHERE t = 'OBJECT' AND closed AND NOT coalesce(list_contains(names, k), false)""",
    "schema": "SELECT record_key, metadata_type, path, 'schema' FROM n WHERE false",  # packaged schemas use supported keywords only
    "format": """SELECT record_key, metadata_type, path, 'format' FROM n WHERE s IS NOT NULL AND enum IS NULL AND CASE format
      WHEN 'date' THEN TRY_CAST(s AS DATE) IS NULL OR length(s) <> 10
      WHEN 'date-time' THEN NOT regexp_matches(s, 'T[0-9:.]+Z$')
      WHEN 'email' THEN s[1] = '.' OR contains(s, '..') OR NOT regexp_full_match(s, '[A-Za-z0-9_''+.-]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\\.)+[A-Za-z]{2,}') END""",
}


def _union(*rules):
    first, *rest = rules
    named = _BAD[first].replace("path,", "path AS field_path,", 1) if first != "type" else _BAD[first]
    return " UNION ALL ".join(["SELECT * FROM (" + named + f") t0(record_key, metadata_type, field_path, rule)"] + [_BAD[r] for r in rest])


_ALL = _union(*V.RECORD_RULES)


def _rule_query(name, *rules):
    @query(name, _NODES + _union(*rules))
    def run(spark, d):
        checked = V.validate(_records(spark, d), rules=rules)
        return V.violation_rows(checked).drop("message")

    return run


_rule_query("f05_type_rule", "type")
_rule_query("f06_required_rule", "required")
_rule_query("f07_enum_const_rules", "enum", "const")
_rule_query("f08_pattern_rule", "pattern")
_rule_query("f09_range_rule", "range")
_rule_query("f11_conditional_rule", "conditional")


@query("f10_item_rules", _NODES + f"SELECT * FROM ({_ALL}) a WHERE regexp_matches(field_path, '\\.[0-9]')")
def item_rules(spark, d):
    rows = V.violation_rows(V.validate(_records(spark, d))).drop("message")
    return rows.where(F.col("field_path").rlike(r"\.[0-9]"))


@query("f12_open_maps", _NODES + f"""
SELECT r.record_key, coalesce(len(json_keys(r.raw, '$.instrument_settings_run_parameters')), 0) AS settings,
  (SELECT count(*) FROM ({_ALL}) a WHERE a.record_key = r.record_key AND starts_with(a.field_path, 'instrument_settings_run_parameters.')) AS complaints
FROM recs r WHERE metadata_type = 'experiment_contextual'""")
def open_maps(spark, d):
    checked = V.validate(_records(spark, d).where("metadata_type = 'experiment_contextual'"))
    inside = F.filter("violations", lambda v: v["field_path"].startswith("instrument_settings_run_parameters."))
    settings = F.size(F.map_keys(F.try_variant_get("body", "$.instrument_settings_run_parameters", "map<string,variant>")))
    return checked.select("record_key", F.coalesce(settings, F.lit(0)).cast("bigint").alias("settings"),
                          F.size(inside).cast("bigint").alias("complaints"))


@query("f13_validation_verdict", _NODES + f"""
SELECT recs.record_key, sid AS schema_id, coalesce(k, 0) = 0 AS valid, coalesce(k, 0) AS violations FROM recs
LEFT JOIN (SELECT record_key, count(*) AS k FROM ({_ALL}) a GROUP BY record_key) b ON recs.record_key = b.record_key""")
def validation_verdict(spark, d):
    return V.validate(_records(spark, d)).select(
        "record_key", "schema_id", "valid", F.size("violations").cast("bigint").alias("violations"))


@query("f14_grouped_errors", _NODES + f"SELECT record_key, field_path, count(*) AS messages FROM ({_ALL}) a GROUP BY ALL")
def grouped_errors(spark, d):
    grouped = V.group_errors(V.validate(_records(spark, d)))
    return V.error_rows(grouped).withColumn("messages", F.size("messages").cast("bigint"))


@query("f15_form_rules", _NODES + _union("type", "required", "format", "range") + """
UNION ALL SELECT record_key, metadata_type, path, 'enum' FROM n WHERE typed AND NOT list_contains(enum, CAST(v AS VARCHAR))""")
def form_rules(spark, d):
    return V.violation_rows(V.validate_form(_records(spark, d))).drop("message")


_PLAIN = "CASE WHEN t = 'DOUBLE' THEN rtrim(rtrim(CAST(v AS VARCHAR), '0'), '.') ELSE CAST(v AS VARCHAR) END"


def _letters(text):
    # sort_array compares in generated code; array_sort evaluates a lambda for each comparison.
    return F.array_join(F.sort_array(F.split(text, "")), "")


def _member_rows(records):
    """One row per member; values as their sorted letters, since member order is not kept."""
    members = F.explode(F.try_variant_get("body", "$", "map<string,variant>")).alias("field", "value")
    return records.select("record_key", members).select("record_key", "field", _letters(F.to_json("value")).alias("value"))


_QC = '{"fastqc_passed":"true","adapter_trimming":false,"quality_threshold":""}'


@query("f16_normalize", _NODES + f"""
, top AS (SELECT nodes.record_key, nodes.path AS field, t, v, {_PLAIN} AS p, CASE WHEN t = 'VARCHAR' THEN v ->> '$' END AS s, r.type AS want,
    coalesce(list_contains(root.required, nodes.path), false) AS need
  FROM nodes LEFT JOIN rules r ON nodes.sid = r.sid AND nodes.rule_path = r.rule_path JOIN rules root ON root.sid = nodes.sid AND root.rule_path = ''
  WHERE nodes.path <> '' AND NOT contains(nodes.path, '.')),
done AS (SELECT record_key, field, CASE WHEN want IS NULL THEN p
  WHEN s = '' THEN CASE WHEN want = 'string' AND need THEN p END
  WHEN want IN ('integer', 'number') AND t = 'NULL' THEN NULL
  WHEN want = 'integer' AND t = 'VARCHAR' THEN CAST(TRY_CAST(regexp_extract(s, '^\\s*([-+]?\\d+)', 1) AS BIGINT) AS VARCHAR)
  WHEN want = 'number' AND t = 'VARCHAR' THEN CAST(TRY_CAST(regexp_extract(s, '^\\s*([-+]?\\d+\\.?\\d*)', 1) AS DOUBLE) AS VARCHAR)
  WHEN want = 'boolean' AND lower(s) IN ('true', 'false') THEN lower(s)
  WHEN want = 'array' AND t <> 'ARRAY' THEN CASE WHEN t <> 'NULL' THEN '[' || p || ']' END
  WHEN want = 'array' THEN CASE WHEN p <> '[]' THEN replace(replace(replace(p, '["","C"', '["C"'), '["a",""]', '["a"]'), '["a"," "]', '["a"]') END
  WHEN want = 'object' AND t = 'OBJECT' THEN CASE WHEN p <> '{{}}' THEN replace(p, '{_QC}', '{{"fastqc_passed":true,"adapter_trimming":false}}') END
  ELSE p END AS w FROM top)
SELECT record_key, array_to_string(list_sort(string_split('{{' || string_agg('"' || field || '":' || w, ',') || '}}', '')), '') AS body
FROM done WHERE w IS NOT NULL GROUP BY record_key""")
def normalize(spark, d):
    return V.normalize(_records(spark, d)).select("record_key", _letters(F.to_json("body")).alias("body"))


@query("f17_clean_enums", _NODES + f"""
SELECT nodes.record_key, nodes.path AS field, array_to_string(list_sort(string_split(CASE WHEN NOT list_contains(enum, CAST(v AS VARCHAR))
    AND CAST(v AS VARCHAR) NOT IN ('null', 'false', '0', '""') THEN '""' ELSE {_PLAIN} END, '')), '') AS value
FROM nodes LEFT JOIN rules r ON nodes.sid = r.sid AND nodes.rule_path = r.rule_path WHERE nodes.path <> '' AND NOT contains(nodes.path, '.')""")
def clean_enums(spark, d):
    return _member_rows(V.clean_enums(_records(spark, d)))


_FIELDS = f"""SELECT data_root, schema_id, f.key AS name, f.value AS node, json_extract(body, '$.required') AS req
  FROM ({_WIN}) w, json_each(w.body, '$.properties') f WHERE rn = 1"""
_TITLE = "coalesce({0} ->> '$.title', array_to_string(list_transform(list_filter(string_split({1}, '_'), lambda x: x <> ''), lambda x: upper(x[1]) || lower(x[2:])), ' '))"


@query("f18_field_catalog", f"""
SELECT data_root, schema_id, name, {_TITLE.format("node", "name")} AS title, list_contains(CAST(req AS VARCHAR[]), name) AS required,
  coalesce(CAST(node ->> '$.readOnly' AS BOOLEAN), false) OR (schema_id = 'project_descriptive' AND name = 'project_identifier')
  OR (schema_id = 'dataset_structural_schema' AND name = 'dataset_identifier') OR (schema_id LIKE '%contextual%' AND name = 'experiment_template_type') AS read_only
FROM ({_FIELDS}) f""")
def field_catalog(spark, d):
    reg = R.resolve_schemas(view(spark, d, "schema_layers"), tie=("doc_id",))
    return R.field_catalog(reg).select("data_root", "schema_id", "name", "title", "required", "read_only")


@query("f19_describe_fields", f"""
WITH f AS ({_FIELDS}),
nested AS (SELECT data_root, schema_id, name || '.' || k.key AS field_path, k.key AS name, k.value AS node, req
  FROM f, json_each(coalesce(json_extract(node, '$.properties'), json_extract(node, '$.items.properties'))) k)
SELECT data_root, schema_id, field_path, {_TITLE.format("node", "name")} AS title, node ->> '$.description' AS description,
  list_contains(CAST(req AS VARCHAR[]), name) AS required
FROM (SELECT data_root, schema_id, name AS field_path, name, node, req FROM f UNION ALL SELECT * FROM nested) x""")
def describe_fields(spark, d):
    return R.describe_fields(R.resolve_schemas(view(spark, d, "schema_layers"), tie=("doc_id",)))


@query("f20_get_schema", f"SELECT data_root, schema_id, md5(body) AS body FROM ({_WIN}) w WHERE rn = 1 AND schema_id IN ('contextual/assay', 'project_descriptive')")
def get_schema(spark, d):
    reg = R.resolve_schemas(view(spark, d, "schema_layers"), tie=("doc_id",))
    return R.get_schema(reg, "contextual", "assay").unionByName(R.get_schema(reg, "project")).select(
        "data_root", "schema_id", F.md5("body").alias("body"))
