"""Catalog-shaped views derived from the given tables.

Every view covers its whole tables. Row numbers taken modulo a small number only
vary the content (an empty title here, a wrong type there), never drop rows.
"""


def _pick(key: str, *values: str | None) -> str:
    """CASE over ``key % n``; None gives NULL, i.e. an absent field."""
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


def _field(name: str, key: str, *values: str | None) -> str:
    """JSON member text ``"name":value`` with the value varied by ``key``."""
    return _pick(key, *[None if v is None else f"'\"{name}\":' || {v}" for v in values])


def _text(expr: str) -> str:
    return f"'\"' || {expr} || '\"'"


def _body(*fields: str) -> str:
    return "'{' || concat_ws(',', " + ", ".join(fields) + ") || '}'"


def _uuid(expr: str) -> str:
    h = f"md5({expr})"
    return (f"substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || "
            f"substr({h},17,4) || '-' || substr({h},21,12)")


def _audit(key: str) -> list[str]:
    day = f"'\"2024-01-' || lpad(CAST({key} % 28 + 1 AS STRING), 2, '0') || 'T00:00:00\"'"
    return [
        _field("created_by", key, "'\"system\"'", "'\"\"'", "'\"ana\"'", None, "'\"ana\"'"),
        _field("created_date", key, day, day, "'null'", day, day, day, "'\"\"'"),
        _field("last_modified_by", key, *["'\"system\"'"] * 10, None),
        _field("last_modified_date", key, *[day] * 12, "'12'"),
    ]


def _files(key: str) -> str:
    whole = ("'{\"file_name\":\"f' || {k} || '.csv\",\"role\":\"raw_data\",\"file_path\":\"f' || {k} || '.csv\","
             "\"file_extension\":\"csv\",\"file_size_bytes\":' || n_chars || ',\"file_created_utc\":\"c\","
             "\"file_modified_utc\":\"m\",\"file_type_os\":\"file\"}'").replace("{k}", key)
    short = f"'{{\"file_name\":\"g' || {key} || '.txt\",\"role\":5,\"file_size_bytes\":-' || n_chars || '}}'"
    return _field("file_descriptions", key, "'[]'", f"'[' || {whole} || ']'",
                  f"'[' || {whole} || ',' || {short} || ']'", f"'[' || {short} || ',7]'", None,
                  "'\"none\"'")


VIEWS: dict[str, str] = {}

VIEWS["files"] = f"""
SELECT doc_id, source, lang, 'p_' || source AS project_key,
  '/data/p_' || source || '/d_' || lang AS dataset_path,
  '/data/p_' || source || '/d_' || lang || '/' ||
    {_pick("doc_id", "'sub0'", "'sub1'", "'.metadata'", "'rebuild'", "'sub2'", "'environment'", "'x~y'", "'sub0'", "'deep/.git'")}
    || '/doc_' || (doc_id % 50) ||
    {_pick("doc_id", "'.txt'", "'.csv'", "'.json'", "'.tar.gz'", "'.tmp'", "'.PNG'", "''", "'.bak'", "'.md'", "'.7z'", "'.log'")} AS path,
  text AS content, OCTETS(text) AS size_bytes,
  {_pick("doc_id", "33188", "33261", "16877", "41471", "35309", "33791", "2541")} AS mode,
  '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || 'T00:00:00' AS modified_time,
  {_pick("doc_id", "'ana'", "'bo'", None)} AS owner
FROM @documents"""

VIEWS["dataset_dirs"] = """
SELECT o_orderkey, o_custkey, 'p_' || o_custkey AS project_key,
  CASE WHEN o_orderkey % 11 = 0 THEN '.x' || o_orderkey
       WHEN o_orderkey % 7 = 0 THEN 'set_' || o_orderkey
       ELSE 'd_' || o_orderkey END AS dataset_key,
  o_orderstatus, o_orderpriority
FROM @orders"""

VIEWS["project_dirs"] = """
SELECT c_custkey, 'p_' || c_custkey AS project_key, c_name, c_mktsegment FROM @customer"""

VIEWS["tree_files"] = """
SELECT d.project_key, d.dataset_key, d.project_key || '/' || d.dataset_key AS dataset_id, d.o_orderkey,
  'f' || l.l_linenumber || '_' || l.l_partkey ||
    CASE l.l_returnflag WHEN 'A' THEN '.csv' WHEN 'N' THEN '.txt' ELSE '.fastq' END AS file_name,
  CASE l.l_returnflag WHEN 'A' THEN 'csv' WHEN 'N' THEN 'txt' ELSE 'fastq' END AS file_extension,
  CAST(round(l.l_extendedprice * 100) AS BIGINT) AS file_size_bytes,
  l.l_linestatus, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity
FROM @lineitem l JOIN $dataset_dirs d ON l.l_orderkey = d.o_orderkey"""

_TEMPLATE = """CASE lang WHEN 'en' THEN 'genomics_sequencing' WHEN 'fr' THEN 'microscopy_imaging'
  WHEN 'de' THEN 'anndata_mudata_object' ELSE 'system_default' END"""

VIEWS["contextual"] = f"""
SELECT doc_id, 'ctx:' || doc_id AS record_key, 'experiment_contextual' AS metadata_type,
  'p_' || source AS project_key, 'd_' || doc_id AS dataset_key, {_body(
    _field("experiment_template_type", "doc_id", *[_text(_TEMPLATE)] * 9, None, "'\"other_kind\"'"),
    _field("experiment_identifier_run_id", "doc_id", _text(_uuid("text")), _text(_uuid("text")), "'\"\"'",
           _text("'exp_d_' || source || '_001_genomics_sequencing'"), "'\"To be filled\"'",
           _text(_uuid("text")), None, _text(_uuid("text")), "'null'", "'\"  \"'", "'\"exp_a_b\"'"),
    _field("experiment_title", "doc_id", _text("'Run ' || doc_id"), "'5'", _text("'Run ' || doc_id"), None,
           "'\"To be filled\"'", _text("'Run ' || doc_id")),
    _field("dataset_identifier_link", "doc_id", _text("'ds_' || doc_id"), "'\"\"'", _text("'ds_' || doc_id"), None),
    _field("sequencing_platform", "doc_id", "'\"Illumina\"'", "'\"PacBio\"'", "'\"Abacus\"'", None, "'\"Other\"'", "'\"To be filled\"'", "'\"Illumina\"'"),
    _field("sequencing_type", "doc_id", "'\"Exome\"'", "'\"RNA-Seq\"'", "'7'", "'\"Other\"'", "'\"Exome\"'"),
    _field("read_length", "doc_id", "'150'", "'\"150\"'", "'1.0'", "'1.5'", "'true'", None, "'\"\"'", "'\"abc\"'"),
    _field("coverage", "doc_id", "'30.5'", "'\"30.5\"'", "'0'", None, "'null'"),
    _field("quality_control", "doc_id", "'{\"fastqc_passed\":true,\"quality_threshold\":' || n_chars || '}'",
           "'{\"fastqc_passed\":\"true\",\"adapter_trimming\":false,\"quality_threshold\":\"\"}'", None, "'{}'", "'\"yes\"'"),
    _field("microscope_type", "doc_id", "'\"Confocal\"'", "'\"Electron\"'", "'\"Toy\"'", "'\"Other\"'", None),
    _field("imaging_modality", "doc_id", "'\"2D\"'", "'\"3D\"'", "'\"\"'"),
    _field("objective_magnification", "doc_id", "'63'", "'\"63x\"'", "'0.5'", "'40'"),
    _field("object_type", "doc_id", "'\"AnnData\"'", "'\"MuData\"'", "'\"anndata\"'"),
    _field("number_of_observations", "doc_id", "n_chars", "n_chars", "'\"many\"'"),
    _field("number_of_variables", "doc_id", "n_chars", "'0'", "'2.5'", "'20'"),
    _field("modality_information", "doc_id", None,
           "'[{\"modality_name\":\"rna\",\"modality_type\":\"x\",\"number_of_modality_observations\":1}]'", "'[]'"),
    _field("qc_assessment", "doc_id", "'\"Pass\"'", "'\"Fail\"'", "'\"Maybe\"'", None),
    _field("experimenters", "doc_id", "'[{\"name\":\"A\",\"orcid\":\"https://orcid.org/0000-0002-1825-0097\"}]'",
           "'[{\"name\":\"B\",\"orcid\":\"0000\"},{\"orcid\":\"see https://orcid.org/0000-0002-1825-009X\"}]'", "'[]'", None,
           "'[\"\",\"C\",{\"name\":5}]'", "'\"D\"'"),
    _field("instrument_settings_run_parameters", "doc_id",
           "'{\"gain\":' || n_chars || ',\"more\":{\"a\":[1,0,\"\"]}}'", None, "'{}'"),
    _field("instrument_used_link", "doc_id", "'[\"i_' || (doc_id % 5) || '\"]'", None),
    _field("experimenter_notes_observations", "doc_id", "'\"\"'", _text("md5(text)"), "'\"To be filled\"'"),
    *_audit("doc_id"))} AS raw
FROM @documents"""

VIEWS["dataset_admin"] = f"""
SELECT d.doc_id, 'dsa:' || d.doc_id AS record_key, 'dataset_administrative' AS metadata_type,
  'p_' || source AS project_key, 'd_' || d.doc_id AS dataset_key, {_body(
    _field("dataset_identifier_link", "d.doc_id", *[_text("'ds_' || d.doc_id")] * 8, None),
    _field("data_steward_contact_person", "d.doc_id",
           "'{\"name\":\"S\",\"email\":\"s@x.org\",\"orcid\":\"https://orcid.org/0000-0002-1825-0097\"}'",
           "'{\"name\":\"S\",\"orcid\":\"x\"}'", "'\"S\"'", None),
    _field("license", "d.doc_id", "'\"CC-BY\"'", "'\"To be filled\"'", None),
    _field("access_level", "d.doc_id", "'\"Public\"'", "'\"Embargoed\"'", "'\"Restricted\"'", "'\"Secret\"'", None),
    _field("access_conditions_contact", "d.doc_id", "'\"desk\"'", None, "'\"\"'", None, None, "'\"desk\"'", None),
    _field("embargo_end_date", "d.doc_id", "'\"2030-01-01\"'", None, None),
    _field("data_sensitivity_classification", "d.doc_id", "'\"Public\"'", "'\"Confidential\"'", "'\"PII/PHI\"'", None, "'\"Internal Use Only\"'"),
    _field("anonymization_method", "d.doc_id", None, "'\"masking\"'"),
    _field("ethics_approval_references", "d.doc_id", "'[\"a\",5]'", "'[]'", "'\"a\"'", "'[\"a\",\" \"]'"),
    "'\"quality\":' || l.quality", "'\"toxic\":' || l.toxic",
    *_audit("d.doc_id"))} AS raw
FROM @documents d JOIN @labels l ON d.doc_id = l.doc_id"""

VIEWS["dataset_structural"] = f"""
SELECT doc_id, 'dss:' || doc_id AS record_key, 'dataset_structural' AS metadata_type,
  'p_' || source AS project_key, 'd_' || doc_id AS dataset_key, {_body(
    _field("dataset_identifier", "doc_id", *[_text("'ds_' || doc_id")] * 7, "'\"\"'", None),
    _field("dataset_title", "doc_id", _text("lang || ' set'"), "'\"To be filled\"'", None, _text("'T' || doc_id")),
    _field("associated_project_identifier", "doc_id", *[_text(_uuid("source"))] * 4, "'\"nowhere\"'"),
    _field("dataset_keywords", "doc_id", "'[\"a\",\"\"]'", "'\"a\"'", "'[]'", None),
    _files("doc_id"),
    *_audit("doc_id"))} AS raw
FROM @documents"""

VIEWS["project_descriptive"] = f"""
SELECT k AS doc_id, 'prd:' || source AS record_key, 'project_descriptive' AS metadata_type,
  'p_' || source AS project_key, CAST(NULL AS STRING) AS dataset_key, {_body(
    _field("project_identifier", "k", *[_text(_uuid("source"))] * 6, None),
    _field("project_title", "k", _text("'Project ' || source"), "'\"\"'", _text("'Project ' || source")),
    _field("principal_investigator", "k", "'{\"name\":\"P\",\"orcid\":\"https://orcid.org/0000-0002-1825-0097\",\"email\":\"p@x.org\",\"affiliation\":\"U\"}'",
           "'\"P\"'", "'{\"name\":\"P\"}'"),
    _field("project_status", "k", "'\"Active\"'", "'\"Paused\"'"),
    "'\"n\":' || n", *_audit("k"))} AS raw
FROM (SELECT source, count(*) AS n, min(doc_id) AS k FROM @documents GROUP BY source) s"""

VIEWS["project_admin"] = f"""
SELECT k AS doc_id, 'pra:' || source AS record_key, 'project_administrative' AS metadata_type,
  'p_' || source AS project_key, CAST(NULL AS STRING) AS dataset_key, {_body(
    _field("project_identifier_link", "k", *[_text(_uuid("source"))] * 6, "'\"\"'"),
    _field("data_steward_contact_person", "k", "'{\"name\":\"S\",\"email\":\"s@x.org\"}'", "'null'"),
    _field("default_license", "k", "'\"CC0\"'", "'\"To be filled\"'", None, "'null'"),
    _field("default_access_level", "k", "'\"Public\"'", "'\"Restricted\"'", None),
    _field("project_ethics_approval_references", "k", "'[\"e1\"]'", None),
    _field("project_data_retention_schedule", "k", "'\"10 years\"'", None, "'\"\"'"),
    "'\"unused_field\":' || n", *_audit("k"))} AS raw
FROM (SELECT source, count(*) AS n, min(doc_id) AS k FROM @documents GROUP BY source) s"""

VIEWS["records"] = " UNION ALL ".join(
    f"SELECT doc_id, record_key, metadata_type, project_key, dataset_key, raw FROM ${v} r"
    for v in ("contextual", "dataset_admin", "dataset_structural", "project_descriptive", "project_admin"))

VIEWS["record_updates"] = f"""
SELECT doc_id, record_key, metadata_type, {_body(
    _field("experiment_title", "doc_id", _text("'New ' || doc_id"), "'7'", None),
    _field("experiment_identifier_run_id", "doc_id", "'\"hacked\"'", None),
    _field("dataset_identifier", "doc_id", "'\"hacked\"'", None, None),
    _field("created_by", "doc_id", None, "'\"\"'", "'\"zoe\"'"),
    "'\"note\":{\"n\":' || doc_id || '}'")} AS raw
FROM $records u"""

VIEWS["requests"] = f"""
SELECT event_id, ts, 'u' || user_id AS client_id, event_type AS endpoint, value * 4 AS latency_ms,
  {_pick("event_id", "'GET'", "'PUT'", "'POST'")} AS method,
  {_pick("event_id", "200", "200", "201", "404", "200", "500", "200")} AS status_code,
  {_pick("event_id", "'success'", "'success'", "'success'", "'failure'", "'success'", "'connection_error'", "'success'")} AS outcome,
  {_pick("event_id", None, "'run_a'", "'run_a'", "'run_b'")} AS run_id, props
FROM @events"""

VIEWS["request_lines"] = f"""
SELECT event_id, CASE WHEN event_id % 23 = 5 THEN '{{"broken":' ELSE
  '{{"timestamp":"' || CAST(ts AS STRING) || '","level":"INFO","name":"' ||
  {_pick("event_id", "'api_stresser'", "'api_stresser'", "'api_stresser'", "'file_stresser'")} || '","message":"' ||
  {_pick("event_id", "'API request completed'", "'API request completed'", "'API request completed'", "'API request completed'", "'started'")} ||
  '","details":' || {_body(
    _field("run_id", "event_id", "'\"run_a\"'", "'\"run_b\"'", None),
    "'\"endpoint\":\"' || event_type || '\"'",
    _field("latency_ms", "event_id", "CAST(value AS STRING)", "CAST(value AS STRING)", None, "CAST(value AS STRING)"),
    _field("status_code", "event_id", "'200'", "'404'", "'500'"),
    _field("outcome", "event_id", "'\"success\"'", "'\"failure\"'", "'\"connection_error\"'", "'\"success\"'"))} || '}}' END AS line
FROM @events"""

VIEWS["tasks"] = f"""
SELECT event_id AS task_id, event_type AS task_type, ts AS created_at,
  {_pick("event_id", "'pending'", "'running'", "'completed'", "'failed'", "'cancelled'")} AS status,
  CASE WHEN event_id % 5 IN (2, 3, 4) THEN ts END AS completed_at, value
FROM @events"""

VIEWS["fs_events"] = f"""
SELECT event_id, ts,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'created' WHEN 'view' THEN 'moved'
    WHEN 'click' THEN 'modified' ELSE 'deleted' END AS kind,
  event_type = 'signup' AS is_directory,
  '/data/p_' || (user_id % 7) || '/d_' || user_id ||
    CASE event_type WHEN 'signup' THEN '' WHEN 'click' THEN '/.metadata/experiment_contextual.json'
      ELSE '/f' || (event_id % 40) || '.csv' END AS src_path,
  CASE WHEN event_type = 'view' THEN '/data/p_' || (user_id % 7) || '/d_' || user_id || '/m' || (event_id % 40) || '.csv' END AS dest_path,
  CAST(round(value * 100) AS BIGINT) AS size_bytes
FROM @events"""

VIEWS["names"] = "SELECT page_id, url, html FROM @pages"

VIEWS["history"] = """
SELECT conv_id, 'rec_' || conv_id AS record_key, turn AS version, 1700000000 + turn * 3600 + conv_id AS commit_ts, md5(text) AS content_hash, role AS author,
  '{"title":"' || md5(text) || '","role":"' || role || '","n":' || length(text) ||
    CASE WHEN turn % 3 = 0 THEN ',"note":"To be filled"' WHEN turn % 3 = 1 THEN ',"note":""' ELSE '' END || '}' AS raw
FROM @conversations"""

VIEWS["schema_layers"] = """
SELECT doc_id, 'r' || CAST(floor(doc_id / 20) AS BIGINT) AS data_root,
  CASE doc_id % 5 WHEN 0 THEN 'project_descriptive' WHEN 1 THEN 'dataset_structural_schema' WHEN 2 THEN 'contextual/imaging'
    WHEN 3 THEN 'contextual/assay' ELSE 'experiment_contextual_schema' END AS schema_id,
  CASE lang WHEN 'en' THEN 'packaged' WHEN 'fr' THEN 'local' WHEN 'de' THEN 'custom' ELSE 'explicit' END AS source,
  CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 0 END AS priority,
  CASE WHEN doc_id % 4 <> 1 THEN 'Schema ' || doc_id END AS title, md5(text) AS description,
  '{"type":"object","required":["project_identifier","cell"],"properties":{"project_identifier":{"type":"string"},' ||
  '"dataset_identifier":{"type":"string","readOnly":true},"experiment_template_type":{"const":"' || lang || '"},' ||
  '"my_field__name":{"type":"string","description":"' || md5(text) || '"},"n":{"type":"integer","title":"Number","minimum":' || n_chars || '},' ||
  '"box":{"type":"object","required":["w"],"properties":{"w":{"type":"number"},"cell":{"type":"string"}}},' ||
  '"rows":{"type":"array","minItems":1,"items":{"type":"object","properties":{"cell":{"type":"string","title":"C' || doc_id || '"}}}}}}' AS body
FROM @documents"""
