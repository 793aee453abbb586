"""Operators on small inputs: known values and brute force."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from fairlake.functions import paths as P
from fairlake.functions import variants as V
from fairlake.operators import files, history, manifest, oplog, quality, ranking, records, templates
from fairlake.operators import validation
from fairlake.operators.registry import packaged_registry
from fairlake.plans import all_queries, validation_queries
from fairlake.sources import io
from fairlake.streaming import ingest


def values(spark, rows, expr, schema="v STRING"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(expr).collect()]


def test_format_size(spark):
    got = values(spark, [0, 512, 1536, 1048575], P.format_size("v"), "v BIGINT")
    assert got == ["0 B", "512.0 B", "1.0 KB", "1023.0 KB"]


def test_sanitize_filename(spark):
    assert values(spark, ["a/b:c.txt ", " ... "], P.sanitize_filename("v")) == ["a_b_c.txt", "unnamed_file"]


def test_component_mode_keeps_longer_names(spark):
    paths = ["/d/environment/a.csv", "/d/env/a.csv", "/d/a.tmp"]
    assert values(spark, paths, P.is_ignored("v")) == [True, True, True]
    assert values(spark, paths, P.is_ignored("v", mode="component")) == [False, True, True]


def test_strict_parse(spark):
    texts = ['{"a":1}', '{"a":1}}', "", "1,2", '[1]', '{"a":1} x', "null"]
    got = values(spark, texts, V.parse_strict("v").isNotNull())
    assert got == [True, False, False, False, True, False, True]


def test_sha512(spark):
    assert values(spark, ["x"], files.checksum("v", "sha512")) == [hashlib.sha512(b"x").hexdigest()]


def _names(uploads, taken):
    taken, out = {k: set(v) for k, v in taken.items()}, {}
    for seq, dataset, name in sorted(uploads):
        used = taken.setdefault(dataset, set())
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if name[:max(dot, 0)].strip(".") else (name, "")
        stored, n = name, 0
        while stored in used:
            n += 1
            stored = f"{stem}_{n}{ext}"
        used.add(stored)
        out[seq] = stored
    return out


def test_dedupe_names_brute_force(spark):
    rnd = random.Random(3)
    pool = ["a.txt", "a_1.txt", "a_1_1.txt", "a_2.txt", "b", ".rc", "b.tar.gz"]
    uploads = [(i, f"d{rnd.randrange(2)}", rnd.choice(pool)) for i in range(40)]
    taken = {"d0": {"a.txt", "a_3.txt", "b_2"}, "d1": {".rc"}}
    got = manifest.dedupe_names(
        spark.createDataFrame(uploads, "seq BIGINT, dataset_id STRING, file_name STRING"),
        spark.createDataFrame([(k, n) for k, v in taken.items() for n in v], "dataset_id STRING, file_name STRING"))
    assert {r.seq: r.stored_name for r in got.collect()} == _names(uploads, taken)


@pytest.mark.parametrize("slices", [1, 8])
def test_running_total_of_a_hot_key_with_nulls(spark, slices):
    rows = [("hot" if i % 3 else None if i % 2 else "cold", None if i < 2 else i * 37 % 1000, i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "k STRING, id BIGINT, v BIGINT")
    want, sums = [], {}
    for k, i, v in sorted(rows, key=lambda r: -1 if r[1] is None else r[1]):
        sums[k] = sums.get(k, 0) + v
        want.append((k, i, v, sums[k]))
    got = [tuple(r) for r in ranking.running_total(df, ["k"], "id", "v", "t", slices=slices).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("versions", [7, 4096])
def test_validity_of_a_hot_record(spark, versions):
    df = spark.range(500).select(F.concat(F.lit("r"), F.col("id") % 2).alias("record_key"), F.floor(F.col("id") / 2).alias("version"),
                                 (F.col("id") * 10).alias("commit_ts"))
    got = {(r.record_key, r.version): (r.valid_from, r.valid_to) for r in history.with_validity(df, versions).collect()}
    assert got == {(f"r{i % 2}", i // 2): (i * 10, (i + 2) * 10 if i < 498 else None) for i in range(500)}


def _quota(rows, n, w):
    kept, out = {}, {}
    for client, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        live = [x for x in kept.get(client, []) if t - x < w]
        out[i] = len(live) < n
        kept[client] = live + [t] if out[i] else live
    return out


def test_quota_brute_force(spark):
    rnd = random.Random(5)
    rows = [(f"c{rnd.randrange(3)}", rnd.randrange(0, 4000), i) for i in range(400)]
    df = spark.createDataFrame(rows, "client_id STRING, t BIGINT, event_id BIGINT").withColumn("ts", F.timestamp_seconds("t"))
    got = oplog.quota_audit(df, 2, 60).collect()
    assert {r.event_id: r.allowed for r in got} == _quota(rows, 2, 60)


def test_quota_boundary(spark):
    df = spark.createDataFrame([("c", t, i) for i, t in enumerate([1, 2, 3, 70])], "client_id STRING, t BIGINT, event_id BIGINT")
    got = oplog.quota_audit(df.withColumn("ts", F.timestamp_seconds("t")), 2, 60).orderBy("event_id").collect()
    assert [r.allowed for r in got] == [True, True, False, True]


def test_percentiles(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("latency_ms"))
    assert {r.percentile: r.value for r in oplog.latency_percentiles(df).collect()} == {50: 5, 90: 9, 95: 9, 99: 9}
    mixed = [-3.5, -3.5, 0.0, 1e-9, 2.0, 2.0, 2.0, 1e12]
    df = spark.createDataFrame([(x,) for x in mixed], "latency_ms DOUBLE")
    want = {p: sorted(mixed)[int(p / 100 * (len(mixed) - 1))] for p in (0, 10, 50, 90, 100)}
    assert {r.percentile: r.value for r in oplog.latency_percentiles(df, list(want)).collect()} == want


def test_completeness_example(spark):
    raw = '{"a":"x","b":"","c":[1,0,{"d":"To be filled"}],"e":{"f":true}}'
    df = spark.createDataFrame([(raw,)], "raw STRING").withColumn("body", F.parse_json("raw"))
    row = quality.completeness(df).select("total_fields", "filled_fields").first()
    assert tuple(row) == (8, 3)


def test_quality_example(spark):
    got = spark.range(1).select(F.round(quality.quality(F.lit(0.45), F.lit(True)), 9), F.round(quality.quality(F.lit(0.5), F.lit(False)), 9)).first()
    assert tuple(got) == (0.56, 0.3)


def _record(spark, kind, body):
    return spark.createDataFrame([("r", kind, json.dumps(body))], "record_key STRING, metadata_type STRING, raw STRING").withColumn("body", F.parse_json("raw"))


AUDIT = {"created_by": "a", "created_date": "b", "last_modified_by": "c", "last_modified_date": "d"}


def test_absent_access_level_needs_both_fields(spark):
    df = _record(spark, "dataset_administrative", {"dataset_identifier_link": "x", **AUDIT})
    found = validation.violation_rows(validation.validate(df)).select("field_path", "rule").collect()
    assert ("embargo_end_date", "conditional") in [tuple(r) for r in found]
    assert ("access_conditions_contact", "conditional") in [tuple(r) for r in found]


def test_default_records_are_valid(spark):
    projects = spark.createDataFrame([("p_x",)], "project_key STRING")
    made = templates.init_projects(projects, "now").withColumn("record_key", F.col("project_key"))
    assert validation.validate(made).select("valid").first()[0]


def test_strict_validation_fails(spark):
    df = _record(spark, "project_descriptive", {})
    with pytest.raises(Exception, match="invalid record r"):
        validation.validate(df, strict=True).select("valid").collect()


def test_updates_are_judged_before_ids_are_restored(spark):
    old = {"project_identifier": "p1", "project_title": "t", **AUDIT}
    current = _record(spark, "project_descriptive", old)
    accepted, rejected = records.apply_updates(current, _record(spark, "project_descriptive", {"project_identifier": "other"}), "now")
    row = accepted.select(V.text("body", "project_identifier"), V.text("body", "created_by"), V.text("body", "last_modified_date")).first()
    assert tuple(row) == ("p1", "a", "now") and rejected.count() == 0
    accepted, rejected = records.apply_updates(current, _record(spark, "project_descriptive", {"project_identifier": 5}), "now")
    assert accepted.count() == 0 and rejected.count() == 1


def test_legacy_template(spark):
    run_id = "exp_d_genomics_seq_001_genomics_sequencing"
    df = _record(spark, "experiment_contextual", {"experiment_identifier_run_id": run_id})
    row = records.migrate_contextual(df).select(V.text("body", "experiment_template_type"), V.text("body", "experiment_identifier_run_id")).first()
    assert row[0] == "seq_001_genomics_sequencing" and row[1] != run_id


def test_inheritance(spark):
    admin = {"data_steward_contact_person": {"name": "n"}, "default_license": "l", "default_access_level": None, "unused_field": "u"}
    df = spark.createDataFrame([(json.dumps(admin),)], "raw STRING").withColumn("admin", F.parse_json("raw"))
    got = df.select(F.map_keys(templates.inherited(F.col("admin")))).first()[0]
    assert sorted(got) == ["data_steward_contact_person", "license"]


def test_tree_on_disk(spark, tmp_path):
    meta = tmp_path / "p_a" / "d_b" / ".metadata"
    meta.mkdir(parents=True)
    (meta / "dataset_structural.json").write_text('{"dataset_title":"T"}')
    (meta / "broken.json").write_text('{"x":')
    data = tmp_path / "p_a" / "d_b" / "data.csv"
    data.write_bytes(b"0123456789")
    loaded = {r.metadata_type: r for r in io.load_records(spark, str(tmp_path)).collect()}
    assert loaded["dataset_structural"].readable and not loaded["broken"].readable
    assert (loaded["dataset_structural"].project_key, loaded["dataset_structural"].dataset_key) == ("p_a", "d_b")
    listed = files.checksum_files(io.scan_files(spark, str(tmp_path)).where("path LIKE '%csv'").select("path"), chunk_bytes=3)
    assert listed.first().checksum == hashlib.sha256(b"0123456789").hexdigest()


def test_registry_on_disk(spark, tmp_path):
    (tmp_path / "contextual").mkdir()
    (tmp_path / "contextual" / "assay.json").write_text('{"title":"Assay"}')
    (tmp_path / "bad.json").write_text("{")
    got = io.load_schema_registry(spark, {"local": (str(tmp_path), 1)}).select("schema_id", "title", "source").collect()
    assert [tuple(r) for r in got] == [("contextual/assay", "Assay", "local")]
    assert packaged_registry(spark).count() == 10


def test_manifest_stream_in_two_starts(spark, tmp_path):
    source, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    schema = "dataset_id STRING, file_name STRING, size BIGINT, note STRING, seq BIGINT"
    for batch in ([("d", "a", 1, "kept", 1), ("d", "b", 1, None, 2)], [("d", "a", 5, None, 3)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.stream_manifest(spark.readStream.schema(schema).parquet(source), table, mark, ["seq"]).awaitTermination()
    got = {r.file_name: (r.size, r.note) for r in io.read_snapshot(spark, table).collect()}
    assert got == {"a": (5, "kept"), "b": (1, None)}


def test_quota_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(9)
    rows = sorted([(f"c{rnd.randrange(2)}", t, t) for t in rnd.sample(range(1000), 60)], key=lambda r: r[1])
    source, table, state, mark = (str(tmp_path / n) for n in ("in", "table", "state", "mark"))
    schema = "client_id STRING, t BIGINT, event_id BIGINT"
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).select("client_id", F.timestamp_seconds("t").alias("ts"), "event_id").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("client_id STRING, ts TIMESTAMP, event_id BIGINT").parquet(source)
        ingest.stream_quota(stream, table, state, mark, 2, 60).awaitTermination()
    got = {r.event_id: r.allowed for r in spark.read.parquet(table).where("NOT carried").collect()}
    assert got == _quota(rows, 2, 60)


def test_percentiles_with_infinite_and_missing_values(spark):
    values = [float("inf"), float("-inf"), 1.0, 2.0, 3.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "latency_ms DOUBLE")
    got = {r.percentile: r.value for r in oplog.latency_percentiles(df, [0, 50, 100]).collect()}
    assert got == {0: float("-inf"), 50: 2.0, 100: float("inf")}


def _deep(depth, leaf):
    value = leaf
    for _ in range(depth):
        value = {"k": value}
    return value


def _deep_schema(depth, leaf):
    node = leaf
    for _ in range(depth):
        node = {"type": "object", "properties": {"k": node}}
    return node


def _layers(spark, rows):
    """Registry rows: root, id, source, schema."""
    data = [(root, sid, source, ["explicit", "local", "custom", "packaged"].index(source), sid, None, json.dumps(body)) for root, sid, source, body in rows]
    return spark.createDataFrame(data, "data_root STRING, schema_id STRING, source STRING, priority INT, title STRING, description STRING, body STRING")


def _records(spark, rows):
    data = [(f"r{i}", "project_descriptive", json.dumps(body), root) for i, (root, body) in enumerate(rows)]
    return spark.createDataFrame(data, "record_key STRING, metadata_type STRING, raw STRING, data_root STRING").withColumn("body", F.parse_json("raw"))


def test_completeness_at_any_depth_and_with_odd_texts(spark):
    bodies = [_deep(12, "x"), _deep(12, ""), {"a\"": "q\"\"", "b": "To be filled", 'c:,[]{}"': "say \"To be filled\"", "d": [0.0, -0, 1e5, "s", None, [2, []], {"e": False}]},
              {}, [], {"a": {}, "b": [], "c": "\\"}, {"n": [[["x", ""]], True], "esc": "\\\"", "u": "\u2028é"}]
    df = _records(spark, [("", b) for b in bodies])

    def count(v):
        total = filled = 0
        for x, member in ([(x, True) for x in v.values()] if isinstance(v, dict) else [(x, False) for x in v]):
            inner = isinstance(x, (dict, list))
            total += member or not inner
            if inner:
                t, f = count(x)
                total, filled = total + t, filled + f
            else:
                filled += bool(x) and x != "To be filled"
        return total, filled

    got = {r.record_key: (r.total_fields, r.filled_fields) for r in quality.completeness(df).collect()}
    assert got == {f"r{i}": count(b) for i, b in enumerate(bodies)}


def test_validation_and_normalisation_as_deep_as_the_schema(spark):
    registry = _layers(spark, [("", "project_descriptive", "local", _deep_schema(9, {"type": "integer"}))])
    df = _records(spark, [("", _deep(9, 5)), ("", _deep(9, "no")), ("", _deep(4, "x"))]).drop("data_root")
    got = {r.record_key: [(v.field_path, v.rule) for v in r.violations] for r in validation.validate(df, registry).collect()}
    assert got == {"r0": [], "r1": [("k" + ".k" * 8, "type")], "r2": [("k.k.k.k", "type")]}
    shallow = _layers(spark, [("", "project_descriptive", "local", _deep_schema(4, {"type": "integer"}))])
    text = validation.normalize(_records(spark, [("", _deep(4, "5"))]).drop("data_root"), shallow).select(F.to_json("body")).first()[0]
    assert json.loads(text) == _deep(4, 5)


def test_grouped_errors_are_validated_once(spark):
    df = _records(spark, [("", {"project_title": 5}), ("", {"project_identifier": "p", "project_title": "t"})]).drop("data_root")
    rows = validation.error_rows(validation.group_errors(validation.validate(df, rules=("type", "required"))))
    plain = validation.validate(df, rules=("type", "required")).select("record_key", F.explode("violations.field_path").alias("p")).collect()
    assert plain and sorted((r.record_key, r.field_path) for r in rows.collect() for _ in r.messages) == sorted(map(tuple, plain))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "- Filter" in line and "flatten" in line]  # no copy of the walk below the joins


def test_violation_rows_are_validated_once(spark):
    df = _records(spark, [("", {"project_title": 5}), ("", {"project_identifier": "p", "project_title": "t"})]).drop("data_root")
    checked = validation.validate(df, rules=("type", "required", "pattern"))
    rows = validation.violation_rows(checked)
    assert sorted((r.record_key, r.field_path, r.rule) for r in rows.collect()) == sorted(
        (r.record_key, v.field_path, v.rule) for r in checked.collect() for v in r.violations) != []
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "- Filter" in line and "flatten" in line]


def test_layers_and_roots_give_one_row_per_record(spark):
    one, two = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}}}, {"type": "object", "required": ["b"]}
    registry = _layers(spark, [("x", "project_descriptive", "packaged", two), ("x", "project_descriptive", "explicit", one),
                               ("x", "project_descriptive", "custom", two), ("y", "project_descriptive", "packaged", two)])
    df = _records(spark, [("x", {"a": "v"}), ("y", {"a": "v"}), ("z", {"a": "v"})])
    rows = validation.validate(df, registry).collect()
    assert {r.record_key: [v.field_path for v in r.violations] for r in rows} == {"r0": [], "r1": ["b"], "r2": []} and len(rows) == 3
    assert validation.validate(df.drop("data_root"), registry).count() == 3
    assert validation.normalize(df, registry).count() == 3 and validation.clean_enums(df, registry).count() == 3
    assert quality.section_progress(df, registry).select("record_key").distinct().count() == 1
    dirs = spark.createDataFrame([("p_1", "x"), ("p_2", "y")], "project_key STRING, data_root STRING")
    got = {r.project_key: json.loads(r.b) for r in templates.init_projects(dirs, "t", registry).select("project_key", F.to_json("body").alias("b")).collect()}
    assert set(got) == {"p_1", "p_2"} and "a" in got["p_1"]


def test_dotted_names_type_lists_lengths_and_closed_objects(spark):
    schema = {"type": "object", "additionalProperties": False, "properties": {
        "a.b": {"type": "integer"}, "a": {"type": "object", "properties": {"b": {"type": "string", "minLength": 3}}},
        "t": {"type": ["string", "integer"]}, "u": {"type": "string", "anyOf": [{"minLength": 1}]}}}
    df = _records(spark, [("", {"a.b": 1, "a": {"b": "long"}, "t": 4}), ("", {"a.b": "x", "a": {"b": ""}, "t": True, "more": 1}), ("", {"u": "v"})])
    rows = validation.validate(df.drop("data_root"), _layers(spark, [("", "project_descriptive", "local", schema)])).collect()
    got = {r.record_key: sorted((v.field_path, v.rule) for v in r.violations) for r in rows}
    assert got == {"r0": [], "r1": [("a.b", "length"), ("a.b", "type"), ("more", "additional"), ("t", "type")], "r2": [("u", "schema")]}


def test_gate_takes_any_white_space_for_empty(spark):
    assert values(spark, ['"\\t"', '"\\u00a0 "', '"x"', "null", '"To be filled"'], V.passes_gate(F.parse_json("v"))) == [False, False, True, False, False]


def test_updates_of_one_record_are_reduced_in_order(spark):
    current = _records(spark, [("", {"a": 1, "b": 1})]).drop("raw", "data_root")
    updates = spark.createDataFrame([("r0", "project_descriptive", '{"a":2,"c":2}', 2), ("r0", "project_descriptive", '{"a":3}', 3), ("r0", "project_descriptive", '{"c":1}', 1)],
                                    "record_key STRING, metadata_type STRING, raw STRING, seq INT").withColumn("body", F.parse_json("raw")).drop("raw")
    rows = records.merge_records(current, updates, ["seq"]).select(F.to_json("body").alias("b")).collect()
    assert [json.loads(r.b) for r in rows] == [{"a": 3, "b": 1, "c": 2}]


def test_work_on_records_is_spread(spark):
    # The given documents are one file with one row group.
    rows = all_queries.QUERIES["f16_normalize"](spark, "/root/testdata/sf0.001")
    sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 0.3 * sum(sizes)


def test_letters_are_sorted_without_a_lambda(spark):
    df = spark.createDataFrame([("bß€a\U0001f600",), ("",), (None,)], "t string").select(validation_queries._letters(F.col("t")).alias("l"))
    assert "lambda" not in df._jdf.queryExecution().toString()
    assert [r[0] for r in df.collect()] == ["abß€\U0001f600", "", None]


def test_kinds_follow_the_json_text(spark):
    texts = ["{}", "[]", "[null]", '{"a":[{"b":null}]}', '"x"', '""', '"{"', "-1", "1.5", "1e10", "1e400", "9" * 30, "9" * 50, "true", "false", "null", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("v")).unionByName(
        spark.sql("SELECT double('NaN')::variant AS v UNION ALL SELECT date'2020-01-01'::variant UNION ALL SELECT X'01'::variant"))
    assert df.where(~V.kind("v").eqNullSafe(V.kind_of_json(F.to_json("v")))).count() == 0


def test_dataset_bodies_are_made_for_the_wanted_type_with_fields_read_once_per_project(spark):
    projects = spark.createDataFrame([("p_1", "a"), ("p_2", "b")], "project_key STRING, project_identifier STRING")
    admins = spark.createDataFrame([("p_1", '{"default_license":"CC0","default_access_level":null,"unused_field":1}')],
                                   "project_key STRING, raw STRING").select("project_key", F.parse_json("raw").alias("body"))
    datasets = spark.createDataFrame([("p_1", "d_1", "a"), ("p_1", "d_2", "a"), ("p_2", "d_3", "b"), ("p_3", "d_4", "c")],
                                     "project_key STRING, dataset_key STRING, project_id STRING")
    known = templates.project_admin_for(datasets, projects, admins)
    assert [list(r[0]) for r in known.where("dataset_key = 'd_1'").select(F.map_keys("admin_inherited")).collect()] == [["license"]]

    def bodies(df):
        return {(r.dataset_key, r.metadata_type): json.loads(r.b) for r in df.withColumn("b", F.to_json("body")).collect()}

    made = templates.init_datasets(known, "t")
    got = bodies(made)
    assert got == bodies(templates.init_datasets(known.drop("admin_inherited"), "t")) and len(got) == 8
    assert [got[d, "dataset_administrative"]["license"] for d in ("d_1", "d_2", "d_3", "d_4")] == ["CC0", "CC0", "To be filled", "To be filled"]
    wanted = made.where("metadata_type = 'dataset_administrative'")
    assert bodies(wanted) == {k: v for k, v in got.items() if k[1] == "dataset_administrative"}
    plan = wanted._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [line for line in plan if "Generate" in line and "to_variant_object" in line]
    body, kept = ([i for i, line in enumerate(plan) if text in line][0] for text in ("to_variant_object", "Filter (metadata_type"))
    assert body < kept  # bodies are made above the filter, of the rows that it keeps


def test_containers_follow_the_json_text(spark):
    texts = ["{}", "[]", '{"a":1}', "[null]", '"{"', '"[x"', "1.5", "1e400", "true", "null", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("v"))
    assert df.where(~V.is_container("v").eqNullSafe(V.is_container_json(F.to_json("v")))).count() == 0
