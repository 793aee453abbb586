"""Records under layered registries, repeated updates and conditional rules."""

import json

from pyspark.sql import functions as F
from test_operators import _layers, _records

from fairlake.operators import records, validation

TS = "2024-03-01T00:00:00"


def test_two_updates_of_one_record_give_one_judged_row(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "string"}}}
    registry = _layers(spark, [("", "project_descriptive", "local", schema)])
    current = _records(spark, [("", {"a": 1, "b": "x"}), ("", {"a": 1})]).drop("raw", "data_root")
    updates = spark.createDataFrame(
        [("r0", "project_descriptive", '{"a":2,"b":7}', 1), ("r0", "project_descriptive", '{"b":"y"}', 2), ("r1", "project_descriptive", '{"a":"no"}', 1),
         ("r1", "project_descriptive", '{"a":5}', 0)], "record_key STRING, metadata_type STRING, raw STRING, seq INT").withColumn("body", F.parse_json("raw")).drop("raw")
    accepted, rejected = records.apply_updates(current, updates, TS, registry, order=["seq"])
    body = json.loads(accepted.select(F.to_json("body")).first()[0])
    assert (body["a"], body["b"]) == (2, "y") and accepted.count() == 1
    assert [r.record_key for r in rejected.collect()] == ["r1"]
    assert records.judge_updates(current, updates, TS, registry).count() == 2


def test_layers_give_each_record_one_schema(spark):
    one = {"type": "object", "properties": {}}
    registry = _layers(spark, [("x", "project_descriptive", "packaged", one), ("x", "project_descriptive", "explicit", one), ("y", "project_descriptive", "custom", one)])
    df = _records(spark, [("x", {}), ("y", {}), ("z", {})])
    got = {r.record_key: r.schema_source for r in records.records_with_schema(df, registry).collect()}
    assert got == {"r0": "explicit", "r1": "custom", "r2": None}
    rows = records.records_with_schema(df.drop("data_root"), registry).collect()
    assert len(rows) == 3 and {r.schema_source for r in rows} == {"explicit"}


def _found(spark, schema, bodies):
    rows = validation.validate(_records(spark, [("", b) for b in bodies]).drop("data_root"),
                               _layers(spark, [("", "project_descriptive", "local", schema)])).collect()
    return [sorted(v.rule for v in r.violations) for r in sorted(rows, key=lambda r: r.record_key)]


def test_conditions_are_checked_or_reported(spark):
    base = {"type": "object", "properties": {"k": {"type": "string"}, "n": {"type": "string"}}}
    rule = {"if": {"properties": {"k": {"const": "on"}}}, "then": {"required": ["n"]}}
    bodies = [{"k": "on"}, {"k": "off"}, {"k": "on", "n": "x"}]
    assert _found(spark, base | rule, bodies) == [["conditional"], [], []]
    assert _found(spark, base | {"allOf": [rule]}, bodies) == [["conditional"], [], []]
    for odd in ({"if": {"properties": {"k": {"pattern": "^o"}}}, "then": {"required": ["n"]}}, rule | {"else": {"required": ["n"]}},
                {"if": rule["if"], "then": {"properties": {"n": {"minLength": 2}}}}, {"if": {"required": ["k"]}, "then": {"required": ["n"]}}):
        for schema in (base | odd, base | {"allOf": [odd]}):
            assert all("schema" in rules for rules in _found(spark, schema, bodies)), odd
    tuple_items = {"type": "object", "properties": {"k": {"type": "array", "items": [{"type": "string"}]}}}
    assert _found(spark, tuple_items, [{"k": []}]) == [["schema"]]
