"""Ingest with a ledger, retention texts, migration chains, prefilled values."""

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from fairlake.operators import lifecycle as L
from fairlake.operators import quality
from fairlake.sources import ingest_catalog as I


def test_ingest_reads_changed_files_only_and_settles_duplicates(spark, tmp_path):
    roots = [str(tmp_path / "a"), str(tmp_path / "b")]

    def write(name, text, at):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (at, at))

    for k in range(5):
        write(f"a/p/{k}.json", f'{{"k":{k}}}', 1000 + k)
    write("b/p/0.json", '{"k":"newer"}', 2000)
    write("b/p/1.json", '{"k":"older"}', 10)
    write("b/x.txt", "no record", 10)
    table = str(tmp_path / "catalog")
    assert I.ingest_catalog(spark, roots, table, 4) == 7
    assert I.ingest_catalog(spark, roots, table, 4) == 0

    def rows():
        return {r.record_key: (os.path.basename(r.root), r.raw, r.copies) for r in I.catalog_records(spark, table).collect()}

    assert rows() == {"p/0": ("b", '{"k":"newer"}', 2), "p/1": ("a", '{"k":1}', 2)} | {f"p/{k}": ("a", f'{{"k":{k}}}', 1) for k in (2, 3, 4)}
    write("a/p/2.json", "{broken", 3000)
    (tmp_path / "b/p/0.json").unlink()
    (tmp_path / "a/p/4.json").unlink()
    assert I.ingest_catalog(spark, roots, table, 4) == 1
    now = rows()
    assert now["p/0"] == ("a", '{"k":0}', 1) and now["p/2"][1] == "{broken" and "p/4" not in now
    assert I.catalog_records(spark, table).where("body IS NULL").count() == 1
    write("a/p/4.json", '{"k":"back"}', 4000)
    assert I.ingest_catalog(spark, roots, table, 4) == 1 and rows()["p/4"] == ("a", '{"k":"back"}', 1)


@pytest.mark.parametrize("text, state, due", [
    ("10 years", "limited", date(2034, 1, 31)), ("1 month", "limited", date(2024, 2, 29)), ("P1M", "limited", date(2024, 2, 29)), ("P1Y1M", "limited", date(2025, 2, 28)),
    ("p1m1d", "limited", date(2024, 3, 1)), ("2 weeks, 3 days", "limited", date(2024, 2, 17)), ("1 Year and 1 year", "limited", date(2026, 1, 31)),
    ("P2W", "limited", date(2024, 2, 14)), ("0 days", "limited", date(2024, 1, 31)), ("Indefinitely", "unlimited", None), ("for ever", "unlimited", None),
    ("P", "unknown", None), ("ten years", "unknown", None), ("10", "unknown", None), ("-5 years", "unknown", None), ("10 years or so", "unknown", None),
    ("PT5M", "unknown", None), (None, "none", None), (" \t", "none", None)])
def test_retention_texts(spark, text, state, due):
    df = spark.createDataFrame([(text, date(2024, 1, 31))], "schedule STRING, start_date DATE")
    r = L.retention_due(df, F.lit("2024-02-29").cast("date")).first()
    assert (r.retention, r.due_date, r.due) == (state, due, due is not None and due <= date(2024, 2, 29))


def test_shortest_chain():
    steps = [L.Step("s", "1", "2"), L.Step("s", "2", "3"), L.Step("s", "3", "1"), L.Step("s", "1", "3x"), L.Step("t", "1", "3")]
    assert [(x.old, x.new) for x in L.shortest_chain(steps, "s", "1", "3")] == [("1", "2"), ("2", "3")]
    assert L.shortest_chain(steps, "s", "3", "3") == [] and L.shortest_chain(steps, "s", "9", "3") is None


def test_migration_over_two_steps(spark):
    steps = [L.Step("s", "1", "2", rename={"a": "b"}, default={"c": '{"x":[1]}'}), L.Step("s", "2", "3", convert={"n": "int"}, drop=("gone",))]
    rows = [("k0", "s", "1", '{"a":1,"n":"5","gone":true}'), ("k1", "s", "1", '{"a":1,"b":2}'), ("k2", "s", "2", '{"a":1,"n":"five"}'), ("k3", "s", "3", '{"a":1}'),
            ("k4", "s", "0", '{"a":1}'), ("k5", "t", "1", '{"a":1}'), ("k6", "s", None, '{"a":1}'), ("k7", "s", "1", '[1]'), ("k8", "s", "2", '{"n":null,"c":5}')]
    df = spark.createDataFrame(rows, "record_key STRING, schema_id STRING, version STRING, raw STRING").withColumn("body", F.parse_json("raw")).drop("raw")
    got = {r.record_key: (json.loads(r.b), r.migrated_version, r.problems) for r in L.migrate(df, steps, {"s": "3"}).withColumn("b", F.to_json("body")).collect()}
    assert got == {
        "k0": ({"b": 1, "n": 5, "c": {"x": [1]}}, "3", []), "k1": ({"b": 2, "c": {"x": [1]}}, "3", []), "k2": ({"a": 1, "n": "five"}, "3", ["n"]),
        "k3": ({"a": 1}, "3", []), "k4": ({"a": 1}, "0", ["no way to 3"]), "k5": ({"a": 1}, "1", []), "k6": ({"a": 1}, None, ["no way to 3"]),
        "k7": ([1], "1", []), "k8": ({"n": None, "c": 5}, "3", [])}


def test_prefill_takes_the_version_valid_at_the_date(spark):
    d = date.fromisoformat
    samples = spark.createDataFrame([
        ("s", "lims", 0, d("2024-01-01"), "old", None), ("s", "lims", 0, d("2024-02-01"), "new", None), ("s", "lims", 0, d("2024-02-01"), "also", None),
        ("s", "bank", 1, d("2024-01-15"), "bank", "T")], "sample_id STRING, source STRING, precedence INT, valid_from DATE, p STRING, t STRING")
    rows = [("r0", "s", d("2024-01-31"), "{}"), ("r1", "s", d("2024-02-01"), '{"p":" ","t":"own"}'), ("r2", "s", d("2023-12-31"), "{}"), ("r3", None, d("2024-02-01"), "{}"),
            ("r4", "other", d("2024-02-01"), '{"p":"To be filled"}'), ("r5", "s", None, "{}"), ("r6", "s", d("2024-03-01"), '{"p":0,"t":null}')]
    df = spark.createDataFrame(rows, "record_key STRING, sample_id STRING, experiment_date DATE, raw STRING").withColumn("body", F.parse_json("raw")).drop("raw")
    got = {r.record_key: (json.loads(r.b), r.filled) for r in L.prefill(df, samples, ["p", "t"]).withColumn("b", F.to_json("body")).collect()}
    assert got == {"r0": ({"p": "old", "t": "T"}, {"p": "lims", "t": "bank"}), "r1": ({"p": "new", "t": "own"}, {"p": "lims"}), "r2": ({}, {}), "r3": ({}, {}),
                   "r4": ({"p": "To be filled"}, {}), "r5": ({}, {}), "r6": ({"p": 0, "t": "T"}, {"t": "bank"})}


def test_prefill_of_a_sample_with_many_records_and_versions(spark):
    n = 4000  # 16 million pairs of records and versions
    samples = spark.range(n).selectExpr("'s' AS sample_id", "'lims' AS source", "CAST(id % 2 AS INT) AS precedence", "date_add(DATE'2024-01-01', CAST(id % 50 AS INT)) AS valid_from",
                                        "CASE WHEN id % 3 > 0 THEN lpad(CAST(id AS STRING), 5, '0') END AS p")
    rows = spark.range(n).selectExpr("CAST(id AS STRING) AS record_key", "'s' AS sample_id", "date_add(DATE'2023-12-31', CAST(id % 60 AS INT)) AS experiment_date", "'{}' AS raw")
    filled = L.prefill(rows.withColumn("body", F.parse_json("raw")).drop("raw"), samples, ["p"])
    got = {int(r.record_key): r.p for r in filled.select("record_key", F.try_variant_get("body", "$.p", "string").alias("p")).collect()}
    versions = {}
    for i in range(n):
        if i % 3:
            versions[i % 50] = max(versions.get(i % 50, ((-2,), "")), ((-(i % 2), i % 50), f"{i:05}"))
    assert got == {i: max((v for day, v in versions.items() if day < i % 60), default=(0, None))[1] for i in range(n)}
    plan = [filled._jdf.queryExecution().optimizedPlan().toString()]
    assert "<= " not in plan[0]  # records meet one row each, not every version before their date


def test_instruments_join_the_complete_record(spark):
    done = spark.createDataFrame([("p", k, '{"version":"2.0","metadata_components":{"a":{"x":1}}}') for k in "abcd"], "project_key STRING, dataset_key STRING, document STRING")
    links = [("a", '{"instrument_used_link":["I2","none","I1","I2"," ",null,{"z":1}]}'), ("b", '{"instrument_used_link":"I1"}'), ("c", "{}"), ("x", '{"instrument_used_link":["I1"]}')]
    contextual = spark.createDataFrame([("p", k, t) for k, t in links], "project_key STRING, dataset_key STRING, raw STRING").withColumn("body", F.parse_json("raw"))
    known = spark.createDataFrame([("I1", '{"n":1}'), ("I2", '{"n":2}')], "instrument_id STRING, raw STRING").withColumn("body", F.parse_json("raw"))
    got = {r.dataset_key: (json.loads(r.document), r.unknown_instruments) for r in quality.with_instruments(done, contextual, known).collect()}
    want = {"a": ([{"n": 2}, {"n": 1}], ["none"]), "b": ([{"n": 1}], []), "c": ([], []), "d": ([], [])}
    assert got == {k: ({"version": "2.0", "metadata_components": {"a": {"x": 1}, "instruments": found}}, lost) for k, (found, lost) in want.items()}
