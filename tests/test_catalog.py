"""Search, link audit, duplicates: edge cases, hot keys and reuse."""

import json
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from fairlake.operators import files, links, search


def slow_search(docs, text, top):
    found = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs.items()}
    mean, out = sum(map(len, found.values())) / len(found), []
    for i, words in found.items():
        counts, score, hit = Counter(words), 0, False
        for term in set(re.findall(r"[^\W_]+", text.lower())):
            df = sum(term in w for w in found.values())
            if counts[term]:
                hit = True
                weight = math.log(1 + (len(found) - df + 0.5) / (df + 0.5))
                score += round(1_000_000 * weight * counts[term] * 2.2 / (counts[term] + 1.2 * (0.25 + 0.75 * len(words) / mean)))
        if hit:
            out.append((-score, i))
    return [(i, -s) for s, i in sorted(out)[:top]]


def test_search_against_brute_force_and_reuse(spark, tmp_path):
    docs = {f"r{i}": f"common Word{i % 7} alpha-{i % 3} " + "beta " * (i % 5) + ("Größe" if i == 4 else "") for i in range(120)} | {"empty": "", "none": None}
    rows = [(k, t, "even" if n % 2 else "odd") for n, (k, t) in enumerate(docs.items())] + [(None, "common", "odd")]
    path = str(tmp_path / "index")
    search.build_index(spark.createDataFrame(rows, "record_key string, text string, side string"), path, fields=["side"])
    asked = {1: "COMMON word3", 2: "beta beta größe", 3: "absent", 4: "", 5: "word1 alpha 1"}
    queries = spark.createDataFrame([(k, t, 0) for k, t in asked.items()] + [(None, "common", 0)], "query_id int, text string, score int")
    got = {}
    for r in search.search(spark, path, queries, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.record, r.score))
    assert got == {k: want for k, t in asked.items() if (want := slow_search(docs, t, 7))}
    allowed = {r[0] for r in rows if r[2] == "even"}
    some = search.search(spark, path, queries, 5, F.col("side") == "even").where("query_id = 1").orderBy("rank").collect()
    assert [(r.record, r.score) for r in some] == [x for x in slow_search(docs, asked[1], 200) if x[0] in allowed][:5]
    plan = search.search(spark, path, queries)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # each task hands on its best only


def test_search_adds_scores_up_where_a_records_postings_meet(spark, tmp_path, monkeypatch):
    docs = {f"r{i:03}": f"all words{i % 5} all w{i % 11} " + "x " * (i % 4) for i in range(300)}
    path = str(tmp_path / "index")
    search.build_index(spark.createDataFrame(list(docs.items()), "record_key string, text string"), path)
    asked = {i: f"all w{i % 11} x words{i % 5}" for i in range(40)}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    monkeypatch.setattr(search, "PAIRS", 1500)  # eight tasks
    found, got = search.search(spark, path, queries, 6), {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.record, r.score))
    assert got == {k: slow_search(docs, t, 6) for k, t in asked.items()}
    plan = found._jdf.queryExecution().toString()
    assert not re.search(r"hashpartitioning\(query_id#\w+, record", plan) and re.search(r"hashpartitioning\(record#\w+, 8\)", plan)


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "record_key string, text string")
    search.build_index(none, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "word")], "query_id int, text string")
    assert search.search(spark, str(tmp_path / "index"), queries).collect() == []


def make(spark, rows):
    return spark.createDataFrame([(k, t, json.dumps(b)) for k, t, b in rows], "record_key string, metadata_type string, raw string").withColumn(
        "body", F.parse_json("raw"))


def test_broken_links_follow_the_hierarchy_and_end(spark):
    rows = [("p1", "project_descriptive", {"project_identifier": "P1"}), ("d1", "dataset_structural", {"dataset_identifier": "D1", "associated_project_identifier": "P1"}),
            ("d2", "dataset_structural", {"dataset_identifier": "D2", "associated_project_identifier": "gone"}),
            ("d3", "dataset_structural", {"dataset_identifier": "D3", "associated_project_identifier": "To be filled"}),
            ("e1", "experiment_contextual", {"dataset_identifier_link": "D1", "instrument_used_link": ["I1", "I2", " ", None, {"a": 1}]}),
            ("e2", "experiment_contextual", {"dataset_identifier_link": "D2", "instrument_used_link": "I1"}),
            ("e3", "experiment_contextual", {"dataset_identifier_link": "D3"}), ("a2", "dataset_administrative", {"dataset_identifier_link": "D2"}),
            ("pa", "project_administrative", {"project_identifier_link": "gone"}), ("x", "other", {"dataset_identifier_link": "gone"}), ("n", "dataset_structural", {})]
    df, instruments = make(spark, rows), spark.createDataFrame([("I1",)], "instrument_id string")
    want = {("d2", "associated_project_identifier", "gone", 1), ("pa", "project_identifier_link", "gone", 1), ("e1", "instrument_used_link", "I2", 1),
            ("e2", "dataset_identifier_link", "D2", 2), ("a2", "dataset_identifier_link", "D2", 2)}
    assert {tuple(r) for r in links.broken_links(df, instruments).collect()} == want
    assert links.broken_links(df.where("false"), instruments).collect() == []
    assert sum(r.field == "instrument_used_link" for r in links.broken_links(df).collect()) == 3


def test_hot_broken_target(spark):
    rows = [(f"e{i}", "experiment_contextual", {"dataset_identifier_link": "gone" if i % 2 else "D"}) for i in range(4000)]
    rows.append(("d", "dataset_structural", {"dataset_identifier": "D"}))
    assert links.broken_links(make(spark, rows)).count() == 2000


def test_duplicate_files_by_content_column_and_by_path(spark, tmp_path):
    contents = {f"f{i}": "same" if i % 2 else f"c{i:03}" for i in range(400)} | {"empty1": "", "empty2": "", "one": "abcd", "null": None}
    df = spark.createDataFrame([(k, len(t) if t is not None else None) for k, t in contents.items()], "path string, size_bytes long")
    texts = spark.createDataFrame(list(contents.items()), "path string, content string")
    got = {(r.size_bytes, r.representative, r.n_files, r.wasted_bytes) for r in files.duplicate_files(df, texts).collect()}
    assert got == {(4, "f1", 200, 796), (0, "empty1", 2, 0)}
    for name in ("a", "b", "c"):
        (tmp_path / name).write_bytes(b"x" * 10 if name < "c" else b"y" * 10)
    paths = spark.createDataFrame([(str(tmp_path / n), 10) for n in "abc"] + [(str(tmp_path / "lost"), 10)], "path string, size_bytes long")
    rows = files.duplicate_files(paths).collect()
    assert [(r.representative, r.n_files, r.wasted_bytes) for r in rows] == [(str(tmp_path / "a"), 2, 10)]
    assert files.duplicate_files(paths.where("false")).collect() == []
