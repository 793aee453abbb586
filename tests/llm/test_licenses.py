"""Licence scans against comparison with every template."""

import re

import pytest

from fairlake.llm import licenses


def grams(text):
    w = re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())
    return set(w) if len(w) < 2 else {" ".join(p) for p in zip(w, w[1:])}


def slow(rows, threshold=0.8):
    out = []
    for doc, text in rows:
        for line, passage in enumerate((text or "").split("\n")):
            g, found = grams(passage), []
            for name, texts in licenses.TEMPLATES.items():
                for k, t in enumerate(texts):
                    h = grams(t)
                    if g and (d := 2.0 * len(g & h) / (len(g) + len(h))) >= threshold:
                        found.append((-d, name, k))
            if found:
                d, name, k = min(found)
                out.append((doc, line, passage, name, k, pytest.approx(-d)))
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def test_templates_variants_and_edge_cases(spark):
    gpl = licenses.TEMPLATES["GPL-3.0"][1]
    rows = [(1, "intro\nReleased under the MIT license\nmore"), (2, "LICENSED UNDER CC BY-NC 4.0!"), (3, "licensed under cc by 4.0."),
            (4, gpl), (5, gpl.replace("program", "library")), (6, " ".join(gpl.split()[:20])), (7, None), (8, ""), (9, "\n\n"),
            (10, "all rights reserved"), (11, "mit"), (12, "MIT License " * 5000), (13, "word " * 100_000 + "\nAll rights reserved."),
            (14, "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0."), (15, "é ü.ö")]
    df = spark.createDataFrame([(i, t, "x", 3, 0.5) for i, t in rows], "doc_id long, text string, license string, line int, dice double")
    got = [tuple(r) for r in licenses.scan_licenses(df).collect()]
    assert sorted(got, key=lambda r: (str(r[0]), r[1])) == slow(rows)
    assert {r[0] for r in got} >= {1, 2, 3, 4, 5, 10, 13, 14} and [r[3] for r in got if r[0] == 2] == ["CC-BY-NC-4.0"]


def test_empty_table_repeated_rows_and_own_templates(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_licenses(none).collect() == []
    twice = spark.createDataFrame([(None, "All rights reserved.")] * 2, "doc_id long, text string")
    assert len(licenses.scan_licenses(twice).collect()) == 2
    assert [r.license for r in licenses.scan_licenses(twice, templates={"own": ["All rights reserved to us"]}).collect()] == []
    assert licenses.scan_licenses(twice, templates={}).collect() == []


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string").select("*")
    plan = licenses.scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
