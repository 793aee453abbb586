"""Substring dedup against every window of every text."""

import hashlib
import random
import re
from collections import Counter

import pytest

from fairlake.llm import queries, substrings

SCHEMA = "doc_id long, text string, start int, anchor long, k string"


def slow(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def fast(df, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest())
                   for r in substrings.remove_repeats(df, **options).collect()), key=str)


def test_planted_passages(spark):
    rng = random.Random(2)
    make = lambda n: [rng.choice("alpha beta gamma delta épsilon zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(n)]
    passages = [make(n) for n in (34, 35, 36, 52, 70, 200)]
    rows = []
    for i in range(60):
        w = make(rng.randint(0, 120))
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = p
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + " tail"), (102, "same " * 200), (103, "same " * 36), (104, None), (105, ""),
             (106, " \n"), (107, " ".join(make(40)) + " " + "z" * 100_000), (108, " ".join(passages[4] * 2)),
             (109, " ".join(f"u{k % 50_000}" for k in range(60_000)))]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA).repartition(7)
    assert fast(df) == slow(rows)
    assert fast(df, window=20, seed=5) == slow(rows, 20)


@pytest.mark.parametrize("rows", [[], [(1, "a b c")], [(1, " ".join(f"w{i}" for i in range(50)))] * 3 + [(None, " ".join(f"v{i}" for i in range(36)))] * 2])
def test_small_and_repeated_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert fast(df) == slow(rows)


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op8_substring_dedup"](spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == slow(rows)
