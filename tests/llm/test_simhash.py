"""SimHash groups against all-pairs comparison of fingerprints made one shingle at a time."""

import random
import re

import numpy as np
import pytest
import xxhash
from helpers import union_components
from pyspark.sql import types as T

from fairlake.llm import components, queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, node int, key int"


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    prints = {i: slow_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    group = union_components(ids, links)
    return {i: (f"{prints[i]:016x}", group[i]) for i in ids}


def as_dict(df):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()}


def test_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert as_dict(queries.QUERIES["op6_simhash"](spark, "/root/testdata/sf0.001")) == slow_groups(rows)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    texts = [None, "", " \t\n", "One", "one", "one two", "A b c", "a  B\nc", "Ärger Ä ä x", long, long + " end", "x" * 200_000]
    docs = spark.createDataFrame([(i, t, "en", None, 0, "clash", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    got = as_dict(simhash.simhash_groups(docs))
    assert got == slow_groups(list(enumerate(texts)))
    assert got[0] == got[1] == got[2] == ("0" * 16, 0)
    assert [r.doc_id for r in simhash.deduplicate(docs).orderBy("doc_id").collect()] == sorted({c for _, c in got.values()})
    assert simhash.deduplicate(docs).columns == docs.columns


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_groups(none).collect() == [] and simhash.deduplicate(none).collect() == []
    twice = spark.createDataFrame([(5, "a b c d")] * 3 + [(None, "p q r s t")], "doc_id long, text string")
    rows = simhash.simhash_groups(twice).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (5, 5), (5, 5), (5, 5)]
    assert [r.doc_id for r in simhash.deduplicate(twice).collect()] == [5]


def _text_near(start, bits):
    """A text whose fingerprint differs from that of ``start`` in at most ``bits``, found by trying."""
    rng, base = random.Random(2), slow_fingerprint(start)
    words = start.split()
    while True:
        other = list(words)
        other[rng.randrange(len(other))] = f"v{rng.randrange(10**6)}"
        if 0 < bin(slow_fingerprint(" ".join(other)) ^ base).count("1") <= bits:
            return " ".join(other)


def test_rows_without_an_id_link_and_stay(spark):
    start = " ".join(f"w{i}" for i in range(400))
    middle = _text_near(start, 3)
    end = _text_further(middle, start)
    rows = [(3, start, "a"), (None, middle, "b"), (9, end, "c"), (None, "alone without an id", "d"), (None, "p q r s t", "e"),
            (None, "p q r s t", "e"), (5, "first text here", "f"), (5, "another one entirely different", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_groups(df).collect()}
    assert got == {(3, 3), (None, 3), (9, 3), (None, None), (5, 5)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.fp for r in kept.collect()) == ["a", "d", "e", "f", "g"]
    assert simhash.keep_one(df.where("false")).collect() == []


def _text_further(middle, start):
    """A text within three bits of ``middle`` and further from ``start``."""
    rng, base, far = random.Random(4), slow_fingerprint(middle), slow_fingerprint(start)
    words = middle.split()
    while True:
        other = list(words)
        for _ in range(rng.randint(1, 2)):
            other[rng.randrange(len(other))] = f"u{rng.randrange(10**6)}"
        fp = slow_fingerprint(" ".join(other))
        if bin(fp ^ base).count("1") <= 3 < bin(fp ^ far).count("1"):
            return " ".join(other)


@pytest.mark.parametrize("block", [8, 1024])
def test_chains_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << b
            prints.append(p)
    prints = sorted(set(prints))
    links = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    signed = np.array(prints, "u8").view("i8").tolist()
    df = spark.createDataFrame(list(zip(signed, range(len(prints)))), "fp long, node long")
    got = {r.node: r.component for r in components.components(simhash.near_links(df)).collect()}
    want = union_components(range(len(prints)), links)
    assert {n: got.get(n, n) for n in want} == want


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 180)] + [(7, i) for i in range(200, 320)] + [(5, 5)]
    edges += [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(200)]
    df = spark.createDataFrame([*edges, (None, 3)], T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]))
    got = {r.node: r.component for r in components.components(df).collect()}
    want = union_components({n for e in edges for n in e}, edges)
    assert {n: got.get(n, n) for n in want} == want
    assert components.components(df.where("false")).collect() == []
