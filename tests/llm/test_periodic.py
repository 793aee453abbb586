"""Periodic runs against a search of every period and place."""

import hashlib
import random
import re
import zlib

import pytest

from fairlake.llm import periodic, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, runs string, id long, n_words int"


def slow_runs(words, least=12):
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def slow_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("least", [2, 5, 12, 20])
def test_random_texts_against_every_period(least):
    rng = random.Random(least)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, kinds = rng.choice([0, 1, 11, 12, 13, 24, 40, 90, 200]), rng.choice([1, 2, 3, 30])
            words = [str(rng.randrange(kinds)) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 9)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(" ".join(words))
        for text, (n, runs, collapsed) in zip(texts, periodic.text_runs(texts, least, periodic._WordHashes())):
            assert (n, runs) == (len(text.split()), slow_runs(text.split(), least))
            assert collapsed == slow_collapsed(text.split(), runs)


def test_query_against_brute_force(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words, h = split(r.text), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(split(r.text))
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = slow_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        digest = hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        want[r.doc_id] = (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, digest,
                          hashlib.sha256(slow_collapsed(words, runs).encode()).hexdigest())
    got = queries.QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert len(got) == len(want) and {r.doc_id: tuple(r)[1:] for r in got} == want
    assert sum(r.n_runs > 0 for r in got) > 5


def test_edge_cases(spark):
    texts = [None, "", " \t\n", "a " * 11, "a " * 12, "a b " * 60_000, " ".join(str(i % 5000) for i in range(60_000)),
             " ".join(map(str, range(30_000))), "x" * 300_000, "Ä ä " * 10, "a b c " * 9 + "q " + "a b c " * 9]
    rows = [(i, t, "en", "clash", 7, 1) for i, t in enumerate(texts)] + [(None, "z " * 30, None, None, None, None)] * 2
    out = periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.doc_id: r for r in out}
    runs = {i: [tuple(x) for x in r.runs] for i, r in got.items()}
    assert len(out) == len(rows) and sum(r.doc_id is None for r in out) == 2
    assert [runs[i] for i in (0, 1, 2, 3, 7, 8)] == [[]] * 6 and [got[i].n_words for i in (0, 1, 2)] == [0, 0, 0]
    assert runs[4] == [(0, 12, 1)] and got[4].collapsed_text == "a" and runs[5] == [(0, 120_000, 2)] and runs[6] == [(0, 60_000, 5000)]
    assert runs[9] == [(0, 20, 2)] and runs[10] == slow_runs(texts[10].split()) and runs[None] == [(0, 30, 1)]
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
