"""Source divergence against a count of every term, pair and language in Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from fairlake.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, slice string"


def slow(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in own:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, f = shares(counts[lang, source]), lambda a, b: (a - b) ** 2 // (a + b)
        pairs = []
        for s in own:
            if s != source:
                q = shares(counts[lang, s])
                pairs.append((sum(f(p[t], q[t]) for t in kept), s))
        q = shares(whole)
        words = [(f(p[t], q[t]), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", words, top)):
            for k, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.add((lang, source, part, item, value, k))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("size", [3, 1 << 13])
def test_small_corpora(spark, monkeypatch, size):
    if size == 3:  # slices of three terms, also in the workers
        monkeypatch.setattr(divergence._runs, "__defaults__", (size,))
    rng = random.Random(size)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "été", "Größe", "日本", "x" * 50_000]
    rows = [(None, "en", "a"), ("", None, None), ("123 !?", "xx", "only"), ("rare words here", "yy", "b"), ("", "yy", "c")]
    for _ in range(160):
        text = ", ".join(rng.choice(vocabulary[:rng.choice([5, 20, 64])]).title() + str(rng.randrange(9)) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "c", None, "É", "z"])))
    rows += rows[-3:]
    df = spark.createDataFrame([(i, *r, 1, "clash", "clash") for i, r in enumerate(rows)], SCHEMA)
    for least in (1, 10):
        assert rows_of(divergence.source_divergence(df, least=least)) == slow(rows, least)


def test_hot_source_and_empty_table(spark):
    rows = [(f"alpha beta word{chr(97 + i % 9)}", "en", "hot" if i % 10 else f"s{i % 4}") for i in range(3000)]
    df = spark.createDataFrame([(i, *r, 1, None, None) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    assert rows_of(divergence.source_divergence(df)) == slow(rows)
    assert divergence.source_divergence(df.where("false")).collect() == []


def test_terms_are_letters_and_everything_beyond_ascii():
    assert divergence.terms("Ab1c ÄB_ß\x00é\x7fz 日本-X") == [x.encode() for x in ("ab", "c", "Äb", "ß", "é", "z", "日本", "x")]
    assert divergence.terms(None) == []
