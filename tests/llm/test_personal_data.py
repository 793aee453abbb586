"""Personal data: the contract's patterns by backtracking search, and planted disguises that must map back."""

import hashlib
import random
import re
import time

import pytest

from fairlake.llm import personal_data as pd_
from fairlake.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, spans string, id long"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def slow_base(text):
    found = [(m.start(), list(PATTERNS).index(kind), kind, m.end()) for kind, p in PATTERNS.items()
             for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_table_against_patterns(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        base = slow_base(r.text)
        counts = [sum(k == kind for k, _, _ in base) for kind in PATTERNS]
        want[r.doc_id] = (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest(), base)
    got = queries.QUERIES["op11_personal_data"](spark, SF).collect()
    assert len(got) == len(want) and sum(sum(w[:4]) for w in want.values()) > 5
    for r in got:
        assert tuple(r)[1:6] == want[r.doc_id][:5]
        assert {f"{k}:{a}:{b}" for k, a, b in want[r.doc_id][5]} <= set(r.spans.split(","))


def test_random_strings_against_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "25", "4111", "@", ".", "..", "-", " ", "+", "(", ")", "a", "b.c", "é", "x@y.z", "٣", "\n", "0000"])
                       for _ in range(rng.randrange(30)))
        assert [(k, a, b) for k, a, b, _, shown in pd_.find_spans(text) if shown] == slow_base(text), text


@pytest.mark.parametrize("kind, hidden, value", [
    ("email", "jane dot doe at example dot com", "jane.doe@example.com"),
    ("email", "jane [at] example [dot] com", "jane@example.com"),
    ("email", "jane(at)example(dot)com", "jane@example.com"),
    ("email", "jane_at_example_dot_com", "jane@example.com"),
    ("email", "jаne@exаmple.cоm", "jane@example.com"),
    ("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "jane@example.com"),
    ("email", "j​ane@exam​ple.com", "jane@example.com"),
    ("email", "JANE AT EXAMPLE DOT ORG", "JANE@EXAMPLE.ORG"),
    ("email", "jane&#64;mail&#46;org", "jane@mail.org"),
    ("email", "bob.smith at example.com", "bob.smith@example.com"),
    ("email", "jane @ example . com", "jane@example.com"),
    ("ip", "192 dot 168 dot 0 dot 1", "192.168.0.1"),
    ("ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
    ("ip", "192[.]168[.]0[.]1", "192.168.0.1"),
    ("ip", "１９２．１６８．０．１", "192.168.0.1"),
    ("card", "four one one one one one one one one one one one one one one one", "4111111111111111"),
    ("card", "４１１１ １１１１ １１１１ １１１１", "4111 1111 1111 1111"),
    ("card", "4111–1111–1111–1111", "4111-1111-1111-1111"),
    ("phone", "plus one two four three five five five five five two six", "+12435555526"),
    ("phone", "+1 (243) 555-five five two six", "+1 (243) 5555526"),
    ("phone", "plus one (two four three) five five five - five five two six", "+12435555526"),
    ("phone", "plus vier neun eins sieben eins zwei drei vier fünf sechs sieben", "+49171234567"),
    ("phone", "+l (243) 555-55O6", "+1 (243) 555-5506"),
])
def test_disguises_map_back_to_their_source(kind, hidden, value):
    for before, after in (("", ""), ("Ñandú 日本 — ", ". Then more."), ("one at a time; ", "\nnext line at the end"), ("а́ ​ x, ", ", and")):
        spans = [s for s in pd_.find_spans(before + hidden + after) if not s[4]]
        assert spans == [(kind, len(before), len(before) + len(hidden), value, False)], (before, after)


def test_clean_texts_stay_clean():
    for text in ("look at the dot on it", "We met at home. One two, then three dot", "at one point one of two", "Привет, как дела? 12 at 3", "E = m c² at 5 · 10",
                 "the 1st l0ng O2 level", "un dos tres, catorce", "a | 12 | 13 | 14 | 15 | 16 | 17 |", "see fig. 1 . 2 . 3", "he is at example.com now"):
        assert pd_.find_spans(text) == [], text


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1" * 400_000 + "x", "1 " * 200_000 + "x", "a." * 200_000 + "@", "@" * 200_000, "+1" * 200_000,
                 "one " * 100_000, "1 dot " * 70_000, "a dot " * 70_000, "at " * 100_000, "O l I 1 " * 50_000 + "é", "[ " * 150_000, "1.1." * 100_000,
                 "а" * 200_000, "​" * 200_000):
        start = time.perf_counter()
        pd_.find_spans(text)
        assert time.perf_counter() - start < 10, text[:20]


def test_edge_cases(spark):
    rows = [(0, None), (1, ""), (2, "a@b.co"), (2, "a@b.co"), (None, "x 10.0.0.1"), (3, "@@ + 1.2.3.256 ...")]
    df = spark.createDataFrame([(i, t, "en", "clash", 9) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id if r.doc_id is not None else -1, [tuple(s)[:3] for s in r.spans]) for r in pd_.find_personal_data(df).collect())
    assert got == [(-1, [("ip", 2, 10)]), (0, []), (1, []), (2, [("email", 0, 6)]), (2, [("email", 0, 6)]), (3, [])]
    assert pd_.find_personal_data(df.where("false")).collect() == []
