"""Mixing against a slow fair queue, and the properties of the mix."""

import re
from collections import defaultdict
from hashlib import md5

import pytest

from fairlake.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, before string, weight int"


def slow_mix(rows, share=1.5, epochs=2):
    """Targets by lowering the level until no source is above its most; then each source in ticket order."""
    sizes = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    total = defaultdict(int)
    for _, s, n in sizes:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, open_ = {}, set(names)
    while open_:
        level = (share * sum(total.values()) - sum(goal.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= epochs * total[s]}
        if not over:
            goal |= {s: weight[s] * level for s in open_}
            break
        goal |= {s: epochs * total[s] for s in over}
        open_ -= over
    taken = {}
    for s in names:
        queue = sorted((md5(f"mix|{i}".encode()).hexdigest(), i, n) for i, o, n in sizes if o == s)
        at = 0
        for e in range(epochs):
            for _, i, n in queue:
                taken[i] = taken.get(i, 0) + max(0, min(n, int(goal[s]) - at))
                at += n
    return {i: (n, total[s], pytest.approx(goal[s]), taken[i]) for i, s, n in sizes}


def got(docs):
    out = {}
    for r in mixing.queue(docs).collect():
        size, whole, target, taken = out.get(r.doc_id, (0, 0, 0, 0))
        out[r.doc_id] = (r["size"], r.source_size, r.target, taken + r.taken)
    return out


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in rows], SCHEMA).repartition(5)


def test_against_slow_queue(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 90)), "s" + str(i % 7 if i % 3 else 0)) for i in range(300)]
    rows += [(400, None, "s1"), (401, "", None), (402, "a b\tc", None), (403, "x " * 30_000, "big"), (404, " \n ", "blank"), (405, "é", "Ünder")]
    docs = make(spark, rows)
    assert got(docs) == slow_mix(rows)


def test_order_and_budget(spark):
    rows = [(i, "w " * (1 + i % 50), "abc"[i % 3]) for i in range(240)]
    copies = mixing.queue(make(spark, rows)).where("taken > 0").orderBy("position").collect()
    assert copies == mixing.queue(make(spark, rows).repartition(3)).where("taken > 0").orderBy("position").collect()
    at, last = 0, 0.0
    for c in copies:
        assert c.position == at and c.finish >= last
        at, last = at + c.taken, c.finish
    assert abs(at - 1.5 * sum(1 + i % 50 for i in range(240))) <= 3


def test_mixed_rows_keep_columns_and_cut_the_last(spark):
    rows = [(i, "  ".join(f"w{k}" for k in range(5 + i % 9)), "ab"[i % 2]) for i in range(60)]
    docs = make(spark, rows)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "epoch", "taken", "position"]
    texts = dict((i, t) for i, t, _ in rows)
    for r in out.collect():
        words = texts[r.doc_id].split()
        assert r.text == texts[r.doc_id] if r.taken == len(words) else r.text == " ".join(words[:r.taken])


def test_given_weights_empty_table_and_repeated_rows(spark):
    assert mixing.queue(make(spark, [])).collect() == [] and mixing.mix(make(spark, [])).collect() == []
    docs = make(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (2, "a b", "t"), (None, "z z", "u")])
    weights = spark.createDataFrame([("s", 1), ("t", 0), ("q", 5)], "source string, weight long")
    assert {(r.source, r.target) for r in mixing.queue(docs, weights).collect()} == {("s", 9.0)}
    assert sum(r.taken for r in mixing.queue(docs, weights).collect()) == 9
    assert sum(r.taken for r in mixing.queue(docs).collect()) == 8 + 2 + 4  # targets 8.25, 2.75 and 4


def test_rows_without_an_id_or_sharing_one_are_documents_of_their_own(spark):
    rows = [(None, "a b c", "s"), (None, "d e f", "s"), (1, "g h i", "s"), (7, "j k l m", "s"), (7, "n o p q", "s"), (None, None, None), (None, "", "s")]
    out = mixing.mix(make(spark, rows), share=1.5).collect()
    assert sum(r.taken for r in out) == int(1.5 * 17) == sum(len(r.text.split()) for r in out)
    assert {" ".join(t.split()[:1]) for _, t, _ in rows if t} <= {r.text.split()[0] for r in out}
    assert max(sum(r.text.split()[0] == w for r in out) for w in "adgjn") <= 2
    again = mixing.mix(make(spark, rows).repartition(2), share=1.5).collect()
    assert sorted((r.text, r.position) for r in again) == sorted((r.text, r.position) for r in out)
