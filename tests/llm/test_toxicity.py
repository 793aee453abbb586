"""Toxicity: held-out accuracy on planted words, and the edges of its input."""

import random
import zlib

import pytest

from fairlake.llm import queries, toxicity


def prose(rng, n, rude):
    plain = "the and river of mountain walking under yellow trees with seven friends along some quiet road near water".split()
    bad = "dumbhead wretchling slimebag".split()
    w = rng.choices(plain, k=n)
    for _ in range(rude):
        w[rng.randrange(n)] = rng.choice(bad)
    return " ".join(w)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(9)
    return [(i, prose(rng, rng.randint(20, 200), 3 if i % 3 == 0 else 0), int(i % 3 == 0)) for i in range(600)]


def test_held_out_accuracy(spark, planted):
    docs = spark.createDataFrame([(i, t, 9.0, "x") for i, t, _ in planted], "doc_id long, text string, score double, k string").repartition(5)
    labels = spark.createDataFrame([(i, m) for i, _, m in planted], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    truth = {i: m for i, _, m in planted}
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in truth}
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    again = toxicity.score_toxicity(docs, toxicity.fit(docs.repartition(3), labels)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in rows}


def test_held_out_labels_are_never_used(spark, planted):
    docs = spark.createDataFrame([(i, t) for i, t, _ in planted], "doc_id long, text string")
    flipped = [(i, 1 - m if zlib.crc32(str(i).encode()) % 5 == 0 else m) for i, _, m in planted]
    models = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, m) for i, _, m in planted], flipped)]
    assert models[0].toxic == models[1].toxic and (models[0].weights == models[1].weights).all()


def test_edge_cases(spark, planted):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "z" * 100_000), (4, "word " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None
    assert [r.score for r in toxicity.score_toxicity(docs, None).collect()] == [0.0] * 6
    model = toxicity.train([t for _, t, m in planted if m][:60], [t for _, t, m in planted if not m][:60])
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert toxicity.score_toxicity(docs.where("false"), model).collect() == []
    assert toxicity.train(["a"], ["b"]) is None
    some = toxicity.train([""] * 5, ["x"] * 5)
    assert some is not None and len(toxicity.windows("q" * 1000)[0]) > 200


def test_query_over_the_table(spark):
    rows = queries.QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 for r in rows)
