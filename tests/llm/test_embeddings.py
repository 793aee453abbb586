"""Embedding near-duplicates against all pairs by numpy."""

import numpy as np
import pytest
from helpers import union_components

from fairlake.llm import embeddings, queries

SCHEMA = "vec_id long, embedding array<float>, label int, tile int, node string"


def slow(rows, threshold=0.95):
    lengths = [len(v) for _, v in rows if v]
    width = max(lengths, key=lambda n: (lengths.count(n), n))
    good = {}
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v) and any(v):
            e = np.array(v, np.float32).astype(np.float64)
            good[i] = e / np.linalg.norm(e)
    ids = sorted(good)
    m = np.array([good[i] for i in ids])
    near = m @ m.T >= threshold
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a != b]
    group = union_components([i for i, _ in rows], links)
    counts = {i: 0 for i, _ in rows}
    for a, _ in links:
        counts[a] += 1
    return {i: (counts[i], group[i], group[i] == i) for i in counts}


def as_dict(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("tile", [24, 2048])
def test_clusters_copies_and_bad_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(tile)
    rows = [rng.normal(size=24) for _ in range(60)]
    for base in rows[:12]:
        rows += [base + rng.normal(size=24) * s for s in (0.1, 0.2, 0.25, 0.3) for _ in range(3)]
    rows += [rows[3]] * 30 + [rows[4] * 2.0] * 5
    vectors = [[float(np.float32(x)) for x in v] for v in rows]
    vectors += [None, [], [0.0] * 24, [1.0] * 23, [float("nan")] * 24, [float("inf"), *[0.0] * 23], [None, *[1.0] * 23], [3e38] * 24, [1e-40] * 24]
    order = rng.permutation(len(vectors)).tolist()
    rows = [(i, vectors[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(6)
    assert as_dict(embeddings.near_vectors(df)) == slow(rows)


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert as_dict(queries.QUERIES["op2_embedding_dedup"](spark, sf)) == slow(rows)


def test_empty_table_and_one_dimension(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, [2.0]), (2, [-1.0]), (3, [5.0])], "vec_id long, embedding array<float>")
    assert as_dict(embeddings.near_vectors(df)) == {1: (1, 1, True), 2: (0, 2, True), 3: (1, 1, False)}


def test_suffix_bounds_lose_no_pair():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(80, 40))
    b = np.vstack([a[:40] + 0.2 * rng.normal(size=(40, 40)), rng.normal(size=(30, 40))])
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    i, j = embeddings.tile_links(a, b, 0.9)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.9)))) and len(i)


def test_every_length_links(spark):
    rng = np.random.default_rng(7)
    rows = [[1.0, 2.0], [2.0, 4.0], [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0], [5.0], None, [], [0.0, 0.0], [float("nan"), 1.0]]
    rows += [[float(np.float32(x)) for x in rng.normal(size=5)] for _ in range(30)]
    rows += [[x * 3 for x in v] for v in rows[10:20]]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in enumerate(rows)], SCHEMA).repartition(4)
    want = {i: (0, i, True) for i in range(len(rows))}
    for width in {len(v) for v in rows if v}:
        want |= slow([(i, v) for i, v in enumerate(rows) if v and len(v) == width])
    assert as_dict(embeddings.near_vectors(df)) == want and want[0] == (1, 0, True) and want[3] == (1, 2, False)


def test_tiles_of_equal_coordinates_are_cut(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(9)
    rows = []
    for k in range(400):  # equal parts along the two first axes, small different ones along the others
        v = np.zeros(12)
        v[:2] = 1.0, (-1.0) ** (k % 3 == 0)
        v[2 + k % 10] = 0.2 + 0.01 * (k // 10 % 7)
        rows.append([float(np.float32(x)) for x in v])
    rows += [[float(np.float32(x)) for x in rng.normal(size=12)] for _ in range(40)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in enumerate(rows)], SCHEMA).repartition(4)
    assert as_dict(embeddings.near_vectors(df)) == slow(list(enumerate(rows)))


def test_pairs_of_tiles_are_neither_shuffled_nor_written(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 32)
    monkeypatch.setattr(embeddings, "LEAST", 64, raising=False)
    frames = {}

    def settle(df, name, *more, known=embeddings.settle):
        frames[name] = known(df, name, *more), df._jdf.queryExecution().executedPlan().toString()
        return frames[name][0]

    monkeypatch.setattr(embeddings, "settle", settle)
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(900, 24))  # a flat spectrum: nearly all tiles are within reach of each other
    rows[450:600] = rows[0] + 0.1 * rng.normal(size=(150, 24))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(4)
    assert as_dict(embeddings.near_vectors(df)) == slow(rows)
    assert "Exchange" not in frames["embedding-links"][1]
    held = sum(sum(len(x) for x in row if isinstance(x, (bytes, bytearray))) for df, _ in frames.values() for row in df.collect())
    assert held < 3 * 900 * 24 * 4  # vectors are written once, as they were given


def test_wide_vectors_and_tiles_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "LEAST", 1, raising=False)
    monkeypatch.setattr(embeddings, "BLOCK", 40 * 150 * 4, raising=False)
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(150, 150))
    rows[:60] = rows[100] + 0.25 * rng.normal(size=(60, 150))
    rows = np.vstack([rows, rows[0] + rng.normal(size=(150, 150)) * 0.05])  # one tile larger than a block
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(4)
    assert as_dict(embeddings.near_vectors(df)) == slow(rows)


@pytest.mark.parametrize("width", [3, 33, 200])
def test_links_of_named_rows_close_to_the_threshold(width):
    rng = np.random.default_rng(width)
    base = rng.normal(size=(60, width))
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (base, base + rng.normal(size=base.shape) * 0.33 * abs(rng.normal(size=(60, 1)))))
    for threshold in [0.0, 0.9, 0.95, *np.sort((a @ b.T).ravel())[-20:]]:
        one, other = np.arange(0, 60, 2), np.arange(5, 60)
        i, j = embeddings.tile_links(a, b, threshold, one, other)
        products = np.einsum("ij,kj->ik", a, b)
        sure = {(x, y) for x in one for y in other if products[x, y] >= threshold + 1e-12}
        found = set(zip(i.tolist(), j.tolist()))
        assert sure <= found and all(products[x, y] >= threshold - 1e-12 for x, y in found)


@pytest.mark.parametrize("held", [1, 3])
def test_shares_of_more_blocks_than_a_worker_holds(spark, monkeypatch, held):
    for name, value in {"TILE": 16, "LEAST": 1, "BLOCK": 30 * 20 * 4, "HELD": held}.items():
        monkeypatch.setattr(embeddings, name, value, raising=False)
    rng = np.random.default_rng(13)
    rows = rng.normal(size=(500, 20))
    rows[::7] = rows[1] + 0.15 * rng.normal(size=rows[::7].shape)
    rows[::11] = rows[2] + 0.25 * rng.normal(size=rows[::11].shape)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(4)
    assert as_dict(embeddings.near_vectors(df)) == slow(rows)
