"""Embedding near-duplicates by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from fairlake.llm.common import settle
from fairlake.llm.components import components

#: Rows of a tile, rows of a block of tiles at least, bytes of its vectors at most, leading dimensions multiplied at first.
TILE, LEAST, BLOCK, LEAD = 2048, 8192, 1 << 23, 32
#: Blocks that a worker holds beside the one they are compared with.
HELD = 4
#: Room for rounding in the bounds.
SLACK = 1e-9


def _room(width: int) -> float:
    """Room for rounding in products of unit vectors of so many parts in single precision."""
    return 1e-5 * max(1.0, width / 64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column, all of one length, as rows; null parts are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which of the rows are vectors that can link at all."""
    whole = rows.astype(np.float64)
    usable = np.isfinite(whole).all(1)
    whole[~usable] = 0
    largest = np.abs(whole).max(1, initial=0)
    usable &= largest > 0
    whole /= np.where(usable, largest, 1)[:, None]  # first by the largest part, so that no square overflows
    return whole / np.where(usable, np.linalg.norm(whole, axis=1), 1)[:, None] + 0.0, usable


def principal_axes(vectors: DataFrame, width: int, embedding: str = "embedding") -> np.ndarray:
    """Orthogonal axes in falling order of the squares that all unit vectors have along them.

    Every partition sums up products of its vectors; only the width x width sums reach the driver.
    """
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            units, usable = _unit(_matrix(batch.column(0), width))
            total += units[usable].T @ units[usable]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "value"])

    sums = vectors.select(F.col(embedding).alias("v")).mapInArrow(products, "cell long, value double")
    gram = np.zeros(width * width)
    for row in sums.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        gram[row["cell"]] = row["value"]
    gram = gram.reshape(width, width)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


class Vectors:
    """Vectors as given, and as unit vectors along the axes in single precision."""

    def __init__(self, rows: np.ndarray, axes: np.ndarray | None = None):
        self.rows, self.turned = rows, np.empty(rows.shape, np.float32)
        for k in range(0, len(rows), 4096):
            units = _unit(rows[k:k + 4096])[0]
            self.turned[k:k + 4096] = units if axes is None else units @ axes
        self._leads: dict[int, np.ndarray] = {}

    def lead(self, k: int) -> np.ndarray:
        """The first ``k`` parts, and the norm of the others rounded up: products of these are bounds."""
        if k not in self._leads:
            parts = self.turned[:, :k]
            if k < self.turned.shape[1]:
                others = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", parts, parts), 0) + np.float32(_room(k)))
                parts = np.hstack([parts, others[:, None]])
            self._leads[k] = np.ascontiguousarray(parts)
        return self._leads[k]

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors of these rows in double precision."""
        own, place = np.unique(rows, return_inverse=True)
        return _unit(self.rows[own])[0][place]


def tile_links(a: np.ndarray | Vectors, b: np.ndarray | Vectors, threshold: float, rows_a: np.ndarray | None = None, rows_b: np.ndarray | None = None,
               leads: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of those named, if any are) whose cosine reaches the threshold, leading dimensions first.

    ``leads``: the leading dimensions of the named rows, where they have been taken already.

    What the other dimensions can add is at most the product of the norms of both suffixes; a pair
    goes as soon as the sum so far and this bound stay below the threshold. Single precision with
    room for its rounding sorts out pairs, double precision decides those that stand close to the threshold.
    """
    a, b = (x if isinstance(x, Vectors) else Vectors(x) for x in (a, b))
    rows_a, rows_b = (np.arange(len(x.rows)) if r is None else r for x, r in ((a, rows_a), (b, rows_b)))
    width = a.turned.shape[1]
    first = min(LEAD, width)
    lead_a, lead_b = leads or (a.lead(first)[rows_a], b.lead(first)[rows_b])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for p in range(0, len(rows_a), 512):
        for q in range(0, len(rows_b), 4096):
            k, most = first, lead_a[p:p + 512] @ lead_b[q:q + 4096].T
            if most.max() < threshold - _room(k):
                continue
            one, other = rows_a[p:p + 512], rows_b[q:q + 4096]
            hits = np.flatnonzero(most >= threshold - _room(k))
            while k < width and len(hits) > most.size // 64:  # too many to look at one by one
                k = min(4 * k, width)
                most = a.lead(k)[one] @ b.lead(k)[other].T
                hits = np.flatnonzero(most >= threshold - _room(k))
            i, j = np.divmod(hits, len(other))
            i, j = one[i], other[j]
            ok = most.ravel()[hits] >= threshold + _room(k) if k == width else np.zeros(len(hits), bool)
            open_ = np.flatnonzero(~ok)
            for s in range(0, len(open_), 65536):
                at = open_[s:s + 65536]
                ok[at] = np.einsum("ij,ij->i", a.exact(i[at]), b.exact(j[at])) >= threshold
            found.append((i[ok], j[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _centres(same: DataFrame, width: int, count: int, axes: np.ndarray) -> np.ndarray:
    """Unit vectors that tiles form around, about one for ``TILE`` vectors, ordered by slices of the first axis and along the second.

    They are distinct vectors with a low hash. The choice decides how much is compared, never what is found.
    """
    wanted = min(count // TILE, (1 << 25) // (8 * width))
    if wanted < 2:
        return axes[:, :1].T
    low = F.pmod(F.xxhash64("v"), F.lit(1 << 31)) < int(wanted / count * (1 << 31))
    drawn = same.where(low).select("v").distinct().toArrow().column("v").combine_chunks()
    units, usable = _unit(_matrix(drawn, width))
    units = units[usable]
    if not len(units):
        return axes[:, :1].T
    turned = units @ axes[:, :2]
    slices = np.array_split(np.lexsort((turned[:, -1], turned[:, 0])), max(1, round(len(units) ** 0.5 / 4)))
    return units[np.concatenate([s[np.argsort(turned[s, -1], kind="stable")] for s in slices])]


def _nearest(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each row the centre with the largest product."""
    units, centres = units.astype(np.float32), centres.astype(np.float32).T
    step = max(1, (1 << 22) // centres.shape[1])
    return np.concatenate([(units[k:k + step] @ centres).argmax(1) for k in range(0, len(units), step)] or [np.zeros(0, np.int64)])


def _marked(same: DataFrame, width: int, centres: np.ndarray, place: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``(id, print, tile)`` of each vector; print, a hash of the unit vector, is null where nothing can link.

    With ``place``, the first block and the number of blocks of each tile, ``(id, print, block, vector)`` of those that can.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = _matrix(batch.column("v"), width)
            units, usable = _unit(given)
            ids, tile = batch.column("id"), _nearest(units, centres)
            prints = [blake2b(u, digest_size=16).digest() if ok else None for u, ok in zip(units, usable)]
            if place is None:
                yield pa.RecordBatch.from_arrays([ids, pa.array(prints, pa.binary()), pa.array(tile.astype(np.int32))], ["id", "print", "tile"])
                continue
            at = np.flatnonzero(usable)
            if not len(at):
                continue
            prints = [prints[i] for i in at]
            dealt = np.frombuffer(b"".join(prints), np.uint64)[::2] % place[1][tile[at]].astype(np.uint64)
            packed = np.ascontiguousarray(given[at])
            ends = np.arange(len(at) + 1, dtype=np.int32) * (packed.itemsize * width)
            vector = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(prints, pa.binary()), pa.array((place[0][tile[at]] + dealt.astype(np.int64)).astype(np.int32)), vector],
                                             ["id", "print", "block", "vector"])

    return same.mapInArrow(rows, "id long, print binary, " + ("tile int" if place is None else "block int, vector binary"))


def _places(sizes: dict[int, int], n_tiles: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first block and the number of blocks of each tile, and the number of all blocks.

    Neighbouring tiles share a block of ``most`` rows; a tile with more rows is dealt over blocks of its own.
    """
    first, parts, block, filled = np.zeros(n_tiles, np.int64), np.ones(n_tiles, np.int64), 0, 0
    for tile in range(n_tiles):
        size = sizes.get(tile, 0)
        if filled and filled + size > most:
            block, filled = block + 1, 0
        first[tile], parts[tile] = block, max(1, -(-size // most))
        filled += size
        if parts[tile] > 1:
            block, filled = block + int(parts[tile]), 0
    return first, parts, block + 1


#: A row a block: its vectors sorted by tile and distance from the tile's middle, and for each piece of a tile where it starts,
#: that middle along the axes, the least cosine with it that a vector linked with one of the piece can have, and the extents along two axes.
_BLOCK = ("block int, node binary, copies binary, vector binary, starts binary, middles binary, least binary, boxes binary, "
          "lo0 double, hi0 double, lo1 double, hi1 double")


def _pack(width: int, kind: str, axes: np.ndarray, centres: np.ndarray, place: tuple[np.ndarray, np.ndarray], threshold: float):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["block"].iloc[0])
        given = np.frombuffer(b"".join(group["vector"]), kind).reshape(-1, width)
        units = _unit(given)[0]
        own = np.flatnonzero((place[0] <= block) & (block < place[0] + place[1]))
        tile, middles, cosine = _nearest(units, centres[own]), [], np.zeros(len(units))
        for t in range(len(own)):
            at = np.flatnonzero(tile == t)
            middle = units[at].sum(0)
            norm = np.linalg.norm(middle)
            middles.append(middle / norm if norm > 1e-6 else axes[:, 0])
            cosine[at] = units[at] @ middles[-1]
        order = np.lexsort((-cosine, tile))
        ends = np.searchsorted(tile[order], np.arange(len(own) + 1))
        cuts = [(t, s, min(s + max(1, TILE // 2), ends[t + 1])) for t in range(len(own)) for s in range(ends[t], ends[t + 1], max(1, TILE // 2))]
        turned = np.einsum("ij,jk->ik", units, axes[:, :2])[order]
        turned = np.hstack([turned, np.zeros((len(turned), 2 - turned.shape[1]))])
        boxes = np.array([[*turned[s:e].min(0), *turned[s:e].max(0)] for _, s, e in cuts])
        # a piece lies within an angle of its middle; what links with it lies within that angle and the threshold's
        inner = np.clip([cosine[order[e - 1]] - SLACK for _, _, e in cuts], -1, 1)
        least = np.where(inner <= -threshold, -2, inner * threshold - np.sqrt(1 - inner ** 2) * np.sqrt(max(0, 1 - threshold ** 2)) - 2 * _room(width))
        return pd.DataFrame({
            "block": [block], "node": [group["node"].to_numpy(np.int64)[order].tobytes()], "copies": [group["copies"].to_numpy(np.int64)[order].tobytes()],
            "vector": [given[order].tobytes()], "starts": [np.array([s for _, s, _ in cuts] + [len(units)], np.int64).tobytes()],
            "middles": [(np.array([middles[t] for t, _, _ in cuts]) @ axes).astype(np.float32).tobytes()], "least": [least.astype(np.float64).tobytes()],
            "boxes": [boxes.tobytes()], "lo0": boxes[:, 0].min(), "hi0": boxes[:, 2].max(), "lo1": boxes[:, 1].min(), "hi1": boxes[:, 3].max()})

    return pack


class _Block(Vectors):
    def __init__(self, row: dict[str, pa.Scalar], side: str, width: int, kind: str, axes: np.ndarray):
        of = lambda name, dtype: np.frombuffer(row[f"{side}_{name}"].as_buffer(), dtype).copy()
        super().__init__(of("vector", kind).reshape(-1, width), axes)
        self.node, self.copies, self.starts = of("node", np.int64), of("copies", np.int64), of("starts", np.int64)
        self.middles, self.least, self.boxes = of("middles", np.float32).reshape(-1, width), of("least", np.float64), of("boxes", np.float64).reshape(-1, 4)

    def close(self, other: _Block) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each piece of the other block the own rows that can link with it, and where in these the own pieces start."""
        near = other.middles @ self.turned.T >= other.least[:, None].astype(np.float32)
        return [(rows, np.searchsorted(rows, self.starts)) for rows in map(np.flatnonzero, near)]


def _stars(count: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``count`` items the first one that the links reach."""
    low = np.arange(count)
    while True:
        least, before = np.minimum(low[u], low[v]), low.copy()
        for x in (u, v):
            np.minimum.at(low, x, least)
            np.minimum.at(low, before[x], least)
        low = low[low]
        if (low == before).all():
            return low


def _links(a: _Block, b: _Block, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts links of each vector of two blocks (or of one with itself), and one link per vector and group of linked vectors."""
    same = a is b
    gap = [np.maximum(0, np.maximum(b.boxes[None, :, k] - a.boxes[:, None, k + 2], a.boxes[:, None, k] - b.boxes[None, :, k + 2])) for k in (0, 1)]
    near = gap[0] ** 2 + gap[1] ** 2 <= 2 - 2 * threshold + SLACK
    if same:
        near = np.triu(near)
    close_a, close_b = a.close(b), b.close(a)
    shift = 0 if same else len(a.rows)
    counts, node = np.zeros(shift + len(b.rows), np.int64), b.node if same else np.concatenate([a.node, b.node])
    ends: list[list[np.ndarray]] = [[], []]
    gathered, first = -1, min(LEAD, a.turned.shape[1])
    for s, t in zip(*np.nonzero(near)):
        (rows_a, cuts_a), (rows_b, cuts_b) = close_a[t], close_b[s]
        rows_a, at_b = rows_a[cuts_a[s]:cuts_a[s + 1]], slice(cuts_b[t], cuts_b[t + 1])
        if not len(rows_a) or at_b.start == at_b.stop:
            continue
        if gathered != s:
            gathered, lead_b = s, b.lead(first)[rows_b]
        i, j = tile_links(a, b, threshold, rows_a, rows_b[at_b], (a.lead(first)[rows_a], lead_b[at_b]))
        if same and s == t:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        np.add.at(counts, i, b.copies[j])
        np.add.at(counts, j + shift, a.copies[i])
        ends[0].append(i)
        ends[1].append(j + shift)
        if sum(map(len, ends[0])) > 1 << 21:
            low = _stars(len(node), *map(np.concatenate, ends))
            at = np.flatnonzero(low != np.arange(len(node)))
            ends = [[at], [low[at]]]
    hit = np.flatnonzero(counts)
    low = _stars(len(node), *map(np.concatenate, ends)) if len(hit) else hit
    return node[hit], counts[hit], node[low[hit]] if len(hit) else hit


def _compare(width: int, kind: str, axes: np.ndarray, threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, held = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: column[k] for name, column in zip(batch.schema.names, batch.columns)}
                a, b = row["a_block"].as_py(), row["b_block"].as_py()
                if row["a_vector"].is_valid:
                    left = a, _Block(row, "a", width, kind, axes)
                if row["b_vector"].is_valid:
                    other = left[1] if a == b else _Block(row, "b", width, kind, axes)
                    if row["hold"].as_py():
                        held[b] = other
                else:
                    other = held[b]
                if row["wanted"].as_py():
                    if left[0] != a:
                        raise ValueError("blocks came in another order")
                    found = _links(left[1], left[1] if a == b else other, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "n", "low"])

    return compare


def _block_pairs(blocks: DataFrame, n_blocks: int, threshold: float) -> DataFrame:
    """Each pair of blocks that may hold links, once, and each block with itself.

    Every task reads its two shares of the settled blocks, so no pair is shuffled or written. Its worker gets a block of the first share
    once, and of the other one with the first of these only if it can hold it. Unit vectors with a cosine of at
    least t are at most sqrt(2 - 2 t) apart, so blocks whose boxes along the two first axes are farther apart hold no link.
    """
    least = min(n_blocks, int(2 * blocks.sparkSession.sparkContext.defaultParallelism ** 0.5))
    a, b = (blocks.coalesce(max(1, n_blocks // share, least)).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).select(
        *[F.col(c).alias(f"{side}_{c}") for c in (*blocks.columns, "at")]) for side, share in (("a", 3 * HELD), ("b", HELD)))
    gap = [F.greatest(F.lit(0.0), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"), F.col(f"a_lo{k}") - F.col(f"b_hi{k}")) for k in (0, 1)]
    even = (F.col("a_block") + F.col("b_block")) % 2 == 0
    once = (F.col("a_block") == F.col("b_block")) | (F.when(even, F.col("a_block") < F.col("b_block")).otherwise(F.col("a_block") > F.col("b_block")))
    wanted = once & (gap[0] * gap[0] + gap[1] * gap[1] <= 2 - 2 * threshold + SLACK)
    hold = F.col("b_at") < HELD
    sent = {"a": F.col("b_at") == 0, "b": (F.col("a_at") == 0) | ~hold}
    return a.join(b.hint("shuffle_replicate_nl"), wanted | (F.col("a_at") == 0) | (F.col("b_at") == 0)).select(
        "a_block", "b_block", wanted.alias("wanted"), hold.alias("hold"),
        *[F.when(sent[side], F.col(f"{side}_{c}")).alias(f"{side}_{c}") for side in "ab" for c in ("node", "copies", "vector", "starts", "middles", "least", "boxes")])


def _linked(same: DataFrame, width: int, kind: str, nodes: DataFrame, axes: np.ndarray, centres: np.ndarray, threshold: float) -> DataFrame:
    """``(p, n_links, component_id)`` of each distinct unit vector of one length."""
    sizes = {r["tile"]: r["count"] for r in nodes.groupBy("tile").count().collect()}
    most = min(max(1, BLOCK // (width * np.dtype(kind).itemsize)), max(LEAST, sum(sizes.values()) // 24))
    *place, n_blocks = _places(sizes, len(centres), most)
    vectors = _marked(same.where("id IS NOT NULL"), width, centres, place).groupBy("print").agg(
        F.min("id").alias("node"), F.count("*").alias("copies"), F.min("block").alias("block"), F.first("vector").alias("vector"))
    packed = vectors.drop("print").repartition(n_blocks, "block").groupBy("block").applyInPandas(_pack(width, kind, axes, centres, place, threshold), _BLOCK)
    pairs = _block_pairs(settle(packed, "embedding-blocks", 1), n_blocks, threshold)
    partial = settle(pairs.mapInArrow(_compare(width, kind, axes, threshold), "node long, n long, low long"), "embedding-links")
    groups = settle(components(partial.select(F.col("node").alias("u"), F.col("low").alias("v"))), "embedding-components")
    links = settle(partial.groupBy("node").agg(F.sum("n").alias("n")), "embedding-counts")
    of_node = nodes.select("print", "node", "copies").join(links.withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left").join(
        groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left").select(
        F.col("print").alias("p"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    return settle(of_node, "embedding-results")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links``, ``component_id`` and ``kept``.

    Vectors of equal length link when their cosine in double precision reaches ``threshold``. Vectors that are
    null, zero, or that hold null or non-finite parts link with
    nothing. Vectors whose unit vectors are equal are one node with a count of copies. Nodes form tiles around vectors of the table, in the order of the
    first two principal axes, and tiles form blocks. A task reads two shares of the blocks and compares tiles unless their extents along the
    axes, or the angles with a tile's middle, are too far apart for the threshold; a tile too large for a block is dealt by hash. Components keep the smallest id.
    Repeated rows count as copies. Ids are
    unique integers. Each length that at least two vectors have is worked on by itself, with axes of its own, one after the other: a table has few.
    Further columns are ignored. An empty table gives no rows.
    """
    parts, kind = ("float", "f4") if isinstance(vectors.schema[embedding].dataType.elementType, FloatType) else ("double", "f8")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast(f"array<{parts}>").alias("v"))
    lengths = own.where(F.size("v") > 0).groupBy(F.size("v").alias("width")).count().where("count > 1")
    every = own.select("id", F.lit(None).cast("string").alias("print"))
    results = None
    counts = {r["width"]: r["count"] for r in lengths.collect()}
    widths = sorted(counts)
    for width in widths:
        same = own.where(F.size("v") == width)
        axes = principal_axes(same, width, "v")
        centres = _centres(same, width, counts[width], axes)
        marks = settle(_marked(same, width, centres), "embedding-prints")
        nodes = settle(marks.where("print IS NOT NULL AND id IS NOT NULL").groupBy("print").agg(
            F.min("id").alias("node"), F.count("*").alias("copies"), F.min("tile").alias("tile")), "embedding-nodes")
        found = _linked(same, width, kind, nodes, axes, centres, threshold)
        rows = marks.select("id", "print").join(found, F.col("print") == F.col("p"), "left").select("id", "n_links", "component_id")
        results = rows if results is None else results.unionByName(rows)
    rest = own.where(~F.coalesce(F.size("v").isin(widths), F.lit(False)) | F.col("v").isNull()) if widths else every
    alone = rest.select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    whole = alone if results is None else results.unionByName(alone)
    component = F.coalesce("component_id", "id")
    return whole.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
