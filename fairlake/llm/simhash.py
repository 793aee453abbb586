"""SimHash near-duplicates: pigeonring candidates over chains of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlake.llm.common import settle
from fairlake.llm.components import components

SEGMENTS, WIDTH, DISTANCE = 4, 16, 3
#: Shingles that are unpacked to bits at once, and fingerprints of one block of a large bucket.
AT_ONCE, BLOCK = 1 << 16, 1024


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text: A-Z lower-cased, shingles of words, repeats included."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    whole, size = b" ".join(found), min(shingle, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found))).tolist()
    ends, counts, n = ends.tolist()[size - 1:], np.zeros(64, np.int64), len(found) - size + 1
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, AT_ONCE):
        hashes = np.array([digest(whole[a:b], seed) for a, b in zip(starts[k:k + AT_ONCE], ends[k:k + AT_ONCE])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(x) for x in batch], dtype="int64")


def _bucket_keys(fp: Column) -> Column:
    """Eight keys: a segment that is equal, and one half of the next that is equal too.

    Distances of the four segments on a ring add up to three at most, so from some segment on every chain of
    l segments differs in at most 3 l / 4 bits: none in the first, one in the first two. One
    differing bit leaves one half of the second segment as it is.
    """
    keys = []
    for i in range(SEGMENTS):
        segment = F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(0xFFFF)
        following = F.shiftrightunsigned(fp, WIDTH * ((i + 1) % SEGMENTS)).bitwiseAND(0xFFFF)
        for half in range(2):
            part = F.shiftrightunsigned(following, 8 * half).bitwiseAND(0xFF)
            keys.append(F.lit(2 * i + half) * (1 << 24) + segment * 256 + part)
    return F.array(*[k.cast("int") for k in keys])


def chain_links(a: np.ndarray, b: np.ndarray, first: int) -> np.ndarray:
    """Which of ``a`` and ``b`` (unsigned fingerprints) pass the chain from segment ``first`` and the full check."""
    turn = np.uint64(WIDTH * first)
    a, b = ((x >> turn) | (x << (np.uint64(64) - turn)) if first else x for x in (a, b))
    x = a[:, None] ^ b[None, :]
    ok = np.bitwise_count(x & np.uint64(0xFFFFFFFF)) <= 2 * DISTANCE // SEGMENTS
    ok &= (x & np.uint64(0xFFFF)) == 0
    i, j = np.nonzero(ok)
    rest = x[i, j]
    near = np.bitwise_count(rest & np.uint64(0xFFFFFFFFFFFF)) <= 3 * DISTANCE // SEGMENTS
    i, j, rest = i[near], j[near], rest[near]
    near = np.bitwise_count(rest) <= DISTANCE
    out = np.zeros(x.shape, bool)
    out[i[near], j[near]] = True
    return out


def _forest(fps: np.ndarray, nodes: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Links of one cell, thinned to one star per group of linked fingerprints."""
    linked = np.vstack([chain_links(fps[k:k + 256], fps, first) for k in range(0, len(fps), 256)])
    free, stars = np.ones(len(fps), bool), []
    for start in range(len(fps)):
        if not free[start]:
            continue
        group, reach = np.zeros(len(fps), bool), np.zeros(len(fps), bool)
        reach[start] = True
        while reach.any():
            group |= reach
            reach = linked[reach].any(0) & ~group
        free &= ~group
        members = nodes[group]
        if len(members) > 1:
            low = int(members.min())
            stars += [(int(m), low) for m in members if m != low]
    return stars


def _cell_links(cells: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in cells:
        found: list[tuple[int, int]] = []
        for key, fps, nodes in zip(batch["key"], batch["fps"], batch["nodes"]):
            found += _forest(np.asarray(fps, "i8").view("u8"), np.asarray(nodes, "i8"), int(key) >> 25)
        yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def near_links(prints: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that join all fingerprints of ``(fp, node)`` within three bits of each other.

    ``fp`` and ``node`` are unique. A bucket holds the fingerprints that share a key. A large one
    is cut into blocks by hash and compared block by block, so no task holds it whole, and a cell
    gives a star per group of linked fingerprints instead of all their pairs.
    """
    keyed = prints.select(F.explode(_bucket_keys(F.col("fp"))).alias("key"), "fp", "node")
    sizes = settle(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    sizes = sizes.select(F.col("key").alias("k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    held = keyed.join(sizes, F.col("key") == F.col("k")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.groupBy("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(
        F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes"))
    return cells.where(F.size("fps") > 1).select("key", "fps", "nodes").mapInPandas(_cell_links, "u long, v long")


def _with_components(prints: DataFrame) -> DataFrame:
    """``(f, component_id)`` of each fingerprint of ``(fp, id)``: links join fingerprints, whoever holds them."""
    prints = settle(prints.groupBy("fp").agg(F.min("id").alias("id")), "simhash-nodes")
    groups = settle(components(near_links(prints.select("fp", F.col("fp").alias("node")))), "simhash-components")
    joined = prints.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("component"))
    lowest = settle(joined.groupBy("component").agg(F.min("id").alias("component_id")), "simhash-lowest")
    return settle(joined.select("fp", "component").join(lowest, "component"), "simhash-classes").select(
        F.col("fp").alias("f"), "component", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents link when their fingerprints differ in at most three bits; the component is the
    smallest id reachable by links. Equal fingerprints are one node, so copies are never
    paired. Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay
    rows. Ids are integers; rows with a null id link like any other and never name a component: one in which no
    row has an id is null. Further columns of ``docs`` are ignored. An empty table gives no rows.
    """
    own = settle(docs.select(F.col(id_col).alias("id"), _fingerprints(F.col(text)).alias("fp")), "simhash-prints")
    return own.join(_with_components(own), F.col("fp") == F.col("f")).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of every component of :func:`simhash_groups`; all columns stay.

    The one with the smallest id stays, one without an id only where the component has no other; among rows that share the
    id, the one with the smallest hash of the text, and of equal rows one. A document that is alone stays, whatever its id.
    """
    id_, hash_ = F.col(f"row.{id_col}"), F.xxhash64(f"row.{text}")
    named = docs.select(F.struct(*docs.columns).alias("row"))  # keeps columns with clashing names apart
    own = settle(named.select(id_.alias("id"), _fingerprints(F.col(f"row.{text}")).alias("fp"), hash_.alias("h")), "simhash-prints")
    placed = own.join(_with_components(own), F.col("fp") == F.col("f"))
    # Only ids and hashes are sorted out; of the documents themselves one join is needed.
    alike = placed.groupBy("component", "id", "h").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull(), "id", "h")
    first = alike.groupBy("component").agg(F.min_by(F.struct("id", "h", "n"), order).alias("x"))
    first = settle(first.select(F.col("x.id").alias("i"), F.col("x.h").alias("k"), F.col("x.n").alias("n")), "simhash-first")
    kept = named.join(first, id_.eqNullSafe(F.col("i")) & (hash_ == F.col("k")))
    once = kept.where("n = 1").select("row.*")
    again = kept.where("n > 1").dropDuplicates(["i", "k"]).select("row.*")  # equal rows
    return once.unionByName(again)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: the document with the smallest id of each component stays, once.

    Rows without an id go, and one row of each id stays; :func:`keep_one` loses neither.
    """
    groups = simhash_groups(docs, id_col, text).where(F.col(id_col) == F.col("component_id"))
    kept = docs.join(groups.select(id_col), id_col, "left_semi")
    return kept.dropDuplicates([id_col]).select(docs.columns)
