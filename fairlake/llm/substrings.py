"""Substring dedup by seed and extend: winnowed anchors, extended both ways to maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlake.llm.common import settle

#: Windows of one text that are worked on at once, and words whose hashes a task remembers.
AT_ONCE, REMEMBERED = 1 << 18, 1 << 20
#: Characters of texts that are hashed together.
TOGETHER = 1 << 21


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes, in order."""
    z = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(29))


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words: doubled up to a power of two, then two runs that overlap."""
    n = 1
    while 2 * n <= size:
        hashes, n = _mix(hashes[:-n], hashes[n:]), 2 * n
    return hashes if n == size else _mix(hashes[:-(size - n)], hashes[size - n:])


def _half(window: int) -> int:
    """The largest power of two within a window."""
    return 1 << (window.bit_length() - 1)


class Winnower:
    """Anchors of texts. Every window of ``window`` words belongs to the anchor it selects: its
    leftmost run of ``seed`` words with the smallest hash. Equal windows select equal anchors at equal places."""

    def __init__(self, window: int, seed: int):
        self.window, self.seed, self.known = window, seed, _WordHashes()

    def hashes(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().split()
        return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))

    def windows(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hashes of the windows that begin at ``starts``."""
        half = _half(self.window)
        part = _grams(hashes, half)
        return _mix(part[starts], part[starts + (self.window - half)])

    def anchors(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchors of texts whose word hashes follow each other, ``lengths`` words each.

        Of each anchor: its hash, the hash of all words of its windows, its text, the first window's start
        there, and the number of windows.
        """
        ends = np.cumsum(lengths)
        starts = np.flatnonzero(np.arange(len(hashes)) + self.window <= np.repeat(ends, lengths))
        if not len(starts):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        seeds = _grams(hashes, self.seed)
        width = self.window - self.seed + 1
        chosen = np.empty(len(hashes) - self.window + 1, np.int64)
        for k in range(0, len(chosen), AT_ONCE):
            part = np.lib.stride_tricks.sliding_window_view(seeds[k:k + AT_ONCE + width - 1], width)[:AT_ONCE]
            chosen[k:k + len(part)] = part.argmin(axis=1) + np.arange(k, k + len(part))
        chosen = chosen[starts]
        lead = np.flatnonzero(np.diff(chosen, prepend=-1))
        count, first = np.diff(lead, append=len(chosen)), starts[lead]
        half = _half(self.window)
        part = _grams(hashes, half)  # overlapping runs of half the length cover all words of an anchor's windows
        last = first + count - 1 + self.window - half
        inner = np.minimum(first + half, last)
        context = _mix(_mix(part[first], part[inner]), _mix(part[last], count.astype(np.uint64)))
        text = np.searchsorted(ends, first, side="right")
        return seeds[chosen[lead]].view(np.int64), context.view(np.int64), text, first - (ends - lengths)[text], count


def _groups(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch in groups of about ``TOGETHER`` bytes of text."""
    place = batch["text"].map(lambda t: len(t or "")).cumsum() // TOGETHER
    for _, group in batch.groupby(place.to_numpy(), sort=False):
        yield group


def _anchor_rows(window: int, seed: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        winnower = Winnower(window, seed)
        for batch in batches:
            for group in _groups(batch):
                parts = [winnower.hashes(t) for t in group["text"]]
                anchor, context, text, start, n = winnower.anchors(np.concatenate(parts), np.array([len(p) for p in parts]))
                yield pd.DataFrame({"anchor": anchor, "context": context, "row_key": group["row_key"].to_numpy()[text],
                                    "start": start.astype(np.int32), "n": n.astype(np.int32)})

    return rows


def _window_rows(window: int, seed: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        winnower = Winnower(window, seed)
        for batch in batches:
            for group in _groups(batch):
                parts = [winnower.hashes(t) for t in group["text"]]
                lengths = np.array([len(p) for p in parts])
                before = np.cumsum(lengths) - lengths
                each = group["starts"].map(len).to_numpy()
                starts, counts, anchors = (np.concatenate(group[c].to_list()).astype(np.int64) for c in ("starts", "counts", "anchors"))
                text = np.repeat(np.repeat(np.arange(len(group)), each), counts)
                step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = np.repeat(starts, counts) + step
                found = winnower.windows(np.concatenate(parts), before[text] + at)
                yield pd.DataFrame({"anchor": np.repeat(anchors, counts), "row_key": group["row_key"].to_numpy()[text],
                                    "window": found.view(np.int64), "start": at.astype(np.int32)})

    return rows


def _row_key(id_col: str, text: str) -> Column:
    return F.xxhash64(id_col, text)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 35, seed: int = 10) -> DataFrame:
    """``(row_key, starts, ends)``: the word ranges of each text that repeated windows cover, not yet merged.

    Seed: documents meet on anchors that occur at least twice. Extend: an anchor's occurrences
    are first compared by all words around it that its windows reach, both ways. Where those are
    equal, the whole stretch repeats; copies and shared passages end here with one group per
    anchor, never a pair. Where they differ, one occurrence of each different surrounding is
    extended window by window, as far as another one agrees. Windows are judged by 128 bits of hash.
    """
    own = docs.select(_row_key(id_col, text).alias("row_key"), F.col(text).alias("text"))
    anchors = own.mapInPandas(_anchor_rows(window, seed), "anchor long, context long, row_key long, start int, n int")
    twice = anchors.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select(F.col("anchor").alias("a"))
    twice = settle(twice, "repeat-anchors")
    met = settle(anchors.join(twice, F.col("anchor") == F.col("a"), "left_semi"), "repeat-seeds")
    around = settle(met.groupBy("anchor", "context").agg(
        F.count("*").alias("times"), F.min(F.struct("row_key", "start", "n")).alias("one")), "repeat-contexts")
    same = around.where("times > 1").select(F.col("anchor").alias("a"), F.col("context").alias("c"))
    whole = met.join(same, (F.col("anchor") == F.col("a")) & (F.col("context") == F.col("c")), "left_semi")
    whole = whole.select("row_key", "start", (F.col("start") + F.col("n") + (window - 1)).alias("end"))
    alone = around.where("times = 1").select(F.col("anchor").alias("a")).distinct()
    extend = around.join(settle(alone, "repeat-edges"), F.col("anchor") == F.col("a"), "left_semi").select("anchor", "one.*")
    per_row = extend.groupBy("row_key").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("x")).select(
        F.col("row_key").alias("k"), F.col("x.anchor").alias("anchors"), F.col("x.start").alias("starts"), F.col("x.n").alias("counts"))
    texts = own.join(per_row, F.col("row_key") == F.col("k")).select("row_key", "text", "anchors", "starts", "counts")
    texts = texts.dropDuplicates(["row_key"])  # repeated rows hold the same windows
    parts = settle(texts.mapInPandas(_window_rows(window, seed), "anchor long, row_key long, window long, start int"), "repeat-windows")
    agreed = settle(parts.groupBy("anchor", "window").agg(F.count("*").alias("times")).where("times > 1").select(
        F.col("anchor").alias("a"), F.col("window").alias("w")), "repeat-agreed")
    edges = parts.join(agreed, (F.col("anchor") == F.col("a")) & (F.col("window") == F.col("w")), "left_semi").select(
        "row_key", "start", (F.col("start") + window).alias("end"))
    return whole.unionByName(edges).groupBy("row_key").agg(F.collect_set(F.struct("start", "end")).alias("x")).select(
        "row_key", F.col("x.start").alias("starts"), F.col("x.end").alias("ends"))


def _merged(starts, ends, n: int) -> np.ndarray:
    """Which of ``n`` words the ranges cover."""
    steps = np.zeros(n + 1, np.int64)
    if starts is not None:
        np.add.at(steps, np.asarray(starts), 1)
        np.add.at(steps, np.asarray(ends), -1)
    return np.cumsum(steps)[:n] > 0


_CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                     T.StructField("kept_text", T.StringType()),
                     T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])


@F.pandas_udf(_CUT)
def _cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    out = []
    for t, a, b in zip(text, starts, ends):
        found = (t or "").encode().split()
        gone = _merged(a, b, len(found))
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        kept = b" ".join([w for w, g in zip(found, gone.tolist()) if not g] if len(edges) else found)
        out.append((len(found), int(gone.sum()), kept.decode(), edges.tolist()))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 35, seed: int = 10) -> DataFrame:
    """Removes every word that lies in a window of ``window`` words found anywhere else.

    Returns ``id_col``, ``n_words``, ``n_removed``, ``kept_text`` (the other words, unchanged, joined by one
    blank) and ``spans`` (the maximal repeats as ``[start, end)`` word places). Windows are
    judged on the input, the same document included. Words are runs of characters other than
    ASCII white space. Null and empty texts have no words and shorter texts no windows. Repeated
    rows repeat each other, so they lose all windows. Further columns of ``docs`` are ignored. An
    empty table gives no rows. ``seed`` must be smaller than ``window``.
    """
    found = repeated_windows(docs, id_col, text, window, seed).withColumnRenamed("row_key", "k")
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), _row_key(id_col, text).alias("row_key"))
    cut = own.join(found, F.col("row_key") == F.col("k"), "left").select(
        F.col("id").alias(id_col), _cut("text", "starts", "ends").alias("x"))
    return cut.select(id_col, "x.*")
