"""Periodic runs of words: dyadic catchers find squares as words are appended, and squares merge into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of texts that are worked on together, and words whose hashes a task remembers.
TOGETHER, REMEMBERED = 1 << 21, 1 << 19
#: Catchers whose comparisons are held at once.
AT_ONCE = 1 << 22


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two neighbouring blocks."""
    z = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(29))


def block_size(period: int, least: int) -> int:
    """The largest power of two of which every run of this period holds a whole aligned block with its repeat.

    A run of n words has n - period words that come again a period later, and any 2 B - 1 words
    in a row hold one whole aligned block of B.
    """
    room, size = max(least, 2 * period) - period, 1
    while 4 * size - 1 <= room:
        size *= 2
    return size


def catcher_periods(longest: int, least: int) -> dict[int, list[int]]:
    """The block sizes in ascending order, each with the periods (up to ``longest``) its catchers look for."""
    sizes: dict[int, list[int]] = {}
    for period in range(1, min(longest, 4 * least) + 1):
        sizes.setdefault(block_size(period, least), []).append(period)
    size = max(sizes, default=1)
    while sizes and sizes[size][-1] < longest:  # from here on a size serves the periods 2 B - 1 to 4 B - 2
        first = sizes[size][-1] + 1
        size = block_size(first, least)
        sizes.setdefault(size, []).extend(range(first, min(4 * size - 2, longest) + 1))
    return dict(sorted(sizes.items()))


class Catchers:
    """Finds the runs of many texts whose words follow each other, longest text first.

    A completed block of ``size`` words is a catcher. Each word that is appended completes one
    suffix of that size, which is compared with the catchers whose distance is one of the size's periods:
    two or three per suffix, however long the text. Equal hashes are a square; squares of one
    period that touch are one, and are then extended word by word to the run. The words of all texts are advanced
    together, a size at a time, as vectors. Work is n log n comparisons and the extension of distinct runs;
    squares inside a known run whose period divides theirs are skipped. Memory follows the number of words.
    """

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, least: int = 12):
        self.lengths, self.least = lengths, least
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        self.words = np.zeros(int((lengths + 1).sum()), np.uint64)
        ends = self.starts + lengths  # a separator that equals nothing ends each text
        at_end = np.zeros(len(self.words), bool)
        at_end[ends] = True
        self.words[~at_end] = hashes
        self.words[ends] = _joined(np.arange(len(ends), dtype=np.uint64), np.full(len(ends), 0x5EED, np.uint64))
        self.mark = np.full(len(self.words), -1, np.int64)  # the run found last over each word
        self.found: list[tuple[int, int, int]] = []  # start, end, period
        self.smallest: dict[tuple[int, int], int] = {}

    def squares(self, blocks: np.ndarray, size: int, periods: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """``(place, period)``: blocks that come again after one of the periods, the first of touching ones only."""
        suffixes = np.concatenate([blocks, np.zeros(-len(blocks) % size, np.uint64)]).reshape(-1, size)
        heads = suffixes[:, 0]
        wanted = np.zeros(periods[-1] // size * size + size, bool)
        wanted[periods] = True
        places, gaps = [], []
        for ahead in range(len(wanted) // size):
            asked = wanted[ahead * size:(ahead + 1) * size]
            if not asked.any() or ahead >= len(heads):
                continue
            step = max(1, AT_ONCE // size)
            for k in range(0, len(heads) - ahead, step):
                part = suffixes[k + ahead:k + ahead + step]
                row, column = np.nonzero((part == heads[k:k + len(part), None]) & asked)
                places.append((row + k) * size)
                gaps.append(ahead * size + column)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, gap = np.concatenate(places), np.concatenate(gaps)
        order = np.lexsort((place, gap))
        place, gap = place[order], gap[order]
        touching = (np.diff(place, prepend=-1) == size) & (np.diff(gap, prepend=-1) == 0)
        return place[~touching], gap[~touching]

    def known(self, place, period, size):
        """Whether a run that was found covers the square and has a period that divides its own."""
        if not self.found:
            return np.zeros(len(place), bool)
        run = self.mark[place]
        ends, periods = (np.array([r[k] for r in self.found], np.int64) for k in (1, 2))
        return (run >= 0) & (ends[run] >= place + period + size) & (period % periods[run] == 0)

    def extend(self, place: int, period: int) -> tuple[int, int]:
        """The longest stretch around ``place`` in which words a period apart are equal."""
        words, low, high = self.words, place, place
        step = 64
        while low > 0:
            a = max(0, low - step)
            same = words[a:low] == words[a + period:low + period]
            if same.all():
                low, step = a, step * 2
                continue
            low = a + int(np.flatnonzero(~same)[-1]) + 1
            break
        step, last = 64, len(words) - period
        while high < last:
            b = min(last, high + step)
            same = words[high:b] == words[high + period:b + period]
            if same.all():
                high, step = b, step * 2
                continue
            high += int(same.argmin())
            break
        return low, high + period

    def run(self) -> tuple[np.ndarray, ...]:
        """``(text, start, length, period)`` of every run, by text, start and period."""
        longest = int(self.lengths.max(initial=0)) // 2
        blocks, size = self.words, 1
        for wanted, periods in catcher_periods(longest, self.least).items():
            # texts that are too short for the size's periods stand behind the others
            held = int(np.searchsorted(-self.lengths, -max(self.least, 2 * periods[0]), side="right"))
            reach = int((self.lengths[:held] + 1).sum())
            while size < wanted:
                blocks = _joined(blocks[:-size], blocks[size:])
                size *= 2
            blocks = blocks[:max(reach - size + 1, 0)]
            place, period = self.squares(blocks, size, periods)
            fresh = ~self.known(place, period, size)
            for x, p in zip(place[fresh].tolist(), period[fresh].tolist()):
                old = self.mark[x]
                if old >= 0 and self.found[old][1] >= x + p + size and p % self.found[old][2] == 0:
                    continue
                start, end = self.extend(x, p)
                if end - start < max(self.least, 2 * p):
                    continue
                key = (start, end)
                if self.smallest.get(key, p + 1) > p:
                    self.smallest[key] = p
                    self.mark[start:end] = len(self.found)
                    self.found.append((start, end, p))
        if not self.smallest:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        runs = np.array([(s, e - s, p) for (s, e), p in self.smallest.items()], np.int64)
        text = np.searchsorted(self.starts, runs[:, 0], side="right") - 1
        start = runs[:, 0] - self.starts[text]
        order = np.lexsort((runs[:, 2], start, text))
        return text[order], start[order], runs[order, 1], runs[order, 2]


_RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)),
                       T.StructField("collapsed_text", T.StringType())])


def _collapsed(found: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period."""
    if not runs:
        return b" ".join(found).decode()
    steps = np.zeros(len(found) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join([w for w, gone in zip(found, np.cumsum(steps).tolist()) if not gone]).decode()


def text_runs(texts: list[str | None], least: int, known: dict[bytes, int]) -> list[tuple]:
    """``(n_words, runs, collapsed text)`` of each text."""
    split = [(t or "").encode().split() for t in texts]
    order = sorted(range(len(split)), key=lambda k: -len(split[k]))
    lengths = np.array([len(split[k]) for k in order], np.int64)
    hashes = np.fromiter((known[w] for k in order for w in split[k]), np.uint64, int(lengths.sum()))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for text, *run in zip(*(x.tolist() for x in Catchers(hashes, lengths, least).run())):
        runs[order[text]].append(tuple(run))
    return [(len(words), own, _collapsed(words, own)) for words, own in zip(split, runs)]


def _finder(least: int):
    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for batch in batches:
            out, group, size = [], [], 0
            for text in batch:
                group.append(text)
                size += len(text or "")
                if size > TOGETHER:
                    out += text_runs(group, least, known)
                    group, size = [], 0
            out += text_runs(group, least, known) if group else []
            yield pd.DataFrame(out, columns=["n_words", "runs", "collapsed_text"])

    return find


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """All periodic runs of every text: ``id_col``, ``n_words``, ``runs`` and ``collapsed_text``.

    Words are runs of characters other than ASCII white space. A run is a stretch of at least ``least`` words and two
    periods whose words repeat after its smallest period, and which no neighbouring word extends.
    ``runs`` holds ``(start, length, period)`` by start, then period; words are counted from 0.
    ``collapsed_text`` keeps the words that no run holds after its first period, joined by one blank.

    Words are compared by 64-bit hash. A document is worked on by itself, so nothing is shuffled and a lost task is
    simply run again; long texts take time in proportion to n log n. Null and empty texts have no words and no runs.
    Repeated rows and null ids stay rows. Further columns of ``docs`` are ignored. An empty table gives no rows.
    """
    found = docs.select(F.col(id_col).alias("id"), _finder(least)(F.col(text)).alias("x"))
    return found.select(F.col("id").alias(id_col), "x.*")
