"""Toxicity by compression distance: windows compressed with a dictionary of toxic and one of ordinary text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW_WORDS, LONGEST_WORD, GRAM = 8, 256, 6
COMMON_BYTES, OWN_BYTES = 112_000, 1536


def windows(text: str | None) -> list[bytes]:
    """The whole text in windows of eight words; very long words are cut, so no window is long."""
    found = (text or "").lower().encode().split()
    if any(len(w) > LONGEST_WORD for w in found):
        found = [w[i:i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return [b" ".join(found[i:i + WINDOW_WORDS]) + b" " for i in range(0, len(found), WINDOW_WORDS)] or [b" "]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Short matches count and headers are left out: only what a window costs is of interest."""
    params = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=18, hash_log=15, chain_log=15, search_log=6, min_match=3, target_length=64,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


def _trained(samples: list[bytes], size: int, k: int, d: int = 6) -> bytes:
    """A dictionary of at most ``size`` bytes; few samples are taken as they are, last."""
    try:
        return zstandard.train_dictionary(size, samples * max(1, 2000 // max(1, len(samples))), k=k, d=d).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _gram_documents(texts: list[str]) -> Counter:
    """In how many texts each run of six bytes within a word occurs."""
    found: Counter = Counter()
    for text in texts:
        words = {b" " + w[:LONGEST_WORD] + b" " for w in set(text.lower().encode().split())}
        found.update({w[i:i + GRAM] for w in words for i in range(len(w) - GRAM + 1)})
    return found


def _passages(text: str, telling: set[bytes]) -> bytes:
    """The parts of a text that telling runs of bytes cover."""
    whole, out, start, end = b" " + b" ".join(text.lower().encode().split()) + b" ", [], 0, -1
    for i in range(len(whole) - GRAM + 1):
        if whole[i:i + GRAM] in telling:
            if i > end:
                out.append(whole[start:end] if end >= 0 else b"")
                start = i
            end = i + GRAM
    return b"".join(out) + (whole[start:end] if end >= 0 else b"")


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary.

    Both begin with the same content, trained on windows of ordinary text, so that ordinary
    words cost the same with either. The toxic one then holds what is trained on those passages
    of toxic texts that ordinary texts hardly have; the ordinary one holds ordinary content of
    the same length there.
    """
    a, b, ratio = _gram_documents(toxic), _gram_documents(ordinary), len(ordinary) / len(toxic)
    telling = {g for g, n in a.items() if n >= 3 and n * ratio >= 6 * b[g] and (n * ratio - b[g]) / (n * ratio + b[g] + 1) ** 0.5 > 6}
    passages = [p for p in (_passages(t, telling) for t in toxic) if len(p) >= 8]
    plain = [w for t in ordinary for w in windows(t)]
    common = _trained(plain[::max(1, len(plain) // 60_000)], COMMON_BYTES, 48)
    own = _trained(passages, OWN_BYTES, 24) if passages else b""
    return common + common[-len(own):] if own else common, common + own


def _measures(text: str | None, ordinary, toxic) -> list[float]:
    """Of one text: how many bytes its windows save with the toxic dictionary."""
    parts = windows(text)
    saved = np.fromiter((len(ordinary.compress(w)) - len(toxic.compress(w)) for w in parts), np.float64, len(parts))
    top = np.sort(np.r_[saved, 0, 0, 0])[::-1][:4]
    n, long = len(saved), np.log(len(saved))
    return [*top, top[0] * long, top[1] * long, np.maximum(saved, 0).sum() / n ** 0.5, (saved >= 4).sum() / n ** 0.5,
            long, long * long, saved.mean()]


@dataclass
class ToxicityModel:
    """Two dictionaries, and the calibration that turns saved bytes into a score."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def scorer(self):
        pair = _compressor(self.ordinary), _compressor(self.toxic)

        def score(texts) -> np.ndarray:
            found = np.array([_measures(t, *pair) for t in texts]).reshape(len(texts), -1)
            return _sigmoid(np.c_[(found - self.mean) / self.spread, np.ones(len(found))] @ self.weights)

        return score


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _calibrate(found: np.ndarray, marks: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of a logistic model by Newton steps; classes weigh as if ``prior`` of all texts were toxic."""
    mean, spread = found.mean(0), found.std(0) + 1e-9
    z = np.c_[(found - mean) / spread, np.ones(len(found))]
    share = np.where(marks == 1, prior / max(1, (marks == 1).sum()), (1 - prior) / max(1, (marks == 0).sum())) * len(marks)
    weights, ridge = np.zeros(z.shape[1]), np.r_[np.ones(z.shape[1] - 1), 1e-6]
    for _ in range(30):
        p = _sigmoid(z @ weights)
        slope = z.T @ (share * (p - marks)) + ridge * weights
        weights = weights - np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + np.diag(ridge), slope)
    return mean, spread, weights


def train(toxic: list[str], ordinary: list[str], prior: float = 0.2) -> ToxicityModel | None:
    """Fits dictionaries and calibration; None if a class has fewer than four texts.

    The calibration sees each half of the sample with dictionaries of the other half, since a
    dictionary compresses its own samples too well. The final dictionaries use all.
    """
    if min(len(toxic), len(ordinary)) < 4:
        return None
    found, marks = [], []
    for half in range(2):
        pair = [_compressor(d) for d in train_dictionaries(toxic[1 - half::2], ordinary[1 - half::2])]
        for mark, texts in ((1, toxic[half::2]), (0, ordinary[half::2])):
            found += [_measures(t, *pair) for t in texts]
            marks += [mark] * len(texts)
    mean, spread, weights = _calibrate(np.array(found), np.array(marks), prior)
    return ToxicityModel(*train_dictionaries(toxic, ordinary), mean, spread, weights)


def held_out(id_col: Column) -> Column:
    """Rows that no training sees: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
        rows_per_class: int = 1500, sample_bytes: int = 1 << 24, prior: float = 0.2) -> ToxicityModel | None:
    """Trains on a bounded sample of labelled rows that are not held out.

    At most ``rows_per_class`` labelled ids of each class are drawn by hash; their texts are
    read until a class has ``sample_bytes``. Ids and texts of the sample, nothing else, reach the driver.
    """
    known = labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label).alias("mark"))
    texts: dict[int, list[str]] = {}
    for mark in (1, 0):
        drawn = known.where(F.col("mark") == mark).orderBy(F.xxhash64(id_col), id_col).limit(rows_per_class)
        rows = docs.where(F.col(text).isNotNull()).join(F.broadcast(drawn.select(id_col)), id_col).select(id_col, text)
        texts[mark], total = [], 0
        for row in rows.dropDuplicates([id_col]).orderBy(F.xxhash64(id_col), id_col).toLocalIterator():
            total += len(row[1])
            if texts[mark] and total > sample_bytes:
                break
            texts[mark].append(row[1])
    return train(texts[1], texts[0], prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Every whole text is cut into windows, and each is compressed with both dictionaries. Null and
    empty texts are one blank window and get its score. Without a model all scores are 0.
    Repeated rows score alike, and columns of these names are replaced. A null id is not held
    out. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer() if shared.value else lambda texts: np.zeros(len(texts))
        for batch in batches:
            yield pd.Series(score(batch.tolist()), dtype="float64")

    scored = docs.withColumn("held_out", held_out(F.col(id_col))).withColumn("score", scores(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
