"""Packing by concatenate and cut: two-pass prefix sums give every token its place in one long row."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlake.session import shared_dir

#: White space of Unicode. Byte-level BPE never joins what stands before a run of it with the run,
#: so a run with the characters after it can be encoded by itself, and its ids remembered.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Nor does it join a letter with the ASCII character after it that is no letter.
_CHUNK = re.compile(rf"[{_SPACE}]*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?=[\x00-@\[-`{{-\x7f]|\Z)|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Chunks whose ids a task remembers, twice: those used of late, and those used before them.
REMEMBERED = 1 << 18
#: Chunks that begin with white space and end without are encoded many in one string, for the tokenizer's cost is mostly one a call.
_JOINS, TOGETHER_AT_ONCE = re.compile(rf"[{_SPACE}].*[^{_SPACE}]\Z", re.S), 256
#: Characters of texts that are encoded and handed on together.
TOGETHER = 1 << 20


class Encoder:
    """Ids of whole texts, little-endian unsigned 32-bit, by a byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)  # in a byte-level vocabulary a character stands for a byte
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        split = [_CHUNK.findall(text or "") for text in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        get = self.known.get
        found = [list(map(get, chunks)) for chunks in split]
        gaps = [k for k, ids in enumerate(found) if None in ids]
        missing = {c for k in gaps for c, ids in zip(split[k], found[k]) if ids is None}
        self.known |= {c: ids for c in missing if (ids := self.older.get(c)) is not None}
        self._learn(list(missing.difference(self.known)))
        for k in gaps:
            found[k] = [self.known[c] if ids is None else ids for c, ids in zip(split[k], found[k])]
        return [b"".join(ids) for ids in found]

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks. Joined ones are told apart by the bytes that their tokens stand for."""
        joins = [c for c in chunks if _JOINS.match(c)]
        alone = [c for c in chunks if not _JOINS.match(c)]
        groups = [joins[k:k + TOGETHER_AT_ONCE] for k in range(0, len(joins), TOGETHER_AT_ONCE)]
        for group, one in zip(groups, self._ids(["".join(g) for g in groups])):
            ids = np.array(one.ids, "<u4")
            token_ends, chunk_ends = np.cumsum(self.bytes_of[ids]), np.cumsum([len(c.encode()) for c in group])
            last = np.searchsorted(token_ends, chunk_ends)
            if last[-1] >= len(ids) or not np.array_equal(token_ends[last], chunk_ends):  # a vocabulary that is not byte-level
                alone += group
                continue
            data, start = ids.tobytes(), 0
            for chunk, end in zip(group, (4 * (last + 1)).tolist()):
                self.known[chunk] = data[start:end]
                start = end
        for chunk, one in zip(alone, self._ids(alone)):
            ids = one.ids
            self.known[chunk] = struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)  # kept by the worker for its next tasks


def _token_rows(path: str, end_id: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, before, end = _encoder(path), TaskContext.get().partitionId(), 0, struct.pack("<I", end_id)
        for batch in batches:
            for group in _groups(batch["text"].map(lambda t: len(t or "")).tolist()):
                out = []
                for doc, ids in zip(batch["id"].iloc[group], encoder.encode_all(batch["text"].iloc[group].tolist())):
                    ids += end
                    out.append((part, before, None if pd.isna(doc) else int(doc), len(ids) // 4, ids))
                    before += len(ids) // 4
                yield _frame(out)

    return rows


def _groups(lengths: list[int]) -> Iterator[slice]:
    """Stretches of texts that hold about ``TOGETHER`` characters."""
    first, size = 0, 0
    for k, n in enumerate(lengths):
        if size and size + n > TOGETHER:
            yield slice(first, k)
            first, size = k, 0
        size += n
    yield slice(first, len(lengths))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "before", "id", "n", "ids"]).astype({"id": "Int64"})


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """Token ids of every document, with its partition and the tokens that the partition has before it.

    Written to the shared folder: both passes read the same partitions, whatever happens to executors.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(
        _token_rows(tokenizer, end_id), "part int, before long, id long, n long, ids binary")
    path = shared_dir(spark, "packing-tokens")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = 2048,
         end_id: int = 1) -> DataFrame:
    """Cuts the concatenation of all documents into sequences of ``length`` tokens; one row per piece.

    First pass: token totals of partitions, and their prefix sums. Second pass: a document's
    global offset is its partition's offset plus what stands before it there, and it is cut
    wherever a multiple of ``length`` falls. A document on such a boundary has a piece, its
    boundary record, on each side. Only the very last sequence can be short.

    Returns ``id_col``, ``start`` (the document's ids before the piece), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``. Every document
    ends with ``end_id``, so null and empty texts have one token. Repeated rows are packed each;
    ids may be null. Further columns of ``docs`` are ignored. An empty table gives no rows.
    """
    tokens = tokenize(docs, tokenizer, id_col, text, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("part_before"))
    placed = tokens.join(F.broadcast(offsets), "part")  # one small row a partition
    at = F.col("part_before") + F.col("before")
    first, last = F.floor(at / length), F.floor((at + F.col("n") - 1) / length)
    cut = placed.select("id", "n", "ids", at.alias("at"), F.explode(F.sequence(first, last)).alias("sequence_id"))
    start = F.greatest(F.lit(0), F.col("sequence_id") * length - F.col("at"))
    stop = F.least(F.col("n"), (F.col("sequence_id") + 1) * length - F.col("at"))
    pieces = cut.withColumn("start", start).withColumn("length", stop - start)
    ids = F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))")
    return pieces.select(F.col("id").alias(id_col), "start", "length", ids.alias("ids"), F.col("n").alias("doc_tokens"),
                         "sequence_id", (F.col("at") + F.col("start") - F.col("sequence_id") * length).alias("offset"))


def sequences(pieces: DataFrame, id_col: str = "doc_id", length: int = 2048, pad_id: int = 1) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``length``, ``doc_ids`` in order, ``ids`` with padding.

    A sequence is padded to ``length`` unless its own length is a power of two.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids", F.col(id_col).alias("doc"))))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("x"), F.sum("length").cast("int").alias("own"))
    joined = F.aggregate("x.ids", F.lit(b""), lambda a, b: F.concat(a, b))
    full = F.when(F.bit_count("own") == 1, F.col("own")).otherwise(length)
    pad = F.lit(struct.pack("<I", pad_id)) if pad_id is not None else F.lit(b"")
    padding = F.aggregate(F.array_repeat(pad, full - F.col("own")), F.lit(b""), lambda a, b: F.concat(a, b))
    return whole.select("sequence_id", F.col("own").alias("length"), F.col("x.doc").alias("doc_ids"),
                        F.concat(joined, padding).alias("ids"))
