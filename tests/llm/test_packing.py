"""Packing against the tokenizer run on whole texts: an exact round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fairlake.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def slow_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, texts):
    """Pieces give back every document's ids, and sequences have no gaps."""
    got, places = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        got.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for doc, text in texts.items():
        parts, ids = sorted(got[doc]), []
        for start, part, total in parts:
            assert start == len(ids) and total == len(slow_ids(text))
            ids += part
        assert ids == slow_ids(text)
    for sequence, parts in places.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or sequence == max(places) and at < 2048
    assert sorted(places) == list(range(len(places)))


def test_round_trip_with_edge_cases(spark):
    texts = [None, "", " ", "\n \n  a  b c\x1cd\x0b e", "it's  we'll\t\t ok", "<|endoftext|> x<|endoftext|>", "é \U0001f600̀ 12 3.4",
             "word " * 60_000, "y" * 50_000]
    rng = random.Random(5)
    alphabet = "ab '\t\n\x0b\x1c\x1f\x85  　.,1éж中<|>"
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 90))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(5)
    pieces = packing.pack(docs, PATH)
    check(pieces.collect(), dict(enumerate(texts)))
    whole = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert {len(r.ids) // 4 for r in whole} == {2048} and sum(r.length for r in whole) == sum(len(slow_ids(t)) for t in texts)


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_packing"](spark, sf).collect()
    for r in rows:
        part = slow_ids(docs[r.doc_id])[r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r.length
    assert sum(r.length for r in rows) == sum(len(slow_ids(t)) for t in docs.values())


def test_empty_table_repeated_rows_and_powers_of_two(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, PATH).collect() == []
    twice = spark.createDataFrame([(3, "a b c")] * 2 + [(None, None)], "doc_id long, text string")
    pieces = packing.pack(twice, PATH)
    assert sorted((p.doc_id or -1, p.length) for p in pieces.collect()) == [(-1, 1), (3, 4), (3, 4)]
    assert [(r.length, len(r.ids) // 4) for r in packing.sequences(pieces).collect()] == [(9, 2048)]
    eight = packing.pack(twice.where("doc_id = 3"), PATH)
    assert [(r.length, len(r.ids) // 4) for r in packing.sequences(eight).collect()] == [(8, 8)]
