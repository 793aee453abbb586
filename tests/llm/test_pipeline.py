"""The pipeline against its stages' brute-force counterparts."""

import sys
from collections import Counter

import numpy as np
from test_mixing import slow_mix
from test_packing import slow_ids
from test_simhash import slow_groups

import corpus_pipeline
from fairlake.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept.append((before, docs))
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    toxic, near, secret, mixed, packed = kept

    model = toxicity.fit(toxic[0], spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score_toxicity(toxic[0], model).where("predicted = 1").collect()}
    assert {r.doc_id for r in toxic[1].collect()} == {r.doc_id for r in toxic[0].collect()} - rejected

    groups = slow_groups([(r.doc_id, r.text) for r in near[0].collect()])
    assert sorted(r.doc_id for r in near[1].collect()) == sorted({c for _, c in groups.values()})

    was, now = ({r.doc_id: r.text for r in x.collect()} for x in secret)
    assert was.keys() == now.keys()
    assert all(now[i] == was[i] or "[SECRET]" in now[i] for i in now)

    want = {i: taken for i, (_, _, _, taken) in slow_mix([(r.doc_id, r.text, r.source) for r in mixed[0].collect()]).items()}
    got = Counter()
    for r in mixed[1].collect():
        got[r.doc_id] += len(r.text.split())
    assert got == {i: n for i, n in want.items() if n}

    texts = Counter((r.doc_id, tuple(slow_ids(r.text))) for r in packed[0].collect())
    total = sum(len(ids) * n for (_, ids), n in texts.items())
    rows = packed[1].collect()
    assert sum(r.length for r in rows) == total and max(r.sequence_id for r in rows) == (total - 1) // 2048
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))])
    assert len(every) == total and (every == 1).sum() >= len(texts)

    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == packed[1].columns and sum(r.length for r in whole.collect()) == total


def test_entry_registers_everything():
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
