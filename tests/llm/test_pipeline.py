"""The pipeline's stages on the smallest tables: what each may keep, and that every document that is left is packed."""

import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from tests.llm.test_near_duplicates import components, shingles
from tidewater.llm import packing, pii
from tidewater.llm.storage import written

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), "test-stage")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
        rows = docs.collect()
        assert rows and {r["doc_id"] for r in rows} <= ids, name
        ids = {r["doc_id"] for r in rows}
        kept.append(rows)
    assert len(kept[0]) >= len(kept[1]) == len(kept[2])
    assert all(not pii.base_spans(r["text"] or "") for r in kept[2])
    assert max(sum(r["doc_id"] == i for r in kept[3]) for i in ids) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == ids

    # Of what the classifier kept, the near-duplicate stage keeps one of each group by brute force, and all clean ones.
    groups = components({r["doc_id"]: shingles(r["text"]) for r in kept[0]}, 80)
    assert sorted(r["doc_id"] for r in kept[1]) == sorted(set(groups.values())) and len(kept[1]) < len(kept[0])
    # Texts without personal data pass the third stage as they are.
    before = {r["doc_id"]: r["text"] for r in kept[1]}
    found = dict(zip(before, pii.find([t or "" for t in before.values()], pii.trained()), strict=True))
    assert all(r["text"] == before[r["doc_id"]] for r in kept[2] if not any(found[r["doc_id"]]))
    # Packed ids are those of the redacted texts, as often as the mix takes each.
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts, times = {r["doc_id"]: r["text"] or "" for r in kept[3]}, {}
    for r in kept[3]:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    for i in ids:
        raw = np.append(encode(texts[i]), np.uint32(0)).astype("<u4")
        wanted = sorted((a, zlib.crc32(raw[a : a + 1024].tobytes())) for a in range(0, len(raw), 1024)) * times[i]
        assert sorted((r["start"], r["ids_crc32"]) for r in packed if r["doc_id"] == i) == sorted(wanted)
    assert corpus_pipeline.STAGES[1][1](spark, docs.limit(0), FOLDER).count() == 0
