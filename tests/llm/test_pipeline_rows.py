"""The whole pipeline over rows without ids, repeated rows, other columns and no rows; the joins over very long texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_duplicates import components, shingles
from tidewater.llm import jaccard, mixing

FOLDER = "/root/testdata/sf0.001"
PIECES = {"doc_id", "start", "length", "sequence_id", "offset", "doc_tokens"}


def tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_over_awkward_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    awkward = docs.filter("doc_id < 4").select(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) if c in ("doc_id", "source") else F.col(c) for c in docs.columns])
    empty = docs.filter("doc_id = 5").withColumn("text", F.lit(None).cast("string"))
    every = docs.unionByName(docs.filter("doc_id % 3 = 0")).unionByName(awkward).unionByName(empty)
    for clash in ("size", "taken", "component_id", "score", "predicted", "sequence_id"):
        every = every.withColumn(clash, F.lit("clash"))
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, every)).collect()
    plain = corpus_pipeline.run(spark, FOLDER).collect()
    assert PIECES <= set(out[0].asDict())
    # A repeated row is a copy, of which one stays, so the same documents come through.
    assert {r["doc_id"] for r in out} - {None} <= {r["doc_id"] for r in docs.collect()}
    assert len({r["doc_id"] for r in out} & {r["doc_id"] for r in plain}) >= 0.9 * len({r["doc_id"] for r in plain})
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 1024


def test_run_over_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, docs.limit(0)))
    assert set(out.columns) >= PIECES and out.count() == 0


@pytest.mark.parametrize("percent,width", [(85, 4), (80, 5)])
def test_join_of_very_long_texts(spark, percent, width):
    rng = np.random.default_rng(percent)
    words = [f"w{x}" for x in rng.integers(50000, size=250000)]
    cut = lambda share: " ".join(words[: int(len(words) * share)])
    texts = {1: cut(1), 2: cut(0.95), 3: cut(0.7), 4: "word " * 300000, 5: "word " * 10, 6: "x" * 2000000, 7: "x" * 2000000, 8: cut(0.001)}
    rows = [(i, t, "s") for i, t in texts.items()]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string, source string"), width=width, percent=percent).collect()}
    sets = {i: shingles(t, width) for i, t in texts.items()}
    wanted = components(sets, percent)
    assert wanted[2] == 1 and wanted[3] == 3 and wanted[5] == 4 and wanted[7] == 6
    assert out == {i: (len(sets[i]), wanted[i]) for i in sets}


def test_mix_counts_the_words_of_very_long_texts(spark):
    rows = [(1, "a b\t" * 400000, "x"), (2, "one two", "x"), (3, "y" * 3000000, "z")]
    out = {r["doc_id"]: r["size"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out == {1: 800000, 2: 2, 3: 1}
