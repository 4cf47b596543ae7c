"""The classifier's network against a naive one, in bounded memory, and its training on awkward tables."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import quality


def network(seed=3, width=4, filters=5):
    rng = np.random.default_rng(seed)
    net = quality.Network(rng.normal(size=(256, width)).astype(np.float32), rng.normal(size=(32 * width, filters)).astype(np.float32), rng.normal(size=filters).astype(np.float32), rng.normal(size=filters).astype(np.float32), 0.3)
    net.vectors[0] = 0
    return net


def naive(net, raw):
    """Every chunk of every row on its own, straight from the definition."""
    best, at = np.zeros(net.filters.shape[1]), 0
    while True:
        chunk = raw[at : at + net.chunk].ljust(net.chunk, b"\0")
        vector = np.concatenate([net.vectors[b] for b in chunk])
        best = np.maximum(best, vector @ net.filters + net.offsets)
        at += net.stride
        if at - net.stride + net.chunk >= len(raw):
            return 1 / (1 + np.exp(-np.clip(best @ net.combine + net.bias, -30, 30)))


def test_scores_equal_a_naive_network_at_every_block_size(monkeypatch):
    rng = np.random.default_rng(0)
    rows = [bytes(rng.integers(0, 256, int(n), dtype=np.uint8)) for n in (0, 1, 4, 31, 32, 33, 36, 37, 100, 1000, 2049, 5000)]
    net, data = network(), np.frombuffer(b"".join(rows), np.uint8)
    wanted = [naive(net, r) for r in rows]
    for block in (64, 256, 1 << 16):
        monkeypatch.setattr(quality, "BLOCK_BYTES", block)
        assert np.allclose(net.scores(data, np.cumsum([0] + [len(r) for r in rows])), wanted, atol=1e-4)


def test_memory_does_not_grow_with_the_text():
    net, data = network(), np.tile(np.arange(256, dtype=np.uint8), 20 * 4096)
    tracemalloc.start()
    net.scores(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_training_and_scoring_of_awkward_tables(spark):
    docs = spark.createDataFrame([(1, "good words here", 1), (1, "another text of the id", 1), (None, "x", 2), (3, None, 3), (4, "", 4), (4, "", 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (3, 0), (4, 1), (4, 0)], "doc_id long, quality int")
    net = quality.train(docs, labels, rows_per_class=2)
    out = quality.score(docs.withColumn("predicted", F.lit("clash")), net)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == 6
    empty = quality.train(docs.limit(0), labels.limit(0))
    assert quality.score(docs.limit(0), empty).count() == 0
