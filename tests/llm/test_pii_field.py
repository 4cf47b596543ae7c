"""The random field: exact marginals on small graphs, evidence across a document, long texts, awkward tables."""

import itertools
import time

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import pii


def exact(unary, pairs, kinds, field):
    rows, labels = unary.shape
    total = np.zeros((rows, labels))
    for ys in itertools.product(range(labels), repeat=rows):
        weight = sum(unary[i, y] for i, y in enumerate(ys)) + sum((field.chain, field.skip)[k][ys[i], ys[j]] for (i, j), k in zip(pairs, kinds, strict=True))
        for i, y in enumerate(ys):
            total[i, y] += np.exp(weight)
    return total / total.sum(1, keepdims=True)


def test_marginals_equal_enumeration():
    field, rng = pii.trained(), np.random.default_rng(4)
    for pairs, kinds, slack in (([], [], 1e-9), ([(0, 1), (1, 2), (1, 3)], [0, 1, 1], 5e-3), ([(0, 1), (1, 2), (2, 3), (0, 2)], [0, 0, 1, 1], 0.12)):
        unary = rng.normal(size=(4, len(pii.LABELS)))
        got = pii.propagate(unary, np.array(pairs, np.int64).reshape(-1, 2), np.array(kinds, np.int64), field)
        assert np.abs(got - exact(unary, pairs, kinds, field)).max() < slack


def test_evidence_reaches_a_hundred_repeats():
    for word in ("9f" * 20, "zq81kx7w33ab"):
        text = f"password = {word} " + " ".join(f"word more {word} text" for _ in range(100))
        ((base, more),) = pii.find([text], pii.trained())
        assert base == [] and [s[0] for s in more] == ["secret"] * 101 and all(text[a:b] == word for _, a, b in more)
    ((_, more),) = pii.find([" ".join("word more zq81kx7w33ab text" for _ in range(100))], pii.trained())
    assert more == []


def test_words_before_are_whole():
    far = f"token {' ' * 500}= {' ' * 500}zq81kx7w33ab end"
    found = pii.tokens(far, [])
    assert [t.before for t in found] == ["token ="]
    assert [t.before for t in pii.tokens("x" * 100_000 + "=Y z 5", [])] == ["x" * 100_000 + "=y z"]


def test_time_is_in_proportion_to_the_text():
    def seconds(n):
        text = " ".join(f"a{i}@b{i % 97}.example.com" for i in range(n))
        began = time.time()
        ((base, _),) = pii.find([text], pii.trained())
        assert len(base) == n
        return time.time() - began

    seconds(1000)
    assert seconds(40_000) < 30 * max(seconds(4000), 0.1)
    pii.find(["1" * 5_000_000, "@" * 1_000_000, "+1" + "(" * 1_000_000], pii.trained())


def test_same_document_same_spans_in_any_batch():
    texts = ["token = zq81kx7w33ab", "ip 10.2.3.4 and 10.2.3.4", "card 4111 1111 1111 1111", "", "call +44 20 7946 0958 now"]
    together = pii.find(texts, pii.trained())
    assert together == [pii.find([t], pii.trained())[0] for t in texts]


def test_awkward_tables(spark):
    rows = [(1, "a@b.example x", 5), (1, "a@b.example x", 5), (None, None, None), (2, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumn("spans", F.lit("clash")).withColumn("n_ip", F.lit("clash"))
    out = sorted(((r["doc_id"] or 0, r["n_email"], r["spans"]) for r in pii.detect(docs).collect()))
    assert out == [(0, 0, ""), (1, 1, "email:0:11"), (1, 1, "email:0:11"), (2, 0, "")]
    clean = sorted(((r["doc_id"] or 0, r["text"], r["n_chars"], r["spans"]) for r in pii.redacted(docs).collect()))
    assert clean == [(0, None, None, "clash"), (1, "<EMAIL> x", 9, "clash"), (1, "<EMAIL> x", 9, "clash"), (2, "", 0, "clash")]
    assert pii.detect(docs.limit(0)).count() == pii.redacted(docs.limit(0)).count() == 0
