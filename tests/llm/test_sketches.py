"""Fingerprints against sketches built word by word with another implementation of the hash."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidewater.llm import sketches

DOCS = "doc_id long, text string"
BELOW = 2 << 56


def shingle_hash(found):
    return int(hashlib.md5(" ".join(found).encode()).hexdigest()[:15], 16)


def plain(text):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    hashes = {shingle_hash(found[i : i + 5]) for i in range(max(len(found) - 4, min(len(found), 1)))}
    low = {h for h in hashes if h < BELOW}
    return low or set(sorted(hashes)[:1])


def likeness(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else float(not a and not b)


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    out = {}
    for k, (i, text) in enumerate(rows):
        follower = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        own, changed = plain(text), plain(edited)
        shown = [",".join(f"{h:015x}" for h in sorted(s)) for s in (own, changed)]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *shown, likeness(own, changed), likeness(own, plain(follower)))
    return out


def run(spark, rows):
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    for clash in ("h1", "n", "sketch", "prefix", "before", "_range"):
        frame = frame.withColumn(clash, F.lit("clash"))
    return [r.asDict() for r in sketches.fingerprints(frame).collect()]


COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_every_column_matches_word_by_word_sketches(spark):
    rows = [(i, " ".join(f"word{(i * j * j) % 97}" for j in range(1 + (i * 37) % 400))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one"), (103, " \t\n"), (104, "é" * 50), (105, "Two  WORDS"), (106, "漢字 " * 30), (107, "a b c d e"), (-3, "x " * 90_000)]
    out = run(spark, rows)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in out} == expected(rows)


def test_copies_ties_and_null_ids(spark):
    rows = [(1, "some words that are here twice over")] * 30 + [(1, "other words under the same id")] + [(None, "no id at all but words")] * 3 + [(2, "x y z")]
    out = run(spark, rows)
    assert len(out) == len(rows) and len({tuple(sorted((k, str(v)) for k, v in r.items())) for r in out}) == 4
    last = next(r for r in out if r["doc_id"] == 2)
    assert last["next_doc_id"] is None and len({r["fingerprint"] for r in out}) == 4


def test_one_document_is_its_own_next_and_no_rows_give_none(spark):
    (one,) = run(spark, [(5, "only one document of some words here")])
    assert one["next_doc_id"] == 5 and one["near_next"] == 1.0
    assert sketches.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("a", "b"), [("one two three four five six seven " * 40, "other words entirely " * 9), ("a b", ""), ("x y z w v u", "x y z w v u")])
def test_sketches_merge_and_estimate_containment(spark, a, b):
    frame = spark.createDataFrame([(a, b)], "a string, b string").select(sketches.words(F.col("a")).alias("a"), sketches.words(F.col("b")).alias("b"))
    frame = frame.select(sketches.sketch_of_words(F.col("a")).alias("a"), sketches.sketch_of_words(F.col("b")).alias("b"))
    row = frame.select("a", "b", sketches.kept(F.concat("a", "b")).alias("both")).first()
    union = {h for h in plain(a) | plain(b) if h < BELOW}
    assert set(row["both"]) == (union or set(sorted(plain(a) | plain(b))[:1])) and row["both"] == sorted(row["both"])


def test_a_large_document_holds_its_part(spark):
    words = [f"w{(k * 7919) % 5003}x{k}" for k in range(20_000)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[3000:4500]))], DOCS)
    row = next(r for r in sketches.fingerprints(frame).collect() if r["doc_id"] == 2)
    assert row["near_next"] == 1.0 and 150 < len(row["fingerprint"].split(",")) < 230
