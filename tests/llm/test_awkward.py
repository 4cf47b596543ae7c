"""Empty tables, repeated rows, nulls, ties, clashing names and long texts for packing, media columns and chat formatting."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewater.llm import chat, packing, transport

PATHS = {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken")}
DOCS = "doc_id long, text string"


def test_long_texts_have_the_ids_of_the_whole(monkeypatch):
    fast, slow = packing.Encoder(**PATHS), packing.Encoder(PATHS["path"])
    text = "Words in a row, 12 of them; and <|endoftext|> é漢 字 again.  Two  spaces\n new line end " * 40
    whole = slow.slow.encode(text, add_special_tokens=False).ids
    for long in (50, 333, 1 << 20):
        monkeypatch.setattr(packing, "LONG", long)
        assert fast(text).tolist() == slow(text).tolist() == whole
    monkeypatch.setattr(packing, "LONG", 50)
    assert len(fast("x" * 2000)) and fast("").tolist() == []


def test_packing_of_repeated_rows_null_ids_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_GROUP", 40)
    rows = [(None, "same text")] * 200 + [(5, "other")] * 200 + [(6, None), (6, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("sequence_id", F.lit("clash")).withColumn("grp", F.lit("clash"))
    out = packing.pack(docs, **PATHS).collect()
    assert len(out) == 402 and sum(r["doc_id"] is None for r in out) == 200
    groups = [sum(r["sequence_id"] >> 28 == g for r in out) for g in {r["sequence_id"] >> 28 for r in out}]
    assert len(groups) > 5 and max(groups) < 120
    assert packing.pack(docs.limit(0), **PATHS).count() == 0


@pytest.mark.parametrize("text", [None, "", "x" * 3_000_000, "é"])
def test_media_of_any_text(spark, text):
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], DOCS).withColumn("media", F.lit("clash")).withColumn("n_bytes", F.lit("clash"))
    out = transport.features(transport.stored(docs, id_column="doc_id", text_column="text"), id_column="doc_id").collect()
    raw = (text or "").encode()
    raw += bytes(-len(raw) % 64 if raw else 64)
    assert len(out) == 3 and {(r["payload_sha256"], r["tail_crc32"]) for r in out} == {(hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))}
    assert len({r["media_sha256"] for r in out}) == 1
    none = transport.stored(docs.limit(0), id_column="doc_id", text_column="text")
    assert transport.features(none, id_column="doc_id").count() == transport.units(none, id_column="doc_id").count() == 0


def test_units_hold_the_payload_with_times(spark):
    text = "".join(map(chr, np.random.default_rng(3).integers(32, 0x500, 200_000)))
    media = transport.stored(spark.createDataFrame([(1, text)], DOCS), id_column="doc_id", text_column="text")
    rows = sorted(transport.units(media, id_column="doc_id").collect(), key=lambda r: r["number"])
    assert b"".join(bytes(r["data"]) for r in rows).rstrip(b"\0").decode() == text
    assert [r["time"] for r in rows] == [transport.TICKS_PER_UNIT * k for k in range(len(rows))] and rows[0]["random_access"] and rows[8]["random_access"] and not rows[1]["random_access"]


def test_chat_of_equal_turn_numbers_repeated_rows_and_no_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "z" * 500_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("loss_start", F.lit("clash"))
    (one,) = chat.read_back(chat.formatted_turns(chat.canonical_turns(frame))).collect()
    said = "user\na\nuser\na\nuser\nb\nassistant\n" + "z" * 500_000 + "\n"
    assert one["n_turns"] == 4 and one["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and one["loss_chars"] == 500_000
    assert chat.read_back(chat.formatted_turns(chat.canonical_turns(frame.limit(0)))).count() == 0
