"""Alignment against groups and counts made token by token with dictionaries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidewater.llm import alignment

PATHS = {"a_path": public_tokenizers.path("byte_bpe_50k.json"), "a_ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "b_path": public_tokenizers.path("piece_bpe_32k.model")}
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def tools():
    first = Tokenizer.from_file(PATHS["a_path"])
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=PATHS["b_path"])


def byte_chars():
    """Which byte each character of a byte-level piece stands for, learnt from the library's own pre-tokenizer."""
    from tokenizers import pre_tokenizers

    split, found = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), {}
    for code in list(range(0x80)) + list(range(0x80, 0x800)) + [0x1000, 0x2000, 0x3000, 0x4000, 0x5000, 0x6000, 0x7000, 0x8000, 0x9000, 0xA000, 0xB000, 0xC000, 0xE000, 0xF000] + [0x10000, 0x40000, 0x80000, 0xC0000, 0x100000]:
        raw = chr(code).encode()
        ((shown, _),) = split.pre_tokenize_str(chr(code))
        found |= dict(zip(shown, raw, strict=True))
    return found


BYTE = byte_chars()


def grouped(text, tools):
    """[(A ids, B ids), ...] of a text, or nothing."""
    first, second = tools
    if not text:
        return []
    a = first.encode(" " + text, add_special_tokens=False).ids
    b = second.encode(text)
    a_bytes = [bytes(BYTE[c] for c in first.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return []
    out, k, done_a, done_b, group = [], 0, 0, 0, ([], [])
    for i, raw in zip(a, a_bytes, strict=True):
        done_a += len(raw)
        group[0].append(i)
        while k < len(b) and done_b + len(b_bytes[k]) <= done_a:
            done_b += len(b_bytes[k])
            group[1].append(b[k])
            k += 1
        if done_a == done_b:
            out.append(group)
            group = ([], [])
    return out


def expected(rows, tools):
    groups = [grouped(t, tools) for _, t in rows]
    links = [Counter((i, j) for g in found for i in g[0] for j in g[1]) for found in groups]
    count = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for (doc, _), found, own in zip(rows, groups, links, strict=True):
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in found)
        best = sum(m for p, m in own.items() if count[p] == most[p[0]])
        out.append((doc, sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), sum(own.values()), best, sum(m * count[p] for p, m in own.items()), hashlib.sha256(said.encode()).hexdigest() if found else ""))
    return sorted(out, key=str)


TEXTS = [
    "Ordinary words, with numbers 12345 and punctuation!?",
    "",
    None,
    " ",
    "  two leading spaces\n\nand lines\r\n\ttabs",
    "<|endoftext|> and <s> </s> <unk> [INST] are plain here",
    "a ▁ lower block is not given back",
    "日本語のテキスト、混ぜた English と emoji 👩‍👩‍👧 🎉",
    "Ærøskøbing naïve café — Привет, мир! שלום",
    "x" * 3000 + " " * 50 + "é" * 400,
    "<0x41> byte names \u0000 and \u0001 controls",
]


def words(seed, n):
    rng = np.random.default_rng(seed)
    known = "the of and antidisestablishmentarianism tokenization Überraschung 東京 alignment 3.14159 don't it's naïveté".split()
    return " ".join(known[k] for k in rng.integers(0, len(known), n))


def run(spark, rows):
    frame = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("run", F.lit("clash")).withColumn("n_a", F.lit("clash")).withColumn("keys", F.lit("clash"))
    out = alignment.align(frame, **PATHS)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_every_column_matches_token_by_token_alignment(spark, tools):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, words(i, 40 + i)) for i in range(30)]
    assert run(spark, rows) == expected(rows, tools)


def test_many_runs_rounds_and_copies_of_the_counts(spark, tools, monkeypatch):
    monkeypatch.setattr(alignment, "RUN_TOKENS", 300)
    monkeypatch.setattr(alignment, "FAN", 3)
    monkeypatch.setattr(alignment, "BLOCK", 7)
    monkeypatch.setattr(alignment, "RUNS_PER_TASK", 4)
    rows = [(i, words(i, 60)) for i in range(60)] + [(None, TEXTS[0])] * 40 + [(7, TEXTS[0])] * 3 + list(enumerate(TEXTS))
    assert run(spark, rows) == expected(rows, tools)


def test_no_rows_and_rows_without_tokens(spark, tools):
    assert alignment.align(spark.createDataFrame([], DOCS), **PATHS).count() == 0
    assert run(spark, [(1, None), (2, "")]) == expected([(1, None), (2, "")], tools)


def test_a_long_text_with_large_groups(spark, tools, monkeypatch):
    monkeypatch.setattr(alignment, "SMALL_GROUP", 1)
    rows = [(1, "é漢" * 3000 + words(3, 2000)), (2, TEXTS[9] * 20)]
    assert run(spark, rows) == expected(rows, tools)


def test_merge_of_runs_is_a_sum_by_key():
    rng = np.random.default_rng(1)
    made = [np.unique(rng.integers(0, 5000, n)) for n in (3000, 10, 1, 4000)]
    found = list(alignment.merged([alignment.zipped(m, m % 7 + 1) for m in made] + [[]]))
    keys, sums = (np.concatenate(c) for c in zip(*found, strict=True))
    want = Counter()
    for m in made:
        want.update({int(k): int(k) % 7 + 1 for k in m})
    assert keys.tolist() == sorted(want) and sums.tolist() == [want[k] for k in sorted(want)]
