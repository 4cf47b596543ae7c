"""Packing documents into fixed-length training sequences by first-fit decreasing.

A document is its token ids and one closing id; it is cut into pieces of at most the sequence length. Documents fall
into randomised groups of bounded size, and within a group first-fit decreasing runs on a tournament tree over the free
space of the group's sequences. Only the pieces' lengths and checksums are shuffled, never texts or ids.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.storage import written
from tidewater.llm.textkit import pieces as parts

END_ID = 0
PIECES_PER_GROUP = 4096
#: Code points of a text that are encoded at once, and where a longer text may be cut; no special string has a space.
LONG, _CUT = 1 << 20, re.compile(r"[^\W\d_](?= [^\W\d_])")


class Encoder:
    """Ids as the tokenizer file gives them, with its special strings recognised.

    Most texts go through the same vocabulary's rank file, which is several times faster and gives the same ids on the
    code points below U+0600 (a test compares every one of them); other texts, and all texts where
    no rank file is given, go through the tokenizer file itself.
    """

    #: The pre-tokenisation that the rank file's vocabulary was built with, in possessive form; a fixed value.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = re.compile("[\u0000-׿]*")

    def __call__(self, text: str) -> np.ndarray:
        """The ids of the whole text. A text of more than LONG code points is encoded part by part, cut between a letter
        and a space that a letter follows, where no token reaches across, so working memory stays bounded."""
        if len(text) <= LONG:
            return self._encode(text)
        ids, begin = [], 0
        while begin < len(text):
            cut = _CUT.search(text, begin + LONG)
            end = cut.start() + 1 if cut else len(text)
            ids.append(self._encode(text[begin:end]))
            begin = end
        return np.concatenate(ids)

    def _encode(self, text: str) -> np.ndarray:
        if self.fast is None or not self.plain.fullmatch(text):
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if self.split is None or not any(s in text for s in self.special):
            return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")
        ids: list[int] = []
        for part in self.split.split(text):
            ids += [self.special[part]] if part in self.special else self.fast.encode_ordinary(part)
        return np.asarray(ids, dtype="<u4")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: items in falling length, each into the first bin with room.

    A tournament tree holds at each node the largest free space below it, so the first bin with room is found by one
    walk from the root.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins = np.empty(n, np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[item] = node - leaves
        tree[node] -= need
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left >= right else right
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins


PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, *, path: str, ranks_path: str | None = None, capacity: int = 1024) -> DataFrame:
    """One row per piece of each document; null text counts as empty, so it is the closing id alone."""
    kind = docs.schema["doc_id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks_path)
        for batch in batches:
            for part in parts(batch, "text", 1 << 22):
                where, start, length, crc, total = [], [], [], [], []
                for row, text in enumerate(part.column("text")):
                    ids = np.append(encoder(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                    raw = ids.tobytes()
                    for begin in range(0, len(ids), capacity):
                        where.append(row)
                        start.append(begin)
                        length.append(min(capacity, len(ids) - begin))
                        crc.append(zlib.crc32(raw[4 * begin : 4 * (begin + capacity)]))
                        total.append(len(ids))
                columns = [part.column("doc_id").take(pa.array(where, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES.format(kind=kind.simpleString()))


def pack(docs: DataFrame, *, path: str, ranks_path: str | None = None, capacity: int = 1024) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: gapless from 0 within a sequence of at most ``capacity`` ids.

    ``docs`` needs doc_id and text. Null doc_ids, repeated rows and empty texts are documents like others; an empty
    table gives no pieces. Groups are dealt by a hash of the stored piece's number, so neither a very long document nor
    rows that repeat an id or a whole text make a large group.
    """
    pieces = token_pieces(docs, path=path, ranks_path=ranks_path, capacity=capacity)
    pieces = written(pieces.withColumn("number", F.monotonically_increasing_id()), "pack-pieces")
    rows = pieces.count()
    groups = max(1, math.ceil(rows / PIECES_PER_GROUP))
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("number", F.lit("packing")), F.lit(groups))).drop("number")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy()
        full = int((lengths == capacity).sum())
        bins = np.concatenate((np.arange(full), full + first_fit_decreasing(lengths[full:], capacity))) if full < len(lengths) else np.arange(full)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        firsts = np.r_[True, bins[order][1:] != bins[order][:-1]]
        base = np.maximum.accumulate(np.where(firsts, ends - lengths[order], 0))
        offset = np.empty(len(lengths), np.int64)
        offset[order] = ends - lengths[order] - base
        return frame.assign(sequence_id=(frame["grp"].to_numpy(np.int64) << 28) + bins, offset=offset).drop(columns="grp")

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return grouped.groupBy("grp").applyInPandas(fit, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents packed into sequences of 1024 ids of the public byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, path=public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=1024)
