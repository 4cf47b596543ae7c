"""Vectorised text helpers that run inside Spark tasks on Arrow batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. All of these are ASCII, so splitting UTF-8 bytes equals
splitting code points. Hashes are 64-bit and do not depend on the batch, the partition or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[where[0] : where[-1]], where - where[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``most`` bytes together, which bounds the working memory."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()), dtype=np.int64)
    ends, begin, total = np.cumsum(sizes), 0, 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, total + most, "right")))
        yield batch.slice(begin, end - begin)
        total, begin = int(ends[end - 1]), end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row that it belongs to."""
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each row."""
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(len(column), np.int64)
    return np.bincount(word_spans(data, offsets)[2], minlength=len(column))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    begins = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(begins, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))
    values = _BYTE_VALUE[_LOWER[data[place + np.repeat(starts, lengths)]]] * powers[place]
    return mix64(np.add.reduceat(values, begins) + lengths.astype(np.uint64) * _ODD[0])


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each row as sorted 64-bit hashes, all rows in one array, and offsets.

    A row with fewer words than ``width`` (one at least) has its whole word sequence as its only shingle; a row without
    words has none.
    """
    data, offsets = utf8(column)
    rows = len(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    starts, ends, row = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    counts = np.bincount(row, minlength=rows)
    if not len(words):
        return words, np.zeros(rows + 1, np.int64)
    full = len(words) - width + 1
    parts, owners = [], []
    if full > 0:
        value = np.zeros(full, np.uint64)
        for k in range(width):
            value = (value ^ words[k : k + full]) * _ODD[k % 5] + np.uint64(k)
        whole = row[:full] == row[width - 1 :]
        parts.append(mix64(value[whole]))
        owners.append(row[:full][whole])
    begin = np.cumsum(counts) - counts
    for length in range(1, width):
        short = np.flatnonzero(counts == length)
        if len(short):
            value = np.full(len(short), length, np.uint64) * _ODD[4]
            for k in range(length):
                value = (value ^ words[begin[short] + k]) * _ODD[k % 5] + np.uint64(k + 101)
            parts.append(mix64(value))
            owners.append(short)
    value, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))
