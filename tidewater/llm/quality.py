"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector; learned filters slide over overlapping chunks of bytes that cover the whole document;
each filter's largest answer over the document is kept, and these are combined into one probability. Training runs on
the driver over a bounded sample of labelled rows; scoring runs on Arrow batches inside Spark tasks, with the weights in
the function that Spark ships.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.textkit import pieces, utf8

#: Rows of each class that training may see, and bytes of the longest text among them.
TRAIN_ROWS_PER_CLASS, TRAIN_MAX_BYTES = 1500, 20_000
THRESHOLD = 0.3
#: Bytes that are scored at once: their chunk matrix takes about 256 times that.
BLOCK_BYTES = 1 << 16


@dataclass
class Network:
    """Weights. ``chunk`` bytes per chunk, a new chunk every ``stride`` bytes; byte 0 and padding have a zero vector."""

    vectors: np.ndarray  # (256, d)
    filters: np.ndarray  # (chunk * d, f)
    offsets: np.ndarray  # (f,)
    combine: np.ndarray  # (f,)
    bias: float
    chunk: int = 32
    stride: int = 4

    def layout(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rows' bytes, each row padded so that whole chunks cover it; each row's first chunk place (and the end of
        all places), and its number of chunks. Places after a row's last chunk are not its own and must be left out."""
        lengths = np.diff(offsets)
        chunks = np.maximum(1, -(-(lengths - self.chunk) // self.stride) + 1)
        room = (chunks - 1) * self.stride + self.chunk
        room += -room % self.stride + self.stride
        begin = np.concatenate(([0], np.cumsum(room)))
        padded = np.zeros(begin[-1] + self.chunk, np.uint8)
        padded[np.arange(len(data)) + np.repeat(begin[:-1] - offsets[:-1], lengths)] = data
        return padded, begin // self.stride, chunks

    def answers(self, padded: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk matrix and filter answers at every chunk place."""
        d = self.vectors.shape[1]
        vectors = np.take(self.vectors, padded, axis=0).reshape(-1)
        places = int(first[-1])
        size = vectors.itemsize
        chunks = np.lib.stride_tricks.as_strided(vectors, (places, self.chunk * d), (self.stride * d * size, size))
        return chunks, np.ascontiguousarray(chunks) @ self.filters + self.offsets

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of the good class for each row. Rows are read in blocks of about BLOCK_BYTES, a longer row in
        several blocks of chunk places, with a running maximum, so memory does not grow with a text's length."""
        rows = len(offsets) - 1
        if rows < 1:
            return np.zeros(0)
        top = np.zeros((rows, self.filters.shape[1]), np.float32)
        most = BLOCK_BYTES // self.stride  # places of a block
        lengths = np.diff(offsets)
        chunks = np.maximum(1, -(-(lengths - self.chunk) // self.stride) + 1)
        parts = -(-chunks // most)
        owner = np.repeat(np.arange(rows), parts)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * most
        begin = offsets[owner] + first * self.stride
        last = np.minimum(first + most, chunks[owner]) - 1
        end = np.minimum(offsets[owner] + last * self.stride + self.chunk, offsets[owner + 1])
        full, at = np.cumsum(end - begin), 0
        while at < len(owner):
            stop = max(at + 1, int(np.searchsorted(full, (full[at - 1] if at else 0) + BLOCK_BYTES + self.chunk, "right")))
            sizes = end[at:stop] - begin[at:stop]
            own = np.concatenate([data[x:y] for x, y in zip(begin[at:stop].tolist(), end[at:stop].tolist(), strict=True)])
            padded, places, count = self.layout(own, np.concatenate(([0], np.cumsum(sizes))))
            bounds = np.stack([places[:-1], places[:-1] + count], axis=1).reshape(-1)
            np.maximum.at(top, owner[at:stop], np.maximum.reduceat(self.answers(padded, places)[1], bounds, axis=0)[::2])
            at = stop
        return 1 / (1 + np.exp(-np.clip(top @ self.combine + self.bias, -30, 30).astype(np.float64)))


def fit(texts: list[bytes], good: np.ndarray, *, width: int = 8, filters: int = 16, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Train on whole texts by Adam on logistic loss; both classes weigh alike in each batch."""
    rng = np.random.default_rng(seed)
    chunk, stride = Network.chunk, Network.stride
    net = Network(rng.normal(0, 0.3, (256, width)).astype(np.float32), rng.normal(0, (2 / (chunk * width)) ** 0.5, (chunk * width, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.3, filters).astype(np.float32), 0.0, chunk, stride)
    net.vectors[0] = 0
    sides = [np.flatnonzero(good == side) for side in (0, 1)]
    if not all(len(s) for s in sides):
        net.combine[:] = 0
        net.bias = 3.0 if len(sides[1]) or not len(sides[0]) else -3.0
        return net
    state: dict[str, list[np.ndarray]] = {}

    def adam(name: str, value: np.ndarray, grad: np.ndarray, t: int) -> np.ndarray:
        m, v = state.setdefault(name, [np.zeros_like(grad), np.zeros_like(grad)])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        pace = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        return (value - pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)

    for t in range(1, steps + 1):
        picked = np.concatenate([rng.choice(s, batch // 2) for s in sides])
        sizes = np.array([len(texts[i]) for i in picked])
        data = np.frombuffer(b"".join(texts[i] for i in picked), np.uint8)
        padded, first, count = net.layout(data, np.concatenate(([0], np.cumsum(sizes))))
        chunks, z = net.answers(padded, first)
        best = np.stack([first[r] + z[first[r] : first[r] + count[r]].argmax(0) for r in range(len(picked))])
        top = np.maximum(np.take_along_axis(z, best, 0), 0)
        p = 1 / (1 + np.exp(-np.clip(top @ net.combine + net.bias, -30, 30)))
        slope = ((p - good[picked]) / len(picked)).astype(np.float32)
        down = slope[:, None] * net.combine * (top > 0)
        cut = chunks[best]  # (rows, filters, chunk * width)
        grad_filters = np.einsum("rf,rfk->kf", down, cut)
        back = (down[:, :, None] * net.filters.T[None]).reshape(len(picked), filters, chunk, width)
        spots = padded[best[:, :, None] * stride + np.arange(chunk)]
        grad_vectors = np.zeros_like(net.vectors)
        np.add.at(grad_vectors, spots.reshape(-1), back.reshape(-1, width))
        net.combine = adam("combine", net.combine, top.T @ slope + 1e-4 * net.combine, t)
        net.bias = float(adam("bias", np.array([net.bias], np.float32), np.array([slope.sum()], np.float32), t)[0])
        net.filters = adam("filters", net.filters, grad_filters + 1e-5 * net.filters, t)
        net.offsets = adam("offsets", net.offsets, down.sum(0), t)
        net.vectors = adam("vectors", net.vectors, grad_vectors, t)
        net.vectors[0] = 0
    return net


def held_out(doc_id):
    """True for the fold that is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, rows_per_class: int = TRAIN_ROWS_PER_CLASS, max_bytes: int = TRAIN_MAX_BYTES) -> Network:
    """A network fitted on at most ``rows_per_class`` labelled ids of each class, those of the smallest hashes, whose
    texts have at most ``max_bytes`` bytes; rows of the held-out fold, null labels and null texts are left out.

    This bound is the only sampling in the operator; every document is scored whole. It also bounds what is broadcast,
    the chosen ids, and what the driver gets: one text an id, the least of those that share it. An id with two labels has
    the larger one. Without labelled texts, or with those of one class only, the network scores all texts alike.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id", F.lit("quality sample")), F.col("doc_id")]
    sides = [usable.filter(F.col("quality") == side).orderBy(*order).limit(rows_per_class) for side in (0, 1)]
    chosen = sides[0].unionAll(sides[1])
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "doc_id")
    texts = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality")).collect()
    found = sorted(((r["doc_id"], r["text"].encode(), r["quality"]) for r in texts), key=lambda r: r[0])
    return fit([t for _, t, _ in found], np.array([q for *_, q in found], np.float32))


def score(docs: DataFrame, network: Network, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` from ``text`` alone.

    Null counts as empty and an empty text is scored like others (no filter answers it). Other columns are kept, those
    named score or predicted replaced. Equal texts get equal scores whatever batch they are in, up to float rounding.
    Repeated rows are scored alike, an empty table gives no rows.
    """
    rest = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    schema = T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 18):
                p = np.round(network.scores(*utf8(part.column("text"))), 6)
                columns = [*part.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "score", "predicted"])

    return rest.mapInArrow(judge, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    network = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    light = score(docs.withColumn("held_out", held_out("doc_id")), network)
    return light.select("doc_id", "held_out", "score", "predicted")
