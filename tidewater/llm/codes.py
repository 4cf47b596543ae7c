"""Vector code compression: integer product codes whose nearest entries are found in the Walsh-Hadamard domain.

A vector's components become integers and the vector is cut into parts; each part position has a small codebook. Parts and
entries are padded with zeros to a power of two and transformed by the unnormalised Walsh-Hadamard transform, which
multiplies squared distances by that power. Differences are added up in sequency order (few sign changes first, where most of
the energy of smooth vectors lies); an entry whose partial sum exceeds the least whole sum known for its part cannot win
and is left. All arithmetic is on integers, so codes, errors and codebooks are the same on every machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.storage import small_side, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that are transformed at once; a batch of any size is worked on in such slices.
SLICE = 8192
#: Codebooks live in the driver and in each task, ENTRIES x length integers for each vector length.
MOST_LENGTHS = 256
#: Components from this size on (in scaled units) have no exact sum in the 38 digits of a Spark decimal.
MOST_VALUE = 1 << 80


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis, padded with zeros to a power of two, in sequency order."""
    size = 1 << max(0, (x.shape[-1] - 1).bit_length())
    out = np.zeros((*x.shape[:-1], size), x.dtype)
    out[..., : x.shape[-1]] = x
    h = 1
    while h < size:
        pairs = out.reshape(*x.shape[:-1], size // (2 * h), 2, h)
        out = np.stack((pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]), axis=-2).reshape(out.shape)
        h *= 2
    return out[..., sequency(size)]


def sequency(size: int) -> np.ndarray:
    """Hadamard row numbers in order of their sign changes: the bit reversal of the Gray code."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    out = np.zeros(size, np.int64)
    for k in range(bits):
        out |= ((gray >> k) & 1) << (bits - 1 - k)
    return out


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each transformed point's nearest transformed entry, ties to the lower one, and the scaled squared distance.

    Coefficients are taken in chunks of 1, 1, 2, 4, ... of them. After the first chunk the most promising entry is summed
    up whole; from then on a (point, entry) pair stays only while its partial sum is at most its point's bound.
    """
    size, rows = points.shape[1], np.arange(len(points))
    first = points[:, None, 0] - entries[None, :, 0]
    partial = first * first
    guess = np.argmin(partial, axis=1)
    whole = points - entries[guess]
    bound = (whole * whole).sum(axis=1)
    row, entry = np.nonzero(partial <= bound[:, None])
    partial, begin = partial[row, entry], 1
    while begin < size:
        end = min(size, 2 * begin)
        step = points[row, begin:end] - entries[entry, begin:end]
        partial = partial + (step * step).sum(axis=1)
        stays = partial <= bound[row]
        row, entry, partial, begin = row[stays], entry[stays], partial[stays], end
    # Pairs are in row order, entries ascending: the first pair of each row's least sum wins.
    starts = np.searchsorted(row, rows)
    least = np.minimum.reduceat(partial, starts) if len(rows) else partial
    wins = np.flatnonzero(partial == least[row])
    _, at = np.unique(row[wins], return_index=True)
    return entry[wins[at]], least


def integers(raw: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly: 64-bit integers where squared distances of transforms fit, Python integers beyond."""
    with np.errstate(over="ignore"):
        value = np.floor(raw.astype(np.float64) * scale)
    if not (np.abs(value) < MOST_VALUE).all():
        raise ValueError(f"a component is {MOST_VALUE // scale} or more in size: too large for exact sums")
    if not value.size or np.abs(value).max() < 2**62:
        return value.astype(np.int64)
    return np.array([int(v) for v in value.ravel().tolist()], object).reshape(value.shape)


def _fits(points: np.ndarray, entries: np.ndarray, size: int) -> bool:
    most = max(max((abs(int(v)) for v in (x.min(), x.max())), default=0) for x in (points, entries) if x.size)
    return 4 * size * size * most * most < 2**63


def assigned(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest of ``entries`` (entry, place) for each of ``points`` (row, place)."""
    size = 1 << max(0, (points.shape[1] - 1).bit_length())
    if not points.size:
        return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    if not _fits(points, entries, size):
        points, entries = points.astype(object), entries.astype(object)
    index, scaled = nearest(transformed(points), transformed(entries))
    return index, scaled // size


class Books:
    """The codebooks of each vector length: (part, entry, place) arrays of Python or 64-bit integers."""

    def __init__(self, books: dict[int, np.ndarray], parts: int, scale: int):
        self.books, self.parts, self.scale = books, parts, scale

    def cut(self, raw: np.ndarray) -> np.ndarray:
        """(row, part, place): scaled rows cut into equal parts, padded with zeros at the end where they do not divide."""
        width = -(-raw.shape[1] // self.parts)
        whole = np.zeros((len(raw), self.parts * width), raw.dtype)
        whole[:, : raw.shape[1]] = raw
        return integers(whole, self.scale).reshape(len(raw), self.parts, width)

    def sha256(self, length: int) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.books[length].ravel().tolist()).encode()).hexdigest()


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(slice, length, rows, vectors): the vectors of one length in a slice of the batch."""
    for at in range(0, len(batch), SLICE):
        part = batch.slice(at, SLICE)
        column = part.column("embedding")
        lengths = np.asarray(column.value_lengths()).astype(np.int64)
        flat = np.asarray(column.flatten()).astype(np.float64)
        starts = np.cumsum(lengths) - lengths
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            yield part, length, rows, flat[starts[rows][:, None] + np.arange(length)]


def _sums(vectors: DataFrame, books: Books) -> DataFrame:
    """(length, part, entry, place, rows, total): what each task's parts add to their entries, then summed over tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {n: np.zeros(b.shape, object) for n, b in books.books.items()}
        counts = {n: np.zeros(b.shape[:2], np.int64) for n, b in books.books.items()}
        for batch in batches:
            for _, length, _, raw in _slices(batch):
                cut, book = books.cut(raw), books.books[length]
                for p in range(books.parts):
                    index, _ = assigned(cut[:, p], book[p])
                    order = np.argsort(index, kind="stable")
                    used, at = np.unique(index[order], return_index=True)
                    counts[length][p] += np.bincount(index, minlength=book.shape[1])
                    if cut.shape[2]:
                        values = cut[order, p]
                        small = values.dtype != object and int(np.abs(values).max()) < 2**48
                        totals[length][p, used] += np.add.reduceat(values if small else values.astype(object), at, axis=0).astype(object)
        for length, total in totals.items():
            keys = np.argwhere(np.broadcast_to(counts[length][:, :, None] > 0, total.shape))
            if len(keys):
                found = [int(total[tuple(k)]) for k in keys.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(keys), length, np.int32)),
                        *[pa.array(keys[:, k].astype(np.int32)) for k in range(3)],
                        pa.array(counts[length][keys[:, 0], keys[:, 1]]),
                        pa.array([Decimal(v) for v in found], pa.decimal128(38, 0)),
                    ],
                    names=["length", "part", "entry", "place", "rows", "total"],
                )

    shape = "length int, part int, entry int, place int, rows long, total decimal(38,0)"
    return vectors.select("embedding").mapInArrow(add, shape).groupBy("length", "part", "entry", "place").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))


def first_books(vectors: DataFrame, id_column: str, *, parts: int, entries: int, scale: int) -> Books:
    """Codebooks that hold the parts of the ``entries`` vectors with the smallest ids, for each vector length."""
    lengths = [r[0] for r in vectors.groupBy(F.size("embedding").alias("n")).count().orderBy("n").limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} vector lengths")
    books = Books({}, parts, scale)
    for length in lengths:
        chosen = vectors.filter(F.size("embedding") == length).orderBy(F.col(id_column).asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
        raw = np.array([r[0] for r in chosen], np.float64).reshape(len(chosen), length)
        books.books[length] = books.cut(raw).transpose(1, 0, 2)
    return books


def trained(vectors: DataFrame, id_column: str, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Books:
    """Codebooks after ``rounds`` rounds of assigning all parts and moving each used entry to the floor of their mean.

    A round that moves nothing ends the training: all later ones would move nothing either. The driver gets one row for each
    component of the codebooks, whatever the number of vectors.
    """
    books = first_books(vectors, id_column, parts=parts, entries=entries, scale=scale)
    for _ in range(rounds):
        moved = {n: b.copy() for n, b in books.books.items()}
        for r in _sums(vectors, books).collect():
            value = int(r["total"]) // r["rows"]
            if abs(value) >= 2**62 and moved[r["length"]].dtype != object:
                moved[r["length"]] = moved[r["length"]].astype(object)
            moved[r["length"]][r["part"], r["entry"], r["place"]] = value
        still = all((moved[n] == b).all() for n, b in books.books.items())
        books = Books(moved, parts, scale)
        if still:
            break
    return books


def encoded(vectors: DataFrame, books: Books, *, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns of every vector with ``code``, ``error`` (null beyond 64 bits) and ``codebooks_sha256``."""
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    digests = {n: books.sha256(n) for n in books.books}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, length, rows, raw in _slices(batch):
                cut, book = books.cut(raw), books.books[length]
                found = [assigned(cut[:, p], book[p]) for p in range(books.parts)]
                index = np.stack([f[0] for f in found], axis=1)
                error = sum(f[1].astype(object) for f in found)
                codes = [bytes(r).hex() for r in index.astype(np.uint8)]
                kept = [part.column(c).take(pa.array(rows)) for c in keep]
                errors = pa.array([int(e) if e < 2**63 else None for e in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*kept, pa.array(codes), errors, pa.array([digests[length]] * len(rows))], names=[*keep, "code", "error", "codebooks_sha256"])

    return vectors.select(*keep, "embedding").mapInArrow(encode, f"{kinds}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, *, id_column: str = "vec_id", group_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, group, code, error, group's error as label_error, codebooks_sha256) of every sound row of ``vectors``.

    ``vectors`` needs the id, the group and ``embedding``, an array of floating-point numbers; other columns are ignored,
    whatever their names. Rows whose vector is null, or holds a null or non-finite component, are dropped. Repeated rows
    and ids count as rows of their own; a starting entry is taken from the smallest ids, null ids last, and among equal
    ids from the smallest vector. With fewer rows than ``entries`` (at most 256) a codebook is as small. Equal entries are
    allowed: the lower one gets all parts and the others stay. Vectors of different lengths have codebooks of their own; a
    length that ``parts`` does not divide is padded with zeros at the end, and an empty vector has the code 00... and the
    error 0. Rows with a null group are one group. A sum or an error beyond 64 bits is null; components of 2**80/scale or
    more are refused with an error. An empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    vectors = vectors.select(F.col(id_column).alias("id"), F.col(group_column).alias("grp"), "embedding").filter(sound)
    books = trained(vectors, "id", parts=parts, entries=entries, rounds=rounds, scale=scale)
    codes = written(encoded(vectors, books, keep=("id", "grp")), "codes")
    sums = written(codes.groupBy("grp").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")), "code-errors")
    sums = small_side(sums.select(F.col("grp").alias("other"), F.expr("try_cast(total as long)").alias("label_error")))
    out = codes.join(sums, F.col("grp").eqNullSafe(F.col("other")), "left")
    return out.select(F.col("id").alias(id_column), F.col("grp").alias(group_column), "code", "error", "label_error", "codebooks_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all embeddings as eight indexes into codebooks of sixteen entries."""
    out = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
