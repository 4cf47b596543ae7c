"""N-gram Jaccard join: parity sketches, pigeonholed per size band, and exact verification.

A document is the set of its distinct word shingles. Its parity sketch has, for each size band, D + 1 + s blocks of 64
bits; a shingle flips bits of one block only, those of its hash (XOR). Sets that are similar enough differ in at most D
shingles of the band, so in at most D blocks: the number of blocks that differ is at most the symmetric difference. At
least s + 1 blocks are equal, and equal blocks that hold a shingle are the join keys (the pigeonhole join); a set with
more than s empty blocks has its empty ones refined, so that no pair goes without a key. Whole blocks are the pigeonholes,
rather than runs of a sketch in which each shingle flips a single bit, because a run with one to four shingles has at
most 6 to 19 bits of information and would meet unrelated documents. The one-bit sketch (SKETCH_BITS) serves what it is
good for: its Hamming distance, again at most the symmetric difference, rejects what has met; what passes is verified on
the sets themselves. No link is lost and none is made up.

At lower thresholds a block holds one or two shingles, and every shared passage would be a key. There the keys are
single shingles, the rarest of each set that a link cannot all do without, of sets that share enough to link at all.

Rows, not ids, are what links: each row gets a number when it is stored, so null and repeated doc_ids do no harm. Equal
sets are one representative from the start. First, each key's most popular member (the one with most shared keys) is
verified against the others, which joins a group of near copies in one pass; only keys whose members are then in
different components are compared in full, by sketches inside tasks, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.storage import discard, small_side, written
from tidewater.llm.tasks import whole_groups
from tidewater.llm.textkit import mix64, pieces, shingle_sets

BAND_GROWTH = 1.6
#: Percent of similarity under which keys are rare shingles instead of blocks.
SEGMENTS_FROM = 85
SKETCH_BITS = 1024
BLOCK = 2048
_U = np.uint64


class Bands:
    """Size bands for a threshold of ``percent``: bounds, and per band the most shingles in which a pair can differ."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        first = next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1))
        bounds = [first]
        while bounds[-1] <= largest:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * BAND_GROWTH)))
        self.bounds = np.array(bounds, np.int64)
        most = (100 - percent) * (self.bounds[1:] - 1) // percent
        self.slack = np.array([self._spare(int(d), int(n)) for d, n in zip(most, self.bounds[:-1], strict=True)], np.int64)
        self.segments = most + 1 + self.slack

    @staticmethod
    def _spare(most: int, smallest: int) -> int:
        """Segments to spare so that a set of the band's smallest size seldom leaves more than these empty."""
        spare = most // 10 + 2
        while True:
            empty = (most + 1 + spare) * math.exp(-smallest / (most + 1 + spare))
            if spare >= empty + 2 * math.sqrt(empty) or spare > most:
                return spare
            spare += 1 + spare // 20

    def roles(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, bands) at home, and as guests one band lower where a smaller set there could be similar enough.

        Sets below the first bound can only equal each other, so they have no band.
        """
        home = np.searchsorted(self.bounds, sizes, "right") - 1
        rows = np.flatnonzero(home >= 0)
        guests = rows[(home[rows] > 0) & (self.percent * sizes[rows] <= 100 * (self.bounds[home[rows]] - 1))]
        return [(rows, home[rows]), (guests, home[guests] - 1)]


def _segments(values: np.ndarray, group: np.ndarray, total: int) -> np.ndarray:
    """XOR of the values of each group, 0 for a group without values; ``group`` does not fall."""
    acc = np.zeros(total, np.uint64)
    if len(values):
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        acc[group[starts]] = np.bitwise_xor.reduceat(values, starts)
    return acc


def _role_keys(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray, bands: np.ndarray, sized: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Segment keys of the given rows in the given bands, and the row of each key."""
    m = sized.segments[bands]
    sizes = offsets[rows + 1] - offsets[rows]
    base = np.cumsum(m) - m
    places = np.arange(int(sizes.sum())) + np.repeat(offsets[rows] - (np.cumsum(sizes) - sizes), sizes)
    v, per = values[places], np.repeat(np.arange(len(rows)), sizes)
    width = m[per].astype(np.uint64)
    # Values are sorted within a row, so the segment of their upper half does not fall.
    group = base[per] + ((v >> _U(32)) * width >> _U(32)).astype(np.int64)
    total = int(m.sum())
    acc = _segments(mix64(v), group, total)
    owner = np.repeat(np.arange(len(rows)), m)
    number = np.arange(total) - base[owner]
    tag = mix64((bands[owner].astype(np.uint64) << _U(40)) + number.astype(np.uint64) + _U(1))
    filled = np.bincount(group, minlength=total) > 0
    keys, of = [mix64(acc[filled] ^ tag[filled])], [rows[owner[filled]]]
    empty = np.flatnonzero(~filled)
    many = np.bincount(owner[empty], minlength=len(rows)) > sized.slack[bands]
    empty = empty[many[owner[empty]]]
    if len(empty):
        # Too many to rely on the others: each empty segment is refined by the same pigeonhole on the lower half of the
        # hashes.
        holders = np.unique(owner[empty])
        chosen = np.isin(per, holders)
        low = base[per[chosen]] + ((v[chosen] & _U(0xFFFFFFFF)) * width[chosen] >> _U(32)).astype(np.int64)
        order = np.argsort(low, kind="stable")
        second = _segments(mix64(v[chosen][order]), low[order], total)
        times = m[owner[empty]]
        which = np.repeat(empty, times)
        inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        keys.append(mix64(second[base[owner[which]] + inner] ^ mix64(tag[which] + (inner.astype(np.uint64) << _U(20)) + _U(7))))
        of.append(rows[owner[which]])
    return np.concatenate(keys), np.concatenate(of)


def described(rows: DataFrame, *, width: int, percent: int) -> DataFrame:
    """(row, doc_id, n, h1, h2, keys, sketch) of every row; ``keys`` are its blocks in its bands, if those are used."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                values, offsets = shingle_sets(part.column("text"), width)
                sizes = np.diff(offsets)
                row = np.repeat(np.arange(len(sizes)), sizes)
                keys, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if percent >= SEGMENTS_FROM:
                    bands = Bands(percent, int(sizes.max(initial=0)))
                    keys, of = zip(*[_role_keys(values, offsets, r, b, bands) for r, b in bands.roles(sizes)], strict=True)
                    keys, of = np.concatenate(keys), np.concatenate(of)
                order = np.argsort(of, kind="stable")
                where = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(sizes))))).astype(np.int32)
                bits = np.bincount(row * SKETCH_BITS + (mix64(values ^ _U(0x5851F42D4C957F2D)) & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=len(sizes) * SKETCH_BITS) & 1
                sketch = np.packbits(bits.astype(np.uint8).reshape(len(sizes), SKETCH_BITS), axis=1)
                whole = [np.zeros(len(sizes), np.uint64) for _ in range(2)]
                some = np.flatnonzero(sizes)
                if len(values):
                    for k, salt in enumerate((0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)):
                        whole[k][some] = np.add.reduceat(mix64(values ^ _U(salt)), offsets[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        *[pa.array(w.view(np.int64), pa.int64()) for w in whole],
                        pa.ListArray.from_arrays(pa.array(where), pa.array(keys[order].view(np.int64), pa.int64())),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    names=["row", "doc_id", "n", "h1", "h2", "keys", "sketch"],
                )

    return rows.select("row", "doc_id", "text").mapInArrow(describe, "row long, doc_id long, n long, h1 long, h2 long, keys array<long>, sketch binary")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (key, doc) whose key has two rows at least, found in one sorted pass that holds no group in memory."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (key, doc, already given out)
        for batch in batches:
            if not len(batch):
                continue
            key, doc = (np.asarray(batch.column(c)) for c in ("key", "doc"))
            if last is not None:
                key, doc = np.r_[last[0], key], np.r_[last[1], doc]
            same = key[1:] == key[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            given = last is not None and last[2]
            if given:
                keep[0] = False
            last = (key[-1], doc[-1], bool(keep[-1]) or (given and len(key) == 1))
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(doc[keep])], names=["key", "doc"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(runs, "key long, doc long")


def _shingle_rows(texts: DataFrame, ids: DataFrame, *, width: int, percent: int, every: bool) -> DataFrame:
    """(key, doc): all shingles of the rows in ``ids`` that can link, or of each set of n the n - o + n // 4 with the
    smallest hashes, where o is the least that a link shares."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                values, offsets = shingle_sets(part.column("text"), width)
                sizes = np.diff(offsets)
                take = sizes if every else sizes - (percent * sizes + 99) // 100 + np.maximum(sizes // 4, 1)
                take = np.where(100 * sizes >= percent * (sizes + 1), take, 0)
                places = np.arange(int(take.sum())) + np.repeat(offsets[:-1] - (np.cumsum(take) - take), take)
                doc = np.repeat(np.asarray(part.column("doc"), dtype=np.int64), take)
                yield pa.RecordBatch.from_arrays([pa.array(values[places].view(np.int64)), pa.array(doc)], names=["key", "doc"])

    return texts.select(F.col("row").alias("doc"), "text").join(small_side(ids).select("doc"), "doc", "left_semi").mapInArrow(emit, "key long, doc long")


def _rare_keys(texts: DataFrame, reps: DataFrame, *, width: int, percent: int) -> DataFrame:
    """(key, doc) such that documents that link share a key, which is a shingle.

    Sets of n and m that link share o(n) = ceil(percent * n / 100) shingles at least, and as many as o(m). In any common
    order of the shingles the first k common ones are among the first n - o(n) + k of the one and m - o(m) + k of the
    other. By hash, with k a quarter of the size: a set whose part holds fewer shingles of other sets than a quarter of
    its smallest partner links with nothing. Of the rest, by the number of sets that hold a shingle, with k = 1: shingles
    without a second set come first and are no keys.
    """
    sizes = written(reps.select("doc", "n", F.expr(f"({percent} * n + 99) div 100").alias("o")), "sizes")
    met = _shared(_shingle_rows(texts, sizes, width=width, percent=percent, every=False)).groupBy("doc").agg(F.count("*").alias("met"))
    able = written(met.join(sizes, "doc").filter("met >= greatest(o div 4, 1)").select("doc", "o"), "able-to-link")
    discard(sizes)
    rows = written(_shingle_rows(texts, able, width=width, percent=percent, every=True), "shingles")
    times = rows.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    own = Window.partitionBy("doc")
    ranked = rows.join(times, "key").withColumn("rank", F.row_number().over(own.orderBy("times", "key"))).withColumn("rows", F.count("*").over(own))
    keys = written(ranked.join(small_side(able), "doc").filter("rank <= rows - o + 1").select("key", "doc"), "rare-keys")
    discard(rows, able)
    return keys


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of sketches, row by row or of many to one."""
    return np.bitwise_count(x ^ y).sum(-1)


def _allowed(pairs: DataFrame, reps: DataFrame, *, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    one = reps.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = reps.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(na), -1) for c in ("sa", "sb"))
            fine = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (_apart(x, y) <= (100 - percent) * (na + nb) // (100 + percent))
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    return pairs.join(two, "b").join(one, "a").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(allow, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, *, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets, made again from the texts of these rows, are similar enough."""
    involved = written(pairs.select(F.col("a").alias("row")).unionAll(pairs.select("b")).distinct(), "involved")
    texts = texts.select("row", "text").join(small_side(involved), "row", "left_semi")
    second = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b")
    both = second.join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "tb"):
                left, first = _distinct_texts(part.column("ta"), width)
                right, offsets = shingle_sets(part.column("tb"), width)
                size_a, size_b = np.diff(first)[left[0]], np.diff(offsets)
                value_a, total = left[1], len(size_b)
                places = np.arange(int(size_a.sum())) + np.repeat(first[left[0]] - (np.cumsum(size_a) - size_a), size_a)
                value = np.concatenate((value_a[places], right))
                owner = np.concatenate((np.repeat(np.arange(total), size_a), np.repeat(np.arange(total), size_b)))
                order = np.lexsort((value, owner))
                value, owner = value[order], owner[order]
                same = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
                common = np.bincount(owner[1:][same], minlength=total)
                fine = (100 * common >= percent * (size_a + size_b - common)) & (size_a > 0) & (size_b > 0)
                yield part.select(["a", "b"]).filter(pa.array(fine))

    links = written(both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"), "links")
    discard(involved)
    return links


def _distinct_texts(column: pa.Array, width: int):
    """Sets of a column in which a text often repeats: ((text number of each row, values), offsets by text number)."""
    coded = column.dictionary_encode()
    values, offsets = shingle_sets(coded.dictionary, width)
    return (np.asarray(coded.indices, dtype=np.int64), values), offsets


def _near(rows: DataFrame, *, percent: int) -> DataFrame:
    """Pairs (a, b) in different components that meet in a block of a key and whose sketches allow a link.

    ``rows``: key, b1, b2 (the block pair), side (which of the two), doc, comp, n, sketch. A block pair has at most
    twice BLOCK rows, so a task holds a bounded group.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ("key", "b1", "b2")):
            yield _block_pairs(table, bounds, percent)

    return rows.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2").mapInArrow(compare, "a long, b long")


def _block_pairs(table: pa.Table, bounds: np.ndarray, percent: int) -> pa.RecordBatch:
    doc, comp, n, side, b1, b2 = (np.asarray(table.column(c)) for c in ("doc", "comp", "n", "side", "b1", "b2"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(doc), -1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        group = np.arange(begin, end)
        one, two = (group[side[group] == 0], group[side[group] == 1]) if b1[begin] != b2[begin] else (group, group)
        for i in one.tolist():
            others = two[two > i] if one is two else two
            others = others[(comp[others] != comp[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
            if len(others):
                apart = _apart(sketch[others], sketch[i])
                others = others[apart <= (100 - percent) * (n[others] + n[i]) // (100 + percent)]
                if len(others):
                    found.append((np.full(len(others), doc[i]), doc[others]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])


def _linked(docs: DataFrame, *, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The stored rows (docs with a number, ``row``) and (row, doc_id, n, component): the smallest number among the rows
    that links reach."""
    given = written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered-rows")
    texts = given.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = written(described(texts, width=width, percent=percent), "keyed-sets")
    sets = written(full.select("row", "doc_id", "n", "h1", "h2"), "sets")
    groups = full.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min(F.struct("row", "keys", "sketch")).alias("r"))
    keyed = written(groups.select("n", "h1", "h2", F.col("r.row").alias("doc"), F.col("r.keys").alias("keys"), F.col("r.sketch").alias("sketch")), "keyed-representatives")
    discard(full)
    reps = written(keyed.drop("keys"), "representatives")
    keys = keyed.select(F.explode("keys").alias("key"), "doc") if percent >= SEGMENTS_FROM else _rare_keys(texts, reps, width=width, percent=percent)
    shared = written(_shared(keys), "shared-keys")
    discard(keyed, keys)

    # A key that a third of all sets hold is one row here: its aggregate is joined back, which adaptive execution splits.
    popular = written(shared.groupBy("doc").agg(F.count("*").alias("keys_shared")), "popular")
    centres = shared.join(small_side(popular), "doc").groupBy("key").agg(F.min(F.struct(-F.col("keys_shared"), "doc")).alias("c")).select("key", F.col("c.doc").alias("centre"))
    centred = shared.join(centres, "key").filter("centre <> doc")
    pairs = written(centred.select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct(), "centre-pairs")
    close = written(_allowed(pairs, reps, percent=percent), "close-pairs")
    links = verified(close, texts, width=width, percent=percent)
    discard(close)
    labels = written(components(links), "centre-components")

    placed = shared.join(small_side(labels).withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("rows")).filter("least <> most")
    open_keys = written(open_keys.select("key", "rows"), "open-keys")
    unsettled = placed.join(small_side(open_keys), "key").join(reps.select("doc", "n", "sketch"), "doc")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    spread = unsettled.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc", "comp", "n", "sketch")
    more = _near(spread, percent=percent).distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(more.join(done, ["a", "b"], "left_anti"), "sketch-pairs")
    discard(shared, pairs, popular, open_keys)
    late = verified(rest, texts, width=width, percent=percent)
    final = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(late))
    discard(rest)

    named = reps.select("n", "h1", "h2", "doc").join(final.withColumnRenamed("node", "doc"), "doc", "left")
    named = named.select("n", "h1", "h2", F.coalesce("component", "doc").alias("component"))
    out = sets.join(named, ["n", "h1", "h2"], "left")
    return given, out.select("row", "doc_id", "n", F.coalesce("component", "row").alias("component"))


def join(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``, which needs doc_id (an integer) and text.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D; a document with fewer than ``width``
    words is one shingle of them all. Two rows link when 100 * intersection >= percent * union; component_id is the
    smallest doc_id of the rows that links reach, null if none of them has one. Without words (null, empty, blank) a row
    links with nothing, not even its like. Rows that share a doc_id are rows of their own: they are in one component if
    their texts link. Repeated rows link with each other. An empty table gives no rows. Other columns are not read.
    """
    _, linked = _linked(docs.select("doc_id", "text"), width=width, percent=percent)
    linked = written(linked, "linked-rows")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return linked.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group that links connect: that with the smallest doc_id, null ones last, and of
    several such rows one. Rows without words all stay. Other columns are kept, with whatever names but ``row``."""
    given, linked = _linked(docs, width=width, percent=percent)
    linked = written(linked, "linked-rows")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("f"), F.count("*").alias("rows"))
    repeated = written(first.filter("rows > 1").select("component", F.col("f.row").alias("kept")), "repeated-components")
    dropped = written(linked.join(small_side(repeated), "component").filter("row <> kept").select("row"), "dropped-rows")
    return given.join(small_side(dropped), "row", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents by 4-word shingles at a similarity of 0.85."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)
