"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how widely each pair is linked.

Both tokenizations of a text are cut into groups where tokens of both end at the same byte; tokens that share a group are
linked. How many documents hold an id pair linked is counted outside memory:

1. A task collects the (pair, document) records of a bounded number of tokens, sorts them and radix-partitions them by the
   first side's id into zstd runs: per run and radix the distinct pairs with their number of documents, and the records.
2. Only the pairs' part of the runs is shuffled, by radix. A heap over the runs' blocks merges them, FAN runs at a time, in as
   many rounds as it takes; a radix is thus never read by one task unless it is already summed up. The last merge is in
   side-major order, so the largest count of an id of the first side is known when its pairs have passed.
3. The records meet their radix's counts, RUNS_PER_TASK runs a task, each task with its own copy of the counts, so a pair that
   a third of all documents hold is dealt out like any other; what each record adds to its document is summed per run,
   and streams back to the run's documents.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.packing import Encoder
from tidewater.llm.storage import discard, written
from tidewater.llm.tasks import whole_groups
from tidewater.llm.textkit import pieces as parts

#: Radix partitions (a power of two); tokens of both sides in a run; entries of a zstd block; runs that one merge takes;
#: runs whose records one task looks up.
RADIX_BITS, RUN_TOKENS, BLOCK, FAN, RUNS_PER_TASK = 6, 1 << 20, 1 << 16, 64, 1024
#: Groups of at most so many links are paired token by token, larger ones by their distinct ids.
SMALL_GROUP = 64


class FirstSide(Encoder):
    """Ids of space and text by the byte-level vocabulary, with its special strings taken as ordinary text."""

    def __init__(self, path: str, ranks_path: str | None = None):
        super().__init__(path, ranks_path)
        self.slow.encode_special_tokens = True
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that byte-level pieces show as themselves
        value = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocabulary = self.slow.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(value[c] for c in piece) if all(c in value for c in piece) else piece.encode()

    def _encode(self, text: str) -> np.ndarray:
        if self.fast is not None and self.plain.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.int64)


class SecondSide:
    """Ids of a text by the piece vocabulary, which puts a space before it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]

    def __call__(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text), np.int64)


def zipped(*columns: np.ndarray) -> list[bytes]:
    """Equally long integer columns as zstd blocks; bytes of equal weight lie together."""
    press, out = zstandard.ZstdCompressor(level=1), []
    for at in range(0, len(columns[0]), BLOCK):
        planes = [np.ascontiguousarray(c[at : at + BLOCK], np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
        out.append(press.compress(b"".join(planes)))
    return out


def unzipped(block: bytes, columns: int) -> list[np.ndarray]:
    """The columns of one block."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).reshape(-1).view(np.int64) for c in raw]


def whole(blocks: list[bytes], columns: int) -> list[np.ndarray]:
    """The columns of all blocks."""
    found = [unzipped(b, columns) for b in blocks]
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * columns


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts, at)


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ascending (keys, sums) of many runs of ascending keys and counts, block by block.

    The heap holds each run's open block by its last key. All entries up to the least of these are complete: every run's
    part of them is open. One block of each run is in memory.
    """
    waiting = [iter(r) for r in runs]
    open_blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def load(k: int) -> None:
        block = next(waiting[k], None)
        if block is None:
            open_blocks.pop(k, None)
        else:
            open_blocks[k] = tuple(unzipped(block, 2))
            heapq.heappush(heap, (int(open_blocks[k][0][-1]), k))

    for k in range(len(runs)):
        load(k)
    while heap:
        bound = heap[0][0]
        keys, counts = [], []
        for k, (key, count) in open_blocks.items():
            cut = int(np.searchsorted(key, bound, "right"))
            if cut:
                keys.append(key[:cut])
                counts.append(count[:cut])
                open_blocks[k] = key[cut:], count[cut:]
        while heap and heap[0][0] <= bound:
            load(heapq.heappop(heap)[1])
        yield summed(np.concatenate(keys), np.concatenate(counts))


def with_maxima(blocks: Iterator[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ascending blocks of (pairs, counts) with whether the count is the largest of the pair's first side, which is what is left
    of a pair without its last ``bits``. Pairs of a first side that goes on in the next block wait for it."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def flagged(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = pairs >> bits
        at = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        most = np.maximum.reduceat(counts, at)
        return pairs, counts, counts == np.repeat(most, np.diff(np.r_[at, len(pairs)]))

    for pairs, counts in blocks:
        pairs, counts = np.concatenate((held[0], pairs)), np.concatenate((held[1], counts))
        cut = int(np.searchsorted(pairs, (pairs[-1] >> bits) << bits))
        if cut:
            yield flagged(pairs[:cut], counts[:cut])
        held = pairs[cut:], counts[cut:]
    if len(held[0]):
        yield flagged(*held)


class Aligner:
    """Both tokenizers, and the groups and pairs of many texts at once."""

    def __init__(self, a_path: str, a_ranks_path: str | None, b_path: str):
        self.a, self.b = FirstSide(a_path, a_ranks_path), SecondSide(b_path)
        self.a_length, self.b_length = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        self.b_bits = (len(self.b.bytes) - 1).bit_length()
        self.a_bits = max((len(self.a.bytes) - 1).bit_length(), RADIX_BITS)
        shown = [f"{i}{end}" for n, ends in ((len(self.a.bytes), ",|"), (len(self.b.bytes), ",;")) for i in range(n) for end in ends]
        self.shown = [s.encode() for s in shown]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both sides; none for null and empty texts and for those that a side does not give back byte by byte."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        wanted, a = (" " + text).encode(), self.a(" " + text)
        if b"".join(map(self.a.bytes.__getitem__, a.tolist())) != wanted:
            return none, none
        b = self.b(text)
        return (a, b) if b"".join(map(self.b.bytes.__getitem__, b.tolist())) == wanted else (none, none)

    def run(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        """Per text n_a, n_b, n_groups, n_links and the groups' digest; then the distinct (pair, text) records: pairs
        ascending within a radix, texts ascending within a pair, and how many links each record stands for."""
        n_a, n_b = (np.array([len(t[side]) for t in texts], np.int64) for side in (0, 1))
        a, b = (np.concatenate([t[side] for t in texts]) for side in (0, 1))
        n_groups, n_links = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if not len(a):
            none = np.zeros(0, np.int64)
            return (n_a, n_b, n_groups, n_links, [""] * len(texts)), (none, none, none)
        # All texts' bytes in a row: as both sides cover the same bytes, each text's end is a common end.
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        a_cut = b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end
        b_cut = a_end[np.minimum(np.searchsorted(a_end, b_end), len(a_end) - 1)] == b_end
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        a_count, b_count = np.bincount(a_group), np.bincount(b_group)
        text_of = np.repeat(np.arange(len(texts)), n_a)[np.flatnonzero(a_cut)]
        np.add.at(n_groups, text_of, 1)
        np.add.at(n_links, text_of, a_count * b_count)
        a_start, b_start = np.cumsum(a_count) - a_count, np.cumsum(b_count) - b_count

        # Tokens of both sides in the order in which the groups are written, each with what follows it.
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + b_start[a_group]] = 2 * a + np.r_[a_group[1:] != a_group[:-1], True]
        code[np.arange(len(b)) + (a_start + a_count)[b_group]] = 2 * (len(self.a.bytes) + b) + np.r_[b_group[1:] != b_group[:-1], True]
        digests, end = [], 0
        for n in (n_a + n_b).tolist():
            said = b"".join(map(self.shown.__getitem__, code[end : end + n].tolist()))[:-1]
            digests.append(hashlib.sha256(said).hexdigest() if n else "")
            end += n

        links = a_count * b_count
        small = links[a_group] <= SMALL_GROUP
        times = np.where(small, b_count[a_group], 0)
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(b_start[a_group], times)
        slot_bits = max(1, (len(texts) - 1).bit_length())
        key = (self.pair(np.repeat(a, times), b[place]) << slot_bits) | np.repeat(text_of[a_group], times)
        key, weight = np.unique(key, return_counts=True)
        more = []
        for g in np.flatnonzero(links > SMALL_GROUP).tolist():
            ids_a, times_a = np.unique(a[a_start[g] : a_start[g] + a_count[g]], return_counts=True)
            ids_b, times_b = np.unique(b[b_start[g] : b_start[g] + b_count[g]], return_counts=True)
            pairs = self.pair(np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a)))
            more.append(((pairs << slot_bits) | text_of[g], np.outer(times_a, times_b).ravel()))
        if more:
            key, weight = summed(np.concatenate([key, *[m[0] for m in more]]), np.concatenate([weight, *[m[1] for m in more]]))
        return (n_a, n_b, n_groups, n_links, digests), (key >> slot_bits, key & ((1 << slot_bits) - 1), weight)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pair as a number: the radix (the last bits of a), the rest of a, b."""
        high = self.a_bits - RADIX_BITS
        return ((((a & ((1 << RADIX_BITS) - 1)) << high) | (a >> RADIX_BITS)) << self.b_bits) | b

    def radix(self, pair: np.ndarray) -> np.ndarray:
        return pair >> (self.a_bits - RADIX_BITS + self.b_bits)


DIGESTS = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = pa.list_(pa.binary())


def runs(docs: DataFrame, *, a_path: str, a_ranks_path: str | None, b_path: str) -> DataFrame:
    """Rows of two kinds: a document of a run (radix -1), and a run's records of one radix (keys: pairs and their numbers
    of documents; records: document slots and links)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["run", "radix", "slot", "doc_id", *DIGESTS, "groups_sha256", "keys", "records"]

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, run, held, ids, tokens = Aligner(a_path, a_ranks_path, b_path), TaskContext.get().partitionId() << 32, [], [], 0

        def ended() -> Iterator[pa.RecordBatch]:
            n = len(held)
            (*numbers, digests), (pair, slot, weight) = aligner.run(held)
            doc_ids = pa.chunked_array(ids).combine_chunks()
            fixed = [pa.array(np.full(n, run)), pa.array(np.full(n, -1, np.int32)), pa.array(np.arange(n, dtype=np.int32)), doc_ids, *map(pa.array, numbers), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*fixed, pa.nulls(n, BLOCKS), pa.nulls(n, BLOCKS)], names=names)
            radix = aligner.radix(pair)
            at = np.flatnonzero(np.r_[True, radix[1:] != radix[:-1]]) if len(pair) else np.zeros(0, np.int64)
            for begin, end in zip(at.tolist(), [*at.tolist()[1:], len(pair)], strict=False):
                own, count = np.unique(pair[begin:end], return_counts=True)
                row = [pa.array([run]), pa.array([int(radix[begin])], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, doc_ids.type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())]
                blocks = [pa.array([zipped(*c)], BLOCKS) for c in ((own, count), (slot[begin:end], weight[begin:end]))]
                yield pa.RecordBatch.from_arrays([*row, *blocks], names=names)

        for batch in batches:
            for part in parts(batch, "text", 1 << 20):
                for row, text in enumerate(part.column("text")):
                    held.append(aligner.tokens(text.as_py()))
                    ids.append(part.column("doc_id").slice(row, 1))
                    tokens += len(held[-1][0]) + len(held[-1][1])
                    if tokens >= RUN_TOKENS:
                        yield from ended()
                        run, held, ids, tokens = run + 1, [], [], 0
        if held:
            yield from ended()

    numbers = ", ".join(f"{c} long" for c in DIGESTS)
    return docs.select("doc_id", "text").mapInArrow(spill, f"run long, radix int, slot int, doc_id {kind}, {numbers}, groups_sha256 string, keys array<binary>, records array<binary>")


def merge_round(keys: DataFrame, groups: int, b_bits: int | None) -> DataFrame:
    """(run, radix, keys) with all runs of a radix and group merged into one; with ``b_bits`` the last round, whose blocks
    carry a third column, whether the count is the largest of its first side."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ("radix", "grp")):
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = table.slice(begin, end - begin)
                found = merged(part.column("keys").to_pylist())
                blocks = [z for c in (found if b_bits is None else with_maxima(found, b_bits)) for z in zipped(*c)]
                yield pa.RecordBatch.from_arrays([pa.array([part.column("grp")[0].as_py()]), pa.array([part.column("radix")[0].as_py()], pa.int32()), pa.array([blocks], BLOCKS)], names=["run", "radix", "keys"])

    dealt = keys.withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(groups))).repartition("radix", "grp").sortWithinPartitions("radix", "grp")
    return dealt.mapInArrow(merge, "run long, radix int, keys array<binary>")


def counted(keys: DataFrame, b_bits: int) -> DataFrame:
    """One row per radix: all its pairs with the documents that hold them, merged in rounds of FAN runs."""
    most = keys.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    stored = None
    while True:
        groups = math.ceil(most / FAN)
        last = groups <= 1
        older, stored = stored, written(merge_round(keys if stored is None else stored, max(groups, 1), b_bits if last else None), "pair-counts")
        if older is not None:
            discard(older)
        if last:
            return stored
        most = groups


def added(records: DataFrame, counts: DataFrame, salts: int) -> DataFrame:
    """(run, radix, adds): per run and radix what its records add to the run's documents (slots, best links, counts)."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs, number, best = None, None, None, None
        for batch in batches:
            for row in range(len(batch)):
                key = (batch.column("radix")[row].as_py(), batch.column("salt")[row].as_py())
                blocks = batch.column("keys")[row].as_py()
                if batch.column("run")[row].as_py() is None:  # the counts come before the runs that need them
                    known, (pairs, number, best) = key, whole(blocks, 3)
                    continue
                if key != known:
                    raise ValueError("records without counts")
                own, times = whole(blocks, 2)
                slot, links = whole(batch.column("records")[row].as_py(), 2)
                at = np.repeat(np.searchsorted(pairs, own), times)
                slots, back = np.unique(slot, return_inverse=True)
                sums = np.zeros((2, len(slots)), np.int64)
                np.add.at(sums[0], back, links * best[at])
                np.add.at(sums[1], back, links * number[at])
                yield pa.RecordBatch.from_arrays([batch.column("run").slice(row, 1), batch.column("radix").slice(row, 1), pa.array([zipped(slots, *sums)], BLOCKS)], names=["run", "radix", "adds"])

    salted = records.select("run", "radix", F.pmod(F.xxhash64("run", F.lit("records")), F.lit(salts)).cast("int").alias("salt"), "keys", "records")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    copied = counts.select(F.lit(None).cast("long").alias("run"), "radix", copies.alias("salt"), "keys", F.lit(None).cast("array<binary>").alias("records"))
    dealt = salted.unionByName(copied).repartition("radix", "salt").sortWithinPartitions(F.col("radix"), F.col("salt"), F.col("run").asc_nulls_first())
    return dealt.mapInArrow(look_up, "run long, radix int, adds array<binary>")


def assembled(documents: DataFrame, adds: DataFrame) -> DataFrame:
    """The documents of each run with the sums of all radixes."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *DIGESTS, "n_best", "count_sum", "groups_sha256"]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ("run",)):
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = table.slice(begin, end - begin)
                n = int((np.asarray(part.column("radix")) < 0).sum())
                sums = np.zeros((2, n), np.int64)
                for blocks in part.column("adds").slice(n).to_pylist():
                    slots, *more = whole(blocks, 3)
                    sums[:, slots] += more
                rows = part.slice(0, n).combine_chunks()
                columns = [rows.column(c) for c in ("doc_id", *DIGESTS)] + [pa.chunked_array([pa.array(s)]) for s in sums] + [rows.column("groups_sha256")]
                yield from pa.table(columns, names=names).to_batches()

    documents = documents.select("run", "radix", "slot", "doc_id", *DIGESTS, "groups_sha256", F.lit(None).cast("array<binary>").alias("adds"))
    both = documents.unionByName(adds, allowMissingColumns=True).repartition("run").sortWithinPartitions("run", "radix", "slot")
    numbers = ", ".join(f"{c} long" for c in (*DIGESTS, "n_best", "count_sum"))
    return both.mapInArrow(assemble, f"doc_id {kind}, {numbers}, groups_sha256 string")


def align(docs: DataFrame, *, a_path: str, a_ranks_path: str | None, b_path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored, whatever their names) its tokens on both sides, groups,
    links, links whose pair is the most widely linked of its first id, the sum of the links' pair counts, and the digest of
    its groups.

    Null and empty texts, and texts that a side does not give back byte by byte, have no tokens: zeros and an empty digest.
    Null ids are ids like others, and repeated rows are documents of their own, each counted. An empty table gives no rows.
    In a task's memory are the tokens and pairs of one run, which a very long text, never cut, makes as large as its own.
    """
    stored = written(runs(docs, a_path=a_path, a_ranks_path=a_ranks_path, b_path=b_path), "alignment-runs")
    records = stored.filter("radix >= 0")
    counts = counted(records.select("run", "radix", "keys"), Aligner(a_path, a_ranks_path, b_path).b_bits)
    most = records.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    adds = added(records.select("run", "radix", "keys", "records"), counts, max(1, math.ceil(most / RUNS_PER_TASK)))
    return assembled(stored.filter("radix < 0"), adds)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: all documents by the public byte-level and piece vocabularies."""
    import public_tokenizers

    path, docs = public_tokenizers.path, spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, a_path=path("byte_bpe_50k.json"), a_ranks_path=path("byte_bpe_50k.tiktoken"), b_path=path("piece_bpe_32k.model"))
