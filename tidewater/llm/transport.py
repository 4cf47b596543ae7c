"""Media columns: MPEG transport streams.

A payload is stored as access units, each a PES packet with a presentation time, in 188-byte transport packets with
continuity counters; program tables (PAT, PMT) come first and again before each random-access point. Reading parses the
tables to find the stream, checks the counters, reassembles the elementary packets and gives their times.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.textkit import pieces

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
UNIT_BYTES, TICKS_PER_UNIT, UNITS_PER_GROUP = 16384, 3600, 8


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2, which ends every table section."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    data = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return data + section_crc(data).to_bytes(4, "big")


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


_PAT = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
_TABLES = [_table_packet(0, k, _PAT) + _table_packet(PMT_PID, k, _PMT) for k in range(16)]
_PLAIN = [bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x10 | k]) for k in range(16)]


def _time(mark: int, ticks: int) -> bytes:
    return bytes([mark << 4 | (ticks >> 29 & 14) | 1, ticks >> 22 & 255, (ticks >> 14 & 254) | 1, ticks >> 7 & 255, (ticks << 1 & 254) | 1])


def multiplex(payload: bytes, *, unit_bytes: int = UNIT_BYTES) -> bytes:
    """The payload as a transport stream; an empty payload gives the program tables alone."""
    out, counter, tables = [], 0, 0
    for unit, begin in enumerate(range(0, max(len(payload), 1), unit_bytes)):
        random_access = unit % UNITS_PER_GROUP == 0
        if random_access:
            out.append(_TABLES[tables & 15])
            tables += 1
        data = payload[begin : begin + unit_bytes]
        if not data:
            break
        ticks = unit * TICKS_PER_UNIT & 0x1FFFFFFFF
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(2, ticks) + data
        clock = (ticks << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4 - 8
        stuffing = max(0, room - len(pes))
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter, 7 + stuffing, 0x50 if random_access else 0x10]) + clock + b"\xff" * stuffing + pes[:room])
        counter = counter + 1 & 15
        whole = room + (max(0, len(pes) - room) // (PACKET - 4)) * (PACKET - 4)
        for at in range(room, whole, PACKET - 4):
            out.append(_PLAIN[counter])
            out.append(pes[at : at + PACKET - 4])
            counter = counter + 1 & 15
        if whole < len(pes):
            rest = pes[whole:]
            gap = PACKET - 4 - len(rest)
            fill = bytes([gap - 1]) + (b"\x00" + b"\xff" * (gap - 2) if gap > 1 else b"")
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter]) + fill + rest)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds: per elementary packet its time, whether it is a random-access point, its data."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    errors: int = 0
    times: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    units: list[bytes] = field(default_factory=list)


def demultiplex(media: bytes) -> Stream:
    """Parse a transport stream. ``errors`` counts lost sync, continuity breaks, bad sections and bad PES lengths."""
    found, last, parts = Stream(), {}, []

    def unit_done() -> None:
        if not parts:
            return
        pes = b"".join(parts)
        parts.clear()
        size = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or size and size + 6 != len(pes):
            found.errors += 1
            found.times.pop()
            found.random_access.pop()
            return
        t = pes[9:14]
        found.times[-1] = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1 if pes[7] & 0x80 else -1
        found.units.append(pes[9 + pes[8] :])

    for at in range(0, len(media), PACKET):
        found.packets += 1
        sync, high, low, control = media[at], media[at + 1], media[at + 2], media[at + 3]
        if sync != SYNC or at + PACKET > len(media):
            found.errors += 1
            continue
        pid = (high & 31) << 8 | low
        if not control & 0x10:
            continue
        if pid in last and (last[pid] + 1 & 15) != control & 15:
            found.errors += 1
        last[pid] = control & 15
        begin, flags = at + 4, 0
        if control & 0x20:
            size = media[begin]
            flags = media[begin + 1] if size else 0
            begin += 1 + size
        if pid in found.streams:
            if high & 0x40:
                unit_done()
                found.times.append(-1)
                found.random_access.append(bool(flags & 0x40))
            parts.append(media[begin : at + PACKET])
        elif pid == 0 or pid in found.programs.values():
            begin += 1 + media[begin]
            section = media[begin : begin + 3 + (int.from_bytes(media[begin + 1 : begin + 3], "big") & 0xFFF)]
            if section_crc(section):
                found.errors += 1
            elif pid == 0:
                for k in range(8, len(section) - 4, 4):
                    found.programs[int.from_bytes(section[k : k + 2], "big")] = int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
            else:
                k = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
                while k < len(section) - 4:
                    found.streams[int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF] = section[k]
                    k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0xFFF)
    unit_done()
    return found


def stored(frame: DataFrame, *, id_column: str, text_column: str, multiple: int = 64) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, zero bytes up to a positive multiple, as a transport stream.

    Null counts as empty. Equal texts give equal media, repeated rows too; an empty table gives no rows; other columns
    are not read. Batches are cut by bytes, so many long texts do not meet in one Arrow column.
    """
    kind = frame.schema[id_column].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_column, 1 << 24):
                raw = [(t.as_py() or "").encode() for t in part.column(1)]
                media = [multiplex(r + bytes(-len(r) % multiple if r else multiple)) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=[id_column, "n_bytes", "media"])

    return frame.select(id_column, text_column).mapInArrow(write, f"{id_column} {kind}, n_bytes long, media binary")


def units(media: DataFrame, *, id_column: str) -> DataFrame:
    """One row per elementary packet of each ``media``: number, time, random_access and data."""
    kind = media.schema[id_column].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_column, "number", "time", "random_access", "data"]
        for batch in batches:
            for row in range(len(batch)):
                s = demultiplex(batch.column("media")[row].as_py() or b"")
                n = len(s.units)
                yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array([row] * n, pa.int64())), pa.array(range(n), pa.int64()), pa.array(s.times, pa.int64()), pa.array(s.random_access, pa.bool_()), pa.array(s.units, pa.binary())], names=names)

    return media.select(id_column, "media").mapInArrow(read, f"{id_column} {kind}, number long, time long, random_access boolean, data binary")


def features(media: DataFrame, *, id_column: str) -> DataFrame:
    """Digests and features of what is read back from ``media`` (null: no stream). Equal media give equal rows, repeated
    rows too; an empty table gives no rows; columns but the id, n_bytes and media are not read."""
    kind = media.schema[id_column].dataType.simpleString()
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access_points"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "media", 1 << 24):
                rows = []
                for value in part.column("media"):
                    raw = value.as_py() or b""
                    s = demultiplex(raw)
                    payload = b"".join(s.units)
                    points = [i for i, x in enumerate(s.random_access) if x]
                    program = ",".join(f"{p}:{q:#06x}" for p, q in sorted(s.programs.items()))
                    kinds = ",".join(f"{p:#06x}/{q:#04x}" for p, q in sorted(s.streams.items()))
                    feature = f"packets={s.packets};programs={program};streams={kinds};errors={s.errors};units={len(s.units)};first={min(s.times, default=-1)};last={max(s.times, default=-1)};rap={len(points)}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, s.times, points))
                kinds_ = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds_, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(id_column), part.column("n_bytes"), *columns], names=names)

    schema = f"{id_column} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access_points array<long>"
    return media.select(id_column, "n_bytes", "media").mapInArrow(read, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document's text as a transport stream, read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return features(stored(docs, id_column="doc_id", text_column="text"), id_column="doc_id")
