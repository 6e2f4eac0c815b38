"""Media columns: payloads in MPEG transport streams.

A payload is an elementary stream cut into access units of 576 bytes, GROUP of them to
a PES packet with a presentation time. PES packets are dealt over 188-byte transport
packets; a program association and a program map table stand before each random-access
point. The table holds each stream with an index of its presentation times and random-access
points. Reading parses the tables (with their CRC), follows the program to its
elementary stream, checks continuity counters, reassembles the PES packets and takes
their times and random-access points, which have to be those of the index. Packets are numpy rows, so Python runs per
document and packet size, not per packet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meridia.llm.common import documents

UNIT, GROUP, PACKET = 576, 16, 188
PAT_PID, PMT_PID, MEDIA_PID, PROGRAM, STREAM_TYPE = 0x0000, 0x0100, 0x0101, 1, 0x06
#: Clock ticks (90 kHz) from one PES packet to the next, and PES packets from one random-access point to the next.
TICKS, RANDOM_EVERY = 3600, 8


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables: not reflected, no final inversion."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _table_packet(pid: int, table_id: int, number: int, body: bytes) -> np.ndarray:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    section = head + body
    section += section_crc(section).to_bytes(4, "big")
    packet = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


_TABLES = np.stack(
    [
        _table_packet(PAT_PID, 0x00, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])),
        _table_packet(PMT_PID, 0x02, PROGRAM, bytes([0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0])),
    ]
)


def _times(pts: np.ndarray) -> np.ndarray:
    """The five bytes of each 33-bit presentation time."""
    p = pts.astype(np.int64)
    return np.stack([0x21 | (p >> 30 & 7) << 1, p >> 22 & 0xFF, 1 | (p >> 15 & 0x7F) << 1, p >> 7 & 0xFF, 1 | (p & 0x7F) << 1], axis=1).astype(np.uint8)


def _packets(data: np.ndarray, first: int) -> np.ndarray:
    """Transport packets (PES packets, packets, 188) of equally long access groups, numbered from `first`; continuity counters are still zero."""
    m, size = data.shape
    number = np.arange(first, first + m)
    pes = np.empty((m, size + 14), np.uint8)
    pes[:, :9] = np.array([0, 0, 1, 0xBD, (size + 8) >> 8, (size + 8) & 0xFF, 0x84, 0x80, 5], np.uint8)
    pes[:, 9:14] = _times(number * TICKS % (1 << 33))
    pes[:, 14:] = data
    size += 14
    head = PACKET - 4 - 8  # the first packet has flags and a clock reference
    more = max(0, -(-(size - head) // 184))
    out = np.full((m, 1 + more, PACKET), 0xFF, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2], out[:, :, 3] = 0x47, MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0x10
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] = 0x30
    short = max(0, head - size)  # stuffing of a packet that isn't filled
    out[:, 0, 4] = 7 + short
    out[:, 0, 5] = np.where(number % RANDOM_EVERY == 0, 0x50, 0x10)
    clock = number.astype(np.int64) * TICKS % (1 << 33)
    out[:, 0, 6:12] = np.stack([clock >> 25, clock >> 17, clock >> 9, clock >> 1, (clock & 1) << 7 | 0x7E, clock * 0], axis=1).astype(np.uint8)
    out[:, 0, 12 + short :] = pes[:, : head - short]
    full = max(0, (size - head) // 184)
    out[:, 1 : 1 + full, 4:] = pes[:, head : head + 184 * full].reshape(m, full, 184)
    if rest := size - head - 184 * full if more > full else 0:
        out[:, -1, 3] = 0x30
        out[:, -1, 4] = 183 - rest
        if rest < 183:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - rest :] = pes[:, size - rest :]
    return out


def pack(payload: bytes) -> bytes:
    """The transport stream of a payload, whose length is a positive multiple of UNIT."""
    data = np.frombuffer(payload, np.uint8)
    size = UNIT * GROUP
    n = len(data) // size
    parts = []
    if n:
        parts.append(_packets(data[: n * size].reshape(n, size), 0))
    if len(data) > n * size:
        parts.append(_packets(data[n * size :].reshape(1, -1), n))
    media = np.concatenate([p.reshape(-1, PACKET) for p in parts])
    media[:, 3] |= (np.arange(len(media)) & 15).astype(np.uint8)
    per = parts[0].shape[1]
    at = np.arange(0, len(media), per * RANDOM_EVERY)
    tables = np.tile(_TABLES, (len(at), 1))
    tables[:, 3] |= np.repeat(np.arange(len(at)) & 15, 2).astype(np.uint8)
    return np.insert(media, np.repeat(at, 2), tables, axis=0).tobytes()


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes
    program: int
    pid: int
    stream_type: int
    packets: int
    discontinuities: int
    times: np.ndarray
    random_access: np.ndarray


def _section(packet: np.ndarray, table_id: int) -> bytes:
    start = 5 + int(packet[4])
    size = 3 + (int(packet[start + 1]) & 0x0F) * 256 + int(packet[start + 2])
    section = packet[start : start + size].tobytes()
    if section[0] != table_id or section_crc(section):
        raise ValueError("a program table is damaged")
    return section


def unpack(stream: bytes) -> Stream:
    """Read a transport stream of one program."""
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != 0x47).any():
        raise ValueError("a packet without its sync byte")
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    begins = (rows[:, 1] & 0x40) > 0
    table = _section(rows[np.flatnonzero((pid == PAT_PID) & begins)[0]], 0x00)
    program, map_pid = int.from_bytes(table[8:10], "big"), int.from_bytes(table[10:12], "big") & 0x1FFF
    table = _section(rows[np.flatnonzero((pid == map_pid) & begins)[0]], 0x02)
    at = 12 + (int.from_bytes(table[10:12], "big") & 0x0FFF)
    kind, media_pid = table[at], int.from_bytes(table[at + 1 : at + 3], "big") & 0x1FFF
    broken = 0
    for p in (PAT_PID, map_pid, media_pid):
        counters = rows[pid == p, 3] & 15
        broken += int((np.diff(counters.astype(np.int16)) % 16 != 1).sum())
    rows, begins = rows[pid == media_pid], begins[pid == media_pid]
    adapted = (rows[:, 3] & 0x20) > 0
    offset = np.where(adapted, 5 + rows[:, 4].astype(np.int32), 4)
    flagged = adapted & (rows[:, 4] > 0) & ((rows[:, 5] & 0x40) > 0)
    body = rows[np.arange(PACKET)[None, :] >= offset[:, None]]
    length = PACKET - offset
    starts = (np.cumsum(length) - length)[begins]
    if not len(starts) or (body[starts] | body[starts + 1]).any() or (body[starts + 2] != 1).any():
        raise ValueError("a PES packet without its start code")
    t = body[starts[:, None] + np.arange(9, 14)[None, :]].astype(np.int64)
    times = (t[:, 0] >> 1 & 7) << 30 | t[:, 1] << 22 | (t[:, 2] >> 1) << 15 | t[:, 3] << 7 | t[:, 4] >> 1
    heads = 9 + body[starts + 8].astype(np.int64)
    stated = (body[starts + 4].astype(np.int64) << 8 | body[starts + 5]) + 6
    if (np.diff(np.append(starts, len(body))) != stated).any():
        raise ValueError("a PES packet of another length than it states")
    parts = [body[s + h : s + n] for s, h, n in zip(starts, heads, stated, strict=True)]
    return Stream(b"".join(p.tobytes() for p in parts), program, media_pid, kind, len(rows), broken, times, times[flagged[begins]])


def pad(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\xff")


def feature(s: Stream) -> str:
    return f"program={s.program};pid={s.pid};type={s.stream_type};packets={s.packets};discontinuities={s.discontinuities};pes={len(s.times)};first={s.times[0]};last={s.times[-1]};random_access={len(s.random_access)}"


def index(payload_bytes: int) -> tuple[list[int], list[int]]:
    """Presentation times of a payload's PES packets, and of those at random-access points."""
    times = (np.arange(-(-payload_bytes // (UNIT * GROUP)), dtype=np.int64) * TICKS % (1 << 33)).tolist()
    return times, times[::RANDOM_EVERY]


def _writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        start, size, rows = 0, 0, []
        for i, t in enumerate(texts):
            text = t.as_py()
            payload = pad(text)
            rows.append((len(text), pack(payload), *index(len(payload))))
            size += len(rows[-1][1])
            if size > 8 << 20 or i + 1 == len(texts):
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), longs, longs), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(rows)), *cols], ["doc_id", "n_bytes", "media", "times", "random_access"])
                start, size, rows = i + 1, 0, []


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for m, times, points in zip(batch.column("media"), batch.column("times").to_pylist(), batch.column("random_access").to_pylist(), strict=True):
            media = m.as_py()
            s = unpack(media)
            if s.times.tolist() != times or s.random_access.tolist() != points:
                raise ValueError("a stream whose times are not those of its index")
            out.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), times, points))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *cols], [c.split()[0] for c in READ.split(", ")])


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<long>, random_access array<long>"


def write_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), media (the transport stream of each text), and its index: times and random_access.

    Null texts count as empty, a null doc_id stays null, each of repeated rows is taken by itself, other columns
    aren't looked at, an empty table gives no rows.
    """
    return documents(docs, id_col, text_col).mapInArrow(_writer, "doc_id long, n_bytes long, media binary, times array<long>, random_access array<long>")


def read_streams(media: DataFrame) -> DataFrame:
    """The columns READ of write_streams()'s rows, from the stored bytes alone; the index is checked against them.

    A damaged or null stream, or one with another index, is an error; rows that repeat are read each, an empty table gives no rows.
    """
    return media.select("doc_id", "n_bytes", "media", "times", "random_access").mapInArrow(_reader, READ)
