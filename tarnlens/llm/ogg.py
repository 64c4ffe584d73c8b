"""Ogg as a column: byte payloads stored as 8-bit samples in Ogg pages, and read back.

Method: the reader finds pages by their capture pattern, verifies each page's checksum, demultiplexes logical streams by
serial number, reassembles packets from lacing values across pages, and derives timestamps from granule positions.
The writer lays down two logical streams: samples (one packet per frame of FRAME samples, granule position = samples
so far) and facts (one packet with the number of payload bytes before padding).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FRAME = 576
RATE = 8000
PAD = b"\xff"
SAMPLES, FACTS = 1, 2
HEAD = b"PCM8    " + struct.pack("<II", RATE, FRAME)
FACT_HEAD = b"FACTS   "
BOS, EOS, CONTINUED = 2, 4, 1
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, zero at both ends.

    zlib's runs over reflected bits; reversing the bits of each byte and of the register makes it this one.
    """
    register = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    page = bytearray(head + body)
    page[22:26] = page_checksum(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def _stream(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of (packet, granule position at its end); the first packet has a page of its own."""
    yield _page(serial, 0, BOS, 0, _lacing(len(packets[0][0])), packets[0][0])
    segments = [(size, n) for n, (p, _) in enumerate(packets[1:], 1) for size in _lacing(len(p))]
    body = b"".join(p for p, _ in packets[1:])
    at = 0
    for page, first in enumerate(range(0, len(segments), 255), 1):
        mine = segments[first : first + 255]
        lacing = bytes(s for s, _ in mine)
        ended = [n for s, n in mine if s < 255]
        flags = (CONTINUED if first and segments[first - 1][0] == 255 else 0) | (EOS if first + 255 >= len(segments) else 0)
        size = sum(lacing)
        yield _page(serial, page, flags, packets[ended[-1]][1] if ended else -1, lacing, body[at : at + size])
        at += size


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def pad(data: bytes) -> bytes:
    return data + PAD * ((-len(data)) % FRAME if data else FRAME)


def mux(data: bytes) -> bytes:
    """The stored form of some bytes; equal bytes have equal forms."""
    payload = pad(data)
    frames = [(payload[i : i + FRAME], i + FRAME) for i in range(0, len(payload), FRAME)]
    one = _stream(SAMPLES, [(HEAD, 0), *frames])
    two = _stream(FACTS, [(FACT_HEAD, 0), (struct.pack("<Q", len(data)), len(payload))])
    # first pages of all streams come before any other page
    first = [next(one), next(two)]
    return b"".join([*first, next(one), *two, *one])


class Stream(NamedTuple):
    packets: list[bytes]
    granules: list[int]
    """The granule position of the page on which each packet ends, if it is the last to end there, else -1."""
    pages: int
    ended: bool


def demux(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; raises OggError for a wrong checksum, a gap, or a packet that isn't whole."""
    found: dict[int, list] = {}
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) < at + 27:
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, checksum, count = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if version or len(lacing) < count or end > len(media):
            raise OggError(f"page at byte {at} isn't whole")
        page = media[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            raise OggError(f"wrong checksum at byte {at}")
        if bool(flags & BOS) == (serial in found):
            raise OggError(f"stream {serial} has no single first page")
        packets, granules, partial, pages, ended = found.setdefault(serial, [[], [], [], 0, False])
        if sequence != pages or ended or bool(flags & CONTINUED) != bool(partial):
            raise OggError(f"stream {serial} has a gap at page {sequence}")
        place, size = at + 27 + count, 0
        for n in lacing:
            size += n
            if n < 255:
                piece = media[place : place + size]
                packets.append(b"".join([*partial, piece]) if partial else piece)
                granules.append(-1)
                partial.clear()
                place += size
                size = 0
        if size or (lacing and lacing[-1] == 255):
            partial.append(media[place : place + size])
        if granule >= 0 and granules:
            granules[-1] = granule
        found[serial][3:] = [pages + 1, bool(flags & EOS)]
        at = end
    if any(partial for _, _, partial, _, _ in found.values()):
        raise OggError("a packet isn't whole")
    return {k: Stream(p, g, n, e) for k, (p, g, _, n, e) in found.items()}


def packet_times(stream: Stream, rate: int = RATE, frame: int = FRAME) -> list[float]:
    """Seconds at each packet's end, its header aside: pages state some, frames between them count back from there."""
    ends = list(stream.granules)
    for i in range(len(ends) - 2, 0, -1):
        if ends[i] < 0:
            ends[i] = ends[i + 1] - frame
    return [e / rate for e in ends[1:]]


def read(media: bytes) -> tuple[bytes, int, str]:
    """The payload, the bytes of it before padding, and its features."""
    streams = demux(media)
    samples, facts = streams.get(SAMPLES), streams.get(FACTS)
    if samples is None or facts is None or samples.packets[0] != HEAD or facts.packets[0] != FACT_HEAD:
        raise OggError("not made by mux()")
    payload = b"".join(samples.packets[1:])
    (size,) = struct.unpack("<Q", facts.packets[1])
    times = packet_times(samples)
    x = np.frombuffer(payload, np.uint8)
    wave = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero((wave[1:] >= 0) != (wave[:-1] >= 0)))
    power = int(np.dot(wave.astype(np.int64), wave.astype(np.int64)))
    pages = sum(s.pages for s in streams.values())
    feature = f"streams={len(streams)};pages={pages};packets={len(samples.packets) - 1};seconds={times[-1]:.3f};mean={int(x.sum(dtype=np.int64)) / len(x):.4f};power={power / len(x):.3f};peak={int(np.abs(wave).max())};crossings={crossings}"
    return payload, size, feature


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([mux(common.utf8(t)) for t in b.column("text").to_pylist()], pa.binary())], names=["id", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    for b in batches:
        rows = []
        for media in b.column("media").to_pylist():
            if media is None:
                rows.append((None,) * 8)
                continue
            stored = (len(media), hashlib.sha256(media).hexdigest())
            try:
                payload, size, feature = read(media)
                rows.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, feature, None))
            except OggError as e:
                rows.append((None, None, None, None, *stored, None, str(e)))
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["id", *names])


def pack_ogg(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, media): each text's UTF-8 bytes, padded with byte 255 to a positive multiple of FRAME, as Ogg.

    Null and empty texts are one frame of padding. One row per input row; ids may be null or repeat; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    return common.arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _pack, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def read_ogg(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the stored bytes hold: sizes, digests, features; a damaged file has its error named and no payload, null media only nulls."""
    kind = dict(media.dtypes)[id_col]
    rows = common.arrow_map(media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")), _read, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string")
    return rows.withColumnRenamed("id", id_col)


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ogg(pack_ogg(common.table(spark, sf_dir, "documents"))).drop("error")
