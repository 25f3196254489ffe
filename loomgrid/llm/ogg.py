"""Media columns in the Ogg container: pages with checksums, packets by lacing values, multiplexed logical streams.

``mux`` and ``demux`` work on any packets.  The payload columns put a text's bytes into two interleaved logical streams of
8-bit samples: block i of the payload goes to stream i modulo 2, one packet a block, and a page's granule position counts the
samples that its stream has finished.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import common

RATE = 8000
BLOCK = 4096
STREAMS = 2
_MAGIC = b"8BITPCM\x01"
_NONE = (1 << 64) - 1
_FLIP = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def checksum(data: bytes) -> int:
    """The container's CRC-32: polynomial 0x04C11DB7, not reflected, no initial or final inversion.

    It is the reflected CRC of the bytes with their bits reversed, started at zero, with its own bits reversed.
    """
    x = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_FLIP), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream from (packet, granule position at its end); the first packet has a page of its own.

    A packet longer than a page's 255 segments continues on the next page, which then carries the continuation flag; a page
    on which no packet ends has the granule position of all ones.
    """
    pages: list[list] = []
    lacing, body, granule, going_on = bytearray(), bytearray(), _NONE, False

    def flush(next_goes_on: bool) -> None:
        nonlocal lacing, body, granule, going_on
        if lacing:
            pages.append([int(going_on), granule, bytes(lacing), bytes(body)])
            lacing, body, granule, going_on = bytearray(), bytearray(), _NONE, next_goes_on

    for i, (packet, at) in enumerate(packets):
        values, done = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255]), 0
        while values:
            part = values[: 255 - len(lacing)]
            take = sum(part)
            lacing += part
            body += packet[done : done + take]
            done, values = done + take, values[len(part) :]
            if not values:
                granule = at
            if len(lacing) == 255 or i == 0 and not values:
                flush(bool(values))
    flush(False)
    return [page(serial, n, flag | 2 * (n == 0) | 4 * (n == len(pages) - 1), at, laces, data) for n, (flag, at, laces, data) in enumerate(pages)]


def mux(streams: list[tuple[int, list[tuple[bytes, int]]]]) -> bytes:
    """One physical stream: all first pages, then the others in turn."""
    paged = [pages_of(serial, packets) for serial, packets in streams]
    return b"".join(p[i] for i in range(max(map(len, paged), default=0)) for p in paged if i < len(p))


def demux(data: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Each logical stream's packets with the granule position of the page that ends them, null but for the last to end there.

    Raises ValueError for a wrong capture pattern, checksum or page number, a missing begin or end, a broken continuation.
    """
    found: dict[int, list[tuple[bytes, int | None]]] = {}
    parts: dict[int, bytearray] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError("a page is cut short")
        magic, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBQIIIB", data, at)
        if magic != b"OggS" or version:
            raise ValueError("no page starts here")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError("a page is cut short")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError("wrong page checksum")
        if number != numbers.get(serial, 0) or bool(flags & 2) != (number == 0) or serial in ended:
            raise ValueError("a page is missing or out of order")
        if bool(flags & 1) != (serial in parts):
            raise ValueError("broken continuation")
        numbers[serial] = number + 1
        packets, where, last = found.setdefault(serial, []), at + 27 + n, None
        part = parts.pop(serial, bytearray())
        open_part = bool(flags & 1)
        for value in lacing:
            part += data[where : where + value]
            where, open_part = where + value, True
            if value < 255:
                last = len(packets)
                packets.append((bytes(part), None))
                part, open_part = bytearray(), False
        if last is not None:
            packets[last] = (packets[last][0], granule)
        if open_part:
            parts[serial] = part
        if flags & 4:
            ended.add(serial)
        at = end
    if parts or ended != set(found):
        raise ValueError("a stream has no end")
    return found


def store(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as a two-stream file; serial numbers come from the payload, so that equal payloads give equal files."""
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    streams = []
    for k in range(STREAMS):
        packets, done = [(_MAGIC + struct.pack("<IIQ", rate, k, len(payload)), 0)], 0
        for start in range(k * BLOCK, len(payload), STREAMS * BLOCK):
            block = payload[start : start + BLOCK]
            done += len(block)
            packets.append((block, done))
        streams.append((serial + k, packets))
    return mux(streams)


def load(media: bytes) -> tuple[bytes, int, list[tuple[int, int, float]]]:
    """(payload, sample rate, (stream, packets, seconds) for each) of a file of ``store``, all checks made."""
    streams = {}
    for packets in demux(media).values():
        head = packets[0][0]
        if head[:8] != _MAGIC:
            raise ValueError("unknown stream header")
        rate, k, total = struct.unpack("<IIQ", head[8:24])
        samples = packets[-1][1] or 0
        if samples != sum(len(x) for x, _ in packets[1:]):
            raise ValueError("granule position and samples differ")
        streams[k] = ([x for x, _ in packets[1:]], rate, total, samples)
    if sorted(streams) != list(range(STREAMS)):
        raise ValueError("a stream is missing")
    blocks = [streams[i % STREAMS][0][i // STREAMS] for i in range(sum(len(s[0]) for s in streams.values()))]
    payload, (_, rate, total, _) = b"".join(blocks), streams[0]
    if len(payload) != total:
        raise ValueError("payload is cut short")
    return payload, rate, [(k, len(s[0]), s[3] / rate) for k, s in sorted(streams.items())]


def payload_of(text: bytes, unit: int = 64) -> bytes:
    """The text and zero bytes up to a positive multiple of ``unit``."""
    return text + bytes(-len(text) % unit or (unit if not text else 0))


def packets(df: DataFrame, media: str = "media") -> DataFrame:
    """A row for each packet of each file of the binary column: df's other columns, then serial, packet, granule, data.

    ``granule`` is the position at the packet's end where the file gives it, else null; a null file gives no row; a broken one
    fails the query with what is wrong with it.
    """
    kept = [c for c in df.columns if c not in (media, "serial", "packet", "granule", "data")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, media):
            at, rows = [], []
            for i, x in enumerate(batch.column(media).to_pylist()):
                if x is not None:
                    for serial, found in demux(x).items():
                        for n, (data, granule) in enumerate(found):
                            at.append(i)
                            rows.append((serial, n, granule, data))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in kept), *columns], names=[*kept, "serial", "packet", "granule", "data"])

    schema = df.select(*kept, F.lit(0).cast("long").alias("serial"), F.lit(0).alias("packet"), F.lit(None).cast("long").alias("granule"), F.lit(None).cast("binary").alias("data")).schema
    return df.mapInArrow(run, schema)


def add_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with the column ``media``: the text's padded bytes as a file; a null text counts as empty.  A column of that name is replaced."""
    kept = [c for c in df.columns if c != media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            out = pa.array([store(payload_of(x)) for x in common.encoded(batch.column(text))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=[*kept, media])

    return df.mapInArrow(run, df.select(*kept, F.lit(None).cast("binary").alias(media)).schema)


def media_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each row.

    Each text is stored, the stored bytes are read back with all checks, and the payload's columns come from what was read.
    The feature names the streams' packets and seconds and the loudness of the samples around their middle value.  Null and
    empty texts have 64 zero bytes; equal texts give equal values.
    """
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def features(payload: bytes, rate: int, streams: list[tuple[int, int, float]]) -> str:
        import numpy as np

        samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
        loud = int((samples * samples).sum()) // len(samples)
        return f"rate={rate};" + ";".join(f"stream{k}={n}p,{s:.6f}s" for k, n, s in streams) + f";power={loud}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            rows = []
            for x in common.encoded(batch.column(text)):
                media = store(payload_of(x))
                payload, rate, streams = load(media)
                rows.append((len(x), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, rate, streams)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    rows = df.select(key, text)
    long, string = F.lit(0).cast("long"), F.lit("")
    schema = rows.select(key, *(x.alias(n) for n, x in zip(names[1:], (long, long, string, long, long, string, string), strict=True))).schema
    return rows.mapInArrow(run, schema)
