"""Pictures: sizes from headers as column expressions, PNG to pixel rows and back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
MAX_PIXELS = 50_000_000


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, photo_id) of the files below a path; the id is the content's hash."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("photo_id"))


def _number(content: Column, at: int, n: int, little: bool = False) -> Column:
    """An unsigned number of ``n`` bytes from the zero-based place."""
    part = F.hex(F.substring(content, at + 1, n))
    text = F.concat(*(F.substring(part, 2 * i + 1, 2) for i in range(n)[::-1])) if little else part
    return F.conv(text, 16, 10).cast("long")


def _starts(content: Column, at: int, text: bytes) -> Column:
    return F.substring(content, at + 1, len(text)) == F.lit(bytearray(text))


def header(content: Column) -> Column:
    """A struct of format, width and height by the first bytes: png, gif, bmp or webp; null for anything else.

    JPEG and AVIF keep their size behind a chain of segments, which ``headers`` follows.
    """
    n = lambda at, size, little=True: _number(content, at, size, little)

    def found(name: str, width: Column, height: Column) -> Column:
        return F.struct(F.lit(name).alias("format"), width.cast("int").alias("width"), height.cast("int").alias("height"))

    signed = lambda v: F.abs(F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v))
    bits = n(21, 4)
    long_enough = lambda size: F.octet_length(content) >= size
    webp = _starts(content, 0, b"RIFF") & _starts(content, 8, b"WEBP")
    return (
        F.when(_starts(content, 0, PNG_MAGIC) & _starts(content, 12, b"IHDR") & long_enough(24), found("png", n(16, 4, False), n(20, 4, False)))
        .when((_starts(content, 0, b"GIF87a") | _starts(content, 0, b"GIF89a")) & long_enough(10), found("gif", n(6, 2), n(8, 2)))
        .when(_starts(content, 0, b"BM") & long_enough(26) & (n(14, 4) == 12), found("bmp", n(18, 2), n(20, 2)))
        .when(_starts(content, 0, b"BM") & long_enough(26), found("bmp", signed(n(18, 4)), signed(n(22, 4))))
        .when(webp & _starts(content, 12, b"VP8X") & long_enough(30), found("webp", n(24, 3) + 1, n(27, 3) + 1))
        .when(webp & _starts(content, 12, b"VP8L") & long_enough(25), found("webp", bits.bitwiseAND(F.lit(0x3FFF)) + 1, F.shiftright(bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1))
        .when(webp & _starts(content, 12, b"VP8 ") & long_enough(30), found("webp", n(26, 2).bitwiseAND(F.lit(0x3FFF)), n(28, 2).bitwiseAND(F.lit(0x3FFF))))
    )


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of the first frame header, its segments followed by their lengths."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 1 or 0xD0 <= marker <= 0xD7:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        else:
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


def avif_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of the first image spatial extent of an AVIF file."""
    if data[4:8] != b"ftyp" or b"avi" not in data[8 : 8 + max(0, struct.unpack_from(">I", data)[0] - 8)]:
        return None
    at = data.find(b"ispe")
    return struct.unpack_from(">II", data, at + 8) if 0 < at and at + 16 <= len(data) else None


def headers(images: DataFrame, content: str = "content") -> DataFrame:
    """``images`` with ``format``, ``width`` and ``height``, null where the header is none that is known."""
    told = images.withColumn("_h", header(F.col(content)))

    def rest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch:
                data = bytes(data or b"")
                size, name = jpeg_size(data), "jpeg"
                if size is None and len(data) > 8:
                    size, name = avif_size(data), "avif"
                rows.append((name, *size) if size else (None, None, None))
            yield pd.DataFrame(rows, columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    follow = F.pandas_udf(rest, "format string, width int, height int")
    known = F.coalesce(F.col("_h"), F.when(_starts(F.col(content), 0, b"\xff\xd8") | _starts(F.col(content), 4, b"ftyp"), follow(F.substring(F.col(content), 1, 1 << 20))))
    return told.withColumn("_h", known).select(*images.columns, "_h.format", "_h.width", "_h.height")


# ---------------------------------------------------------------- PNG


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def encode_png(rgba: np.ndarray) -> bytes:
    """An (h, w, 4) byte array as a PNG; each row takes whichever of no filter or the one to the left leaves the smaller sum."""
    h, w, _ = rgba.shape
    raw = rgba.astype(np.uint8).reshape(h, w * 4)
    left = raw.copy()
    left[:, 4:] -= raw[:, :-4]
    cost = lambda a: np.abs(a.view(np.int8).astype(int)).sum(axis=1)
    use = cost(left) < cost(raw)
    rows = np.concatenate([use[:, None].astype(np.uint8), np.where(use[:, None], left, raw)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def write_png(pixel_rows: DataFrame, key: str = "photo_id") -> DataFrame:
    """(key, png): each picture's pixels (y, x, r, g, b, a) as a PNG; a place without a row is clear."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1, 4), np.uint8)
        out[rows["y"], rows["x"]] = rows[list("rgba")].to_numpy()
        return pd.DataFrame({key: [rows[key].iloc[0]], "png": [encode_png(out)]})

    return pixel_rows.select(key, "y", "x", *"rgba").groupBy(key).applyInPandas(run, f"{key} {dict(pixel_rows.dtypes)[key]}, png binary")


def decode_png(data: bytes) -> np.ndarray:
    """An (h, w, 4) array of an 8-bit, not interlaced PNG; raises ValueError for any other or a broken one."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("no PNG")
    at, parts, head, table, clear = 8, [], None, None, b""
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("wrong checksum")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            table = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            parts.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[0] * head[1] > MAX_PIXELS:
        raise ValueError("unsupported PNG")
    w, h, kind = head[0], head[1], head[3]
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w, n), np.uint8)
    above = np.zeros((w, n), np.int64)
    for y in range(h):
        line, mode = rows[y, 1:].reshape(w, n).astype(np.int64), rows[y, 0]
        if mode == 1:
            line = np.cumsum(line, axis=0)
        elif mode == 2:
            line = line + above
        elif mode in (3, 4):
            before, corner = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in range(w):
                if mode == 3:
                    guess = (before + above[x]) // 2
                else:
                    p = before + above[x] - corner
                    da, db, dc = np.abs(p - before), np.abs(p - above[x]), np.abs(p - corner)
                    guess = np.where((da <= db) & (da <= dc), before, np.where(db <= dc, above[x], corner))
                corner = above[x]
                before = line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    if kind == 3:
        alpha = np.full(len(table), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(table)]
        return np.concatenate([table[out[..., 0]], alpha[out[..., 0]][..., None]], axis=2)
    colour = np.repeat(out[..., :1], 3, axis=2) if n < 3 else out[..., :3]
    alpha = out[..., -1:] if n in (2, 4) else np.full((h, w, 1), 255, np.uint8)
    return np.concatenate([colour, alpha], axis=2)


def pixels(images: DataFrame, key: str = "photo_id", content: str = "content") -> DataFrame:
    """(key, y, x, r, g, b, a), a row for each pixel of each PNG; a picture at a time, its rows in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rgba = decode_png(batch.column(1)[i].as_py())
                h, w = rgba.shape[:2]
                step = max(1, 500_000 // w)
                for top in range(0, h, step):
                    part = rgba[top : top + step]
                    n = len(part) * w
                    name = pa.repeat(batch.column(0)[i], n)
                    places = np.repeat(np.arange(top, top + len(part)), w), np.tile(np.arange(w), len(part))
                    yield pa.RecordBatch.from_arrays([name, *map(pa.array, places), *(pa.array(part[..., c].ravel().astype(np.int32)) for c in range(4))], names=[key, "y", "x", *"rgba"])

    return images.select(F.col(key).cast("string").alias(key), content).mapInArrow(run, f"{key} string, y long, x long, r int, g int, b int, a int")


def from_rgba(images: DataFrame, key: str, width: str, height: str, data: str) -> DataFrame:
    """Pixels of raw RGBA bytes, by their places alone."""
    at = F.explode(F.sequence(F.lit(0), F.col(width) * F.col(height) - 1))
    rows = images.select(key, width, data, at.alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring(F.col(data), F.col("i") * 4 + k + 1, F.lit(1))), 16, 10).cast("int")
    return rows.select(key, F.floor(F.col("i") / F.col(width)).alias("y"), (F.col("i") % F.col(width)).alias("x"), *(byte(k).alias(c) for k, c in enumerate("rgba")))
