"""Pixels of images: PNG, GIF and BMP bytes to RGB over white, within Arrow batches; files by Spark's own image source."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.images import BMP, GIF, PNG, size_of

# Channels by PNG's colour types, and the starts and steps of Adam7's passes (column, row).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Pixels of an image at most; a header that claims more is an error, so a few bytes can't take a task's memory.
MOST_PIXELS = 1 << 28


class Undecodable(ValueError):
    """Bytes that are no image, or one of a kind that isn't decoded here."""


def _over_white(rgb: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    a = alpha.astype(np.uint32)[..., None]
    return ((rgb.astype(np.uint32) * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)


# ---- PNG -------------------------------------------------------------------------------------------


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """Chunks by name up to the end, data chunks joined; a wrong checksum or a missing end is an error."""
    found, at = {}, len(PNG)
    while at + 12 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(name + body)):
            raise Undecodable("a chunk is cut off or has a wrong checksum")
        if name == b"IEND":
            return found
        found[name] = found.get(name, b"") + body if name == b"IDAT" else body
        at += 12 + size
    raise Undecodable("the end is missing")


def _unfiltered(data: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes with their filters undone; ``step`` bytes make a pixel."""
    raw = np.frombuffer(data, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    rows, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:]
        if kind == 0:
            row = line
        elif kind == 1:  # each channel is a running sum, and bytes wrap around
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            row = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            row = line + above
        elif kind in (3, 4):
            row = np.frombuffer(_neighbours(line.tobytes(), above.tobytes(), step, kind == 4), np.uint8)
        else:
            raise Undecodable(f"filter {kind}")
        rows[y] = above = row
    return rows


def _neighbours(line: bytes, above: bytes, step: int, paeth: bool) -> bytearray:
    """A row whose bytes were predicted from the left, above and, for ``paeth``, the upper left: each needs the one before."""
    out = bytearray(len(line))
    for i, x in enumerate(line):
        a, b = (out[i - step] if i >= step else 0), above[i]
        if not paeth:
            out[i] = x + (a + b >> 1) & 255
            continue
        c = above[i - step] if i >= step else 0
        to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        out[i] = x + (a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c) & 255
    return out


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(height, width, channels) samples; of two bytes the first counts."""
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        rows = bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
    return rows[:, : width * channels].reshape(len(rows), width, channels)


def _png(data: bytes) -> np.ndarray:
    chunks = _chunks(data)
    try:
        width, height, depth, kind, packing, filters, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
        channels = CHANNELS[kind]
    except (KeyError, struct.error) as e:
        raise Undecodable("no sound header") from e
    if packing or filters or interlaced > 1 or depth not in {0: (1, 2, 4, 8, 16), 3: (1, 2, 4, 8)}.get(kind, (8, 16)) or not 0 < width * height <= MOST_PIXELS:
        raise Undecodable("no sound header")
    packed = chunks.get(b"IDAT", b"")
    parts = [p for p in PASSES if p[0] < width and p[1] < height] if interlaced else [(0, 0, 1, 1)]
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in parts]
    strides = [-(-w * channels * depth // 8) for w, _ in sizes]
    need = sum(h * (s + 1) for (_, h), s in zip(sizes, strides))
    out = zlib.decompressobj().decompress(packed, need)
    if len(out) < need:
        raise Undecodable("pixels are missing")
    made, at = np.zeros((height, width, channels), np.uint8), 0
    for (x, y, dx, dy), (w, h), stride in zip(parts, sizes, strides):
        rows = _unfiltered(out[at : at + h * (stride + 1)], h, stride, max(1, channels * depth // 8))
        made[y::dy, x::dx] = _samples(rows, w, channels, depth)
        at += h * (stride + 1)
    if kind == 3:
        palette = np.frombuffer(chunks.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if made.max() >= len(palette):
            raise Undecodable("a colour beyond the palette")
        alpha = np.full(len(palette), 255, np.uint8)
        told = np.frombuffer(chunks.get(b"tRNS", b""), np.uint8)[: len(palette)]
        alpha[: len(told)] = told
        return _over_white(palette, alpha)[made[..., 0]]
    if depth < 8:
        made *= 255 // ((1 << depth) - 1)
    rgb = made[..., :3] if channels >= 3 else np.repeat(made[..., :1], 3, 2)
    return _over_white(rgb, made[..., -1]) if kind in (4, 6) else rgb


# ---- GIF and BMP -----------------------------------------------------------------------------------


def _unpacked(data: bytes, least: int, n: int) -> bytearray:
    """``n`` bytes of the variable-length codes that GIF has."""
    clear, end = 1 << least, (1 << least) + 1
    table, size, last = [bytes([k]) for k in range(clear)] + [b"", b""], least + 1, b""
    out, held, bits = bytearray(), 0, 0
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= size:
            code = held & (1 << size) - 1
            held, bits = held >> size, bits - size
            if code == clear:
                table, size, last = table[: clear + 2], least + 1, b""
                continue
            if code == end or len(out) >= n:
                return out
            if code > len(table) or code == len(table) and not last:
                raise Undecodable("a code that isn't known yet")
            now = table[code] if code < len(table) else last + last[:1]
            out += now
            if last and len(table) < 4096:
                table.append(last + now[:1])
            if len(table) == 1 << size and size < 12:
                size += 1
            last = now
    return out


def _gif(data: bytes) -> np.ndarray:
    """The first frame on its canvas, over white."""
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, palette, clear = 13, b"", None
    if flags & 0x80:
        palette, at = data[13 : 13 + (6 << (flags & 7))], 13 + (6 << (flags & 7))
    while data[at] == 0x21:
        if data[at + 1] == 0xF9 and data[at + 3] & 1:
            clear = data[at + 6]
        at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    if data[at] != 0x2C or not 0 < width * height <= MOST_PIXELS:
        raise Undecodable("no frame")
    left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
    at += 10
    if flags & 0x80:
        palette, at = data[at : at + (6 << (flags & 7))], at + (6 << (flags & 7))
    least, at, packed = data[at], at + 1, bytearray()
    while data[at]:
        packed += data[at + 1 : at + 1 + data[at]]
        at += data[at] + 1
    pixels = np.frombuffer(_unpacked(bytes(packed), least, w * h), np.uint8)
    colours = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    if len(pixels) < w * h or left + w > width or top + h > height or pixels.max(initial=0) >= len(colours):
        raise Undecodable("pixels are missing")
    frame = pixels[: w * h].reshape(h, w)
    if flags & 0x40:
        order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
        frame = frame[np.argsort(order)]
    out = np.full((height, width, 3), 255, np.uint8)
    alpha = np.where(frame == clear, 0, 255) if clear is not None else np.full(frame.shape, 255)
    out[top : top + h, left : left + w] = _over_white(colours[frame], alpha)
    return out


def _bmp(data: bytes) -> np.ndarray:
    start, header, width, height, _, depth, packing = struct.unpack("<I4xIiiHHI", b"\0" * 0 + data[10:14] + b"\0" * 4 + data[14:34])
    down, height = height < 0, abs(height)
    if packing not in (0, 3) or depth not in (8, 24, 32) or not 0 < width * height <= MOST_PIXELS:
        raise Undecodable("a bitmap of another kind")
    stride = (width * depth + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
    rows = rows if down else rows[::-1]
    if depth == 8:
        n = struct.unpack("<I", data[46:50])[0] or 256
        colours = np.frombuffer(data, np.uint8, 4 * n, 14 + header).reshape(-1, 4)
        return colours[rows[:, :width]][..., 2::-1]
    return rows[:, : width * depth // 8].reshape(height, width, -1)[..., 2::-1]


def rgb_of(data: bytes | None) -> np.ndarray:
    """(height, width, 3) pixels over white. What is no image, or is cut off, is an error, and so are JPEG and WebP, which need a library that isn't here."""
    try:
        if data and data.startswith(PNG):
            return _png(data)
        if data and data.startswith(GIF):
            return _gif(data)
        if data and data.startswith(BMP):
            return _bmp(data)
    except (zlib.error, struct.error, IndexError, ValueError) as e:
        raise e if isinstance(e, Undecodable) else Undecodable(f"the image is broken: {e}") from e
    raise Undecodable("this kind of image isn't decoded here" if size_of(data) else "these bytes are no image")


def decoded(data: Column) -> Column:
    """``width, height, rgb`` of an image's bytes, row by row of three bytes a pixel; null for null, an error for what can't be decoded."""

    @F.pandas_udf("width int, height int, rgb binary")
    def read(column: pd.Series) -> pd.DataFrame:
        rows = []
        for x in column:
            made = None if x is None else rgb_of(bytes(x))
            rows.append((None, None, None) if made is None else (made.shape[1], made.shape[0], np.ascontiguousarray(made).tobytes()))
        return pd.DataFrame(rows, columns=["width", "height", "rgb"]).astype({"width": "Int32", "height": "Int32"})

    return F.when(data.isNotNull(), read(data))


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, width, height, rgb`` of image files, JPEG among them, by Spark's image source, which the executors' Java decodes; an unreadable file is an error. Transparency is laid over white."""
    from tessera.session import ship

    files = ship(spark).read.format("image").option("recursiveFileLookup", True).load(path).select("image.*")

    @F.pandas_udf("binary")
    def straight(data: pd.Series, channels: pd.Series) -> pd.Series:
        def one(x, n):
            bgr = np.frombuffer(x, np.uint8).reshape(-1, n)
            rgb = np.repeat(bgr, 3, 1) if n == 1 else bgr[:, 2::-1]
            return (_over_white(rgb, bgr[:, 3]) if n == 4 else rgb).tobytes()

        return pd.Series([one(x, n) for x, n in zip(data, channels)])

    sound = F.when(F.col("nChannels") > 0, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("no image: "), F.col("origin"))).cast("binary"))
    return files.select(F.col("origin").alias("path"), "width", "height", straight(sound, F.col("nChannels")).alias("rgb"))
