"""Width and height of images from their headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures of image files, and the markers of JPEG that begin a frame.
PNG, GIF, BMP, JPEG = b"\x89PNG\r\n\x1a\n", (b"GIF87a", b"GIF89a"), b"BM", b"\xff\xd8"
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) that an image's header tells; None for other bytes."""
    try:
        if not data:
            return None
        if data.startswith(PNG):
            return struct.unpack(">II", data[16:24])
        if data.startswith(GIF):
            return struct.unpack("<HH", data[6:10])
        if data.startswith(BMP):
            width, height = struct.unpack("<ii", data[18:26])
            return width, abs(height)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data.startswith(JPEG):
            return _jpeg(data)
    except (struct.error, IndexError):
        return None
    return None


def _webp(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X":
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    width, height = struct.unpack("<HH", data[26:30])
    return width & 0x3FFF, height & 0x3FFF


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker in FRAMES:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 1 if marker == 0xFF else 2 if marker == 1 or 0xD0 <= marker <= 0xD9 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def dimensions(data: Column) -> Column:
    """``width``, ``height`` of an image's bytes, by Arrow batches; null for what is no image."""

    @F.pandas_udf("width int, height int")
    def read(column: pd.Series) -> pd.DataFrame:
        found = [size_of(x) or (None, None) for x in column]
        return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    return read(data)
