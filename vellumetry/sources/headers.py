"""Sizes of images from their first bytes, without decoding them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Markers of JPEG frames that carry the size, and those without a length.  Fixed values of the standard.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE, PICTURE = frozenset((0x01, *range(0xD0, 0xD9))), (0xD9, 0xDA)


def _big(data: bytes, at: int, n: int = 2) -> int:
    return int.from_bytes(data[at : at + n], "big")


def _segments(data: bytes) -> Iterator[tuple[int, int]]:
    """(marker, place of its length) of a JPEG's segments, up to its picture or a length that can't be.  What lies between
    segments is passed over."""
    at = data.find(0xFF, 2)
    while 0 <= at and at + 4 <= len(data):
        marker = data[at + 1]
        if marker == 0xFF:  # fill
            at += 1
        elif marker in BARE:
            at = data.find(0xFF, at + 2)
        elif marker in PICTURE or _big(data, at + 2) < 2:
            return
        else:
            yield marker, at + 2
            at = data.find(0xFF, at + 2 + _big(data, at + 2))


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """(width, height); None where the bytes are of no known format or too few."""
    data = data or b""
    found = None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        found = _big(data, 16, 4), _big(data, 20, 4)
    elif data[:2] == b"\xff\xd8":
        frame = next((at for marker, at in _segments(data) if marker in FRAMES), None)
        if frame is not None and len(data) >= frame + 7:
            found = _big(data, frame + 5), _big(data, frame + 3)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        low = lambda at, n: int.from_bytes(data[at : at + n], "little")
        if data[12:16] == b"VP8X":
            found = low(24, 3) + 1, low(27, 3) + 1
        elif data[12:16] == b"VP8L" and data[20] == 0x2F:
            bits = low(21, 4)
            found = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        elif data[12:16] == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
            found = low(26, 2) & 0x3FFF, low(28, 2) & 0x3FFF
    return found if found and min(found) > 0 else None


@F.pandas_udf(StructType().add("width", IntegerType()).add("height", IntegerType()))
def _sizes(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([size_of(c) or (None, None) for c in content], columns=["width", "height"], dtype="Int32")


def image_size(content: Column) -> Column:
    """(width, height), both null where unknown."""
    return _sizes(content)
