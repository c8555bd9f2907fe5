"""Small images: read from PNG, reduced to a palette, and drawn."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours an image is reduced to.
COLORS = 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def png_pixels(content: bytes) -> np.ndarray | None:
    """Pixels by channels of a PNG of eight bits a sample, without palette or interlace; null for anything else, broken files too."""
    if not content or not content.startswith(_SIGNATURE):
        return None
    at, packed, head = len(_SIGNATURE), b"", None
    try:
        while at + 8 <= len(content):
            (size,), kind = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
            body = content[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"IDAT":
                packed += body
            at += size + 12
        width, height, depth, color, _, _, interlace = head
        if depth != 8 or color not in _CHANNELS or interlace:
            return None
        n = _CHANNELS[color]
        rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * n)
    except (struct.error, zlib.error, ValueError, TypeError):
        return None
    out = np.zeros((height, width, n), np.uint8)
    above = np.zeros((width, n), np.int32)
    for y, row in enumerate(rows):
        line = row[1:].reshape(width, n).astype(np.int32)
        if row[0] == 2:
            line = line + above & 255
        elif row[0] in (1, 3, 4):
            left, corner = np.zeros(n, np.int32), np.zeros(n, np.int32)
            for x in range(width):
                up = above[x]
                if row[0] == 1:
                    guess = left
                elif row[0] == 3:
                    guess = (left + up) // 2
                else:
                    by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
                line[x] = line[x] + guess & 255
                left, corner = line[x], up
        out[y], above = line, line
    return out.reshape(-1, n)


def palette_counts(pixels: np.ndarray, colors: int = COLORS) -> list[int]:
    """How many pixels each colour of a reduced palette covers: boxes of colours are halved at the median of their widest channel."""
    boxes, whole = [pixels.astype(np.int32)], []
    while boxes and len(boxes) + len(whole) < colors:
        boxes.sort(key=lambda b: int(np.ptp(b, axis=0).max()))
        box = boxes.pop()
        spread = np.ptp(box, axis=0)
        if not spread.max():
            whole.append(box)
            continue
        values = box[:, spread.argmax()]
        cut = np.median(values)
        low = values <= cut if (values <= cut).sum() < len(values) else values < cut
        boxes += [box[low], box[~low]]
    return sorted((len(b) for b in [*whole, *boxes]), reverse=True)


def colors_of(content: Column, colors: int = COLORS) -> Column:
    """Pixels by colour of the reduced palette of each PNG; null where it can't be read."""

    @F.pandas_udf("array<bigint>")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in parts:
            read = [None if c is None else png_pixels(bytes(c)) for c in contents]
            yield pd.Series([None if p is None or not len(p) else palette_counts(p, colors) for p in read], dtype=object)

    return counted(content)


def striped_png(stripes: int, size: int = 20) -> bytes:
    """A square of so many stripes of colours far apart: something to read where no images are at hand."""
    line = b"".join(bytes(((60 * k) % 256, (200 - 45 * k) % 256, (25 * k * k) % 256)) for k in (x * stripes // size for x in range(size)))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + line) * size)) + chunk(b"IEND", b"")
