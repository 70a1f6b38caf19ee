"""Images of files as rows; what their bytes tell of their size; smaller ones by area."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import media

#: Samples of a pixel by PNG colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
SIZE = "struct<format:string,width:int,height:int>"


def image_rows(files: DataFrame, content: str = "content", kind: str = "content_type") -> DataFrame:
    """A row for each image inside an office file, in place of its content: ``image_idx`` from 0 in archive order, and ``image``.

    A file has as many rows as images, so no array holds them all; broken files and other types have none.
    """

    @F.udtf(returnType="image_idx int, image binary")
    class Images:
        def eval(self, content: bytes, kind: str) -> Iterator[tuple[int, bytes]]:
            if content is not None and kind in ("docx", "pptx"):
                yield from enumerate(media(bytes(content)))

    return files.lateralJoin(Images(F.col(content).outer(), F.col(kind).outer())).drop(content)


def texts_of(rows: DataFrame, key: str, label: str = "Image") -> DataFrame:
    """``(key, text)`` from ``(key, image_idx, text)``: texts under headers with the image's own number from 1; blank ones are left out."""
    titled = F.concat(F.lit(f"[{label} "), (F.col("image_idx") + 1).cast("string"), F.lit("]\n"), "text")
    laid = F.transform(F.sort_array(F.collect_list(F.struct("image_idx", titled.alias("t")))), lambda x: x["t"])
    return rows.where("text <> ''").groupBy(key).agg(F.array_join(laid, "\n\n").alias("text"))


def size_of(content: bytes) -> tuple[str, int, int] | None:
    """``(format, width, height)`` from the header of a PNG, GIF or JPEG; nothing of other or broken files."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return ("png", *struct.unpack(">II", content[16:24]))
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return ("gif", *struct.unpack("<HH", content[6:10]))
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            marker, length = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame's header
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return "jpeg", width, height
            at += 1 if marker == 0xFF else 2 + length
    return None


def png_pixels(content: bytes) -> np.ndarray:
    """``[height, width, channels]`` of a PNG of eight bits a sample, not interlaced and without a palette."""
    parts, at, head = [], 8, b""
    while at + 8 <= len(content):
        length, name = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + length]
        head = data if name == b"IHDR" else head
        if name == b"IDAT":
            parts.append(data)
        at += 12 + length
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise ValueError("PNG with a palette, of other depth, or interlaced")
    n, stride = CHANNELS[colour], width * CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, stride + 1)
    out, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(height):
        kind, row = raw[y, 0], raw[y, 1:]
        if kind == 1:
            row = np.add.accumulate(row.reshape(width, n), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            row = _along(row.tolist(), above.tolist(), n, kind)
        out[y] = row
        above = out[y]
    return out.reshape(height, width, n)


def _along(row: list[int], above: list[int], n: int, kind: int) -> list[int]:
    """Filters whose guess needs the sample to the left already made; each channel by itself."""
    for first in range(n):
        left = corner = 0
        for k in range(first, len(row), n):
            up = above[k]
            if kind == 3:
                guess = left + up >> 1
            else:
                of_left, of_up, of_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                guess = left if of_left <= of_up and of_left <= of_corner else up if of_up <= of_corner else corner
                corner = up
            row[k] = left = row[k] + guess & 255
    return row


def _shares(size: int, to: int) -> np.ndarray:
    """``[to, size]``: how much of each old place lies in a new one, in units of which an old place has ``to``."""
    old, new = np.arange(size) * to, np.arange(to) * size
    return np.maximum(0, np.minimum(new[:, None] + size, old[None, :] + to) - np.maximum(new[:, None], old[None, :]))


def resampled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """A smaller image, of which each sample is the floor of the mean over its area."""
    over_rows = np.tensordot(_shares(pixels.shape[0], height), pixels.astype(np.int64), axes=(1, 0))
    both = np.tensordot(_shares(pixels.shape[1], width), over_rows, axes=(1, 1)).transpose(1, 0, 2)
    return (both // (pixels.shape[0] * pixels.shape[1])).astype(np.uint8)


def png_of(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)), axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, {n: c for c, n in CHANNELS.items()}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def described(image: Column | str) -> Column:
    """Struct ``(format, width, height)`` of an image's bytes; null where they tell nothing."""

    @F.pandas_udf(SIZE)
    def of(contents: pd.Series) -> pd.DataFrame:
        found = [size_of(bytes(c)) if c is not None else None for c in contents]
        return pd.DataFrame([f or (None, None, None) for f in found], columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    return of(image)


def fitted(most: int = 2048) -> Callable[[Column | str], Column]:
    """A column function: images whose longer side exceeds ``most``, scaled down to it; others, and such as cannot be read, as they are."""

    def one(content: bytes | None) -> bytes | None:
        size = size_of(bytes(content)) if content is not None else None
        if size is None or size[0] != "png" or max(size[1:]) <= most:
            return content
        scale = most / max(size[1:])
        try:
            return png_of(resampled(png_pixels(bytes(content)), max(1, int(size[1] * scale)), max(1, int(size[2] * scale))))
        except (ValueError, zlib.error, struct.error):
            return content

    @F.pandas_udf("binary")
    def fit(contents: pd.Series) -> pd.Series:
        return contents.map(one)

    # Spark repeats a Python function inside each other one over its result, unless told that results may differ
    return fit.asNondeterministic()


def pixels(image: Column | str) -> Column:
    """The samples of a PNG, row by row; null if it cannot be read."""

    def one(content: bytes | None) -> list[int] | None:
        try:
            return png_pixels(bytes(content)).reshape(-1).tolist() if content is not None else None
        except (ValueError, zlib.error, struct.error):
            return None

    @F.pandas_udf("array<int>")
    def of(contents: pd.Series) -> pd.Series:
        return contents.map(one)

    return of(image)
