"""Office files, images, recordings and PDF made from table rows, for queries that read them back."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import A, P, R, W

#: The oldest time that an archive can hold, so that equal texts make equal files.
STAMP = (1980, 1, 1, 0, 0, 0)


def _archive(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name, STAMP), content)
    return out.getvalue()


def docx(lines: list[str], images: list[bytes] = [b"image"]) -> bytes:
    """A document with a paragraph for each line, and its images."""
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    return _archive({"word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>', **{f"word/media/image{k}.png": x for k, x in enumerate(images, 1)}})


def pptx(slides: list[list[str]]) -> bytes:
    """A presentation of slides with a shape for each line, a table and a group beside; the archive holds the slides in reverse."""
    ids = range(1, len(slides) + 1)
    listed = "".join(f'<p:sldId r:id="r{k}"/>' for k in ids)
    targets = "".join(f'<Relationship Id="r{k}" Target="slides/slide{k}.xml"/>' for k in ids)
    parts: dict[str, str | bytes] = {"ppt/presentation.xml": f'<p:presentation xmlns:p="{P[1:-1]}" xmlns:r="{R[1:-1]}">{listed}</p:presentation>', "ppt/_rels/presentation.xml.rels": f"<Relationships>{targets}</Relationships>"}
    paragraph = lambda x: "<a:p>" + "<a:br/>".join(f"<a:r><a:t>{escape(w)}</a:t></a:r>" for w in x.split("\v")) + "</a:p>"
    shape = lambda x: f"<p:sp><p:nvSpPr/><p:txBody><a:bodyPr/>{paragraph(x)}</p:txBody></p:sp>"
    table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody>{paragraph('cell')}</a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    for k in reversed(ids):
        shapes = "".join(map(shape, slides[k - 1])) + table + f"<p:grpSp>{shape('grouped')}</p:grpSp><p:pic/>"
        parts[f"ppt/slides/slide{k}.xml"] = f'<p:sld xmlns:p="{P[1:-1]}" xmlns:a="{A[1:-1]}"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>'
    return _archive(parts)


def packer() -> Callable[[Column, Column], Column]:
    """A column function from ``(text, kind)`` to a file: ``docx`` by lines; ``images`` with each line as an image; else ``pptx``, its first line on a slide of its own."""

    def one(text: str, kind: str) -> bytes:
        lines = text.split("\n")
        if kind == "docx":
            return docx(lines)
        return docx([], [x.encode() for x in lines if x]) if kind == "images" else pptx([lines[:1], lines[1:]])

    @F.pandas_udf("binary")
    def pack(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([one(t, k) for t, k in zip(texts, kinds)])

    return pack


def png(pixels: np.ndarray, filters: tuple[int, ...] = (0, 1, 2, 3, 4)) -> bytes:
    """A PNG of ``[height, width, channels]`` bytes, its rows filtered in turn."""
    height, width, channels = pixels.shape
    row = pixels.astype(np.int64)
    left, above, corner = np.zeros((3, *row.shape), np.int64)
    left[:, 1:], above[1:], corner[1:, 1:] = row[:, :-1], row[:-1], row[:-1, :-1]
    guess = left + above - corner
    of_left, of_above, of_corner = (np.abs(guess - x) for x in (left, above, corner))
    paeth = np.where((of_left <= of_above) & (of_left <= of_corner), left, np.where(of_above <= of_corner, above, corner))
    kinds = np.resize(filters, height).astype(np.uint8)
    made = np.choose(kinds[:, None, None], (row, row - left, row - above, row - (left + above) // 2, row - paeth)) % 256
    rows = np.concatenate((kinds[:, None], made.reshape(height, -1).astype(np.uint8)), axis=1).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def shaded(widths: pd.Series, heights: pd.Series, seeds: pd.Series) -> pd.Series:
    """Grey images whose pixel at (x, y) is (7 x + 13 y + seed) mod 256."""
    return pd.Series([png(((7 * np.arange(w)[None, :] + 13 * np.arange(h)[:, None] + s) % 256)[:, :, None]) for w, h, s in zip(widths, heights, seeds)])


shaded = shaded.asNondeterministic()  # made once, however many functions read it


def wav(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A recording of ``[frame, channel]`` whole numbers."""
    channels = samples.shape[1]
    data = (samples.astype(np.uint8) if bits == 8 else samples.astype("<i2")).tobytes()
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    parts = b"fmt " + struct.pack("<I", len(form)) + form + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


@F.pandas_udf(T.BinaryType())
def toned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Recordings, by frames, rate and channels, of a tone of 440 Hz; a batch of numbers becomes several of recordings."""
    tone = lambda n, r: np.round(8000 * np.sin(2 * np.pi * 440 * np.arange(n) / r))
    for frames, rates, channels in batches:
        for k in range(0, len(frames), 256):
            own = zip(*(x.iloc[k : k + 256] for x in (frames, rates, channels)))
            yield pd.Series([wav(np.repeat(tone(n, r)[:, None], c, axis=1), int(r)) for n, r, c in own])


def pdf(pages: list[list[str]], packed: bool = False) -> bytes:
    """A PDF of pages of lines: in Latin letters with a plain font, else with codes of its own and a map to Unicode.

    ``packed`` puts the objects without streams into an object stream, with a cross-reference stream.
    """
    letters = sorted({c for page in pages for line in page for c in line})
    plain = all(c.encode("cp1252", "ignore") and ord(c) >= 32 for c in letters)
    codes = {c: k + 1 for k, c in enumerate(letters)}
    escape_ = lambda x: x.encode("cp1252").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)")
    show = (lambda x: b"(" + escape_(x) + b") Tj") if plain else (lambda x: b"<" + b"".join(b"%04X" % codes[c] for c in x) + b"> Tj")
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    streams: dict[int, bytes] = {}
    if plain:
        objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    else:
        objects[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /ToUnicode 4 0 R >>"
        pairs = [b"<%04X> <%s>" % (k, c.encode("utf-16-be").hex().encode()) for c, k in codes.items()]
        streams[4] = b"\n".join(b"%d beginbfchar\n%s\nendbfchar" % (len(p), b"\n".join(p)) for p in (pairs[k : k + 100] for k in range(0, len(pairs), 100)))
    kids = []
    for n, lines in enumerate(pages):
        at = 10 + 2 * n
        kids.append(b"%d 0 R" % at)
        objects[at] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (at + 1)
        streams[at + 1] = b"BT /F1 10 Tf 12 TL 50 780 Td\n" + b" T*\n".join(map(show, lines)) + b"\nET"
    objects[2] = b"<< /Type /Pages /Kids [ %s ] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(kids), len(kids))
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}

    def put(n: int, body: bytes) -> None:
        places[n] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (n, body))

    for n, data in streams.items():
        data = zlib.compress(data)
        put(n, b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(data), data))
    if not packed:
        for n, body in objects.items():
            put(n, body)
        start, size = len(out), max(places) + 1
        rows = b"".join(b"%010d %05d %s \n" % ((places[n], 0, b"n") if n in places else (0, 65535, b"f")) for n in range(size))
        return bytes(out) + b"xref\n0 %d\n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (size, rows, size, start)
    offsets, at = [], 0
    for n, body in objects.items():
        offsets.append(b"%d %d" % (n, at))
        at += len(body) + 1
    head = b" ".join(offsets) + b" "
    data = zlib.compress(head + b" ".join(objects.values()))
    put(5, b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(objects), len(head), len(data), data))
    index = {n: k for k, n in enumerate(objects)}
    size, start = max([*places, *objects]) + 2, len(out)
    places[6] = start
    rows = b"".join(struct.pack(">BIH", *((2, 5, index[n]) if n in index else (1, places[n], 0) if n in places else (0, 0, 65535))) for n in range(size))
    data = zlib.compress(rows)
    put(6, b"<< /Type /XRef /Size %d /W [ 1 4 2 ] /Root 1 0 R /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (size, len(data), data))
    return bytes(out) + b"startxref\n%d\n%%%%EOF" % start


def printer(lines: int = 40) -> Callable[[Column, Column], Column]:
    """A column function from ``(text, seed)`` to a PDF of so many lines a page; of seeds by five, the fourth is cut off and the others are packed by turns."""

    def one(text: str, seed: int) -> bytes:
        own = text.split("\n")
        made = pdf([own[k : k + lines] for k in range(0, len(own), lines)], packed=seed % 2 == 1)
        return made[: made.index(b"stream") + 9] if seed % 5 == 3 else made

    @F.pandas_udf("binary")
    def print_(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([one(t, s) for t, s in zip(texts, seeds)])

    return print_
