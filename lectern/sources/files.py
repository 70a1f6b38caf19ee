"""Files to text: validation, hashing and parsing of uploads."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, content_type, magic_ok
from .config import Options
from .pdf import pages_of

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, filename, size, content, content_hash, content_type)`` of files; reading stays lazy and split by file."""
    files = spark.read.format("binaryFile").load(path)
    name = basename(F.url_decode("path"))
    return files.select("path", name.alias("filename"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("content_hash"), content_type(name).alias("content_type"))


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element:
    return ET.fromstring(archive.read(name))


def _run_text(paragraph: ET.Element) -> str:
    marks = {f"{W}t": None, f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join((x.text or "") if marks[x.tag] is None else marks[x.tag] for x in paragraph.iter() if x.tag in marks)


def docx_text(content: bytes) -> str:
    """Paragraphs of the body that are not blank, two line feeds apart; tables are not read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _xml(z, "word/document.xml").find(f"{W}body")
    texts = [_run_text(p) for p in (body if body is not None else []) if p.tag == f"{W}p"]
    return "\n\n".join(t for t in texts if t.strip())


def _shape_text(paragraph: ET.Element) -> str:
    parts = {f"{A}r": lambda x: x.findtext(f"{A}t") or "", f"{A}fld": lambda x: x.findtext(f"{A}t") or "", f"{A}br": lambda x: "\v"}
    return "".join(parts[x.tag](x) for x in paragraph if x.tag in parts)


def pptx_text(content: bytes) -> str:
    """Paragraphs of each slide's own shapes in the order of the presentation; slides two line feeds apart.

    Tables and grouped shapes are not read; a line break inside a paragraph is a vertical tab.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = {x.get("Id"): x.get("Target") for x in _xml(z, "ppt/_rels/presentation.xml.rels")}
        order = [x.get(f"{R}id") for x in _xml(z, "ppt/presentation.xml").iter() if x.tag.endswith("}sldId")]
        slides = []
        for k in order:
            slide = _xml(z, "ppt/" + targets[k].removeprefix("/ppt/"))
            paragraphs = [_shape_text(p) for p in slide.iterfind(f"{P}cSld/{P}spTree/{P}sp/{P}txBody/{A}p")]
            slides.append("\n".join(p for p in paragraphs if p.strip()))
    return "\n\n".join(s for s in slides if s)


def media(content: bytes) -> list[bytes]:
    """Images in an office file, in archive order; none of a broken one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [z.read(n) for n in z.namelist() if re.match(r"(word|ppt)/media/.", n)]
    except (zipfile.BadZipFile, KeyError, OSError):
        return []


PARSED = "struct<text:string,page_count:int,images:array<binary>,error:string>"


def parser(pdf: Callable[[bytes], list[str]] = pages_of) -> Callable[[Column, Column], Column]:
    """A column function from ``(content, type)`` to text, page count (PDF), embedded images and error.

    A file is read once. Undecodable bytes of plain text become U+FFFD.
    """

    def one(content: bytes, kind: str | None) -> dict:
        out = {"text": None, "page_count": None, "images": [], "error": None}
        try:
            if kind == "pdf":
                pages = pdf(content)
                out |= {"text": "\n\n".join(pages), "page_count": len(pages)}
            elif kind in ("docx", "pptx"):
                out |= {"text": (docx_text if kind == "docx" else pptx_text)(content), "images": media(content)}
            elif kind in ("txt", "md"):
                out["text"] = content.decode("utf-8", errors="replace")
            else:
                out["error"] = "Unsupported file type"
        except Exception as error:  # a broken file is a failed row, not a failed job
            out["error"] = f"{type(error).__name__}: {error}"
        return out

    @F.pandas_udf(PARSED)
    def parse(contents: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(c or b"", k) for c, k in zip(contents, kinds)], columns=["text", "page_count", "images", "error"]).astype({"page_count": "Int32"})

    return parse


def upload_verdict(uploads: DataFrame, options: Options = Options()) -> DataFrame:
    """Add ``http_status`` and ``error``: the first check of an upload that fails, else 201, or 200 for a known file.

    ``uploads`` has ``filename, size, content, n_sources`` (of its notebook) and ``known``
    (the notebook has the same content already).
    """
    name = basename(F.col("filename"))
    kind = content_type(name)
    checks = [
        (F.col("n_sources") >= options.max_sources_per_notebook, F.lit(f"Source limit reached ({options.max_sources_per_notebook}).")),
        (F.col("content").isNull(), F.lit("No file provided.")),
        (F.coalesce("filename", F.lit("")) == "", F.lit("No file selected.")),
        (name.isNull(), F.lit("Invalid filename.")),
        (kind.isNull(), F.concat(F.lit("Unsupported file type: "), name)),
        (F.col("size") > options.max_file_size_mb * 1024 * 1024, F.lit(f"File too large (max {options.max_file_size_mb} MB).")),
        (~magic_ok(F.col("content"), kind), F.concat(F.lit("File content does not match its extension: "), name)),
    ]
    error = F.coalesce(*(F.when(failed, message) for failed, message in checks))
    status = F.when(error.isNotNull(), 400).when(F.col("known"), 200).otherwise(201)
    return uploads.withColumn("error", error).withColumn("http_status", status)


def fitted_size(width: Column, height: Column, most: int = 2048) -> Column:
    """Struct ``(width, height)`` of an image scaled down to ``most`` on its longer side."""
    scale = F.lit(float(most)) / F.greatest(width, height)
    fit = lambda x: F.when(F.greatest(width, height) > most, (x * scale).cast("int")).otherwise(x)
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def data_url(content: Column, kind: str = "image/png") -> Column:
    """A data URL; Spark breaks base64 into lines, which such a URL does not have."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(content), "\r\n", ""))


def needs_ocr(text: Column, kind: Column, n_images: Column, options: Options = Options()) -> Column:
    """Little text, and something to read instead: a PDF's pages or an office file's images."""
    from ..functions.text import py_strip

    little = F.length(py_strip(F.coalesce(text, F.lit("")))) < options.ocr_threshold_chars
    return F.lit(options.ocr_enabled) & little & ((kind == "pdf") | (kind.isin("docx", "pptx") & (n_images > 0)))


def joined_image_texts(texts: Column, label: str) -> Column:
    """Texts of images or pages under headers with their number from 1; blank ones are left out."""
    titled = F.transform(texts, lambda t, k: F.when(t != "", F.concat(F.lit(f"[{label} "), (k + 1).cast("string"), F.lit("]\n"), t)))
    return F.array_join(F.filter(titled, lambda t: t.isNotNull()), "\n\n")
