"""Scans of page documents through injected decoders.

A decoder turns a file's bytes into pages; none is bundled. ``Decoder`` names what the scans need, so tests use fakes and deployments their library. Files
come from Spark's ``binaryFile`` source; size limits are decided on the ``length`` column before any content is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X

MAX_MB, MAX_PAGES, MAX_DPI, LONG_EDGE = 500, 1000, 400, 1600


@dataclass
class Page:
    text: str = ""
    width: float = 612.0
    height: float = 792.0
    spans: list[tuple[str, float, float, float, float]] = field(default_factory=list)
    images: list[tuple[int, str, bytes, list[float] | None]] = field(default_factory=list)  # xref, extension, bytes, placement
    masks: list[int] = field(default_factory=list)
    content: bytes = b""


@dataclass
class Document:
    pages: list[Page]
    metadata: dict[str, str] = field(default_factory=dict)
    encrypted: bool = False


class Decoder(Protocol):
    """``open`` raises ValueError on unreadable bytes; ``render`` and ``crop`` give PNG bytes."""

    def open(self, content: bytes) -> Document: ...

    def render(self, content: bytes, page: int, dpi: int) -> bytes: ...

    def crop(self, png: bytes, box: tuple[int, int, int, int]) -> bytes: ...

    def shrink(self, image: bytes, ext: str, long_edge: int) -> bytes: ...


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


PREFLIGHT = "path string, valid boolean, page_count int, metadata map<string,string>, width_pts double, height_pts double, born_digital boolean, error string"


def preflight(files: DataFrame, decoder: Decoder, max_mb: float = MAX_MB, max_pages: int = MAX_PAGES) -> DataFrame:
    """One row a file. Of the reasons to refuse it the first holds: size, unreadable, password, too many pages, none. Files above the size limit are never decoded."""
    limit = int(max_mb * 1024 * 1024)
    large = files.where(F.col("length") > limit)
    refused = large.select("path", F.lit(False).alias("valid"), F.lit(0).alias("page_count"), F.create_map().cast("map<string,string>").alias("metadata"), *[F.lit(None).cast("double").alias(c) for c in ("width_pts", "height_pts")], F.lit(False).alias("born_digital"), F.format_string(f"size %d exceeds cap {max_mb:g} MB", "length").alias("error"))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                pages, error, meta = [], None, {}
                try:
                    doc = decoder.open(bytes(row.content))
                    pages, meta = doc.pages, doc.metadata
                    if doc.encrypted:
                        error = "password-protected"
                    elif len(pages) > max_pages:
                        error = f"page count {len(pages)} exceeds cap {max_pages}"
                    elif not pages:
                        error = "PDF has no pages"
                except (ValueError, OSError, RuntimeError):
                    error = "unreadable or corrupt PDF"
                first = pages[0] if pages and not error else None
                out.append((row.path, error is None, len(pages), meta, first.width if first else None, first.height if first else None, [p.text for p in pages[:3]] if first else [], error))
            yield pd.DataFrame(out, columns=["path", "valid", "page_count", "metadata", "width_pts", "height_pts", "_texts", "error"])

    kind = PREFLIGHT.replace("born_digital boolean", "_texts array<string>")
    own = files.where(F.col("length") <= limit).mapInPandas(probe, kind)
    own = own.withColumn("born_digital", F.coalesce(X.born_digital(F.col("_texts")), F.lit(False))).select(*[c.split()[0] for c in PREFLIGHT.split(", ")])
    return own.unionByName(refused)


PAGES = "path string, page_number int, text string, width double, height double, source_hash string"


def _opened(decoder: Decoder, content: bytes) -> list[Page]:
    try:
        return decoder.open(content).pages
    except (ValueError, OSError, RuntimeError):
        return []


def page_hash(page: Page) -> str:
    """SHA-256 over a page's content stream and its rectangle."""
    return hashlib.sha256(page.content + f"{page.width}x{page.height}".encode()).hexdigest()


def native_pages(files: DataFrame, decoder: Decoder) -> DataFrame:
    """(path, page_number, text, width, height, source_hash) of every page; a defect gives an empty text, an unreadable file no page."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.path, i, p.text or "", p.width, p.height, page_hash(p)) for r in frame.itertuples() for i, p in enumerate(_opened(decoder, bytes(r.content)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "width", "height", "source_hash"])

    return files.mapInPandas(read, PAGES)


def text_spans(files: DataFrame, decoder: Decoder) -> DataFrame:
    """(doc_id, page_number, pos, text, x0, y0, x1, y1): what a box-clipped text scan joins with."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.path, i, k, *s) for r in frame.itertuples() for i, p in enumerate(_opened(decoder, bytes(r.content)), 1) for k, s in enumerate(p.spans)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "pos", "text", "x0", "y0", "x1", "y1"])

    return files.mapInPandas(read, "doc_id string, page_number int, pos int, text string, x0 double, y0 double, x1 double, y1 double")


def native_images(files: DataFrame, decoder: Decoder) -> DataFrame:
    """(doc_id, page_number, pos, xref, ext, data, box): image objects without soft masks, each once a page; box is null where it isn't placed. Large pictures are shrunk to ``LONG_EDGE``, unreadable ones pass as they are."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                for i, page in enumerate(_opened(decoder, bytes(r.content)), 1):
                    seen = set(page.masks)
                    for k, (xref, ext, data, box) in enumerate(page.images):
                        if xref not in seen:
                            seen.add(xref)
                            try:
                                data = decoder.shrink(data, ext, LONG_EDGE)
                            except (ValueError, OSError, RuntimeError):
                                pass
                            rows.append((r.path, i, k, xref, ext, data, box))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "pos", "xref", "ext", "data", "box"])

    return files.mapInPandas(read, "doc_id string, page_number int, pos int, xref int, ext string, data binary, box array<double>")


def rendered(files: DataFrame, wanted: DataFrame, decoder: Decoder) -> DataFrame:
    """(path, page_number, dpi, png, error) of the wanted (path, page_number, dpi); the resolution must be 1 to ``MAX_DPI`` and the page exist."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                png, error = None, None
                try:
                    if not 0 < r.dpi <= MAX_DPI:
                        raise ValueError(f"dpi {r.dpi} outside 1..{MAX_DPI}")
                    if not 1 <= r.page_number <= len(decoder.open(bytes(r.content)).pages):
                        raise ValueError(f"page {r.page_number} outside the document")
                    png = decoder.render(bytes(r.content), r.page_number, r.dpi)
                except (ValueError, OSError, RuntimeError) as e:
                    error = str(e)
                out.append((r.path, r.page_number, r.dpi, png, error))
            yield pd.DataFrame(out, columns=["path", "page_number", "dpi", "png", "error"])

    return files.select("path", "content").join(wanted, "path").mapInPandas(draw, "path string, page_number int, dpi int, png binary, error string")


def crops(renders: DataFrame, boxes: DataFrame, decoder: Decoder) -> DataFrame:
    """(path, page_number, idx, png): cut-outs of renders (path, page_number, png, width, height); boxes (path, page_number, idx, x0..y1) that aren't inside give null."""
    from quire.functions import geometry as G

    joined = renders.join(boxes, ["path", "page_number"])
    joined = joined.withColumn("ok", G.crop_valid(G.box(""), F.col("width"), F.col("height")))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["png"] = [decoder.crop(bytes(r.png), (round(r.x0), round(r.y0), round(r.x1), round(r.y1))) if r.ok else None for r in frame.itertuples()]
            yield frame[["path", "page_number", "idx", "png"]]

    return joined.select("path", "page_number", "idx", "png", "x0", "y0", "x1", "y1", "ok").mapInPandas(cut, "path string, page_number int, idx int, png binary")


def render_name(page: Column) -> Column:
    return F.format_string("page-%03d.png", page.cast("int"))


def crop_name(page: Column, index: Column) -> Column:
    return F.format_string("page-%03d-fig-%02d.png", page.cast("int"), index.cast("int"))
