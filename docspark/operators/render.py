"""Page images and OCR: plug-in renderers and recognisers that run in tasks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..pdf.document import Document
from ..pdf.errors import PdfError
from ..pdf.image import NativeRenderer, Renderer, crop_region, decode_png, encode_png

IMAGE = "struct<width:int,height:int,png:binary,error:string>"
_IMAGE_ARROW = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("png", pa.binary()), ("error", pa.string())])
OCR = "struct<text:string,confidence:double,words:array<struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>,error:string>"
_WORD = pa.struct([("text", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "confidence"))])
_OCR_ARROW = pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("words", pa.list_(_WORD)), ("error", pa.string())])
OCR_DPI, OCR_MAX_PIXELS = 300, 30_000_000
RENDERERS: dict[str, Callable[[], Renderer]] = {"native": NativeRenderer}


def renderer(name: str = "auto") -> Callable[[], Renderer]:
    """A registered renderer; auto is the native one unless another is registered as 'pdfium'."""
    if name == "auto":
        return RENDERERS.get("pdfium", NativeRenderer)
    if name not in RENDERERS:
        raise PdfError("not_implemented", f"no renderer {name!r}")
    return RENDERERS[name]


def render(content: Column, page: Column, *, backend: str = "auto", compress: bool = True, **options) -> Column:
    """Struct (width, height, png, error) of a page. options: width, height, dpi, scale, background, max_pixels, max_dimension."""
    make = renderer(backend)

    def of(content: pa.Array, page: pa.Array) -> pa.Array:
        own, out, doc, held = make(), [], None, None
        for data, n in zip(content.to_pylist(), page.to_pylist(), strict=True):
            try:
                if doc is None or data != held:  # pages of one document mostly follow each other
                    doc, held = None, data
                    doc = Document(data or b"")
                bitmap = own.render(doc, n, options)
                out.append({"width": bitmap.shape[1], "height": bitmap.shape[0], "png": encode_png(bitmap, compress), "error": None})
            except PdfError as e:
                out.append({"width": None, "height": None, "png": None, "error": e.code})
            except Exception:  # one broken page is a row, not a failed job
                out.append({"width": None, "height": None, "png": None, "error": "internal"})
        return pa.array(out, _IMAGE_ARROW)

    return F.arrow_udf(of, IMAGE)(content, page)


def crop(content: Column, page: Column, box: Column, *, backend: str = "auto", **options) -> Column:
    """A box (array of four numbers, in points) of a page's image."""
    make = renderer(backend)

    def of(content: pa.Array, page: pa.Array, box: pa.Array) -> pa.Array:
        own, out = make(), []
        for data, n, b in zip(content.to_pylist(), page.to_pylist(), box.to_pylist(), strict=True):
            try:
                doc = Document(data or b"")
                part = crop_region(own.render(doc, n, options), *doc.size(doc.page(n)), tuple(b))
                out.append({"width": part.shape[1], "height": part.shape[0], "png": encode_png(part) if part.size else None, "error": None})
            except PdfError as e:
                out.append({"width": None, "height": None, "png": None, "error": e.code})
        return pa.array(out, _IMAGE_ARROW)

    return F.arrow_udf(of, IMAGE)(content, page, box)


def ocr(png: Column, provider: Callable[[], Callable]) -> Column:
    """Struct (text, confidence, words, error). provider makes a recogniser once for each batch: a function of an RGB array to such a dict."""

    def of(png: pa.Array) -> pa.Array:
        out, own = [], None
        for data in png.to_pylist():
            try:
                own = own or provider()
                got = own(decode_png(data))
                out.append({"text": got.get("text", ""), "confidence": got.get("confidence"), "words": got.get("words", []), "error": None})
            except Exception as e:  # a page that is not recognised falls back to its image
                out.append({"text": None, "confidence": None, "words": None, "error": getattr(e, "code", "backend_error")})
        return pa.array(out, _OCR_ARROW)

    return F.arrow_udf(of, OCR)(png)


def extract_with_ocr(docs: DataFrame, page_texts: DataFrame, kinds: DataFrame, provider: Callable[[], Callable], *, min_text_chars: int = 200, content: str = "content") -> DataFrame:
    """(doc_id, page, text, recognised, png): pages of too little text in documents of too little are recognised if they are scans or images.

    A page that is recognised has the new text and no image; another such page keeps its text and has an image."""
    from .extract import low_text_pages

    low = low_text_pages(page_texts, min_text_chars=min_text_chars).join(kinds.select("doc_id", "page", "kind"), ["doc_id", "page"]).join(docs.select("doc_id", F.col(content).alias("_c")), "doc_id")
    drawn = low.withColumn("_i", F.when(F.col("kind").isin("Scanned", "ImageOnly"), render(F.col("_c"), F.col("page"), dpi=OCR_DPI, max_pixels=OCR_MAX_PIXELS)))
    read = drawn.withColumn("_o", F.when(F.col("_i.png").isNotNull(), ocr(F.col("_i.png"), provider)))
    kept = read.select("doc_id", "page", F.col("_o.text").alias("_text"), F.when(F.col("_o.text").isNull(), render(F.col("_c"), F.col("page"))).alias("_image"))
    out = page_texts.join(kept, ["doc_id", "page"], "left")
    return out.select("doc_id", "page", F.coalesce("_text", F.coalesce("text", F.lit(""))).alias("text"), F.col("_text").isNotNull().alias("recognised"), F.col("_image.png").alias("png"))


