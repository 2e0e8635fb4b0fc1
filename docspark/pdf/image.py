"""Bitmaps: decoding a page's images, drawing them, PNG both ways. RGBA arrays of shape (height, width, 4)."""

from __future__ import annotations

import math
import struct
import zlib
from typing import Protocol

import numpy as np

from . import jpeg
from .document import Document
from .errors import PdfError
from .filters import unpredict
from .objects import Stream

DEFAULT_DPI, MAX_PIXELS, MAX_DIMENSION = 150.0, 4_000_000, 10_000


class Renderer(Protocol):
    """Draws one page."""

    def render(self, doc: Document, page: int, options: dict) -> np.ndarray: ...


def output_dimensions(w: float, h: float, *, width=None, height=None, dpi=None, scale=None, max_pixels: int = MAX_PIXELS, max_dimension: int = MAX_DIMENSION) -> tuple[int, int]:
    w, h = max(w, 1.0), max(h, 1.0)
    factor = dpi / 72 if dpi is not None else scale if scale is not None else DEFAULT_DPI / 72
    out_w = width if width is not None else height * w / h if height is not None else w * factor
    out_h = height if height is not None else width * h / w if width is not None else h * factor
    size = max(1, math.floor(out_w + 0.5)), max(1, math.floor(out_h + 0.5))
    if max(size) > max_dimension or size[0] * size[1] > max_pixels:
        raise PdfError("budget_exceeded", f"a page image of {size[0]} x {size[1]} is over the limit")
    return size


def decode_image(doc: Document, stream: Stream) -> np.ndarray | None:
    """8-bit gray or RGB samples, or a baseline JPEG; None for what is not supported."""
    get = doc.get
    w, h = get(stream.dict.get("Width")), get(stream.dict.get("Height"))
    if type(w) is not int or type(h) is not int or w <= 0 or h <= 0 or w * h > 1 << 28:
        return None
    data, left = doc.file.stream_parts(stream)
    if left in (["DCTDecode"], ["DCT"]):
        try:
            pixels = jpeg.decode(data)
        except (ValueError, IndexError, KeyError):
            return None
        return None if pixels is None else np.dstack([pixels, np.full(pixels.shape[:2], 255, np.uint8)])
    bits = get(stream.dict.get("BitsPerComponent"))
    n = {"DeviceGray": 1, "DeviceRGB": 3}.get(get(stream.dict.get("ColorSpace")))
    if left or n is None or bits not in (None, 8) or len(data) < w * h * n:
        return None
    samples = np.frombuffer(data, np.uint8, count=w * h * n).reshape(h, w, n)
    out = np.full((h, w, 4), 255, np.uint8)
    out[:, :, :3] = samples
    return out


class NativeRenderer:
    """Background and upright images; text and vector graphics are not drawn."""

    def render(self, doc: Document, page: int, options: dict) -> np.ndarray:
        d = doc.page(page)
        pw, ph = doc.size(d)
        opts = dict(options)
        clear = opts.pop("background", "white") == "transparent"
        w, h = output_dimensions(pw, ph, **opts)
        out = np.full((h, w, 4), 0 if clear else 255, np.uint8)
        found = doc.images(d)
        for name, m in doc.interpret(d).draws:
            self._draw(out, decode_image(doc, found[name][0]), m, w / max(pw, 1.0), h / max(ph, 1.0))
        return out

    @staticmethod
    def _draw(out: np.ndarray, image: np.ndarray | None, m: tuple, sx: float, sy: float) -> None:
        a, b, c, d, e, f = m
        if image is None or abs(b) > 1e-3 or abs(c) > 1e-3:
            return
        h, w = out.shape[:2]
        left, right = max(0, math.floor(min(e, e + a) * sx)), min(w, math.ceil(max(e, e + a) * sx))
        top, bottom = max(0, math.floor(h - max(f, f + d) * sy)), min(h, math.ceil(h - min(f, f + d) * sy))
        if right <= left or bottom <= top:
            return
        pick = lambda n, size: np.minimum((np.arange(n) / n * size).astype(int), size - 1)  # noqa: E731  the nearest sample
        out[top:bottom, left:right] = image[np.ix_(pick(bottom - top, image.shape[0]), pick(right - left, image.shape[1]))]


def crop(bitmap: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return bitmap[max(0, y) : max(0, y) + max(0, h), max(0, x) : max(0, x) + max(0, w)]


def crop_region(bitmap: np.ndarray, page_w: float, page_h: float, box: tuple[float, float, float, float]) -> np.ndarray:
    """A box in points of a page's bitmap."""
    h, w = bitmap.shape[:2]
    sx, sy = w / max(page_w, 1.0), h / max(page_h, 1.0)
    left, right = math.floor(min(box[0], box[2]) * sx), math.ceil(max(box[0], box[2]) * sx)
    top, bottom = math.floor(h - max(box[1], box[3]) * sy), math.ceil(h - min(box[1], box[3]) * sy)
    left, top = max(0, left), max(0, top)
    return crop(bitmap, left, top, right - left, bottom - top)


def encode_png(bitmap: np.ndarray, compress: bool = True) -> bytes:
    if bitmap.ndim != 3 or bitmap.shape[2] != 4 or bitmap.dtype != np.uint8:
        raise PdfError("backend_error", "a bitmap has four bytes for each pixel")
    h, w = bitmap.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(bitmap).reshape(h, w * 4)], axis=1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6 if compress else 0)) + part(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """RGB of a PNG of 8 bits, not interlaced; shape (height, width, 3)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise PdfError("backend_error", "not a PNG")
    at, body, palette = 8, [], None
    w = h = bits = kind = lace = 0
    while at + 8 <= len(data):
        n, name = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            w, h, bits, kind, _, _, lace = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(part)
        at += 12 + n
    colors = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if bits != 8 or colors is None or lace or w * h > 1 << 28:
        raise PdfError("backend_error", "this kind of PNG is not supported")
    raw = unpredict(zlib.decompress(b"".join(body)), {"Predictor": 15, "Colors": colors, "BitsPerComponent": 8, "Columns": w})
    a = np.frombuffer(raw, np.uint8, count=w * h * colors).reshape(h, w, colors)
    if kind == 3:
        return palette[a[:, :, 0]]
    return a[:, :, :3] if kind in (2, 6) else np.repeat(a[:, :, :1], 3, axis=2)
