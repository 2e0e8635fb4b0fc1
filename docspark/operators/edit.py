"""The write path: documents in a binary column to documents in a binary column.

Each function gives a column of struct (value, error): a document that cannot be changed has a null value and the
error's code."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..pdf.document import Document, parse
from ..pdf.errors import PdfError
from ..pdf.writer import A4, LETTER, Builder, Editor
from .grouped import of_groups

OPS = "doc_id {id}, page int, op_ix int, kind string, text string, x double, y double, size double, font string"


def _guarded(kind: pa.DataType, ddl: str, work: Callable) -> Callable[..., Column]:
    """A function of columns: work's value and error for each row."""
    arrow = pa.struct([("value", kind), ("error", pa.string())])

    def row(args: tuple) -> dict:
        if args[0] is None:
            return {"value": None, "error": "malformed_pdf"}
        try:
            return {"value": work(*args), "error": None}
        except PdfError as e:
            return {"value": None, "error": e.code}
        except Exception:  # one broken document is a row, not a failed job
            return {"value": None, "error": "internal"}

    def one(a: pa.Array) -> pa.Array:
        return pa.array([row((x,)) for x in a.to_pylist()], arrow)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([row(x) for x in zip(a.to_pylist(), b.to_pylist(), strict=True)], arrow)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array([row(x) for x in zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), strict=True)], arrow)

    return lambda *cols: F.arrow_udf({1: one, 2: two, 3: three}[len(cols)], f"struct<value:{ddl},error:string>")(*cols)


def _merge(parts: list[bytes]) -> bytes:
    if len(parts) < 2:
        raise PdfError("expected_multiple_files", "a merge takes two documents or more")
    first = Editor(parts[0])
    for x in parts[1:]:
        first.merge(Editor(x))
    return first.save()


def merge(contents: Column) -> Column:
    """An array of documents as one, in order."""
    return _guarded(pa.binary(), "binary", _merge)(contents)


def merge_groups(docs: DataFrame, *, by: str, order: str, content: str = "content") -> DataFrame:
    """(by, merged): the documents of each group as one, in order. A group is one document in the end, so it has to fit into a row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c")))), lambda x: x.c)
    return docs.groupBy(by).agg(parts.alias("parts")).select(by, merge(F.col("parts")).alias("merged"))


def _split(data: bytes, ranges: list) -> list[bytes]:
    if not ranges:
        raise PdfError("empty_ranges", "no ranges")
    return Editor(data).split([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in ranges])


def split(content: Column, ranges: Column) -> Column:
    """A document for each inclusive range (array of [first, last])."""
    return _guarded(pa.list_(pa.binary()), "array<binary>", _split)(content, ranges)


def _edited(change: Callable) -> Callable:
    def work(data: bytes, *args) -> bytes:
        e = Editor(data)
        change(e, *args)
        return e.save()

    return work


def remove_pages(content: Column, pages: Column) -> Column:
    return _guarded(pa.binary(), "binary", _edited(lambda e, p: e.remove_pages(p)))(content, pages)


def _rotate(e: Editor, page: int, degrees: int) -> None:
    if degrees % 90:
        raise PdfError("invalid_degrees", "a rotation is a multiple of 90 degrees")
    e.rotate_page(page, degrees)


def rotate_page(content: Column, page: Column, degrees: Column) -> Column:
    return _guarded(pa.binary(), "binary", _edited(_rotate))(content, page, degrees)


def watermark(content: Column, text: Column, *, size: float = 48.0, gray: float = 0.75, degrees: float = 45.0) -> Column:
    return _guarded(pa.binary(), "binary", _edited(lambda e, t: e.watermark(t, size=size, gray=gray, degrees=degrees)))(content, text)


def fill_form(content: Column, values: Column) -> Column:
    """values: a map of field names to values."""
    return _guarded(pa.binary(), "binary", _edited(lambda e, v: e.fill_form(dict(v))))(content, values)


def form_field_value(content: Column, name: Column) -> Column:
    return _guarded(pa.string(), "string", lambda data, n: Editor(data).form_field_value(n))(content, name)


def page_count(content: Column, password: Column | None = None) -> Column:
    return _guarded(pa.int32(), "int", lambda data, p=None: Document(data, p).page_count)(content, *([password] if password is not None else []))


def extract_text(content: Column, password: Column | None = None) -> Column:
    """The whole text of a document, pages joined by line ends."""
    from ..core.layout import group_lines, reflow

    def work(data: bytes, password: str | None = None) -> str:
        got = parse(data, password, want=("runs",))
        runs: dict[int, list] = {p["page"]: [] for p in got["pages"]}
        for r in got["runs"]:
            runs[r["page"]].append((r["text"], r["x0"], r["y0"], r["x1"], r["y1"], r["font_size"]))
        out = ""
        for page in sorted(runs):
            out += ("\n" if out else "") + reflow(group_lines(runs[page]))
        return out

    return _guarded(pa.string(), "string", work)(content, *([password] if password is not None else []))


def zip_parts(parts: Column) -> Column:
    """Documents as a zip of part-000.pdf and so on."""

    def work(parts: list[bytes]) -> bytes:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for i, x in enumerate(parts):
                z.writestr(zipfile.ZipInfo(f"part-{i:03}.pdf", (1980, 1, 1, 0, 0, 0)), x, zipfile.ZIP_DEFLATED)
        return held.getvalue()

    return _guarded(pa.binary(), "binary", work)(parts)


def build(ops: DataFrame, *, page_size: tuple[float, float] = LETTER, titles: DataFrame | None = None, classic: bool = False, compress: bool = True) -> DataFrame:
    """(doc_id, content): a document drawn from rows (doc_id, page, op_ix, text, x, y, size, font), one group for each."""
    kind = ops.schema["doc_id"].dataType.simpleString()
    rows = ops.select("doc_id", "page", "op_ix", "text", "x", "y", "size", "font")
    rows = rows.withColumn("title", F.lit(None).cast("string")) if titles is None else rows.join(titles.select("doc_id", "title"), "doc_id", "left")

    def of(key: tuple, cols: list[list]):
        b = Builder(title=cols[-1][0], compress=compress)
        for _ in range(cols[0][-1]):
            b.add_page(page_size)
        for page, text, x, y, size, font, _ in zip(*cols, strict=True):
            if text is not None:
                b.draw_text(page - 1, text, (x, y), font=font or "Helvetica", size=size)
        yield (*key, b.save_classic() if classic else b.save())

    return of_groups(rows, ["doc_id"], ["page", "op_ix"], ["page", "text", "x", "y", "size", "font", "title"], of, f"doc_id {kind}, content binary")


SIZES = {"letter": LETTER, "a4": A4}
