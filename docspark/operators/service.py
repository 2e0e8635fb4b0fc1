"""What a server would call, batch-wise: requests in, answers with a status out.

A request is (request_id, operation, files array<binary>, options JSON). An answer is (request_id, status, code, message, json,
files): JSON for readings, files for documents and images. Details of a backend's error are not passed on."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..core import single
from ..pdf.document import Document, parse
from ..pdf.errors import STATUS, PdfError
from ..pdf.image import NativeRenderer, encode_png
from ..pdf.writer import Editor

SCAN_PAGES = 5000
ANSWER = "request_id {id}, status int, code string, message string, json string, files array<binary>"


def status_of(code: Column) -> Column:
    """The HTTP status of an error code; 200 without one."""
    table = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    return F.when(code.isNull(), 200).otherwise(F.coalesce(table[code], F.lit(500)))


def public_message(code: Column, message: Column) -> Column:
    return F.when(code.isin("backend_error", "internal"), "the document could not be processed").otherwise(message)


def _bounded(data: bytes, o: dict, want: tuple[str, ...]) -> dict:
    return parse(data, o.get("password"), max_pages=SCAN_PAGES, want=want)


def _metadata(files: list[bytes], o: dict):
    got = _bounded(files[0], o, ("outline", "links"))
    links: dict[int, list] = {}
    for x in got["links"]:
        links.setdefault(x["page"], []).append({k: v for k, v in x.items() if k not in ("page", "link_ix") and v is not None})
    return {"metadata": got["meta"], "outline": single.outline_tree(got["outline"]), "links": [{"page": p, "links": x} for p, x in sorted(links.items())]}


def _figures(files: list[bytes], o: dict):
    pages: dict[int, list] = {}
    for x in single.figures(_bounded(files[0], o, ("runs", "draws"))):
        pages.setdefault(x["page"], []).append({"bbox": x["bbox"], "caption": x["caption"]})
    return [{"page": p, "figures": x} for p, x in sorted(pages.items())]


def _chunks(files: list[bytes], o: dict):
    made = single.chunk_document(files[0], o.get("password"), target_tokens=int(o.get("target_tokens", 512)), overlap_tokens=int(o.get("overlap_tokens", 0)), contextual_prefix=bool(o.get("contextual_prefix", False)))
    return {"chunks": json.loads(single.to_json(made)), "document_text": single.document_text(made)}


def _extract(files: list[bytes], o: dict):
    mode = o.get("mode", "auto")
    if mode not in ("auto", "text", "images", "both"):
        raise PdfError("bad_options", f"no mode {mode!r}")
    got = parse(files[0], o.get("password"), pages=o.get("pages"), max_pages=int(o.get("max_pages", 20)), want=("runs",))
    texts, least = single.page_texts(got), int(o.get("min_text_chars", 200))
    count = lambda t: sum(not c.isspace() for c in t)
    total = sum(map(count, texts))
    text, cut = single.join_capped(texts, int(o.get("max_text_chars", 200_000)))
    wanted = [p["page"] for p, t in zip(got["pages"], texts, strict=True) if mode in ("images", "both") or mode == "auto" and total < least and count(t) < least]
    images, used, short, doc = [], 0, False, Document(files[0], o.get("password"))
    for page in wanted:
        try:
            bitmap = NativeRenderer().render(doc, page, o.get("image") or {})
        except PdfError as e:
            if e.code == "budget_exceeded":
                short = True
                break
            continue
        used += bitmap.shape[0] * bitmap.shape[1]
        if used > 4_000_000:
            short = True
            break
        images.append({"page": page, "width": bitmap.shape[1], "height": bitmap.shape[0], "png_base64": base64.b64encode(encode_png(bitmap)).decode()})
    return {"text": "" if mode == "images" else text, "page_images": images, "pages_processed": [p["page"] for p in got["pages"]], "truncated": {"text": cut and mode != "images", "images": short}}


def _merged(files: list[bytes], o: dict) -> list[bytes]:
    if len(files) < 2:
        raise PdfError("expected_multiple_files", "a merge takes two files or more")
    first = Editor(files[0])
    for x in files[1:]:
        first.merge(Editor(x))
    return [first.save()]


def _split(files: list[bytes], o: dict) -> list[bytes]:
    if not o.get("ranges"):
        raise PdfError("empty_ranges", "no ranges")
    return Editor(files[0]).split([tuple(r) for r in o["ranges"]])


def _changed(change: Callable[[Editor, dict], None]) -> Callable[[list[bytes], dict], list[bytes]]:
    def work(files: list[bytes], o: dict) -> list[bytes]:
        e = Editor(files[0])
        change(e, o)
        return [e.save()]

    return work


def _rotate(e: Editor, o: dict) -> None:
    if int(o["degrees"]) % 90:
        raise PdfError("invalid_degrees", "a rotation is a multiple of 90 degrees")
    e.rotate_page(int(o["page"]), int(o["degrees"]))


def _render(files: list[bytes], o: dict) -> list[bytes]:
    options = {k: o[k] for k in ("width", "height", "dpi", "scale", "background") if k in o}
    return [encode_png(NativeRenderer().render(Document(files[0], o.get("password")), int(o.get("page", 1)), options))]


READINGS = {"metadata": _metadata, "figures": _figures, "chunks": _chunks, "extract": _extract, "structure": lambda f, o: single.structure_tree(_bounded(f[0], o, ("runs", "structure"))) or {"tagged": False}, "outline": lambda f, o: single.outline_tree(_bounded(f[0], o, ("outline",))["outline"])}
CHANGES = {"merge": _merged, "split": _split, "rotate": _changed(_rotate), "watermark": _changed(lambda e, o: e.watermark(o["text"])), "fill": _changed(lambda e, o: e.fill_form(o["fields"])), "render": _render}
NEEDS = {"split": ("ranges",), "rotate": ("page", "degrees"), "watermark": ("text",), "fill": ("fields",)}


def answer(operation: str, files: list[bytes] | None, options: str | None) -> tuple[str | None, list[bytes] | None]:
    """(JSON, files) of one request; raises PdfError with the code to answer with."""
    files = files or []
    if operation not in READINGS and operation not in CHANGES:
        raise PdfError("not_implemented", f"no operation {operation!r}")
    if operation != "merge" and len(files) != 1:
        raise PdfError("expected_one_file", "one file is expected")
    for data in files:
        if b"%PDF-" not in (data or b"")[:1024]:
            raise PdfError("not_a_pdf", "no PDF signature")
    try:
        o = json.loads(options) if options and options.strip() else {}
    except ValueError as e:
        raise PdfError("bad_options", "options are no JSON") from e
    if not isinstance(o, dict):
        raise PdfError("bad_options", "options are no object")
    if missing := [k for k in NEEDS.get(operation, ()) if k not in o]:
        raise PdfError("empty_ranges" if missing == ["ranges"] and o else "missing_options", f"options lack {', '.join(missing)}")
    if operation in READINGS:
        return json.dumps(READINGS[operation](files, o), ensure_ascii=False), None
    return None, CHANGES[operation](files, o)


def answers(requests: DataFrame) -> DataFrame:
    """Answers to requests, a row for each; no request fails the job."""
    kind = requests.schema["request_id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    types = [id_type, pa.string(), pa.string(), pa.string(), pa.list_(pa.binary())]
    names = ["request_id", "code", "message", "json", "files"]

    def of(batches):
        for b in batches:
            for rid, operation, files, options in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                code = message = body = out = None
                try:
                    body, out = answer(operation, files, options)
                except PdfError as e:
                    code, message = e.code, e.message
                except (KeyError, TypeError, ValueError) as e:
                    code, message = "bad_options", f"{type(e).__name__}: {e}"[:200]
                except Exception as e:  # a request that breaks is answered, the others still run
                    code, message = "internal", type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((rid, code, message, body, out), types, strict=True)], names=names)

    made = requests.select("request_id", "operation", "files", "options").mapInArrow(of, f"request_id {kind}, code string, message string, json string, files array<binary>")
    return made.select("request_id", status_of(F.col("code")).alias("status"), "code", public_message(F.col("code"), F.col("message")).alias("message"), "json", "files")
