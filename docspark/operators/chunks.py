"""Blocks and chunks: body size, block grouping, packing, provenance."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .. import schema
from ..core import blocks as core, captions
from ..core.layout import Line
from ..functions import text as T
from .grouped import of_groups, record_batch
from .layout import RUN_COLUMNS, id_type

SEPARATOR = "\n\n"


def body_size(runs: DataFrame) -> DataFrame:
    """(doc_id, body): the most frequent size in whole points, the smaller of ties."""
    counts = runs.groupBy("doc_id", F.round("font_size").alias("size")).agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.min_by("size", F.struct((-F.col("n")).alias("n"), F.col("size"))).alias("body"))


def _block_rows(key: tuple, blocks: list[core.Block]):
    for k, b in enumerate(blocks):
        yield (*key, k, b.page, b.kind, b.text, b.bbox, b.size, b.column, b.table)


def _chunk_rows(key: tuple, made: list[dict]):
    at = 0
    for k, c in enumerate(made):
        yield (*key, k, c["page"], c["kind"], c["text"], c["heading_path"], c["bbox"], c["token_estimate"], c["table"], at, len(c["text"]))
        at += len(c["text"]) + len(SEPARATOR)


def _pages(page: list, runs: list[list]) -> dict[int, dict]:
    out: dict[int, dict] = {}
    for p, run in zip(page, zip(*runs, strict=True), strict=True):
        if p not in out:
            out[p] = {"runs": [], "images": [], "rules": []}
        out[p]["runs"].append(run)
    return out


def blocks(runs: DataFrame) -> DataFrame:
    """Runs to blocks, one group for each document: body size, lines and blocks in one pass after one shuffle."""

    def of(key: tuple, cols: list[list]):
        return _block_rows(key, core.geometry_blocks(_pages(cols[0], cols[1:])))

    return of_groups(runs, ["doc_id"], ["page", "run_ix"], ["page", *RUN_COLUMNS], of, schema.of(schema.BLOCKS, id_type(runs)))


def blocks_with(runs: DataFrame, draws: DataFrame, rules: DataFrame) -> DataFrame:
    """Blocks of pages that have images or rules besides text: the three tables meet by document, in one narrow layout."""
    wide = [f"v{i}" for i in range(6)]

    def side(df: DataFrame, part: int, ix: str, text: str | None, values: list[str]) -> DataFrame:
        own = [F.col(c).cast("double") for c in values] + [F.lit(None).cast("double")] * (len(wide) - len(values))
        return df.select("doc_id", F.lit(part).alias("part"), "page", F.col(ix).cast("bigint").alias("ix"), (F.col(text) if text else F.lit(None).cast("string")).alias("text"), *(c.alias(w) for c, w in zip(own, wide, strict=True)))

    rows = side(runs, 0, "run_ix", "text", list(RUN_COLUMNS[1:])).unionByName(side(draws, 1, "draw_ix", None, list("abcdef"))).unionByName(side(rules, 2, "line_ix", None, ["vertical", "pos", "lo", "hi"]))

    def of(key: tuple, cols: list[list]):
        pages: dict[int, dict] = {}
        for part, p, text, *v in zip(*cols, strict=True):
            if p not in pages:
                pages[p] = {"runs": [], "images": [], "rules": []}
            if part == 0:
                pages[p]["runs"].append((text, *v[:5]))
            elif part == 1:
                pages[p]["images"].append(tuple(v))
            else:
                pages[p]["rules"].append((v[0] == 1.0, *v[1:4]))
        return _block_rows(key, core.geometry_blocks(pages))

    return of_groups(rows, ["doc_id"], ["part", "page", "ix"], ["part", "page", "text", *wide], of, schema.of(schema.BLOCKS, id_type(runs)))


def group_blocks(lines: DataFrame, body: DataFrame) -> DataFrame:
    """Lines and body sizes to blocks, where the lines are already there."""
    joined = lines.join(body, "doc_id", "left").withColumn("body", F.coalesce("body", F.lit(core.DEFAULT_BODY)))

    def of(key: tuple, cols: list[list]):
        pages: dict[int, list[Line]] = {}
        for page, text, y, x0, x1, size, gaps, cells, column, _ in zip(*cols, strict=True):
            pages.setdefault(page, []).append(Line(text, y, x0, x1, size, gaps, [[c["text"], c["x0"], c["x1"]] for c in cells], column))
        return _block_rows(key, [b for page, own in pages.items() for b in core.group_blocks(own, cols[-1][0], page)])

    return of_groups(joined, ["doc_id"], ["page", "line_ix"], ["page", "text", "y", "x0", "x1", "size", "gap_xs", "cells", "column", "body"], of, schema.of(schema.BLOCKS, id_type(lines)))


def heading_paths(blocks_: DataFrame) -> DataFrame:
    """blocks with heading_path: the headings above, outermost first. One pass over each document's blocks."""
    names = [f.name for f in blocks_.schema.fields if f.name not in ("doc_id", "heading_path")]
    at = {n: names.index(n) for n in ("kind", "size", "text")}

    def of(key: tuple, cols: list[list]):
        stack: list[tuple[float, str]] = []
        for row in zip(*cols, strict=True):
            heading = row[at["kind"]] == "Heading"
            while heading and stack and stack[-1][0] <= row[at["size"]]:
                stack.pop()
            yield (*key, *row, [t for _, t in stack])
            if heading:
                stack.append((row[at["size"]], row[at["text"]]))

    ddl = ", ".join([f"doc_id {id_type(blocks_)}", *(f"`{n}` {blocks_.schema[n].dataType.simpleString()}" for n in names), "heading_path array<string>"])
    return of_groups(blocks_, ["doc_id"], ["block_ix"], names, of, ddl)


def pack(blocks_: DataFrame, *, target_tokens: int = 512, overlap_tokens: int = 0) -> DataFrame:
    """Blocks to chunks: greedy over each document's blocks in order."""

    def of(key: tuple, cols: list[list]):
        own = [core.Block(text, page, kind, bbox, size, column, table=table) for text, page, kind, bbox, size, column, table in zip(*cols, strict=True)]
        return _chunk_rows(key, core.pack(own, target_tokens=target_tokens, overlap_tokens=overlap_tokens))

    return of_groups(blocks_, ["doc_id"], ["block_ix"], ["text", "page", "kind", "bbox", "size", "column", "table"], of, schema.of(schema.CHUNKS, id_type(blocks_)))


def chunk_runs(runs: DataFrame, *, target_tokens: int = 512, overlap_tokens: int = 0) -> DataFrame:
    """Runs to chunks in one grouped pass: one shuffle by document, then lines, blocks and packing together."""

    def of(key: tuple, cols: list[list]):
        return _chunk_rows(key, core.pack(core.geometry_blocks(_pages(cols[0], cols[1:])), target_tokens=target_tokens, overlap_tokens=overlap_tokens))

    return of_groups(runs, ["doc_id"], ["page", "run_ix"], ["page", *RUN_COLUMNS], of, schema.of(schema.CHUNKS, id_type(runs)))


def stable_id(page: Column, kind: Column, text: Column) -> Column:
    """FNV-1a over page, kind and text, as 16 hex digits; equal contents share an id by design."""

    def of(page: pa.Array, kind: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array([captions.stable_id(p, k, t) for p, k, t in zip(page.to_pylist(), kind.to_pylist(), text.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(of, "string")(page.cast("bigint"), kind, text)


def finalize(chunks: DataFrame, *, titles: DataFrame | None = None, contextual_prefix: bool = False, with_id: bool = True) -> DataFrame:
    """chunks with id, and context if asked for; char_start and char_len where packing has not told them. Native but for the id."""
    out = chunks if "char_start" in chunks.columns else offsets(chunks)
    if with_id:
        out = out.withColumn("id", stable_id(F.col("page"), F.col("kind"), F.col("text")))
    if not contextual_prefix:
        return out.withColumn("context", F.lit(None).cast("string"))
    if titles is not None:
        out = out.join(titles.select("doc_id", F.col("title").alias("_title")), "doc_id", "left")
    else:
        out = out.withColumn("_title", F.lit(None).cast("string"))
    return out.withColumn("context", T.context_prefix(F.col("_title"), F.col("heading_path"), F.col("page"))).drop("_title")


def offsets(chunks: DataFrame) -> DataFrame:
    """chunks with char_start and char_len in the document's text: a running sum."""
    w = Window.partitionBy("doc_id").orderBy("chunk_ix").rowsBetween(Window.unboundedPreceding, -1)
    out = chunks.withColumn("char_len", F.length("text").cast("bigint"))
    return out.withColumn("char_start", F.coalesce(F.sum(F.col("char_len") + len(SEPARATOR)).over(w), F.lit(0)).cast("bigint"))


def document_text(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): the chunks' texts joined; char_start and char_len slice it."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", "text"))), lambda x: x.text), SEPARATOR)
    return chunks.groupBy("doc_id").agg(joined.alias("text"))


def chunk_parsed(parsed: DataFrame, *, target_tokens: int = 512, overlap_tokens: int = 0, contextual_prefix: bool = False) -> DataFrame:
    """Nested rows of sources.pdf to finished chunks: by tags where a document has any that make blocks, else by layout.

    All of a document is in its row, so nothing is shuffled."""
    from ..core.single import chunk_parsed as of_one
    from ..sources.pdf import NESTED

    ddl = schema.of(schema.CHUNKS, id_type(parsed)) + ", id string, context string"
    fields = StructType.fromDDL(ddl)
    names, kinds = fields.fieldNames(), [to_arrow_type(f.dataType) for f in fields.fields]

    def of(batches):
        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                made = of_one(r, target_tokens=target_tokens, overlap_tokens=overlap_tokens, contextual_prefix=contextual_prefix)
                rows += [(*x, c["id"], c["context"]) for x, c in zip(_chunk_rows((r["doc_id"],), made), made, strict=True)]
            if rows:
                yield record_batch(rows, names, kinds)

    whole = parsed.where("error is null").select("doc_id", "meta", "tagged", *NESTED)
    return whole.mapInArrow(of, ddl)
