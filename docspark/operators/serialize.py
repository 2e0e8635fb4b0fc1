"""Chunks and tables as JSON, Markdown, HTML and CSV: native expressions over the nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


def _pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def _rule(columns: Column) -> Column:
    return F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), columns))


def _pipe_table(rows: Column, columns: Column) -> Column:
    head = _pipe_row(F.get(rows, F.lit(0)))
    rest = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.concat(F.lit("\n"), _pipe_row(r)))
    return F.concat(head, _rule(columns), F.array_join(rest, ""))


def grid_to_markdown(table: Column) -> Column:
    rows = F.transform(table.rows, lambda r: F.transform(r, lambda c: c.text))
    return F.when((table["columns"] == 0) | (F.size(table.rows) == 0), "").otherwise(_pipe_table(rows, table["columns"]))


def text_to_markdown(text: Column) -> Column:
    """Tab-separated lines as a pipe table; fewer than two columns stay text."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"\r?\n\z", ""), r"\r\n", "\n"), "\n", -1)
    cells = F.transform(lines, lambda x: F.transform(F.split(x, "\t", -1), T.trim))
    wide = F.array_max(F.transform(cells, F.size))
    full = F.transform(cells, lambda r: F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))))
    return F.when(wide < 2, T.trim_end(text)).otherwise(_pipe_table(full, wide))


def table_to_csv(table: Column) -> Column:
    return F.array_join(F.transform(table.rows, lambda r: F.array_join(F.transform(r, lambda c: T.csv_field(c.text)), ",")), "\n")


def table_to_html(table: Column) -> Column:
    """A table with its spans: a fold over the rows carries how many rows below each column stays covered."""
    n, heads = table["columns"], F.least(table["header_rows"], F.size(table.rows))
    zero = F.array_repeat(F.lit(0), n)

    def row(acc: Column, r: Column) -> Column:
        tag = F.when(acc.ix < heads, "th").otherwise("td")
        start = F.struct(F.lit("").alias("html"), F.lit(0).alias("until"), acc.active.alias("active"))

        def one(c: Column, cell: Column) -> Column:
            held = F.get(c.active, cell.col)
            lower = lambda v: F.transform(c.active, lambda x, i: F.when(i == cell.col, v).otherwise(x))
            colspan = F.when(cell.col >= c.until, F.greatest(cell.colspan, F.lit(1))).otherwise(F.lit(1))
            rowspan = F.greatest(cell.rowspan, F.lit(1))
            attrs = F.concat(F.when(colspan > 1, F.concat(F.lit(' colspan="'), colspan.cast("string"), F.lit('"'))).otherwise(""), F.when(rowspan > 1, F.concat(F.lit(' rowspan="'), rowspan.cast("string"), F.lit('"'))).otherwise(""))
            html = F.concat(c.html, F.lit("<"), tag, attrs, F.lit(">"), T.html_escape(cell.text), F.lit("</"), tag, F.lit(">"))
            until = F.when(cell.col >= c.until, cell.col + colspan).otherwise(c.until)
            cover = F.when(rowspan > 1, F.transform(c.active, lambda x, i: F.when((i >= cell.col) & (i < cell.col + colspan), rowspan - 1).otherwise(x))).otherwise(c.active)
            shown = F.struct(html.alias("html"), until.alias("until"), cover.alias("active"))
            skipped = F.struct(c.html.alias("html"), c.until.alias("until"), lower(held - 1).alias("active"))
            return F.when(held > 0, skipped).when((cell.col < c.until) & (cell.text == ""), c).otherwise(shown)

        made = F.aggregate(r, start, one)
        both = F.struct(F.concat(F.lit("<tr>"), made.html, F.lit("</tr>")).alias("html"), made.active.alias("active"))
        return F.struct((acc.ix + 1).alias("ix"), both.active.alias("active"), F.concat(acc.html, F.when((acc.ix == 0) & (heads > 0), "<thead>").otherwise(""), F.when((acc.ix == heads), "<tbody>").otherwise(""), both.html, F.when((heads > 0) & (acc.ix + 1 == heads), "</thead>").otherwise(""), F.when((acc.ix + 1 == F.size(table.rows)) & (acc.ix >= heads), "</tbody>").otherwise("")).alias("html"))

    init = F.struct(F.lit(0).alias("ix"), zero.alias("active"), F.lit("").alias("html"))
    return F.concat(F.lit("<table>"), F.aggregate(table.rows, init, row, lambda a: a.html), F.lit("</table>"))


def chunk_markdown(kind: Column, text: Column, path: Column, table: Column) -> Column:
    level = F.least(F.size(path) + 1, F.lit(6))
    return (
        F.when(kind == "Heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), T.escape_block_markers(T.trim(text))))
        .when(kind.isin("Caption", "Figure"), F.concat(F.lit("*"), T.trim(text), F.lit("*")))
        .when(kind == "Table", F.when(table.isNull(), text_to_markdown(text)).otherwise(grid_to_markdown(table)))
        .when(kind == "List", T.trim_end(text))
        .otherwise(T.escape_block_markers(T.trim_end(text)))
    )


def to_markdown(chunks: DataFrame) -> DataFrame:
    """(doc_id, markdown): every chunk of a document in order; a blank line between, but none before the first text."""
    part = chunk_markdown(F.col("kind"), F.col("text"), F.col("heading_path"), F.col("table"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", part.alias("part")))), lambda x: x.part)
    joined = F.aggregate(parts, F.lit(""), lambda acc, p: F.when(acc == "", p).otherwise(F.concat(acc, F.lit("\n\n"), p)))
    return chunks.groupBy("doc_id").agg(joined.alias("markdown"))


JSON_FIELDS = ["id", "text", "context", "page", "bbox", "kind", "heading_path", "char_start", "char_len", "token_estimate"]


def chunk_json(pretty: bool = False) -> Column:
    """One chunk, lossless; table only where there is one, other nulls explicit."""
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})
    plain = F.to_json(F.struct(*JSON_FIELDS), options)
    return F.when(F.col("table").isNull(), plain).otherwise(F.to_json(F.struct(*JSON_FIELDS, "table"), options))


def to_json(chunks: DataFrame) -> DataFrame:
    """(doc_id, json): an array of a document's chunks in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", chunk_json().alias("part")))), lambda x: x.part)
    return chunks.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("json"))


def table_cells(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_ix, row, col, text, colspan, rowspan, bbox): the grids, a row for each cell."""
    rows = chunks.where("table is not null").select("doc_id", "chunk_ix", F.posexplode("table.rows").alias("row", "cells"))
    return rows.select("doc_id", "chunk_ix", "row", F.explode("cells").alias("c")).select("doc_id", "chunk_ix", "row", "c.col", "c.text", "c.colspan", "c.rowspan", "c.bbox")
