"""Lines, columns and page texts as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema
from ..core import layout as core
from .grouped import of_groups

RUN_COLUMNS = ["text", "x0", "y0", "x1", "y1", "font_size"]


def id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def lines(runs: DataFrame) -> DataFrame:
    """Runs to the lines of each page, in reading order: one shuffle by page, each page a group of its own."""

    def of(key: tuple, cols: list[list]):
        for k, ln in enumerate(core.group_lines(list(zip(*cols, strict=True)))):
            cells = [{"text": t, "x0": a, "x1": b} for t, a, b in ln.cells]
            yield (*key, k, ln.column, ln.text, ln.y, ln.x0, ln.x1, ln.size, ln.gap_xs, cells)

    return of_groups(runs, ["doc_id", "page"], ["run_ix"], RUN_COLUMNS, of, schema.of(schema.LINES, id_type(runs)))


def median_size(runs: DataFrame) -> DataFrame:
    """(doc_id, page, median): the upper median of sizes over half a point, 12 where there is none."""
    sizes = F.array_sort(F.filter(F.collect_list("font_size"), lambda s: s > 0.5))
    rows = runs.groupBy("doc_id", "page").agg(sizes.alias("s"))
    return rows.select("doc_id", "page", F.when(F.size("s") > 0, F.get("s", F.floor(F.size("s") / 2).cast("int"))).otherwise(core.DEFAULT_SIZE).alias("median"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def page_text(lines_: DataFrame) -> DataFrame:
    """(doc_id, page, text): lines joined, a blank line where a paragraph or column ends. Native."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_ix")
    before_y, before_column = F.lag("y").over(w), F.lag("column").over(w)
    wide = (before_column != F.col("column")) | (before_y - F.col("y") > core.PARAGRAPH_GAP * F.col("size"))
    glue = F.when(before_y.isNull(), "").when(wide, "\n\n").otherwise("\n")
    parts = lines_.select("doc_id", "page", "line_ix", F.concat(glue, trimmed(F.col("text"))).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "part"))), lambda x: x.part), "")
    return parts.groupBy("doc_id", "page").agg(joined.alias("text"))
