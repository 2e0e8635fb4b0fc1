"""Positioned runs out of plain text: a layout that is known by construction, from native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LINES_PER_PAGE, TOP, STEP, LEFT = 40, 740.0, 18.0, 72.0
SIZES = ((17, 22.0), (9, 16.0))  # every 17th line is a chapter, every 9th a section
BODY = 11.0
CAPTION_EVERY, ITEM_EVERY = 7, 5


def line_size(n: Column) -> Column:
    out = F.when(n % SIZES[0][0] == 0, SIZES[0][1])
    for every, size in SIZES[1:]:
        out = out.when(n % every == 0, size)
    return out.otherwise(BODY)


def line_text(n: Column, text: Column) -> Column:
    """The line itself, announced as a caption or list item at fixed places."""
    return F.when(n % CAPTION_EVERY == 3, F.concat(F.lit("Figure "), n.cast("string"), F.lit(": "), text)).when(n % ITEM_EVERY == 2, F.concat(F.lit("- "), text)).otherwise(text)


def text_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line): the lines of a text that are not empty; a null text has none."""
    split = docs.select(F.col(id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    return split.where("line <> ''")


def synthetic_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text", step: float = STEP) -> DataFrame:
    """Runs of RUNS's columns: one for each line that is not empty; empty lines leave their gap."""
    n = F.col("line_no")
    rows = text_lines(docs, id=id, text=text).select("doc_id", n, line_size(n).alias("font_size"), line_text(n, F.col("line")).alias("text"))
    y = F.lit(TOP) - step * (n % LINES_PER_PAGE)
    return rows.select(
        "doc_id", (F.floor(n / LINES_PER_PAGE) + 1).cast("int").alias("page"), n.cast("bigint").alias("run_ix"), "text", F.lit(LEFT).alias("x0"), y.alias("y0"),
        (LEFT + F.length("text") * 0.5 * F.col("font_size")).alias("x1"), (y + F.col("font_size")).alias("y1"), "font_size", F.lit(None).cast("bigint").alias("mcid"),
    )


def word_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A run for each word of a line, side by side."""
    words = text_lines(docs, id=id, text=text).select("doc_id", "line_no", F.posexplode(F.filter(F.split("line", " +"), lambda w: w != "")).alias("word_no", "text"))
    n = F.col("line_no")
    w = Window.partitionBy("doc_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    x0 = LEFT + F.coalesce(F.sum(F.length("text") * 0.5 * BODY + 5.5).over(w), F.lit(0.0))
    return _body_runs(words, (F.floor(n / LINES_PER_PAGE) + 1), n * 1_000_000 + F.col("word_no"), x0, TOP - STEP * (n % LINES_PER_PAGE))


GRID_COLUMNS, GRID_ROWS, GRID_STEP = 3, 4, 2000.0


def grid_pages(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, page, n): the rows on each page of grid_runs, counted without laying out a word."""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    rows = F.ceil(words / GRID_COLUMNS)
    sized = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("doc_id"), rows.alias("rows")).where("rows > 0")
    paged = sized.select("doc_id", "rows", F.explode(F.sequence(F.lit(1), F.ceil(F.col("rows") / GRID_ROWS).cast("int"))).alias("page"))
    return paged.select("doc_id", "page", F.least(F.lit(GRID_ROWS), F.col("rows") - GRID_ROWS * (F.col("page") - 1)).cast("bigint").alias("n"))


def grid_rows(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pages): the words of grid_runs as they lie, arrays of cells in arrays of rows in an array of pages; a text without words has none."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    full = docs.select(F.col(id).alias("doc_id"), words.alias("w")).where("size(w) > 0")
    full = full.select("doc_id", F.concat("w", F.array_repeat(F.lit("-"), F.pmod(-F.size("w"), F.lit(GRID_COLUMNS)))).alias("w"))

    def parts(of, n):
        return F.transform(F.sequence(F.lit(1), F.size(of), F.lit(n)), lambda i: F.slice(of, i, F.lit(n)))

    rows = full.select("doc_id", parts(F.col("w"), GRID_COLUMNS).alias("r"))
    return rows.select("doc_id", parts(F.col("r"), GRID_ROWS).alias("pages"))


def grid_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All words of a text as table cells of one width: three in a row, the last row filled with dashes, four rows on a page."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    full = docs.select(F.col(id).alias("doc_id"), words.alias("w")).select("doc_id", F.concat("w", F.array_repeat(F.lit("-"), F.pmod(-F.size("w"), F.lit(GRID_COLUMNS)))).alias("w"))
    rows = full.select("doc_id", F.posexplode("w").alias("k", "text"))
    k = F.col("k")
    row = F.floor(k / GRID_COLUMNS)
    return _body_runs(rows, F.floor(row / GRID_ROWS) + 1, k, LEFT + GRID_STEP * (k % GRID_COLUMNS), TOP - STEP * (row % GRID_ROWS), F.lit(GRID_STEP / 2))


def _body_runs(rows: DataFrame, page: Column, ix: Column, x0: Column, y: Column, width: Column | None = None) -> DataFrame:
    size = F.lit(BODY)
    width = F.length("text") * 0.5 * size if width is None else width
    return rows.select(
        "doc_id", page.cast("int").alias("page"), ix.cast("bigint").alias("run_ix"), "text", x0.cast("double").alias("x0"), y.cast("double").alias("y0"),
        (x0 + width).alias("x1"), (y + size).alias("y1"), size.alias("font_size"), F.lit(None).cast("bigint").alias("mcid"),
    )
