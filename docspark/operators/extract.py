"""Extraction policy: page selection, capped text, and which pages to render, all as windows and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import MAX_PIXELS, output_dimensions
from ..functions.text import non_space_count

MAX_PAGES, MIN_TEXT_CHARS, MAX_TEXT_CHARS = 20, 200, 200_000
SCAN_PAGES = 5000


def select_pages(pages: DataFrame, requested: DataFrame | None = None, *, max_pages: int | None = MAX_PAGES) -> DataFrame:
    """(doc_id, pos, page, error) of the pages to visit, in order.

    pages: doc_id, page. requested: doc_id, pages (array), where a document asks for some: every number is checked
    first, and a document with one out of range gets a single row with error 'page_out_of_range'; order and
    repetitions stay. Other documents have all their pages. The first max_pages are taken, all if None."""
    counts = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    if requested is None:
        asked = counts.withColumn("pages", F.lit(None).cast("array<int>"))
    else:
        asked = counts.join(requested.select("doc_id", "pages"), "doc_id", "left")
    wrong = F.exists("pages", lambda p: (p < 1) | (p > F.col("n")))
    listed = F.coalesce(F.col("pages"), F.sequence(F.lit(1), F.col("n")))
    taken = listed if max_pages is None else F.slice(listed, 1, max_pages)
    made = asked.select("doc_id", F.when(wrong, F.array(F.lit(None).cast("int"))).otherwise(taken).alias("p"), F.coalesce(wrong, F.lit(False)).alias("wrong"))
    return made.select("doc_id", "wrong", F.posexplode("p").alias("pos", "page")).select("doc_id", "pos", F.col("page").cast("int").alias("page"), F.when(F.col("wrong"), "page_out_of_range").alias("error"))


def page_errors(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (doc_id, page) that no page answers: an anti-join."""
    return wanted.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def join_capped(texts: Column, cap: int | None) -> Column:
    """Struct (text, truncated) of an array of page texts.

    Pages are parted by a line end, none before the first text; truncated tells that a character of a page, not just
    a line end, was left out. Without a cap nothing is."""
    if cap is None:
        first = F.array_position(F.transform(texts, lambda t: t != ""), True).cast("int")
        whole = F.when(first > 0, F.array_join(F.slice(texts, F.greatest(first, F.lit(1)), F.greatest(F.size(texts), F.lit(1))), "\n")).otherwise("")
        return F.struct(whole.alias("text"), F.lit(False).alias("truncated"))
    from_first = F.aggregate(texts, F.struct(F.lit("").alias("t"), F.lit(0).alias("lost")), lambda acc, p: _take(acc, p, cap))
    return F.struct(from_first.t.alias("text"), (from_first.lost > 0).alias("truncated"))


def _take(acc: Column, page: Column, cap: int) -> Column:
    gap = (F.length(acc.t) > 0) & (F.length(acc.t) < cap) & (acc.lost == 0)
    before = F.when(gap, F.concat(acc.t, F.lit("\n"))).otherwise(acc.t)
    room = F.greatest(F.lit(cap) - F.length(before), F.lit(0))
    part = F.when(acc.lost > 0, F.lit("")).otherwise(F.substring(page, F.lit(1), room))
    return F.struct(F.concat(before, part).alias("t"), (acc.lost + F.when(F.length(page) > room, 1).otherwise(0)).alias("lost"))


def document_text(page_texts: DataFrame, *, max_pages: int = MAX_PAGES, max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    """(doc_id, text, truncated): the texts of a document's first pages, capped."""
    rows = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x.text), 1, max_pages)
    return page_texts.groupBy("doc_id").agg(rows.alias("t")).select("doc_id", join_capped(F.col("t"), max_chars).alias("j")).select("doc_id", "j.text", "j.truncated")


def low_text_pages(page_texts: DataFrame, *, min_text_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """(doc_id, page, chars) of the pages that the automatic mode renders: in documents of too little text, the pages of too little."""
    chars = non_space_count(F.coalesce("text", F.lit("")))
    rows = page_texts.select("doc_id", "page", chars.cast("bigint").alias("chars"))
    total = F.sum("chars").over(Window.partitionBy("doc_id"))
    return rows.withColumn("_total", total).where((F.col("_total") < min_text_chars) & (F.col("chars") < min_text_chars)).drop("_total")


def render_prefix(pages: DataFrame, *, budget: int = MAX_PIXELS, **image) -> DataFrame:
    """pages (doc_id, page, w_pt, h_pt) with width, height and rendered: a document's pages up to the first that no longer fits."""
    sized = pages.withColumn("_d", output_dimensions(F.col("w_pt"), F.col("h_pt"), **{k: F.lit(v) for k, v in image.items()}))
    px = F.col("_d.width") * F.col("_d.height")
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    used, failed = F.sum(px).over(w), F.max(F.col("_d.error").isNotNull().cast("int")).over(w)
    return sized.withColumns({"_used": used, "_failed": failed}).select("doc_id", "page", F.col("_d.width").alias("width"), F.col("_d.height").alias("height"), ((F.col("_used") <= budget) & (F.col("_failed") == 0)).alias("rendered"))


def extract(page_texts: DataFrame, pages: DataFrame, *, mode: str = "auto", requested: DataFrame | None = None, max_pages: int | None = MAX_PAGES, min_text_chars: int = MIN_TEXT_CHARS, max_text_chars: int | None = MAX_TEXT_CHARS, budget: int | None = MAX_PIXELS, **image) -> DataFrame:
    """(doc_id, text, truncated_text, image_pages, truncated_images, pages_processed, error) of each document.

    page_texts: doc_id, page, text (null where a page failed: it counts as empty). pages: doc_id, page, w_pt, h_pt.
    mode: text, images, both or auto. image: width, height, dpi or scale. max_pages, max_text_chars and budget (pixels of
    all images) bound what is returned; None is no bound."""
    if mode not in ("text", "images", "both", "auto"):
        raise ValueError(f"no mode {mode!r}")
    chosen = select_pages(pages, requested, max_pages=max_pages)
    rows = chosen.join(page_texts.select("doc_id", "page", "text"), ["doc_id", "page"], "left").join(pages.select("doc_id", "page", "w_pt", "h_pt"), ["doc_id", "page"], "left")
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("chars", non_space_count(F.col("text")))
    all_of = Window.partitionBy("doc_id")
    total = F.sum("chars").over(all_of)
    wants = {"text": F.lit(False), "images": F.lit(True), "both": F.lit(True), "auto": (total < min_text_chars) & (F.col("chars") < min_text_chars)}[mode]
    rows = rows.withColumn("wants", wants & F.col("error").isNull()).withColumn("d", output_dimensions(F.col("w_pt"), F.col("h_pt"), **{k: F.lit(v) for k, v in image.items()}))
    w = all_of.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(F.col("wants"), F.col("d.width") * F.col("d.height")).otherwise(0)).over(w)
    failed = F.max((F.col("wants") & F.col("d.error").isNotNull()).cast("int")).over(w)
    within = F.lit(True) if budget is None else F.col("_used") <= budget
    rows = rows.withColumns({"_used": used, "_failed": failed}).withColumn("fits", F.col("wants") & within & (F.col("_failed") == 0))
    one = F.array_sort(F.collect_list(F.struct("pos", "page", "text", "wants", "fits")))
    grouped = rows.groupBy("doc_id").agg(one.alias("p"), F.first("error", ignorenulls=True).alias("error"))
    text = F.struct(F.lit("").alias("text"), F.lit(False).alias("truncated")) if mode == "images" else join_capped(F.transform("p", lambda x: x.text), max_text_chars)
    return grouped.withColumn("j", text).select(
        "doc_id", F.when(F.col("error").isNull(), F.col("j.text")).alias("text"), F.col("j.truncated").alias("truncated_text"), F.transform(F.filter("p", lambda x: x.fits), lambda x: x.page).alias("image_pages"),
        F.exists("p", lambda x: x.wants & ~x.fits).alias("truncated_images"), F.when(F.col("error").isNull(), F.transform("p", lambda x: x.page)).alias("pages_processed"), "error",
    )
