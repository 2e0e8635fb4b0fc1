"""Page signals and page kinds: native aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import non_space_count

#: Characters that make a page text, and the coverage that makes it an image or a scan.
TEXT_CHARS, IMAGE_COVER, SCAN_COVER = 50, 0.5, 0.6


def page_signals(pages: DataFrame, runs: DataFrame, draws: DataFrame) -> DataFrame:
    """(doc_id, page, text_char_count, image_count, image_coverage) of every page.

    pages: doc_id, page, w_pt, h_pt. Overlapping images count twice, the sum is clamped to 1."""
    text = runs.groupBy("doc_id", "page").agg(F.sum(non_space_count(F.col("text"))).alias("chars"))
    area = draws.groupBy("doc_id", "page").agg(F.count("*").alias("images"), F.sum(F.abs(F.col("a") * F.col("d") - F.col("b") * F.col("c"))).alias("area"))
    whole = F.greatest(F.col("w_pt") * F.col("h_pt"), F.lit(1.0))
    joined = pages.join(text, ["doc_id", "page"], "left").join(area, ["doc_id", "page"], "left")
    return joined.select(
        "doc_id", "page", F.coalesce("chars", F.lit(0)).cast("bigint").alias("text_char_count"), F.coalesce("images", F.lit(0)).cast("bigint").alias("image_count"),
        F.least(F.greatest(F.coalesce(F.col("area") / whole, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("image_coverage"),
    )


def page_kind(chars: Column, images: Column, coverage: Column) -> Column:
    """TextBased, Scanned, ImageOnly or Mixed."""
    has_text, covered = chars >= TEXT_CHARS, coverage >= IMAGE_COVER
    return (
        F.when(has_text & covered, "Mixed").when(has_text, "TextBased")
        .when((images == 1) & (coverage >= SCAN_COVER), "Scanned").when((images > 0) | covered, "ImageOnly").otherwise("TextBased")
    )


def classify(signals: DataFrame) -> DataFrame:
    return signals.withColumn("kind", page_kind(F.col("text_char_count"), F.col("image_count"), F.col("image_coverage")))
