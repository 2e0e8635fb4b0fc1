"""What language models take: message blocks, data URLs, and titles for chunks that have no heading."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import base64_line, data_url, trim

BLOCK = "struct<type:string,text:string,media_type:string,data:string>"


def text_block(text: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("media_type"), none.alias("data"))


def image_block(png: Column) -> Column:
    return F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("image/png").alias("media_type"), base64_line(png).alias("data"))


def to_message_content(text: Column, images: Column) -> Column:
    """Blocks: the text if there is any, then the images (an array of PNGs) in order."""
    none = F.array().cast(f"array<{BLOCK}>")
    return F.concat(F.when(text != "", F.array(text_block(text))).otherwise(none), F.transform(images, image_block))


def to_data_urls(images: Column) -> Column:
    return F.transform(images, lambda p: data_url(p))


def title_chunks(chunks: DataFrame, client: Callable[[], Callable[[list[str]], list[str | None]]]) -> DataFrame:
    """chunks whose path is empty get a title as their path; headings, and chunks that have a path, stay.

    client makes, once for each batch, a function of texts to titles; a title is trimmed, and none if empty."""

    def of(text: pa.Array) -> pa.Array:
        return pa.array(client()(text.to_pylist()), pa.string())

    title = trim(F.when((F.col("kind") != "Heading") & (F.size("heading_path") == 0), F.arrow_udf(of, "string")(F.col("text"))))
    made = chunks.withColumn("_title", title)
    return made.withColumn("heading_path", F.when(F.coalesce(F.col("_title"), F.lit("")) != "", F.array("_title")).otherwise(F.col("heading_path"))).drop("_title")
