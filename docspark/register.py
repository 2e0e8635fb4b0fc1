"""SQL names for the functions: after register(spark), SELECT docspark_page_count(content) works."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from .core import captions, single
from .pdf.document import Document
from .pdf.errors import PdfError


def register(spark: SparkSession) -> list[str]:
    """Register scalar functions and the chunk table function; returns their names."""

    def guarded(f):
        def one(x):
            try:
                return None if x is None else f(x)
            except PdfError:
                return None

        return one

    def add(name: str, f, kind: str) -> None:
        def batch(values: pd.Series) -> pd.Series:
            return values.map(guarded(f))

        spark.udf.register(name, F.pandas_udf(batch, kind))
        names.append(name)

    names: list[str] = []
    add("docspark_page_count", lambda x: Document(bytes(x)).page_count, "int")
    add("docspark_text", lambda x: single.join_capped(single.page_texts(single.parse(bytes(x), want=("runs",))), 1 << 31)[0], "string")
    add("docspark_is_caption", captions.is_caption, "boolean")
    add("docspark_block_kind", captions.classify_text, "string")

    @F.udtf(returnType="chunk_ix: int, page: int, kind: string, text: string, char_start: bigint")
    class Chunks:
        def eval(self, content: bytes):
            try:
                made = single.chunk_document(bytes(content))
            except PdfError:
                return
            for i, c in enumerate(made):
                yield i, c["page"], c["kind"], c["text"], c["char_start"]

    spark.udtf.register("docspark_chunks", Chunks)
    return [*names, "docspark_chunks"]
