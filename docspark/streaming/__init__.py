"""Streams: documents as they arrive, chunked in micro-batches. An extension; the tables are those of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunks as C


def chunk_stream(parsed: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Write the chunks of a stream of parsed documents as Parquet; each micro-batch is a folder of its own, so a batch that is run again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        C.chunk_parsed(df, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return parsed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
