"""Files out of binary and text columns, one for each row, in a folder that every worker sees.

A file is written under a name of its own and then renamed, so a task that runs again replaces what it wrote. Where there is no such
folder, write the column as Parquet instead; Spark's own writers reach every file system."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def write_files(df: DataFrame, folder: str, *, name: str, content: str) -> DataFrame:
    """(name, path, length, error) of each file written; nulls and names that would leave the folder are errors.

    Lazy, as any DataFrame: an action writes the files."""
    folder = folder.removeprefix("file://")

    def one(own: str | None, data: bytes | None) -> tuple[str | None, str | None, int | None, str | None]:
        if own is None or data is None or not own.strip("./") or os.path.isabs(own) or ".." in own.split("/"):
            return own, None, None, "bad_name" if data is not None else "no_content"
        path = os.path.join(folder, own)
        held = f"{path}.{uuid.uuid4().hex}.part"
        try:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(held, "wb") as f:
                f.write(data)
            os.replace(held, path)
        except OSError as e:
            return own, None, None, f"backend_error: {e.strerror}"
        return own, path, len(data), None

    def of(batches):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            for own, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one(own, data.as_py()), kinds, strict=True)], names=["name", "path", "length", "error"])

    rows = df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    return rows.mapInArrow(of, "name string, path string, length bigint, error string")
