"""What the training-data operators share: the shared folder, Arrow batches, text as bytes."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes in one Arrow batch handed to Python, where the session leaves it open; bounds a worker's memory.
BATCH_BYTES = 8 << 20
_BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset and all runs in one process."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="docspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docspark-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the application's own part of the shared folder."""
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}-{name}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that outlive executors."""
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docspark_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized DataFrame that nothing reads any more."""
    if path := getattr(df, "_docspark_path", None):
        _delete(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application left in the shared folder, when no result is read any more."""
    _delete(spark, _own_dir(spark))


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a run of long texts cannot fill a worker."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_BYTES_KEY))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES_KEY, str(BATCH_BYTES))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column's values."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def apart(df: DataFrame, *made: str) -> DataFrame:
    """df with its columns that have the name of one to be made (in any case) renamed to input_<name>, so that no value is lost."""
    names = {c.lower() for c in [*df.columns, *made]}
    for c in df.columns:
        if c.lower() in {m.lower() for m in made}:
            new = f"input_{c}"
            while new.lower() in names:
                new = f"input_{new}"
            names.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df
