"""Groups in order, many to a batch: one shuffle by key, a sort that can spill, and a stream of groups through Python.

Spark's own grouped functions send each group as a table of its own; with thousands of small documents that costs more
than the work. Here a task reads whole Arrow batches and cuts them where the key changes, so only one group and one
batch are held at a time."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows of a result batch.
OUT_ROWS = 4096
#: Elements of arrays that are Python values at once.
IN_ITEMS = 65536


def values(col: pa.Array) -> list:
    """A column's Python values, as to_pylist gives them, without a scalar object for each where numpy has a type for all."""
    kind = col.type
    if pa.types.is_string(kind) or col.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return col.to_numpy(zero_copy_only=False).tolist()
    return col.to_pylist()


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns after the keys) of each group, in the order it comes."""
    key, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        names = list(zip(*(values(b.column(i)) for i in range(keys)), strict=True))
        cols = [values(b.column(i)) for i in range(keys, b.num_columns)]
        start = 0
        cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
        for end in chain(cuts, [len(names)]):
            part = [c[start:end] for c in cols]
            if held is not None and names[start] == key:
                for a, x in zip(held, part, strict=True):
                    a.extend(x)
            else:
                if held is not None:
                    yield key, held
                key, held = names[start], part
            start = end
    if held is not None:
        yield key, held


def of_groups(df: DataFrame, keys: list[str], order: list[str], columns: list[str], work: Callable[[tuple, list[list]], Iterable[tuple]], ddl: str) -> DataFrame:
    """work(key, columns) for each group, its rows sorted by order; it gives the result's rows as tuples."""
    schema = StructType.fromDDL(ddl)
    names, kinds = schema.fieldNames(), [to_arrow_type(f.dataType) for f in schema.fields]
    n = len(keys)

    def of(batches):
        rows: list[tuple] = []
        searched = gc.isenabled()
        gc.disable()  # a group's many small objects hold no cycles; looking for some takes a quarter of the time
        try:
            for key, cols in _groups(batches, n):
                rows.extend(work(key, cols))
                if len(rows) >= OUT_ROWS:
                    yield record_batch(rows, names, kinds)
                    rows = []
            if rows:
                yield record_batch(rows, names, kinds)
        finally:
            if searched:
                gc.enable()

    # A fixed count: adaptive coalescing goes by bytes, and would leave work that is heavy for its bytes to a few tasks.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*keys, *columns, *(c for c in order if c not in columns)).repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*keys, *columns).mapInArrow(of, ddl)


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut between rows, so that a part's arrays hold IN_ITEMS elements or are one row's."""
    start, held = 0, 0
    for i, n in enumerate(b.column(1).value_lengths().to_pylist()):
        if n and held and held + n > IN_ITEMS:
            yield b.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    yield b.slice(start)


def in_rows(docs: DataFrame, column: str, fields: list[str], work: Callable[[list[list]], Iterable[tuple]], ddl: str) -> DataFrame:
    """As of_groups with key doc_id, where each row holds its whole group as an array of structs in order: work(columns) gives the result's rows without the key."""
    schema = StructType.fromDDL(ddl)
    names, kinds = schema.fieldNames(), [to_arrow_type(f.dataType) for f in schema.fields]

    def of(batches):
        rows: list[tuple] = []
        searched = gc.isenabled()
        gc.disable()
        try:
            for b in chain.from_iterable(map(_parts, batches)):
                parts = b.column(1).flatten()
                cols = [[None] * len(parts) if c.null_count == len(c) else values(c) for c in parts.flatten()]
                at = 0
                for key, n in zip(values(b.column(0)), b.column(1).value_lengths().to_pylist(), strict=True):
                    end = at + (n or 0)
                    rows.extend((key, *made) for made in work([c[at:end] for c in cols]))
                    at = end
                    if len(rows) >= OUT_ROWS:
                        yield record_batch(rows, names, kinds)
                        rows = []
            if rows:
                yield record_batch(rows, names, kinds)
        finally:
            if searched:
                gc.enable()

    held = F.transform(column, lambda x: F.struct(*(x[f].alias(f) for f in fields))) if docs.schema[column].dataType.elementType.names != fields else F.col(column)
    return docs.select("doc_id", held.alias(column)).mapInArrow(of, ddl)


def record_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
