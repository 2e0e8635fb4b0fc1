"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first, every step of it: fingerprints, lists by byte positions, the tally of shared ones, verified bits and
components (simhash_dedup). What it links within 2 bits is a list of its own, whose members' sets are compared as in any
other, since fingerprints may be near where the sets are not.

The other lists are of the same index over a wider sketch. Fingerprints of 64 bits differ in 3 to 11 bits or more at this
similarity, where their 8 bytes need share none; a sketch of 128 positional bytes, the low bytes of 128 minima of the
set under as many hashes, shares each with a chance of 0.8 or more. Positions are joined to 32 blocks of 4, whose whole
minima name a list: a pair at the threshold meets in no list with a chance of (1 - 0.8^4)^32 = 5e-8, and a closer pair
with less. In a list the shared positional bytes of each pair are tallied, and pairs below MIN_SHARED go (a pair at the
threshold shares fewer with a chance below 1e-8); of the retained the sets themselves decide. What is connected already
is not compared. Components of the links are the groups.

Lists of the same members are one list. A list of more than CELL members is dealt to cells of about that size, each with
the list's smallest member beside its own, and components are found; where a list then holds more than one component, the
members outside its largest one are held against every cell, one by one. So a pair that meets in a list is compared
or connected, wherever its members lie, and a task holds one cell and one member more.

Equal sets are one vertex. Defined results: words as in simhash_dedup; a text of fewer than five words is one
shingle, a null or wordless text has the empty set, and empty sets are equal. Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import as_bytes, bounded_batches, materialize
from . import simhash_dedup
from .simhash_dedup import components, fingerprint, shingle_hashes

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
ROWS, BANDS = 4, 32
#: Positional bytes that a pair must share to be verified, of ROWS * BANDS.
MIN_SHARED = 74
#: Members of a list that a task holds at once.
CELL = 512
_RANDOM = np.random.default_rng(42)
_TURN = _RANDOM.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The set of a text's shingles, sorted."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def minima(found: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of the ROWS * BANDS hashes."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        mixed = (found[None, i : i + 1024] ^ _TURN) * _TIMES
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, (mixed * _TIMES).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """A key for each band, of its place and minima."""
    return [_signed(xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)]


def sketch(least: np.ndarray) -> bytes:
    """The positional bytes."""
    return (least >> np.uint64(16)).astype(np.uint8).tobytes()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Of sorted sets: the similarity is LEAST or more."""
    up, low = LEAST
    if low * min(len(a), len(b)) < up * max(len(a), len(b)):
        return False
    if not len(b):
        return True
    both = int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))
    return low * both >= up * (len(a) + len(b) - both)


_SKETCH = pa.struct([("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("fp", pa.int64())])


def _sketch(text: pa.Array) -> pa.Array:
    out = []
    for x in as_bytes(text):
        found = shingles(x)
        least = minima(found)
        out.append({"node": _signed(xxhash.xxh64_intdigest(found.tobytes())), "bands": bands(least), "sketch": sketch(least), "fp": _signed(fingerprint(x))})
    return pa.array(out, _SKETCH)


def _set(text: pa.Array) -> pa.Array:
    return pa.array([shingles(x).tobytes() for x in as_bytes(text)], pa.binary())


class Cell:
    """Members of one cell: sketches to tally, sets to verify, and what each is connected with (by a root)."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.roots: list[int] = []
        self.sets: list[np.ndarray] = []
        self.sketches = np.zeros((16, ROWS * BANDS), np.uint8)

    def add(self, node: int, root: int, found: np.ndarray, own: bytes) -> None:
        if len(self.nodes) == len(self.sketches):
            self.sketches = np.concatenate([self.sketches, np.zeros_like(self.sketches)])
        self.sketches[len(self.nodes)] = np.frombuffer(own, np.uint8)
        self.nodes.append(node)
        self.roots.append(root)
        self.sets.append(found)

    def retained(self, own: bytes) -> np.ndarray:
        """The places of members whose tally of shared positional bytes reaches the minimum."""
        return np.flatnonzero((self.sketches[: len(self.nodes)] == np.frombuffer(own, np.uint8)).sum(axis=1) >= MIN_SHARED)

    def near(self, root: int, found: np.ndarray, own: bytes) -> list[int]:
        """The first similar member of each root but one's own."""
        out, known = [], {root}
        for k in self.retained(own).tolist():
            if self.roots[k] not in known and similar(self.sets[k], found):
                known.add(self.roots[k])
                out.append(k)
        return out

    def join(self, node: int, found: np.ndarray, own: bytes) -> list[tuple[int, int]]:
        """Add a member; links to what it connects, fewer than members in all."""
        near = self.near(node, found, own)
        gone = {self.roots[k] for k in near}
        self.roots = [node if r in gone else r for r in self.roots]
        self.add(node, node, found, own)
        return [(self.nodes[k], node) for k in near]


def _links(batches):
    """From rows (cell, later, node, root, found, sketch) sorted by cell, then later: links among a cell's own members, and where later is 2 of a member from outside with them."""

    def rows():
        last, held = None, Cell()
        for batch in batches:
            for cell, later, node, root, found, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != last:
                    last, held = cell, Cell()
                members = np.frombuffer(found, np.uint64)
                if later == 2:
                    for k in held.near(root, members, own):
                        yield held.nodes[k], node
                elif root is None:
                    yield from held.join(node, members, own)
                else:
                    held.add(node, root, members, own)

    out: list[tuple[int, int]] = []
    for pair in rows():
        out.append(pair)
        if len(out) >= 65536:
            yield _pairs(out)
            out = []
    if out:
        yield _pairs(out)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["a", "b"])


def _dealt(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of rows (cell, later, node, root): each cell in one task, sorted as _links takes them."""
    rows = members.join(sets, "node").select("cell", "later", "node", "root", "found", "sketch")
    return rows.repartition("cell").sortWithinPartitions("cell", "later", "node").mapInArrow(_links, "a bigint, b bigint").distinct()


def band_postings(nodes: DataFrame) -> DataFrame:
    """(posting, node): the lists of the wider sketch."""
    return nodes.select(F.explode("bands").alias("posting"), "node")


def fingerprint_postings(spark: SparkSession, fingerprints: DataFrame) -> DataFrame:
    """(posting, node) of rows (node, fp): a list for each component of fingerprints that SimHash links."""
    distinct = materialize(spark, fingerprints.select("fp").distinct(), "fingerprints")
    roots = components(simhash_dedup.links(distinct)).select(F.col("node").alias("_fp"), "root")
    named = fingerprints.join(roots, F.col("fp") == F.col("_fp"), "left").select(F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("posting"), "node").distinct()
    return materialize(spark, named, "fingerprint-postings")


def _lists(postings: DataFrame) -> DataFrame:
    """(list, node, leader, cells, cell): members of every list of two or more; of lists of the same members one stays."""
    told = [F.count("*").alias("n"), F.min("node").alias("leader"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    kept = postings.groupBy("posting").agg(*told).where("n > 1").groupBy("n", "leader", "x", "y").agg(F.min("posting").alias("list"))
    cells = F.ceil(F.col("n") / CELL).cast("bigint")
    members = postings.join(kept, postings.posting == kept.list).select("list", "node", "leader", cells.alias("cells"))
    return members.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")))


def _cell(cell: Column) -> Column:
    return F.xxhash64("list", cell).alias("cell")


def links(spark: SparkSession, lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect all that is similar in a list."""
    no_root = F.lit(None).cast("bigint").alias("root")
    own = lists.where("node <> leader").select(_cell(F.col("cell")), F.lit(1).alias("later"), "node", no_root)
    lead = lists.where("node = leader").select("list", "node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)).alias("c")).select(_cell(F.col("c")), F.lit(0).alias("later"), "node", no_root)
    found = materialize(spark, _dealt(own.unionAll(lead), sets), "links")
    long = lists.where("cells > 1")
    if long.isEmpty():
        return found
    roots = components(found).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    placed = materialize(spark, long.join(roots, F.col("node") == F.col("_node"), "left").select("list", "node", "cells", "cell", F.coalesce("_root", "node").alias("root")), "placed")
    parts = placed.groupBy("list", "root").agg(F.count("*").alias("n"), F.max("cells").alias("cells")).groupBy("list").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("n", "root")).alias("main"), F.max("cells").alias("cells")).where("parts > 1")
    apart = placed.join(parts.select("list", "main", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)).alias("cell")), ["list", "cell"])  # by cells, as a list may be large
    held = apart.select(_cell(F.col("cell")), F.lit(1).alias("later"), "node", "root")
    rest = apart.where("root <> main").select("list", "node", "root", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)).alias("c")).select(_cell(F.col("c")), F.lit(2).alias("later"), "node", "root")
    return found.unionAll(_dealt(held.unionAll(rest), sets))


def deduplicate(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: that of the smallest id (null only where all are), of rows that share it that of the least text hash."""
    spark = docs.sparkSession
    bounded_batches(spark)
    name = {"_docspark_id": F.coalesce(F.col(id), F.lit(0).cast(docs.schema[id].dataType)), "_docspark_key": F.xxhash64(F.col(id).isNull(), F.col(text))}
    row = ["_docspark_id", "_docspark_key"]
    sketched = F.arrow_udf(_sketch, "struct<node:bigint,bands:array<bigint>,sketch:binary,fp:bigint>").asNondeterministic()
    own = docs.select(F.col(id).isNull().alias("_docspark_null"), *(c.alias(k) for k, c in name.items()), sketched(F.col(text)).alias("s"))
    marked = materialize(spark, own.select("_docspark_null", *row, "s.*"), "sketches")
    nodes = materialize(spark, marked.groupBy("node").agg(F.min(F.struct("_docspark_null", *row)).alias("first"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    linked = fingerprint_postings(spark, marked.select("node", "fp").distinct())
    lists = materialize(spark, _lists(band_postings(nodes).unionAll(linked)), "lists")
    wanted = nodes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "sketch", *(F.col(f"first.{c}").alias(c) for c in row))
    texts = docs.withColumns(name).select(*row, F.col(text).alias("text")).join(wanted, row).groupBy("node").agg(F.first("text").alias("text"), F.first("sketch").alias("sketch"))
    sets = materialize(spark, texts.select("node", F.arrow_udf(_set, "binary")(F.col("text")).alias("found"), "sketch"), "sets")
    roots = components(links(spark, lists, sets)).withColumnRenamed("node", "_node")
    kept = nodes.join(roots, nodes.node == roots._node, "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = kept.select(*(F.col(f"first.{c}").alias(f"{c}_kept") for c in row))
    once = docs.withColumns(name).groupBy(*row).agg(*(F.first(c).alias(c) for c in docs.columns))
    return once.join(kept, [F.col(c) == F.col(f"{c}_kept") for c in row], "left_semi").select(*docs.columns)
