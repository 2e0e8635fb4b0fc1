"""SimHash near-duplicates by an inverted index on byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 2 bits differ in at most 2 of their 8 bytes, so they share at least 6
positional bytes (position, value). Lists of one positional byte would hold 1/256 of all fingerprints each; so the
index joins the positions to four blocks of two, and lists every distinct fingerprint under each choice of two
blocks and their 4 bytes. As two bytes touch two blocks at most, every link meets in a list. Inside a list the shared
positional bytes of each pair are tallied, pairs that reach the guaranteed minimum of 6 are retained, and the
retained are verified on the differing bits.

Lists longer than LIST_MAX are told by a count beforehand and refined instead: each member is listed again under each
choice of 2 of the 4 positions left, so that what meets has a tally of 6, and each list has two bytes left, 65,536
members at most. There the 136 differences of at most 2 bits are looked up. So no task holds a list of unbounded
size, no list costs more than LIST_MAX^2 / 2 tallies or 136 lookups a member, and nothing is left out. A list of k
yields less than k links. Components of the links come from alternating star rounds.

Equal fingerprints are one vertex, so a group of copies of any size costs one row.

Defined results: a null, empty or wordless text has the fingerprint zero and links like any other; rows that repeat
a doc_id keep their own fingerprint; a null doc_id is never a component's smallest unless all are null. Extra
columns pass through with_fingerprint, one named like the result as input_<name>.
"""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import apart, as_bytes, bounded_batches, discard, materialize

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Positions of four blocks of two bytes, and the choices of the blocks that a link leaves untouched at least.
_BLOCKS = ((0, 1), (2, 3), (4, 5), (6, 7))
_KEPT = [a + b for a, b in combinations(_BLOCKS, 4 - MAX_BITS)]
#: The positions that a refined list adds to a choice of _KEPT.
_ADDED = [list(combinations(sorted({*range(8)} - {*kept}), 8 - MAX_BITS - 4)) for kept in _KEPT]
#: Members of a list whose pairs are tallied; longer ones are refined.
LIST_MAX = 2048
#: Marks the posting of a refined list.
_REFINED = 1 << 60
_BITS = 1 << np.arange(63, -1, -1, dtype=np.uint64)


def shingle_hashes(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    words = (text or b"").lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    h, join = xxhash.xxh64_intdigest, b" ".join
    return [h(join(x), seed) for x in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero without words."""
    hashes = shingle_hashes(text, size)
    if not hashes:
        return 0
    if len(hashes) == 1:
        return hashes[0]
    ones = np.zeros(64, np.int64)
    a = np.array(hashes, np.uint64).byteswap()  # big endian: bit 0 of unpackbits is the highest
    for i in range(0, len(a), 4096):
        ones += np.unpackbits(a[i : i + 4096].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * ones > len(a)].sum(dtype=np.uint64))


def _fingerprint(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x) for x in as_bytes(text)], np.uint64).view(np.int64), pa.int64())


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint's 64 bits as a long."""
    bounded_batches(docs.sparkSession)
    return apart(docs, to).withColumn(to, F.arrow_udf(_fingerprint, "bigint")(F.col(text)))


def _key(fp: np.ndarray, positions: tuple[int, ...], number: int) -> np.ndarray:
    """A list's number and the bytes of the fingerprints at its positions, in one long."""
    key = np.full(len(fp), number, np.uint64)
    for p in positions:
        key = (key << np.uint64(8)) | ((fp >> np.uint64(8 * p)) & np.uint64(255))
    return key


def _postings(batches):
    """Each fingerprint under each choice of two blocks."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for c, kept in enumerate(_KEPT):
            yield pa.RecordBatch.from_arrays([pa.array(_key(fp, kept, c).view(np.int64)), pa.array(fp.view(np.int64))], names=["posting", "fp"])


def _refine(batches):
    """Rows (posting, fp, long): those of a long list under each choice of 2 more positions, the others as they are."""
    for batch in batches:
        key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        long = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        out = [(key[~long], fp[~long])]
        for c, kept in enumerate(_KEPT):
            own = fp[long & (key >> 32 == c)].view(np.uint64)
            for k, added in enumerate(_ADDED[c] if len(own) else ()):
                out.append((_key(own, kept + added, 8 * c + k).view(np.int64) | _REFINED, own.view(np.int64)))
        keys, fps = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps)], names=["posting", "fp"])


def retained(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of rows sorted by list: the places of the pairs of a list whose tally of shared positional bytes reaches the minimum, and how many pairs were tallied."""
    first, second, tallied = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    i, d = np.arange(len(key)), 1
    while len(i := i[: np.searchsorted(i, len(key) - d)]) and len(i := i[key[i] == key[i + d]]):
        for part in np.array_split(i, -(-len(i) // 65536)):
            tally = ((fp[part] ^ fp[part + d]).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            part = part[tally >= 8 - MAX_BITS]
            first.append(part)
            second.append(part + d)
        tallied += len(i)
        d += 1
    return np.concatenate(first), np.concatenate(second), tallied


#: All differences of 1 to MAX_BITS bits in the two bytes that a refined list leaves open.
_NEAR = np.array(sorted({1 << a | 1 << b for a in range(16) for b in range(16)}), np.uint64)


def _neighbours(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by refined list, then fingerprint: the places of verified pairs, looked up by each one's differences of at most MAX_BITS bits."""
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    edge = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else 0, len(key)].tolist()
    for s, e in pairwise(edge):
        if e - s < 2:
            continue
        number = int(key[s]) >> 48 & 0xFFF
        kept = _KEPT[number >> 3]
        p, q = sorted({*range(8)} - {*kept, *_ADDED[number >> 3][number & 7]})
        own = fp[s:e]
        for d in _NEAR:
            turn = (d >> np.uint64(8)) << np.uint64(8 * q) | (d & np.uint64(255)) << np.uint64(8 * p)
            at = np.searchsorted(own, own ^ turn)
            i = np.flatnonzero((own ^ turn > own) & (at < len(own)))
            i = i[own[at[i]] == own[i] ^ turn]
            first.append(i + s)
            second.append(at[i] + s)
    return np.concatenate(first), np.concatenate(second)


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of n places is connected with by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        was, low = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, was):
            return root


def list_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is near within each of whole lists, fewer than members; rows are sorted by list, then fingerprint."""
    cut = int(np.searchsorted(key, _REFINED))
    a, b, _ = retained(key[:cut], fp[:cut])
    near = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
    c, d = _neighbours(key[cut:], fp[cut:])
    root = _joined(np.r_[a[near], c + cut], np.r_[b[near], d + cut], len(fp))
    rest = np.flatnonzero(root != np.arange(len(fp)))
    return fp[root[rest]], fp[rest]


def _links(batches):
    """From rows sorted by posting: the links of each list."""
    left = (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def of(keys: np.ndarray, fps: np.ndarray):
        order = np.lexsort((fps, keys))
        a, b = list_links(keys[order], fps[order])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.r_[left[0], batch.column(0).to_numpy(zero_copy_only=False)]
        fps = np.r_[left[1], batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        yield from of(keys[:cut], fps[:cut])
        left = (keys[cut:], fps[cut:])
    yield from of(*left)


def links(fingerprints: DataFrame, *, list_max: int = LIST_MAX) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, distinct) that connect all within MAX_BITS bits."""
    postings = fingerprints.select("fp").mapInArrow(_postings, "posting bigint, fp bigint")
    long = postings.groupBy(F.col("posting").alias("_posting")).agg(F.count("*").alias("n")).where(F.col("n") > list_max).select("_posting")
    told = postings.join(long, F.col("posting") == F.col("_posting"), "left").select("posting", "fp", F.col("_posting").isNotNull().alias("long"))
    lists = told.mapInArrow(_refine, "posting bigint, fp bigint")
    return lists.repartition("posting").sortWithinPartitions("posting").mapInArrow(_links, "a bigint, b bigint").distinct()


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that an edge (a, b) names; the root is the component's smallest node.

    Large-star and small-star rounds, each ended by a table in the shared folder; rounds grow with the logarithm
    of a component's size. Only the number of edges and a checksum reach the driver.
    """
    spark = edges.sparkSession
    now = materialize(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    was = None
    for k in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if state.n == 0 or (state.n, state.s) == was:
            break
        was = (state.n, state.s)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = materialize(spark, large, f"large{k}")
        small = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        lowest = small.groupBy("u").agg(F.min("v").alias("m"))
        down = small.join(lowest, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        before = now
        now = materialize(spark, down.union(lowest.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct(), f"small{k}")
        discard(before)
        discard(large)
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).union(now.select("a", "a").distinct()).groupBy("node").agg(F.min("root").alias("root"))


def cluster(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component): one row per row of docs, component the smallest id reachable."""
    marked = materialize(docs.sparkSession, with_fingerprint(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), to="fp").select("doc_id", "fp"), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    of = _rooted(distinct)
    smallest = of.groupBy("root").agg(F.min("first").alias("component"))
    linked = of.join(smallest, "root").select(F.col("fp").alias("_fp"), "component")
    return marked.join(linked, marked.fp == linked._fp).select(F.col("doc_id").alias(id), "fp", "component")


def _rooted(distinct: DataFrame) -> DataFrame:
    """Rows of distinct fingerprints (fp, first) with the root of their component."""
    roots = components(links(distinct))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def deduplicate(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id (null only where all are), of rows that share it that of the least text hash.

    A row is named by its id and a hash of its text. Equal rows become one before their texts are shuffled, so rows
    repeated any number of times are no hot key; the rows to keep then meet the texts where that shuffle put them."""
    spark = docs.sparkSession
    name = {"_docspark_id": F.coalesce(F.col(id), F.lit(0).cast(docs.schema[id].dataType)), "_docspark_key": F.xxhash64(F.col(id).isNull(), F.col(text))}
    own = docs.select(F.col(id).isNull().alias("_docspark_null"), *(c.alias(k) for k, c in name.items()), F.col(text).alias("text"))
    marked = materialize(spark, with_fingerprint(own, to="fp").select("_docspark_null", "_docspark_id", "_docspark_key", "fp"), "named-fingerprints")
    distinct = marked.groupBy("fp").agg(F.min(F.struct("_docspark_null", "_docspark_id", "_docspark_key")).alias("first"))
    kept = _rooted(distinct).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._docspark_id").alias("_docspark_kept_id"), F.col("first._docspark_key").alias("_docspark_kept_key"))
    once = docs.withColumns(name).groupBy("_docspark_id", "_docspark_key").agg(*(F.first(c).alias(c) for c in docs.columns))
    return once.join(kept, (F.col("_docspark_id") == F.col("_docspark_kept_id")) & (F.col("_docspark_key") == F.col("_docspark_kept_key")), "left_semi").select(*docs.columns)
