"""Benchmark decontamination by the q-gram lemma.

A passage of m bytes that occurs in a text with at most k edits shares at least m - q + 1 - k*q of its q-grams with
the text, all on k + 1 neighbouring diagonals (text place less passage place). Shared q-grams are counted in bands
of diagonals that overlap by half, so that some band holds each such set; bands that reach the bound are verified by
banded alignment. Letters A-Z compare without case, ASCII white space compares as a space.

The texts stream past the passages: these are sent to the tasks in blocks of at most BLOCK_BYTES, so their table may
be of any size.

Defined results: a null or empty text or passage matches nothing; a passage shorter than q bytes matches exactly
only; repeated rows of either table match each on their own. Places are code points, end exclusive. Without passages
nothing is found and all is clean. find reads no extra columns, clean lets them through.

Passages go to the executors BLOCK_BYTES at a time, as one index that a worker holds while it reads the documents
once; a benchmark of n blocks costs n such passes, one after the other, and no worker or broadcast holds more than one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, bounded_batches

Q = 12
#: Edits allowed, as a share of a passage's bytes.
RATE = 0.05
#: Bytes of passages that a task holds at once.
BLOCK_BYTES = 8 << 20
#: Bytes of text hashed at once, and pairs of places tallied at once.
_CHUNK, _PAIRS = 4 << 20, 1 << 21
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FILTER_BITS = 22


def fold(text: bytes | None) -> bytes:
    return (text or b"").translate(_FOLD)


def gram_hashes(text: bytes) -> np.ndarray:
    """A hash of the Q bytes at every place: two overlapping 8-byte loads, mixed."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pad = text + bytes(16)
    wide = np.empty((len(text) // 8 + 1) * 8, np.uint64)
    for k in range(8):
        got = np.frombuffer(pad, "<u8", count=(len(pad) - k) // 8, offset=k)
        part = wide[k::8]
        part[: min(len(part), len(got))] = got[: len(part)]
    out = wide[:n] * _M1
    out ^= out >> np.uint64(29)
    out += wide[Q - 8 : Q - 8 + n] * _M2
    out ^= out >> np.uint64(32)
    out *= _M1
    return out


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed in a passage of m bytes; never so many that the bound on shared q-grams falls to zero."""
    return max(0, min(int(rate * m), (m - Q) // Q))


@dataclass
class Index:
    """The q-grams of passages: sorted hashes, with (passage, place) of each."""

    ids: list
    texts: list[bytes]
    rate: float = RATE

    def __post_init__(self) -> None:
        grams = [gram_hashes(t) for t in self.texts]
        h = np.concatenate([np.zeros(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hashes, self.first, self.many = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        m = np.array([len(t) for t in self.texts], np.int64)
        self.k = np.array([budget(int(x), self.rate) for x in m], np.int64)
        self.least = m - Q + 1 - self.k * Q
        self.short = [i for i, t in enumerate(self.texts) if 0 < len(t) < Q]
        self.m = m

    def places(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places in text of q-grams that some passage has, and which of self.hashes each is."""
        h = gram_hashes(text)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[g] == h[at]
        return at[same], g[same]

    def regions(self, at: np.ndarray, gram: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, least diagonal, greatest diagonal) of the bands that reach the bound."""
        keys, counts = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        many = np.cumsum(self.many[gram])
        cut = [0, *np.searchsorted(many, np.arange(_PAIRS, int(many[-1]) if len(many) else 0, _PAIRS)).tolist(), len(at)]
        for s, e in zip(cut, cut[1:], strict=False):
            if s >= e:
                continue
            n = self.many[gram[s:e]]
            j = np.repeat(self.first[gram[s:e]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
            item = self.item[j]
            half = self.k[item] + 1
            band = (np.repeat(at[s:e], n) - self.place[j]) // half
            new = np.column_stack([np.r_[item, item], np.r_[band, band - 1]])
            keys, back = np.unique(np.r_[keys, new], axis=0, return_inverse=True)
            counts = np.bincount(back.ravel(), weights=np.r_[counts, np.ones(len(new), np.int64)], minlength=len(keys)).astype(np.int64)
        good = counts >= self.least[keys[:, 0]] if len(keys) else np.zeros(0, bool)
        half = self.k[keys[good, 0]] + 1
        return list(zip(keys[good, 0].tolist(), (keys[good, 1] * half).tolist(), (keys[good, 1] * half + 2 * half - 1).tolist(), strict=True))

    def matches(self, text: bytes, at: np.ndarray, gram: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(passage, start, end, edits) in bytes; of matches of a passage that overlap, the best."""
        found: list[tuple[int, int, int, int]] = []
        for i, lo, hi in self.regions(at, gram) if len(at) else []:
            start = max(0, lo)
            window = text[start : max(0, hi) + int(self.m[i]) + int(self.k[i])]
            for s, e, d in align(self.texts[i], window, int(self.k[i])):
                found.append((i, start + s, start + e, d))
        for i in self.short:
            s = text.find(self.texts[i])
            while s >= 0:
                found.append((i, s, s + len(self.texts[i]), 0))
                s = text.find(self.texts[i], s + len(self.texts[i]))
        out: list[tuple[int, int, int, int]] = []
        ends: dict[int, list[tuple[int, int]]] = {}
        for i, s, e, d in sorted(set(found), key=lambda x: (x[0], x[3], x[1], x[2])):
            if all(e <= a or b <= s for a, b in ends.setdefault(i, [])):
                ends[i].append((s, e))
                out.append((i, s, e, d))
        return sorted(out, key=lambda x: (x[1], x[0]))


def align(passage: bytes, window: bytes, k: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of occurrences of the whole passage in the window with at most k edits, the best of each
    run of ends. The window is about a band wide, so each row of the table is short."""
    out, s = [], window.find(passage)
    while s >= 0:
        out.append((s, s + len(passage), 0))
        s = window.find(passage, s + len(passage))
    if out or not k:
        return out
    text = np.frombuffer(window, np.uint8)
    n, m = len(text), len(passage)
    width = min(n, n - m + 2 * k + 1) if n >= m - k else 0  # diagonals the band holds, from -k on
    if width <= 0:
        return []
    far = m + n + 1
    cost = np.zeros(width, np.int64)  # cell c of row i stands for i + c - k bytes of text
    cost[:k] = far
    began = np.arange(width) - k
    step = np.arange(width)
    for i in range(1, m + 1):
        j = i + step - k
        inside = (j >= 0) & (j <= n)
        same = np.zeros(width, bool)
        reads = (j >= 1) & (j <= n)
        same[reads] = text[j[reads] - 1] == passage[i - 1]
        new = np.where(reads, cost + ~same, far)
        src = began.copy()
        up, up_from = np.r_[cost[1:] + 1, far], np.r_[began[1:], 0]  # a byte of the passage is left out
        better = (up < new) & inside
        new[better], src[better] = up[better], up_from[better]
        run = np.minimum.accumulate(new - step)  # bytes of the text are left out
        first = np.maximum.accumulate(np.where(new - step == run, step, 0))
        skip = run + step
        better = (skip < new) & inside
        src = np.where(better, src[first], src)
        cost, began = np.where(inside, np.minimum(new, np.where(better, skip, new)), far), src
    ends = m + step - k
    order = np.flatnonzero((cost <= k) & (ends >= 0) & (ends <= n))
    taken: list[tuple[int, int, int]] = []
    for c in sorted(order.tolist(), key=lambda c: (int(cost[c]), int(ends[c]))):
        s, e = int(began[c]), int(ends[c])
        if e > s and all(e <= a or b <= s for a, b, _ in taken):
            taken.append((s, e, int(cost[c])))
    return sorted(taken)


SCHEMA = "array<struct<item:int,start:bigint,end:bigint,edits:int>>"
_ARROW = pa.list_(pa.struct([("item", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


def _points(text: bytes, places: list[int]) -> list[int]:
    """Code points before each of the byte places."""
    a = np.frombuffer(text, np.uint8)
    before = np.r_[0, np.cumsum((a & 0xC0) != 0x80)]
    return before[places].tolist()


def search(texts: list[bytes | None], index: Index) -> list[list[dict]]:
    """Matches of each text, in code points. Texts are hashed together, parted so that no q-gram spans two."""
    out: list[list[dict]] = [[] for _ in texts]
    k = 0
    while k < len(texts):
        parts, starts, size, e = [], [], 0, k
        while e < len(texts) and (size < _CHUNK or e == k):
            parts.append(fold(texts[e]))
            starts.append(size)
            size += len(parts[-1]) + Q
            e += 1
        whole = bytes(Q).join(parts)
        at, gram = index.places(whole)
        cut = np.searchsorted(at, np.array([*starts, size]))
        for i, part in enumerate(parts):
            s, t = int(cut[i]), int(cut[i + 1])
            if s == t and not index.short or not part:
                continue
            near = at[s:t] - starts[i]
            inside = near <= len(part) - Q
            found = index.matches(part, near[inside], gram[s:t][inside])
            if found:
                p = _points(texts[k + i], [x for _, a, b, _ in found for x in (a, b)])
                out[k + i] = [{"item": x[0], "start": p[2 * n], "end": p[2 * n + 1], "edits": x[3]} for n, x in enumerate(found)]
        k = e
    return out


def _udf(passages):
    made: list[Index] = []

    def find(text: pa.Array) -> pa.Array:
        if not made:
            ids, texts, rate = passages.value
            made.append(Index(ids, texts, rate))
        return pa.array(search(as_bytes(text), made[0]), _ARROW)

    return F.arrow_udf(find, SCHEMA).asNondeterministic()


def blocks(benchmark: DataFrame, item: str, text: str, most: int) -> list[tuple[list, list[bytes]]]:
    """The passages in blocks of about `most` bytes; only one is collected at a time."""
    own = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null and text <> ''")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // most))
    for b in range(n):
        rows = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).orderBy("item", "text").collect()
        if rows:
            yield [r.item for r in rows], [fold(r.text.encode()) for r in rows]


def find(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, start, end, edits): one row for each occurrence of a passage in a text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = benchmark.schema[item].dataType
    out = []
    for ids, texts in blocks(benchmark, item, text, block_bytes):
        found = docs.select(F.col(id).alias("_id"), _udf(spark.sparkContext.broadcast((ids, texts, rate)))(F.col(text)).alias("_found")).select("_id", F.explode("_found").alias("m"))
        names = spark.createDataFrame(list(enumerate(ids)), "item int, name " + kind.simpleString())
        out.append(found.join(F.broadcast(names), F.col("m.item") == names.item).select(F.col("_id").alias(id), F.col("name").alias(item), "m.start", "m.end", "m.edits"))
    if not out:
        return spark.createDataFrame([], f"{id} {docs.schema[id].dataType.simpleString()}, {item} {kind.simpleString()}, start bigint, end bigint, edits int")
    return reduce(DataFrame.unionByName, out)


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows in which a passage occurs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for ids, texts in blocks(benchmark, "item_id", "text", block_bytes):
        found = _udf(spark.sparkContext.broadcast((ids, texts, rate)))(F.col(text))
        docs = docs.where(F.size(found) == 0)
    return docs
