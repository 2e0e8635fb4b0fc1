"""Packing token ids into windows by non-negative least squares.

Each task packs its own rows, block by block: whole windows are cut from long documents, and the lengths that remain
form a histogram. Shallow combinations (up to three lengths that together fill a window) are enumerated once; least
squares with non-negative counts says how often to use each, the counts are rounded down, and what the rounding and
the histogram leave over is packed greedily, longest first. Gaps are then filled by cutting pieces off the emptiest
windows, and the one window left open in a block is cut at powers of two, which need no padding.

Nothing is shuffled and no statistic is global, so a hot source costs nothing, memory is bounded by BLOCK_TOKENS and
a lost task can be run again alone. Sequence ids count within a task, whose number stands in their high bits; they
are the same in every run if the input is read from files.

Defined results: a null or empty text has only the end id; repeated rows are packed each; a document longer than a
block is cut into whole windows as any other. An empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches

WINDOW = 2048
UNITS = 64
DEPTH = 3
END_ID = 1
VOCABULARY = "byte_bpe_50k"
#: Token ids that a task holds at once before it packs them.
BLOCK_TOKENS = 4_000_000


@functools.lru_cache(maxsize=4)
def _encoder(json_path: str, ranks_path: str, pattern: str):
    """texts -> lists of ids, as the vocabulary's own library gives them.

    The rank file of the same vocabulary gives the same ids about four times as fast; a text that spells a special
    token goes to the library itself."""
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special = [x.content for x in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(x in text for x in special):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def encoder(vocabulary: str = VOCABULARY):
    import public_tokenizers as files

    return _encoder(files.path(f"{vocabulary}.json"), files.path(f"{vocabulary}.tiktoken"), files.PATTERN)


@functools.cache
def combinations() -> np.ndarray:
    """Counts of each length (in units of a window) in each combination of at most DEPTH that fills a window."""
    found = [(UNITS,)] + [(a, UNITS - a) for a in range(1, UNITS // 2 + 1)]
    if DEPTH >= 3:
        found += [(a, b, UNITS - a - b) for a in range(1, UNITS) for b in range(a, UNITS) if UNITS - a - b >= b]
    out = np.zeros((UNITS, len(found)))
    for j, parts in enumerate(found):
        for u in parts:
            out[u - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, *, rounds: int = 400) -> np.ndarray:
    """x >= 0 of least |a x - b|, by the active-set method of Lawson and Hanson on the normal equations."""
    ata, atb = a.T @ a, a.T @ b
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(rounds):
        w = atb - ata @ x
        w[on] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= slack:
            break
        on[j] = True
        while True:
            p = np.flatnonzero(on)
            z = np.linalg.lstsq(ata[np.ix_(p, p)], atb[p], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[p] = z
                break
            low = z <= 0
            step = (x[p][low] / np.maximum(x[p][low] - z[low], 1e-300)).min()
            x[p] += step * (z - x[p])
            on[p[x[p] <= 1e-12]] = False
            x[~on] = 0
            if not on.any():
                break
    return x


def plan(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of pieces (document, start, length): every id in exactly one piece."""
    unit = window // UNITS
    out: list[list[tuple[int, int, int]]] = []
    bins: list[list[int]] = [[] for _ in range(UNITS)]
    rest = (lengths % window).astype(np.int64)
    for d, n in enumerate(lengths.tolist()):
        out += [[(d, s, window)] for s in range(0, n - n % window, window)]
    for d in np.argsort(rest, kind="stable").tolist():
        if rest[d]:
            bins[-(-int(rest[d]) // unit) - 1].append(d)
    piece = lambda d: (d, int(lengths[d] - rest[d]), int(rest[d]))
    have = np.array([len(x) for x in bins], float)
    partial: list[list[tuple[int, int, int]]] = []
    if have.any():
        a = combinations()
        counts = np.floor(nnls(a, have) + 1e-6).astype(int)
        for j in np.argsort(-counts, kind="stable").tolist():
            if not counts[j]:
                break
            parts = np.repeat(np.arange(UNITS), a[:, j].astype(int)).tolist()
            for _ in range(counts[j]):
                if any(len(bins[u]) < parts.count(u) for u in parts):
                    break
                partial.append([piece(bins[u].pop()) for u in parts])
    left = sorted((d for x in bins for d in x), key=lambda d: (-rest[d], d))
    partial += _greedy([piece(d) for d in left], window)
    return out + _fill(partial, window)


def _greedy(pieces: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Longest first, each into the fullest open window that has room."""
    by_room: list[list[int]] = [[] for _ in range(window + 1)]
    out: list[list[tuple[int, int, int]]] = []
    rooms = np.zeros(window + 1, bool)
    for p in pieces:
        k = p[2] + int(np.argmax(rooms[p[2] :]))
        if rooms[k]:
            w = by_room[k].pop()
            rooms[k] = bool(by_room[k])
            out[w].append(p)
            k -= p[2]
        else:
            w, k = len(out), window - p[2]
            out.append([p])
        by_room[k].append(w)
        rooms[k] = True
    return out


def _fill(windows: list[list[tuple[int, int, int]]], window: int) -> list[list[tuple[int, int, int]]]:
    """Close the gaps with pieces cut from the emptiest windows; part the last one at powers of two."""
    used = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda i: (-used[i], i))
    i, j = 0, len(order) - 1
    while i < j:
        x, y = order[i], order[j]
        gap = window - used[x]
        if not gap:
            i += 1
            continue
        d, s, n = windows[y].pop()
        take = min(n, gap)
        windows[x].append((d, s, take))
        used[x] += take
        used[y] -= take
        if take < n:
            windows[y].append((d, s + take, n - take))
        if not windows[y]:
            j -= 1
    done = [windows[k] for k in order[: j + 1]]
    if done and used[order[j]] < window:
        last, rest = done.pop(), used[order[j]]
        size = 1 << (rest.bit_length() - 1)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            part, room = [], size
            while room:
                d, s, n = last.pop(0)
                take = min(n, room)
                part.append((d, s, take))
                room -= take
                if take < n:
                    last.insert(0, (d, s + take, n - take))
            done.append(part)
            rest -= size
    return done


FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _blocks(batches: Iterable[pa.RecordBatch], encode, block: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, tokens, size = [], [], 0
    for batch in batches:
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(d)
            tokens.append(np.array([*encode(text or ""), END_ID], "<u4"))
            size += len(tokens[-1])
            if size >= block:
                yield ids, tokens
                ids, tokens, size = [], [], 0
    if ids:
        yield ids, tokens


def pack(docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, by default, ids."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def of(batches):
        number, encode = TaskContext.get().partitionId() << 40, None
        for ids, tokens in _blocks(batches, encode or encoder(vocabulary), block_tokens):
            rows: list[tuple] = []

            def batch(rows=rows, ids=ids, tokens=tokens):
                cols = list(zip(*rows, strict=True))
                made = [pa.array([ids[d] for d in cols[0]], id_type)] + [pa.array(c, t) for c, (_, t) in zip(cols[1:], FIELDS, strict=True)]
                if with_ids:
                    made.append(pa.array([tokens[d][s : s + n].astype(np.int32) for d, s, n in zip(cols[0], cols[1], cols[2], strict=True)], pa.list_(pa.int32())))
                return pa.RecordBatch.from_arrays(made, names=[id, *(f for f, _ in FIELDS), *(["ids"] if with_ids else [])])

            for pieces in plan(np.array([len(x) for x in tokens], np.int64), window):
                at = 0
                for d, s, n in pieces:
                    rows.append((d, s, n, zlib.crc32(tokens[d][s : s + n].tobytes()), len(tokens[d]), number, at))
                    at += n
                number += 1
                if len(rows) >= 2000:
                    yield batch()
                    rows.clear()
            if rows:
                yield batch()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id].dataType)
    schema = f"`{id}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id), F.col(text)).mapInArrow(of, schema)
