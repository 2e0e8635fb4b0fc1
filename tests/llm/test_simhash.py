from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash

from docspark.llm import simhash_dedup as S


def brute_fingerprint(text: str | None) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(rows: list[tuple[int, int]]) -> dict[int, int]:
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, fa in rows:
        for b, fb in rows:
            if a < b and (fa ^ fb).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_fingerprint_is_brute_force():
    for text in ["", None, "  \n", "one", "One two", "a b c", "A b C d e f", "é Ü ß\x85x y\x1fz w", "x " * 500, "word joined a b c d"]:
        assert S.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text), text


def lists(fps: list[int], list_max: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that links() gives to _links, sorted by list."""
    held = pa.RecordBatch.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64))], names=["fp"])
    post = pa.Table.from_batches(S._postings([held])).to_pandas()
    post["long"] = post.groupby("posting").fp.transform("size") > list_max
    out = pa.Table.from_batches(S._refine([pa.RecordBatch.from_pandas(post, preserve_index=False)])).to_pandas()
    key, fp = out.posting.to_numpy(), out.fp.to_numpy().view(np.uint64)
    order = np.lexsort((fp, key))
    return key[order], fp[order]


def near_groups(seed: int, k: int) -> list[int]:
    """Fingerprints of which many differ by a few bits, or share 4 to 7 bytes."""
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(3)]
    turned = lambda x: x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(32) << rng.choice((0, 16, 32)) if rng.random() < 0.3 else 0)
    return sorted({turned(rng.choice(bases)) for _ in range(k)})


def test_lists_link_like_all_pairs():
    for k in (1, 3, 50, 400, 900):
        for list_max in (2, 16, 2048):
            fps = near_groups(k, k)
            a, b = S.list_links(*lists(fps, list_max))
            assert all(0 < (int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True))
            place = {x: i for i, x in enumerate(fps)}
            root = S._joined(np.array([place[int(x)] for x in a], np.int64), np.array([place[int(x)] for x in b], np.int64), len(fps))
            want = brute_components([(x, x) for x in fps])
            assert [fps[r] for r in root.tolist()] == [want[x] for x in fps], (k, list_max)


def test_the_tally_rejects_and_retains_what_shares_six_bytes():
    fps = near_groups(7, 500)
    key, fp = lists(fps, 2048)
    a, b, tallied = S.retained(key, fp)
    share = lambda x, y: sum((int(x) ^ int(y)) >> 8 * p & 255 == 0 for p in range(8))
    got = {(int(fp[i]), int(fp[j])) for i, j in zip(a, b, strict=True)}
    assert got == {(x, y) for n, x in enumerate(fps) for y in fps[n + 1 :] if share(x, y) >= 6}
    assert tallied > 1.2 * len(a)  # pairs that share 4 or 5 bytes met and were rejected


def test_refined_lists_are_bounded_and_hold_every_link():
    fps = near_groups(11, 600)
    key, fp = lists(fps, 8)
    pairs = {(int(x), int(y)) for n, x in enumerate(fps) for y in fps[n + 1 :] if (x ^ y).bit_count() <= 2}
    cut = int(np.searchsorted(key, S._REFINED))
    assert 0 < cut < len(key)
    a, b = S._neighbours(key[cut:], fp[cut:])
    c, d, _ = S.retained(key[:cut], fp[:cut])
    found = {(int(fp[i + cut]), int(fp[j + cut])) for i, j in zip(a, b, strict=True)} | {(int(fp[i]), int(fp[j])) for i, j in zip(c, d, strict=True) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 2}
    assert {tuple(sorted(x)) for x in found} == pairs


def test_clusters_are_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = brute_components(rows)
    got = S.cluster(docs).collect()
    assert {(r.doc_id, r.fp & (1 << 64) - 1, r.component) for r in got} == {(i, f, want[i]) for i, f in rows}


def test_refined_lists_cluster_alike(spark):
    fps = near_groups(3, 300)
    want = brute_components([(x, x) for x in fps])
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    for list_max in (4, 2048):
        roots = {r.node: r.root for r in S.components(S.links(frame, list_max=list_max)).collect()}
        mine = [roots.get(x - (1 << 64) if x >> 63 else x, x - (1 << 64) if x >> 63 else x) for x in fps]
        assert len(set(mine)) == len(set(want.values())) and all(len({mine[i] for i, x in enumerate(fps) if want[x] == w}) == 1 for w in set(want.values()))


def test_long_chain_and_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 2000), (2000, 1500), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1000] == got[1500] == got[2000] == 1000


def test_odd_rows(docs_of):
    docs = docs_of([(3, None), (2, ""), (1, " \n"), (7, "a b c d"), (7, "a b c d"), (7, "other words entirely in this one"), (None, "a b c d"), (9, "x" * 300_000)])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp == 0, r.component) for r in S.cluster(docs).collect())
    assert got[:4] == [(-1, False, 7), (1, True, 1), (2, True, 1), (3, True, 1)]
    kept = sorted((r.doc_id, (r.text or "")[:5]) for r in S.deduplicate(docs).collect())
    assert kept == [(1, " \n"), (7, "a b c"), (7, "other"), (9, "xxxxx")]
    assert S.deduplicate(docs).columns == docs.columns
    assert S.deduplicate(docs_of([])).collect() == [] and S.cluster(docs_of([])).collect() == []
    only_null = docs_of([(None, "a b c"), (None, "a b c"), (None, "quite another text")])
    assert len(S.deduplicate(only_null).collect()) == 2
