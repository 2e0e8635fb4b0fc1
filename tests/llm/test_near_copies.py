from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from docspark.llm import near_copies as N


def brute_set(text: str | None) -> set[str]:
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows: list[tuple[int, str]]) -> list[int]:
    sets, root = {i: brute_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and 5 * both >= 4 * either:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in root})


def edited(rng: random.Random, base: list[str], n: int) -> str:
    words = list(base)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_drops_what_is_similar_and_nothing_else(spark):
    rng, rows = random.Random(3), []
    for k in range(40):  # from one changed word to ten of 200: on both sides of the limit
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [(len(rows) + i, edited(rng, base, i and 1 + (k + i) % 10)) for i in range(4)]
    base = [f"v{rng.randrange(5000)}" for _ in range(60)]
    rows += [(1000 + i, edited(rng, base, i % 3)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == brute_kept(rows) and 40 < len(got) < len(rows) - 60


def test_odd_rows(docs_of):
    docs = docs_of([(3, None), (2, ""), (1, " \n"), (7, "a b c d"), (7, "a b c d"), (7, "other words entirely in this one"), (None, "A b c d"), (9, "x" * 300_000)])
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in N.deduplicate(docs).collect()) == [(1, " \n"), (7, "a b c"), (7, "other"), (9, "xxxxx")]
    assert N.deduplicate(docs).columns == docs.columns and N.deduplicate(docs_of([])).collect() == []
    assert len(N.deduplicate(docs_of([(None, "a b c"), (None, "a b c"), (None, "quite another text")])).collect()) == 2


def test_long_lists_are_dealt_to_cells_and_lose_no_link(spark, monkeypatch):
    """Cells of three members: near copies of one text, some connected only by members of other cells."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, edited(rng, base, rng.choice((0, 1, 2, 3, 5, 7)))) for i in range(120)]
    step = list(base)  # a chain: each text is near the one before, the last far from the first
    for k in range(30):
        step[k * 6 % 200] = f"c{k}"
        rows.append((500 + k, " ".join(step)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_kept(rows)
    for cell in (3, 512):
        monkeypatch.setattr(N, "CELL", cell)
        assert sorted(r.doc_id for r in N.deduplicate(docs).collect()) == want, cell


def test_the_tally_rejects_and_keeps_what_is_similar():
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [edited(rng, base, n).encode() for n in (0, 1, 3, 6, 10, 20, 40, 80, 200) for _ in range(8)]
    sets = [N.shingles(t) for t in texts]
    sketches = [N.sketch(N.minima(s)) for s in sets]
    cell = N.Cell()
    for k, (s, own) in enumerate(zip(sets, sketches, strict=True)):
        cell.add(k, k, s, own)
    dropped = 0
    for k, (s, own) in enumerate(zip(sets, sketches, strict=True)):
        held = set(cell.retained(own).tolist())
        alike = {j for j, t in enumerate(sets) if 5 * len(np.intersect1d(s, t)) >= 4 * len(np.union1d(s, t))}
        assert alike <= held and {j for j in held if N.similar(sets[j], s)} == alike, k
        dropped += len(sets) - len(held)
    assert dropped > 1000
