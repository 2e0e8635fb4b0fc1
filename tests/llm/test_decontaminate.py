from __future__ import annotations

import random

import pytest

from docspark.llm import decontaminate as D


def distance_in(passage: bytes, text: bytes) -> int:
    """The least edits of the whole passage against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(passage, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng: random.Random, text: str, n: int) -> str:
    for _ in range(n):
        k, how = rng.randrange(len(text)), rng.randrange(3)
        text = text[:k] + ("" if how == 0 else rng.choice("qxzj")) + text[k + (how < 2) :]
    return text


def passages(n: int = 12, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ed", "in", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(12, 45))) for _ in range(n)]


def test_hashes_tell_grams_apart():
    text = "".join(random.Random(2).choice("abcdef ") for _ in range(5000)).encode()
    h = D.gram_hashes(text)
    grams = [text[i : i + D.Q] for i in range(len(text) - D.Q + 1)]
    assert len(h) == len(grams) and len(set(h.tolist())) == len(set(grams))
    assert len(D.gram_hashes(b"short")) == 0 and len(D.gram_hashes(b"x" * D.Q)) == 1


def test_band_alignment_is_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(20, 60)))
        k = rng.randint(1, 4)
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 6))) + edited(rng, p, rng.randint(0, 5)) + "".join(rng.choice("abc ") for _ in range(rng.randint(0, 6)))
        found = D.align(p.encode(), text.encode(), k)
        best = distance_in(p.encode(), text.encode())
        lead = min((s for s, _, _ in found), default=0)
        if found:
            assert min(d for _, _, d in found) >= best and lead >= 0
            for s, e, d in found:
                assert distance_in(p.encode(), text.encode()[s:e]) <= d <= k


def test_finds_every_occurrence_within_the_budget():
    rng, items = random.Random(4), passages()
    index = D.Index(list(range(len(items))), [D.fold(x.encode()) for x in items])
    texts, want = [], []
    for n in range(120):
        i = rng.randrange(len(items))
        k = int(index.k[i])
        edits = rng.randint(0, k)
        lead, tail = " ".join(passages(2, 100 + n)), " ".join(passages(1, 900 + n))
        body = edited(rng, items[i], edits)
        text = f"{lead} {body if n % 3 else body.upper() if body.isascii() else body}\n{tail}"
        texts.append(text.encode())
        want.append((i, len(lead) + 1, edits))
    for text, (i, start, edits), found in zip(texts, want, D.search(texts, index), strict=True):
        hits = [x for x in found if x["item"] == i]
        if distance_in(index.texts[i], D.fold(text)) <= index.k[i]:  # an edit of é may be two of bytes
            assert hits, (i, edits)
            assert min(abs(x["start"] - start) for x in hits) <= edits + 1
        else:
            assert not hits
        for x in found:
            part = D.fold(text.decode()[x["start"] : x["end"]].encode())
            assert distance_in(index.texts[x["item"]], part) <= x["edits"] <= index.k[x["item"]]


def test_clean_texts_have_no_match():
    items = passages()
    index = D.Index(list(range(len(items))), [D.fold(x.encode()) for x in items])
    texts = [" ".join(passages(5, 5000 + n)).encode() for n in range(40)]
    for text, found in zip(texts, D.search(texts, index), strict=True):
        assert bool(found) == any(distance_in(p, D.fold(text)) <= index.k[i] for i, p in enumerate(index.texts)) or not found
        assert not found


def test_repeated_letters_and_long_texts():
    index = D.Index([0], [b"a" * 300])
    found = D.search([b"a" * 20_000, b"b" * 1000 + b"a" * 300, b""], index)
    assert found[0] and found[1][0]["start"] == 1000 and found[2] == []


def test_query_rows(spark, docs_of):
    items = passages(3)
    docs = docs_of([(1, f"before {items[0]} after"), (1, f"before {items[0]} after"), (2, items[1]), (3, "nothing to see here"), (4, None), (5, ""), (None, items[2]), (6, ("word " * 60_000) + items[0])])
    bench = spark.createDataFrame([(0, items[0]), (1, items[1]), (2, items[2]), (3, None), (4, ""), (5, "tiny"), (0, items[0])], "item_id bigint, text string")
    got = sorted(((r.doc_id or 0), r.item_id, r.edits) for r in D.find(docs, bench).collect())
    assert [g for g in got if g[1] != 5] == [(0, 2, 0), (1, 0, 0), (1, 0, 0), (1, 0, 0), (1, 0, 0), (2, 1, 0), (6, 0, 0), (6, 0, 0)]
    assert sorted(r.doc_id for r in D.clean(docs, bench).collect()) == [3, 4, 5]
    small = sorted(((r.doc_id or 0), r.item_id) for r in D.find(docs, bench, block_bytes=100).collect())
    assert small == sorted((a, b) for a, b, _ in got)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find(docs, none).collect() == [] and D.find(docs_of([]), bench).collect() == [] and D.clean(docs, none).count() == 8


@pytest.mark.parametrize("m", [1, 11, 12, 20, 24, 100, 400])
def test_budget_keeps_the_bound_positive(m):
    k = D.budget(m)
    assert k >= 0 and (m < D.Q or m - D.Q + 1 - k * D.Q >= 1)
