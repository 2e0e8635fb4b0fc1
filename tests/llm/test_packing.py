from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from docspark.llm import packing as P


def check_plan(lengths, windows):
    seen = {}
    for w in windows:
        n = sum(p[2] for p in w)
        assert 0 < n <= P.WINDOW
        for d, s, k in w:
            assert k > 0
            seen.setdefault(d, []).append((s, k))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen.get(d, [])):
            assert s == at
            at += k
        assert at == n
    padding = sum(P.WINDOW - n for n in (sum(p[2] for p in w) for w in windows) if n & (n - 1))
    return padding


@pytest.mark.parametrize("seed", range(6))
def test_every_id_lies_in_one_piece_and_nothing_is_padded(seed):
    rng = random.Random(seed)
    kind = [lambda: rng.randint(1, 300), lambda: rng.randint(1, 9000), lambda: 700, lambda: rng.choice([1, 2048, 4096, 2047]), lambda: int(rng.lognormvariate(6, 1)) + 1, lambda: 1][seed]
    lengths = [kind() for _ in range(rng.choice([1, 7, 900]))]
    assert check_plan(lengths, P.plan(np.array(lengths))) == 0


def test_nnls_against_a_grid_and_its_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((8, 5)), rng.normal(size=8)
        x = P.nnls(a, b)
        w = a.T @ (b - a @ x)
        assert (x >= 0).all() and (w <= 1e-8).all() and np.abs(w[x > 0]).max(initial=0) < 1e-8
    c = P.combinations()
    units = np.arange(1, P.UNITS + 1)
    assert (units @ c == P.UNITS).all() and (c.sum(axis=0) <= P.DEPTH).all() and len({tuple(x) for x in c.T}) == c.shape[1]


def test_combinations_are_used():
    """A histogram that combinations fill is packed by them, without cuts."""
    unit = P.WINDOW // P.UNITS
    lengths = [unit * k for k in (20, 30, 14)] * 50 + [unit * 32] * 40
    windows = P.plan(np.array(lengths))
    assert all(len(w) in (2, 3) for w in windows) and len(windows) == 70
    assert sum(len(w) for w in windows) == len(lengths)


def test_ids_are_the_vocabulary_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "Hello world", "é ü ß 漢字 🙂", " \n\n\t x", "a<|endoftext|>b", "don't we'll I'm", "x" * 5000, "1234567 890", "\x00\x1f\x85 ", "word " * 3000]
    assert [P.encoder()(x) for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_operator_rows(spark, docs_of):
    texts = [(1, None), (2, ""), (3, "hello world " * 3000), (3, "hello"), (None, "null id"), (4, "word"), (5, "é" * 10_000)] + [(100 + i, f"text number {i} " * (i % 90)) for i in range(300)]
    docs = docs_of(texts).coalesce(2)
    rows = P.pack(docs, block_tokens=20_000).collect()
    encode = P.encoder()
    want = sorted(tuple([*encode(t or ""), 1]) for _, t in texts)
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    waste = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.WINDOW
        waste += P.WINDOW - at if at & (at - 1) else 0
    assert waste == 0
    per_doc: dict = {}
    for r in rows:
        if r.doc_id != 3:
            per_doc.setdefault(r.doc_id, []).append(r)
    for own in per_doc.values():
        ids = [i for r in sorted(own, key=lambda r: r.start) for i in r.ids]
        assert tuple(ids) in want and len(ids) == own[0].doc_tokens and ids[-1] == 1
    assert sum(r.length for r in rows) == sum(map(len, want))
    assert P.pack(docs_of([])).collect() == []


def test_a_task_that_runs_again_packs_alike(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = [sorted(map(tuple, P.pack(docs, with_ids=False, block_tokens=50_000).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
