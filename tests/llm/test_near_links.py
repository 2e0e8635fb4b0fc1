from __future__ import annotations

import random

import corpus_pipeline
from docspark.llm import near_copies as N, simhash_dedup as S
from test_near_copies import brute_kept, edited


def test_simhash_alone_links_what_it_finds(spark, monkeypatch):
    """Without the lists of the wider sketch the stage drops what fingerprints link and the sets confirm."""
    rng, rows = random.Random(6), []
    for k in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(2000)]
        rows += [(3 * k + i, edited(rng, base, i)) for i in range(3)]
    rows += [(100, "ab cd ef " * 300), (101, "ab cd ef " * 300 + "ij kl mn op qr st uv wx")]  # equal or near fingerprints, sets far apart
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    fps = {i: S.fingerprint(t.encode()) for i, t in rows}
    assert (fps[100] ^ fps[101]).bit_count() <= 2
    bands = N.band_postings
    monkeypatch.setattr(N, "band_postings", lambda nodes: bands(nodes).limit(0))
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    linked = {b for a, _ in rows for b, _ in rows if a < b < 100 and a // 3 == b // 3 and (fps[a] ^ fps[b]).bit_count() <= 2}
    assert linked and sorted(got) == sorted({i for i, _ in rows} - linked) and {100, 101} <= set(got)
    monkeypatch.setattr(N, "band_postings", bands)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute_kept(rows)
