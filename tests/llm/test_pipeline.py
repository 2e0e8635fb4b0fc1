from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline
from docspark.llm import decontaminate as D, packing as P, quality_rules as Q, secret_scan as S
from test_decontaminate import distance_in
from test_near_copies import brute_kept
from test_quality import brute as counts

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    """Each stage over its own input against brute force."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = [D.fold(r.text.encode()) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    seen, columns = {}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before.collect(), docs.collect())
        if k < 4:
            assert docs.columns == columns
    was, now = seen["quality_rules"]
    failed = {r.doc_id for r in was if (c := counts(r.text))[0] < 50 or 100 * c[4] > 50 * c[0]}
    assert not failed & {r.doc_id for r in now}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    good = [r.doc_id for r in was if label.get(r.doc_id) == 1 and r.doc_id not in failed]
    assert len({r.doc_id for r in now} & set(good)) > 0.95 * len(good)
    was, now = seen["simhash_near_dedup"]
    assert sorted(r.doc_id for r in now) == brute_kept([(r.doc_id, r.text) for r in was])
    was, now = seen["benchmark_decontamination"]
    dirty = {r.doc_id for r in was if any(p in D.fold(r.text.encode()) for p in bench)}
    assert dirty and {r.doc_id for r in was} - {r.doc_id for r in now} >= dirty
    for gone in {r.doc_id: r.text for r in was if r.doc_id not in {x.doc_id for x in now}}.items():
        assert gone[0] in dirty or any(distance_in(p, D.fold(gone[1].encode())) <= D.budget(len(p)) for p in bench)
    was, now = seen["secret_scans"]
    text = {r.doc_id: r for r in now}
    assert sorted(text) == sorted(r.doc_id for r in was)
    for r in was:
        assert not S.scan(text[r.doc_id].text) and text[r.doc_id].n_chars == len(text[r.doc_id].text)
        assert S.scan(r.text) or text[r.doc_id].text == r.text
    was, now = seen["packing"]
    encode = P.encoder()
    pieces: dict = {}
    for r in now:
        pieces.setdefault(r.doc_id, []).append(r)
    for r in was:
        ids = np.array([*encode(r.text), 1], "<u4")
        at = 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids) == pieces[r.doc_id][0].doc_tokens


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert rows and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "packing"]


def test_odd_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _found int"
    prose = lambda k: " ".join(f"word{(i * 7919 + k * 104729) % 9973}x{k}" for i in range(200))  # noqa: E731  no two share a shingle
    rows = [(None, prose(1), "en", "s", 1, 1), (1, prose(2), None, None, None, None), (1, prose(2), None, None, None, None), (1, prose(3), "en", "s", 1, 1), (2, None, "en", "s", 1, 1), (3, prose(4) + " token=abcdefgh1234", "en", "s", 1, 1), (4, " ".join(f"t{i}" for i in range(40_000)), "de", "s", 1, 1)]
    empty = lambda ddl: spark.createDataFrame([], ddl)
    for name, table in (("full", spark.createDataFrame(rows, schema)), ("none", empty(schema))):
        d = str(tmp_path / name)
        table.write.parquet(f"{d}/documents.parquet")
        empty("doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        empty("item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        if name == "none":
            assert out == []
        else:
            assert {r.doc_id for r in out} == {None, 1, 3, 4}
            assert len({(r.doc_id, r.doc_tokens) for r in out}) == 5  # both texts of id 1
    assert Q.MAX_ROWS > 0
