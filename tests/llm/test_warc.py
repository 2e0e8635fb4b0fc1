from __future__ import annotations

import hashlib
import os

import pytest
import zstandard

from docspark.llm import queries, warc as W


def test_archives_round_trip():
    records = [W.record(i, f"http://h/{i}", (f"<p>{i} body text of a page</p>" * (i % 40)).encode(), "ab", None, "2024-01-01T00:00:00Z") for i in range(300)]
    data = W.SEPARATOR.join(W.archive(records)) + W.SEPARATOR
    assert list(W.records(data)) == records
    kinds = [m for m, _, _ in W.frames(data)]
    assert kinds[0] == W.DICT_MAGIC and kinds.count(0xFD2FB528) == 300
    raw = data[8 : 8 + int.from_bytes(data[4:8], "little")]
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    places = [(s, e) for m, s, e in W.frames(data) if m == 0xFD2FB528]
    assert plain.decompress(data[places[150][0] : places[150][1]]) == records[150]  # one record alone
    assert len(data) < sum(map(len, records)) / 3
    for few in ([], records[:1], [b"x"], [os.urandom(70_000)] * 3):
        assert list(W.records(b"".join(W.archive(few)))) == few


def test_frames_are_refused_where_there_are_none():
    with pytest.raises(ValueError):
        list(W.frames(b"not zstandard at all"))


def brute(rows):
    big: dict = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            big[p] = max(big.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        head = big.get(p)
        revisit = head is not None and i != head
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


def test_query_over_odd_rows(spark, tmp_path):
    long = "<p>é text</p>" * 200
    rows = [(1, "http://a/", long), (2, "http://a/", long), (9, None, long), (9, "http://b/", long), (3, "u\r\nInjected: x", "short"), (4, "http://c", "short"), (5, "http://d", None), (6, "http://e", ""), (7, "http://f", "x" * 999), (8, "http://g", "x" * 999), (10, "h", "y" * 300_000), (None, "n", long)]
    rows += [(100 + i, f"http://h/{i}", f"<html>{i}" + "common text " * 150) for i in range(40)]
    spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op7_warc(spark, str(tmp_path)).collect()), key=str)
    want = brute(rows)
    assert got == want
    assert sum(x[0] == 9 and x[3] == "response" for x in got) == 2  # equal id and payload: none is smaller


def test_payloads_come_back(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    W.write(pages, str(tmp_path / "w"), min_revisit=1 << 40)
    back = {r.page_id: (r.url, r.payload.decode()) for r in W.read(spark, str(tmp_path / "w")).collect()}
    assert back == {r.page_id: (r.url, r.html) for r in pages.collect()}
    W.write(pages.limit(0), str(tmp_path / "none"))
    assert W.read(spark, str(tmp_path / "none")).collect() == []


def test_archives_by_a_byte_target(spark, sf_dir, tmp_path):
    records = [W.record(i, f"http://h/{i}", os.urandom(600) + b"<p>body</p>" * 40, "ab", None, "2024-01-01T00:00:00Z") for i in range(300)]
    made = list(W.archives(records, 40_000))
    assert [r for frames in made for r in W.records(b"".join(frames))] == records and len(made) > 3
    assert all(sum(map(len, x)) >= 40_000 for x in made[:-1]) and all(sum(map(len, x[:-1])) < 40_000 for x in made)
    assert len(list(W.archives(records[:5], 1))) == 5  # a record each, where the dictionary alone is over the target
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").coalesce(2)
    rows = {}
    for most in (30_000, W.ARCHIVE_BYTES):
        path = str(tmp_path / str(most))
        W.write(pages, path, archive_bytes=most)
        files = [f for f in os.listdir(path) if f.startswith("part-")]
        rows[most] = len(files), sorted(map(tuple, W.read(spark, path).drop("payload").collect()), key=str)
        assert all(os.path.getsize(f"{path}/{f}") < 2 * most + 100_000 for f in files)
    assert rows[30_000][0] > rows[W.ARCHIVE_BYTES][0] and rows[30_000][1] == rows[W.ARCHIVE_BYTES][1]
