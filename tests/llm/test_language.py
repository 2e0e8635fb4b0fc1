from __future__ import annotations

import zlib

import numpy as np

from docspark.llm import language_id as L, queries


def brute_buckets(text: str) -> list[int]:
    """Each run of 2 to 5 bytes of a folded text, hashed byte by byte."""
    raw, out = L.fold(text), []
    for n in L.SIZES:
        for i in range(len(raw) - n + 1):
            part = raw[i : i + n]
            if 32 in part[1:-1] or n == 2 and part == b"  ":
                continue
            h = part[0]
            for c in part[1:]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
            h = (h * 0x9E3779B1 + (n * 0x85EBCA6B & 0xFFFFFFFF)) & 0xFFFFFFFF
            out.append(h >> (32 - (L.BUCKETS.bit_length() - 1)))
    return out


def test_subwords_are_brute_force():
    for t in ["", "a", "Hello, World", "é ü ß", "  two  spaces ", "x1y2", "漢字 kanji"]:
        got = [int(x) for row in L.buckets(L.fold(t)) for x in row if x >= 0]
        assert sorted(got) == sorted(brute_buckets(t)), t


def test_pieces_lose_nothing(monkeypatch):
    text = "one two three four five six seven eight nine ten " * 20
    whole = sorted(brute_buckets(text))
    monkeypatch.setattr(L, "_PIECE", 64)
    parts = L.pieces(L.fold(text))
    assert len(parts) > 5
    assert sorted(int(x) for p in parts for row in L.buckets(p) for x in row if x >= 0) == whole


def test_held_out_accuracy_and_columns(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op3_language_id(spark, d).collect()
    assert len(rows) == len(truth) and {r.lang_pred for r in rows} <= set(truth.values()) | {"und"}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert len(held) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.99


def test_calibration_and_rejection():
    rng = np.random.default_rng(0)
    make = lambda sounds: " ".join("".join(rng.choice(sounds, rng.integers(1, 4))) for _ in range(rng.integers(3, 60)))
    a, b = ["ka", "to", "mi", "na"], ["str", "ung", "heit", "ver"]
    texts = [make(a) for _ in range(300)] + [make(b) for _ in range(300)]
    model = L.train(texts, ["x"] * 300 + ["y"] * 300)
    assert np.mean([model.predict(make(a))[0] == "x" for _ in range(100)]) > 0.98
    assert np.mean([model.predict(make(b))[0] == "y" for _ in range(100)]) > 0.98
    assert 0 < model.threshold <= 1 and model.temperature > 0
    mixed = [model.predict(make(a) + " " + make(b))[1] for _ in range(50)]
    assert np.mean(mixed) < np.mean([model.predict(make(a))[1] for _ in range(50)])


def test_odd_rows(spark, docs_of):
    model = L.train(["the thing and that"] * 20 + ["der die und das ist"] * 20, ["en"] * 20 + ["de"] * 20)
    docs = docs_of([(1, None), (2, ""), (3, "123 !?"), (4, "the and that thing"), (5, "der und die das " * 40_000), (None, "the and"), (4, "the and that thing"), (6, "漢字")])
    got = {(r.doc_id, r.language.lang) for r in L.predict(docs, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (None, "en"), (6, model.predict("漢字")[0])}
    assert model.predict("漢字")[1] < model.predict("the and that thing")[1]  # no subword of it was learned
    nothing = L.train([], [])
    assert nothing.predict("the") == ("und", 0.0, True)
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert L.fit(none).classes == () and L.predict(none, nothing).collect() == []
    odd = spark.createDataFrame([(None, "a b", "en"), (1, None, "en"), (3, "words here", None)], "doc_id bigint, text string, lang string")
    assert L.fit(odd).classes == ()


def test_what_is_no_letter_is_und():
    model = L.train(["the thing and that"] * 20 + ["der die und das ist"] * 20, ["en"] * 20 + ["de"] * 20)
    for text in ("½ ² ①", "Ⅷ", "٣ 42", "_", "😀", "\u0301"):
        assert model.predict(text) == ("und", 0.0, True), text
    for text in ("é", "ʰ", "漢", "ß 1"):
        assert model.predict(text)[0] in ("en", "de"), text


def test_clashing_column_keeps_its_value(spark):
    model = L.train(["the thing and that"] * 20 + ["der die und das ist"] * 20, ["en"] * 20 + ["de"] * 20)
    row = L.predict(spark.createDataFrame([("the thing", "xx")], "text string, language string"), model).first()
    assert row.input_language == "xx" and row.language.lang == "en"
