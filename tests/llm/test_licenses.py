from __future__ import annotations

from pathlib import Path

from docspark.llm import license_scan as S
from docspark.llm.licenses import KNOWN, MIT


def test_equivalent_texts_share_a_digest():
    same = MIT.upper().replace('"', "'").replace("\n\n", "\n   # ").replace("copyright holders".upper(), "copyright owners")
    assert S.canonical(same) == S.canonical(MIT)
    headed = "Copyright (c) 2020 Somebody\n(C) copyright 2021 Else. All rights reserved.\n\n" + MIT
    assert S.canonical("MIT Licence\n\n" + headed) == S.canonical("MIT License\n\n" + MIT)
    assert S.canonical(MIT + " more") != S.canonical(MIT) and S.canonical("éMIT License") != S.canonical("MIT License")


def test_known_digests_name_one_licence_each():
    rows = S.known()
    assert len({d for d, _ in rows}) == len(rows) >= 25 and {n for _, n in rows} == set(KNOWN)


def brute(text: str | None) -> list[tuple[str, str, int, int]]:
    by_digest, out = dict(S.known()), []
    for unit, _, s, e in S.units(text or ""):
        if form := S.canonical((text or "")[s:e]):
            if name := by_digest.get(S.digest(form)):
                out.append((name, unit, s, e))
    return out


def test_rows_against_every_unit(spark, docs_of):
    texts = [None, "", "\n\n", MIT, "Copyright 2020 X\n\n" + MIT, "intro\n\n" + MIT.replace("\n\n", "\n") + "\n\nend", "prose\nReleased under the MIT Licence\nmore", "Licensed under CC BY-NC 4.0.", "licensed under cc by nc 4 0\n", "x " * 100_000 + "\nReleased under CC0 1.0."]
    rows = list(enumerate(texts)) + [(None, texts[7]), (7, texts[7])]
    got = sorted((str(r.doc_id), r.license, r.unit, r.start, r.end) for r in S.scan(docs_of(rows)).collect())
    assert got == sorted((str(i), *x) for i, t in rows for x in brute(t))
    assert {(g[0], g[2]) for g in got} >= {("3", "document"), ("4", "document"), ("5", "paragraph"), ("6", "line"), ("7", "document"), ("8", "document"), ("9", "line"), ("None", "document")}
    assert S.scan(docs_of([])).collect() == []


def test_own_texts(docs_of):
    got = S.scan(docs_of([(1, "My Terms!"), (2, "else")]), texts={"mine": ["my terms", ""]}).collect()
    assert [(r.doc_id, r.license) for r in got] == [(1, "mine")]


def test_whole_texts_and_runs_of_paragraphs(docs_of):
    folder = Path("/usr/share/common-licenses")
    whole = {i: (folder / name).read_text() for i, name in enumerate(("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0")) if (folder / name).exists()}
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"]
    rows = [(i, t) for i, t in whole.items()] + [(10 + i, f"Readme\n\nA tool.\n\n{t}\n\nThat is all.") for i, t in whole.items()]
    rows += [(20, f"Readme\n\nA tool.\n\n{MIT}\n\nThat is all."), (21, f"Readme\n\nMIT License\n\nCopyright 2020 X\n\n{MIT}"), (22, "Readme\n\n" + MIT.replace("free of charge", "for a fee"))]
    got = {(r.doc_id, r.license, r.unit) for r in S.scan(docs_of(rows)).collect()}
    assert got >= {(i, names[i], "document") for i in whole} | {(10 + i, names[i], "run") for i in whole} | {(20, "MIT", "run"), (21, "MIT", "run")}
    assert not any(g[0] == 22 for g in got)
    at = [(r.start, r.end) for r in S.scan(docs_of(rows)).collect() if r.doc_id == 20]
    assert [rows[[x[0] for x in rows].index(20)][1][s:e] for s, e in at] == [MIT]
