from __future__ import annotations

import math
import random

import fixtures as X
import pyarrow as pa
import pytest

from docspark.core import blocks as B, captions as C, layout as L, tables as T
from docspark.operators.grouped import values
from docspark.pdf.document import parse


def run(text, x0, x1, y, size=12.0):
    return (text, x0, y, x1, y + size, size)


def test_single_column():
    lines = L.group_lines([run(f"line{i}", 72, 300, 700 - 18 * i) for i in range(6)])
    assert [ln.text for ln in lines] == [f"line{i}" for i in range(6)] and {ln.column for ln in lines} == {0}


def two_columns(n):
    return [r for i in range(n) for r in (run(f"L{i}", 72, 260, 740 - 18 * i), run(f"R{i}", 300, 520, 740 - 18 * i))]


def test_two_columns_with_a_header():
    lines = L.group_lines([run("Header", 72, 500, 760, 14), *two_columns(8)])
    assert [ln.text for ln in lines] == ["Header"] + [f"L{i}" for i in range(8)] + [f"R{i}" for i in range(8)]
    assert len({ln.column for ln in lines}) == 3
    footed = L.group_lines([*two_columns(8), run("Footer", 72, 500, 500)])
    assert footed[-1].text == "Footer" and footed[-1].column == 3


def test_short_columns_and_interior_spans_stay_one_region():
    lines = L.group_lines(two_columns(4))
    assert len(lines) == 4 and {ln.column for ln in lines} == {0}
    lines = L.group_lines([*two_columns(6), run("spanning middle", 72, 500, 680)])
    assert {ln.column for ln in lines} == {0}


@pytest.mark.parametrize("x0", [100.0, math.nan, 1e10])
def test_degenerate_runs(x0):
    assert L.group_lines([]) == []
    lines = L.group_lines([run("x", x0, 100.0, 700)])
    assert lines[0].column == 0 and lines[0].text == "x"


def test_gaps_inside_a_line():
    lines = L.bucket([run("a", 0, 10, 100), run("b", 14, 20, 101), run("c", 21, 30, 100), run("d", 100, 110, 100), run(" e", 115, 120, 100)])
    assert lines[0].text == "a bc\td e" and lines[0].gap_xs == [65.0] and [c[0] for c in lines[0].cells] == ["a bc", "d e"]
    assert len(lines[0].gap_xs) + 1 == len(lines[0].cells)
    assert L.upper_median([1, 2, 3, 4, 0.1]) == 3 and L.upper_median([]) == 12


def first_fit(runs):
    """Which line takes each run, looked up one by one."""
    lines, homes = [], []
    for _, _, y, _, _, size in runs:
        home = next((k for k, (at, tall) in enumerate(lines) if abs(at - y) <= L.SAME_LINE * max(tall, size)), len(lines))
        lines[home:home + 1] = [(y, size) if home == len(lines) else (lines[home][0], max(lines[home][1], size))]
        homes.append(home)
    return homes


def test_lines_are_first_fit():
    rng = random.Random(5)
    for _ in range(300):
        ys, sizes = [rng.choice([700, 700.0, 704, 709, 690.5, math.inf, math.nan, 0]) for _ in range(4)], [12.0, 12.0, 9, 20, 0.0, -3.0]
        runs = [run(str(k), 30 * k, 30 * k + 10, rng.choice(ys), rng.choice(sizes)) for k in range(14)]
        by_line = {}
        for k, home in enumerate(first_fit(runs)):
            by_line.setdefault(home, set()).add(str(k))
        assert sorted(map(sorted, by_line.values())) == sorted(sorted(ln.text.split()) for ln in L.bucket(runs))


def test_columns_as_python_values():
    for column in ([1, None, 3], [1, 2], [1.5, None], [0.5, -0.0], [True, None], [True, False], ["a", None, "é"], [], [[1.0], None], [b"x", None]):
        a = pa.array(column, pa.int64() if not column else None)
        assert values(a) == a.to_pylist() == column and list(map(type, values(a))) == list(map(type, column))
        assert values(a[1:]) == column[1:]
    assert math.isnan(values(pa.array([math.nan]))[0])


def test_reflow():
    ln = lambda t, y, c=0: L.Line(t, y, 0, 10, 12, column=c)
    assert L.reflow([ln("a ", 100), ln("b", 88), ln("c", 60), ln("d", 50, 1)]) == "a\nb\n\nc\n\nd"


def test_captions_and_kinds():
    yes = ["Figure 1: A chart.", "FIG. 2. Something", "Table 3) rows", "  exhibit 4- x", "Chart 5— y", "diagram 6a: z"]
    no = ["Figure shows this", "Figure 1 shows", "In Figure 1: no", "Table", "Figures 1: x", "Fig 1", "Figure 1: " + "word " * 20, ""]
    assert all(map(C.is_caption, yes)) and not any(map(C.is_caption, no))
    assert [C.classify_text(t) for t in ("• a", "- b", "  12. c", "3) d", "3 e", "a. f", "–x", "")] == ["List", "List", "List", "List", "Paragraph", "Paragraph", "List", "Paragraph"]
    assert [C.estimate_tokens(t) for t in ("", "abcd", "abcde")] == [1, 1, 2]
    assert C.tail_tokens("one two three four", 2) == "four" and C.tail_tokens(" short ", 9) == "short" and C.tail_tokens("x" * 50, 2) == "x" * 8
    assert C.stable_id(1, "Heading", "Chapter One") == "f0ba3639a2b5c977"


def test_place_cell():
    slots = [(0.0, 100.0), (100.0, 200.0), (200.0, 300.0)]
    assert T.place_cell(0, 90, slots) == (0, 1) and T.place_cell(10, 190, slots) == (0, 2) and T.place_cell(0, 300, slots) == (0, 3)
    assert T.place_cell(120, 130, slots) == (1, 1) and T.place_cell(900, 910, slots) == (2, 1)
    assert T.has_aligned_column([[100.0], [105.0]]) and not T.has_aligned_column([[100.0], [120.0]]) and not T.has_aligned_column([[100.0, 101.0], []])
    assert T.boundaries([10.0, 12.9, 13.1, 13.0, math.nan, 1e9, 40.0]) == [10.0, 13.1, 40.0]


def chunks(data, **more):
    got = parse(data)
    pages = {p["page"]: {"runs": [], "images": [], "rules": []} for p in got["pages"]}
    for r in got["runs"]:
        pages[r["page"]]["runs"].append((r["text"], r["x0"], r["y0"], r["x1"], r["y1"], r["font_size"]))
    for d in got["draws"]:
        pages[d["page"]]["images"].append(tuple(d[c] for c in "abcdef"))
    for r in got["rules"]:
        pages[r["page"]]["rules"].append((r["vertical"], r["pos"], r["lo"], r["hi"]))
    return B.pack(B.geometry_blocks(pages), **more)


def test_headings_and_packing():
    got = [(c["kind"], c["heading_path"], c["text"].split("\n")[0]) for c in chunks(X.multi_heading())]
    assert got == [
        ("Heading", [], "Chapter One"), ("Heading", ["Chapter One"], "Section A"), ("Paragraph", ["Chapter One", "Section A"], "Alpha body paragraph first line of text."),
        ("Heading", ["Chapter One"], "Section B"), ("Paragraph", ["Chapter One", "Section B"], "Beta body paragraph line."), ("Heading", [], "Chapter Two"), ("Paragraph", ["Chapter Two"], "Gamma paragraph."),
    ]
    assert chunks(X.multi_heading())[-1]["text"] == "Gamma paragraph.\nDelta paragraph."
    assert [c["text"] for c in chunks(X.multi_heading(), target_tokens=5)][-2:] == ["Gamma paragraph.", "Delta paragraph."]
    assert [c["text"] for c in chunks(X.multi_heading(), target_tokens=5, overlap_tokens=3)][-1] == "paragraph.\nDelta paragraph."


def test_tables_from_gaps_and_rules():
    got = chunks(X.table_doc())
    assert [c["kind"] for c in got] == ["Table", "Caption"]
    t = got[0]["table"]
    assert (t["columns"], t["header_rows"]) == (3, 1) and [[c["text"] for c in row] for row in t["rows"]] == X.ROSTER and {c["colspan"] for row in t["rows"] for c in row} == {1}
    assert [len(c["table"]["rows"]) for c in chunks(X.two_tables())] == [2, 2]
    t = chunks(X.ruled_spanning())[0]["table"]
    assert t["columns"] == 2 and len(t["rows"]) == 3 and t["rows"][0][0]["colspan"] == 2 and t["rows"][1][1]["text"] == "Engineer"


def test_rowspan_from_a_missing_rule():
    rules = [(False, y, 0.0, 200.0) for y in (100.0, 60.0)] + [(False, 80.0, 100.0, 200.0)] + [(True, x, 60.0, 100.0) for x in (0.0, 100.0, 200.0)]
    rows = [{"y": 85.0, "size": 10.0, "cells": [["tall", 5.0, 50.0], ["a", 105.0, 120.0]]}, {"y": 65.0, "size": 10.0, "cells": [["b", 105.0, 120.0]]}]
    lattice = T.find_lattice(rules, [5.0, 65.0, 120.0, 95.0])
    t = T.ruled_table(rows, lattice)
    assert t["rows"][0][0]["rowspan"] == 2 and [c["text"] for r in t["rows"] for c in r] == ["tall", "a", "", "b"]
    assert T.find_lattice(rules[:2], [5.0, 65.0, 120.0, 95.0]) is None
    assert T.ruled_table([{"y": 500.0, "size": 1.0, "cells": []}], lattice) is None


def test_figures_adopt_captions():
    got = chunks(X.figure_with_caption())
    assert [(c["kind"], c["text"]) for c in got] == [("Figure", "Figure 1: A sample chart.")] and got[0]["bbox"] == [100, 400, 500, 700]
    assert [(c["kind"], c["text"]) for c in chunks(X.scanned())] == [("Figure", "[figure]")]


def test_tagged_grid():
    cell = lambda tag, text, cs=1, rs=1: {"tag": tag, "text": text, "bbox": None, "col_span": cs, "row_span": rs}
    t = T.tagged_table([[cell("TH", "a"), cell("TH", "b")], [], [cell("TD", "c", 1, 5), cell("TD", "d")], [cell("TD", "e", 900)]])
    assert t["header_rows"] == 1 and t["columns"] == 5 and t["rows"][2][0]["rowspan"] == 2 and t["rows"][3][1]["text"] == "e" and t["rows"][3][1]["colspan"] == 4
    assert T.tagged_table([[], []]) is None and T.tagged_table([[cell("TD", "x")]])["header_rows"] == 0


def test_strips_find_the_first_close_line():
    import random

    rng = random.Random(7)
    for _ in range(30):
        runs = [run(str(i), float(rng.randint(0, 400)), 500.0, rng.uniform(0, 80), rng.choice([4.0, 9.0, 30.0])) for i in range(60)]
        lines = []
        for r in runs:  # as told: the first line there is, in the order they were made
            home = next((ln for ln in lines if abs(ln.y - r[2]) <= 0.5 * max(ln.size, r[5])), None)
            if home is None:
                lines.append(L.Line(r[0], r[2], r[1], r[3], r[5], cells=[[r[0], r[1], r[3]]]))
            else:
                home.add(r)
        want = sorted(lines, key=lambda ln: (-ln.y, ln.x0))
        assert [(ln.text, ln.y) for ln in L.bucket(runs)] == [(ln.text, ln.y) for ln in want]
