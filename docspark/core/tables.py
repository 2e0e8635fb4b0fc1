"""Table grids: from aligned gaps, from ruled lines, and from tagged rows.

A grid is {"columns", "header_rows", "rows"}; a row has a cell for each column: {"text", "bbox", "col", "colspan",
"rowspan"}. Cells that a span covers are there, empty.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import groupby

ALIGN = 8.0
MAX_SPAN = 1000
#: Fixed values of the lattice: how far a rule may lie from the text, and from another of the same boundary.
SEED_MARGIN, GRID_TOL = 24.0, 3.0
MAX_BOUNDARIES, MAX_CELLS = 128, 4096
THIN = 1e-3


def cell(text: str, bbox: list[float], col: int, colspan: int = 1, rowspan: int = 1) -> dict:
    return {"text": text, "bbox": bbox, "col": col, "colspan": colspan, "rowspan": rowspan}


def _clusters(points: list[tuple[float, int]], tol: float) -> list[tuple[float, int]]:
    """(first x, distinct rows) of runs of sorted points that lie within tol of their first."""
    out: list[tuple[float, int]] = []
    first, rows = 0.0, set()
    for x, row in sorted(points):
        if rows and x - first <= tol:
            rows.add(row)
        else:
            if rows:
                out.append((first, len(rows)))
            first, rows = x, {row}
    if rows:
        out.append((first, len(rows)))
    return out


def has_aligned_column(gap_rows: list[list[float]]) -> bool:
    return any(rows >= 2 for _, rows in _clusters([(x, r) for r, xs in enumerate(gap_rows) for x in xs], ALIGN))


def column_lefts(rows: list[dict]) -> list[float]:
    """Left edges that two rows or more share."""
    points = [(c[1], r) for r, row in enumerate(rows) for c in row["cells"] if math.isfinite(c[1])]
    return [x for x, n in _clusters(points, ALIGN) if n >= 2]


def place_cell(x0: float, x1: float, slots: list[tuple[float, float]]) -> tuple[int, int]:
    """(column, columns covered): slots covered by half or more, else the one that holds the center."""
    first, n = -1, 0
    for i, (lo, hi) in enumerate(slots):
        wide = hi - lo
        if wide > THIN and 2 * max(0.0, (x1 if x1 < hi else hi) - (x0 if x0 > lo else lo)) >= wide:
            first, n = (i if n == 0 else first), n + 1
    if n:
        return first, n
    center = (x0 + x1) / 2
    return next((i for i, (lo, hi) in enumerate(slots) if lo <= center < hi), len(slots) - 1), 1


def gap_table(rows: list[dict], bbox: list[float]) -> dict | None:
    """rows: {"y", "size", "cells": [[text, x0, x1]]}, from the top."""
    lefts = column_lefts(rows)
    if len(rows) < 2 or not bbox[2] > bbox[0] or not lefts:
        return None
    bounds: list[float] = []
    for x in [min(bbox[0], lefts[0]), *lefts[1:], bbox[2]]:
        if not bounds or abs(x - bounds[-1]) >= THIN:
            bounds.append(x)
    slots = list(zip(bounds, bounds[1:], strict=False))
    if not slots:
        return None
    grid, places = [], {}
    for row in rows:
        y0 = row["y"]
        y1 = y0 + max(row["size"], THIN)
        made: list[dict | None] = [None] * len(slots)
        for text, x0, x1 in row["cells"]:
            at = places.get((x0, x1))
            if at is None:
                at = places[x0, x1] = place_cell(x0, x1, slots)
            col, span = at
            here = made[col]
            if here and here["text"]:
                here["text"] += " " + text
                here["bbox"][2] = max(here["bbox"][2], x1)
                here["colspan"] = max(here["colspan"], span)
            else:
                left = min(x0, x1)
                made[col] = {"text": text, "bbox": [left, y0, max(x1, left + THIN), y1], "col": col, "colspan": span, "rowspan": 1}
        grid.append([c or cell("", [lo, y0, max(hi, lo + THIN), y1], i) for i, (c, (lo, hi)) in enumerate(zip(made, slots, strict=True))])
    return {"columns": len(slots), "header_rows": 1, "rows": grid}


def boundaries(values: list[float]) -> list[float]:
    """Values in hundredths, each run within the tolerance of its first merged into that."""
    out: list[int] = []
    for v in sorted(math.floor(abs(x) * 100 + 0.5) * (1 if x >= 0 else -1) for x in values if math.isfinite(x) and abs(x) < 100_000):
        if not out or v - out[-1] > int(GRID_TOL * 100):
            out.append(v)
    return [v / 100 for v in out]


class Lattice:
    """Column boundaries from the left, row boundaries from the top, and the rules between; a rule is (vertical, pos, lo, hi)."""

    def __init__(self, rules: list[tuple]) -> None:
        self.rules = rules
        self.xs = boundaries([r[1] for r in rules if r[0]])
        self.ys = boundaries([r[1] for r in rules if not r[0]])[::-1]
        self.extents: dict[tuple[bool, float], list[tuple[float, float]]] = {}

    def along(self, vertical: bool, at: float) -> list[tuple[float, float]]:
        """(lo, hi) of the rules at this boundary, looked up once."""
        found = self.extents.get((vertical, at))
        if found is None:
            found = self.extents[vertical, at] = [(low, h) for v, p, low, h in self.rules if v == vertical and abs(p - at) <= GRID_TOL]
        return found

    def ruled(self, vertical: bool, at: float, a: float, b: float) -> bool:
        """Whether one rule at this boundary covers half of a..b or more."""
        lo, hi = min(a, b), max(a, b)
        half = (hi - lo) / 2
        for low, h in self.along(vertical, at):
            if max(0.0, min(h, hi) - max(low, lo)) >= half:
                return True
        return False

    def closed(self) -> bool:
        if min(len(self.xs), len(self.ys)) < 2 or max(len(self.xs), len(self.ys)) > MAX_BOUNDARIES or (len(self.xs) - 1) * (len(self.ys) - 1) > MAX_CELLS:
            return False

        def spanning(vertical: bool, at: list[float], extent: float) -> int:
            return sum(any(h - low >= extent / 2 for low, h in self.along(vertical, b)) for b in at)

        return spanning(True, self.xs, self.ys[0] - self.ys[-1]) >= 2 and spanning(False, self.ys, self.xs[-1] - self.xs[0]) >= 2


def _near(rule: tuple, box: list[float], margin: float) -> bool:
    vertical, pos, lo, hi = rule
    a, b, c, d = (box[0], box[2], box[1], box[3]) if vertical else (box[1], box[3], box[0], box[2])
    return a - margin <= pos <= b + margin and hi >= c - margin and lo <= d + margin


def find_lattice(rules: list[tuple], bbox: list[float]) -> Lattice | None:
    """The closed grid over a block: rules near its text show how far the table reaches, and all rules there count."""
    if not (bbox[2] > bbox[0] and bbox[3] > bbox[1]):
        return None
    box = list(bbox)
    for vertical, pos, lo, hi in (r for r in rules if _near(r, bbox, SEED_MARGIN)):
        x0, y0, x1, y1 = (pos, lo, pos, hi) if vertical else (lo, pos, hi, pos)
        box = [min(box[0], x0), min(box[1], y0), max(box[2], x1), max(box[3], y1)]
    made = Lattice([r for r in rules if _near(r, box, GRID_TOL)])
    return made if made.closed() else None


class _Slots:
    """Cells by (row, column), and what their spans cover."""

    def __init__(self) -> None:
        self.cells: dict[tuple[int, int], dict] = {}
        self.covered: set[tuple[int, int]] = set()

    def put(self, row: int, made: dict) -> None:
        self.cells[row, made["col"]] = made
        if made["rowspan"] > 1 or made["colspan"] > 1:
            area = {(row + i, made["col"] + j) for i in range(made["rowspan"]) for j in range(made["colspan"])}
            self.covered |= area - {(row, made["col"])}


def ruled_table(rows: list[dict], lattice: Lattice) -> dict | None:
    """Text rows placed into a lattice; a span goes on where a rule is missing. None if a row lies outside."""
    xs, ys = lattice.xs, lattice.ys
    n_cols, n_rows = len(xs) - 1, len(ys) - 1
    slots = _Slots()
    for row in rows:
        y = row["y"]
        r = next((i for i in range(n_rows) if ys[i + 1] < y <= ys[i] or i == n_rows - 1 and y == ys[-1]), None)
        if r is None:
            return None
        for text, x0, _ in row["cells"]:
            c = max(0, min(bisect_right(xs, x0 + GRID_TOL), n_cols) - 1)
            while (r, c) in slots.covered and c + 1 < n_cols:
                c += 1
            if (r, c) in slots.cells:
                slots.cells[r, c]["text"] += " " + text
                continue
            colspan = next((k for k in range(1, n_cols - c) if lattice.ruled(True, xs[c + k], ys[r], ys[r + 1])), n_cols - c)
            left, right = xs[c], xs[c + colspan]
            rowspan = next((k for k in range(1, n_rows - r) if lattice.ruled(False, ys[r + k], left, right)), n_rows - r)
            slots.put(r, cell(text, [left, ys[r + rowspan], right, ys[r]], c, colspan, rowspan))
    if not slots.cells:
        return None
    grid = [[slots.cells.get((r, c)) or cell("", [xs[c], ys[r + 1], xs[c + 1], ys[r]], c) for c in range(n_cols)] for r in range(n_rows)]
    return {"columns": n_cols, "header_rows": 1, "rows": grid}


def tagged_table(rows: list[list[dict]]) -> dict | None:
    """rows of {"tag", "text", "bbox", "col_span", "row_span"} cells, TH or TD, placed as HTML places them."""
    most = sum(map(len, rows))
    slots, columns = _Slots(), 0
    for r, cells in enumerate(rows):
        c = 0
        for x in cells:
            while (r, c) in slots.covered:
                c += 1
            colspan = min(max(1, min(x["col_span"], MAX_SPAN)), max(most - c, 1))
            rowspan = min(max(1, min(x["row_span"], MAX_SPAN)), max(len(rows) - r, 1))
            slots.put(r, cell(x["text"], x["bbox"] or [0.0] * 4, c, colspan, rowspan))
            c += colspan
            columns = max(columns, c)
    if not columns:
        return None
    filled = [{x["tag"] for x in cells} for cells in rows]
    header = 0
    for head, run in groupby(filled, key=lambda tags: tags <= {"TH"}):
        header = sum(bool(tags) for tags in run) if head else 0
        break
    grid = [[slots.cells.get((r, c)) or cell("", [0.0] * 4, c) for c in range(columns)] for r in range(len(rows))]
    return {"columns": columns, "header_rows": header, "rows": grid}
