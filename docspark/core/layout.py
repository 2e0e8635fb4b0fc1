"""Reading order of one page: positioned runs to lines, columns and text.

A run is (text, x0, y0, x1, y1, size). Runs come in content order, which decides ties.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

#: What separates words and table cells (in font sizes), and what makes a column.
WORD_GAP, CELL_GAP = 0.25, 4.0
SAME_LINE = 0.5
GUTTER_COVER, GUTTER_SIZES = 0.10, 3.0
MAX_GUTTERS, MIN_COLUMN_LINES, MAX_BINS = 3, 5, 20_000
PARAGRAPH_GAP = 1.8
DEFAULT_SIZE = 12.0


@dataclass(slots=True)
class Line:
    text: str
    y: float
    x0: float
    x1: float
    size: float
    gap_xs: list[float] = field(default_factory=list)
    cells: list[list] = field(default_factory=list)  # [text, x0, x1]
    column: int = 0

    def add(self, run: tuple) -> None:
        text, x0, _, x1, _, size = run
        unit, gap = max(self.size, size), x0 - self.x1
        if gap > CELL_GAP * unit:
            self.gap_xs.append((self.x1 + x0) / 2)
            self.cells.append([text, x0, x1])
            self.text += "\t" + text
        else:
            glue = " " if self.text and self.text[-1] not in " \t" and not text.startswith(" ") and gap > WORD_GAP * unit else ""
            self.text += glue + text
            cell = self.cells[-1]
            cell[0] += glue + text
            cell[2] = max(cell[2], x1)
        self.x0, self.x1, self.size = min(self.x0, x0), max(self.x1, x1), unit


def upper_median(sizes: list[float]) -> float:
    kept = sorted(s for s in sizes if s > 0.5)
    return kept[len(kept) // 2] if kept else DEFAULT_SIZE


def bucket(runs: list[tuple], column: int = 0) -> list[Line]:
    """Runs to lines: the first line of a close baseline takes a run.

    Lines are looked up by strips as high as the widest tolerance, so a page of many lines costs no more for each."""
    lines: list[Line] = []
    strips: dict[int | None, list[int]] = {}
    high = max((SAME_LINE * r[5] for r in runs if r[5] < math.inf), default=0.0) or 1.0
    before, beside, home = None, 0.0, None
    for run in runs:
        text, x0, y, x1, _, size = run
        if y == before and size == beside:  # only the line that took the last run has changed since, and it has grown
            home.add(run)
            continue
        at = math.floor(y / high) if math.isfinite(y) else None
        before, beside = (y, size) if at is not None and size >= 0 else (None, 0.0)
        home, first = None, len(lines)
        for strip in (at - 1, at, at + 1) if at is not None else (None,):
            for k in strips.get(strip, ()):  # in the order they began
                if k >= first:
                    break
                line = lines[k]
                tall = line.size
                if abs(line.y - y) <= SAME_LINE * (tall if tall > size else size):
                    home, first = line, k
                    break
        if home is None:
            strips.setdefault(at, []).append(len(lines))
            home = Line(text, y, x0, x1, size, [], [[text, x0, x1]], column)
            lines.append(home)
        else:
            home.add(run)
    return sorted(lines, key=lambda ln: (-ln.y if ln.y == ln.y else math.inf, ln.x0 if ln.x0 == ln.x0 else math.inf))


def baselines(runs: list[tuple]) -> int:
    """How many distinct baselines the runs have, first fit."""
    seen: list[tuple[float, float]] = []
    for _, _, y, _, _, size in runs:
        if not any(abs(at - y) <= SAME_LINE * max(tall, size) for at, tall in seen):
            seen.append((y, size))
    return len(seen)


@dataclass(frozen=True)
class Columns:
    bands: tuple[tuple[float, float], ...]
    middles: tuple[float, ...]

    def spans(self, run: tuple) -> bool:
        return any(run[1] <= m <= run[3] for m in self.middles)

    def band(self, run: tuple) -> int:
        center = (run[1] + run[3]) / 2
        away = [0.0 if lo <= center < hi else min(abs(center - lo), abs(center - hi)) for lo, hi in self.bands]
        return away.index(min(away))


def find_columns(runs: list[tuple]) -> Columns | None:
    """Vertical strips that almost no run covers part a page into columns of at least five lines each."""
    if len({r[2] for r in runs}) < MIN_COLUMN_LINES:  # too few baselines for any column
        return None
    x_min, x_max = min(r[1] for r in runs), max(r[3] for r in runs)
    width = x_max - x_min
    if not math.isfinite(width) or width <= 0 or any(not math.isfinite(v) for r in runs for v in r[1:5]):
        return None
    bins = math.ceil(width)
    if not 0 < bins <= MAX_BINS:
        return None
    steps = np.zeros(bins + 1)
    for _, x0, y0, x1, y1, _ in runs:
        lo, hi = math.floor(x0 - x_min), min(math.ceil(x1 - x_min), bins)
        if hi > lo:
            steps[lo] += y1 - y0
            steps[hi] -= y1 - y0
    height = max(max(r[4] for r in runs) - min(r[2] for r in runs), 1.0)
    bare = np.cumsum(steps[:-1]) / height <= GUTTER_COVER
    edge = np.flatnonzero(np.diff(np.r_[False, bare, False].astype(np.int8)))
    need = GUTTER_SIZES * upper_median([r[5] for r in runs])
    gutters = [(x_min + s, x_min + e) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if s > 0 and e < bins and e - s >= need]
    if not 1 <= len(gutters) <= MAX_GUTTERS:
        return None
    starts = [x_min, *(g[1] for g in gutters)]
    ends = [*(g[0] for g in gutters), x_max]
    found = Columns(tuple(zip(starts, ends, strict=True)), tuple((a + b) / 2 for a, b in gutters))
    for lo, hi in found.bands:
        inside = [r for r in runs if lo <= (r[1] + r[3]) / 2 < hi and not found.spans(r)]
        if baselines(inside) < MIN_COLUMN_LINES:
            return None
    return found


def group_lines(runs: list[tuple]) -> list[Line]:
    """All lines of a page in reading order: what stands above the columns, each column, what stands below."""
    columns = find_columns(runs)
    if columns is None:
        return bucket(runs)
    in_band: list[list[tuple]] = [[] for _ in columns.bands]
    across = []
    for run in runs:
        across.append(run) if columns.spans(run) else in_band[columns.band(run)].append(run)
    ys = [r[2] for part in in_band for r in part]
    if not ys or any(min(ys) < r[2] < max(ys) for r in across):
        return bucket(runs)
    out = bucket([r for r in across if r[2] >= max(ys)])
    for k, part in enumerate(in_band, 1):
        out += bucket(part, k)
    return out + bucket([r for r in across if r[2] < max(ys)], len(in_band) + 1)


def reflow(lines: list[Line]) -> str:
    """A page's text: a blank line where a paragraph or a column ends."""
    out: list[str] = []
    for k, line in enumerate(lines):
        if k:
            before = lines[k - 1]
            wide = before.column == line.column and before.y - line.y > PARAGRAPH_GAP * line.size
            out.append("\n\n" if wide or before.column != line.column else "\n")
        out.append(line.text.rstrip())
    return "".join(out)
