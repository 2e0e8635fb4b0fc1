"""Lines to blocks, blocks to chunks: headings, paragraphs, lists, tables, captions, figures."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from .captions import classify_text, estimate_tokens, is_caption, tail_tokens
from .layout import Line, group_lines
from .tables import find_lattice, gap_table, has_aligned_column, ruled_table

#: How much larger than the body a heading is, and when lines belong together.
HEADING_RATIO, SIZE_TOL, LEADING, LEADING_MORE = 1.25, 0.15, 1.9, 4.0
CAPTION_REACH = 3.0
DEFAULT_BODY = 12.0
NO_FIGURE_TEXT = "[figure]"


@dataclass(slots=True)
class Block:
    text: str
    page: int
    kind: str
    bbox: list[float] | None
    size: float
    column: int = 0
    last_y: float = 0.0
    rows: list[dict] = field(default_factory=list)
    gaps: list[list[float]] = field(default_factory=list)
    table: dict | None = None


def round_half_up(x: float) -> int:
    return math.floor(x + 0.5) if x >= 0 else -math.floor(-x + 0.5)


def body_size(sizes: list[float]) -> float:
    """The most frequent size in whole points, the smaller of ties."""
    seen: Counter[int] = Counter()
    for size, n in Counter(sizes).items():
        if math.isfinite(size):
            seen[round_half_up(size)] += n
    return float(min(seen, key=lambda s: (-seen[s], s))) if seen else DEFAULT_BODY


def group_blocks(lines: list[Line], body: float, page: int, rules: list[tuple] = ()) -> list[Block]:
    out: list[Block] = []
    for line in lines:
        heading = line.size > HEADING_RATIO * body
        last = out[-1] if out else None
        joins = (
            last is not None and not heading and last.kind != "Heading" and last.column == line.column
            and abs(last.size - line.size) <= SIZE_TOL * line.size and last.last_y - line.y <= LEADING * line.size + LEADING_MORE
        )
        box = [line.x0, line.y, line.x1, line.y + line.size]
        if joins:
            last.text += "\n" + line.text
            last.bbox = union(last.bbox, box)
        else:
            last = Block(line.text, page, "Heading" if heading else classify_text(line.text), box, line.size, line.column)
            out.append(last)
        last.last_y = line.y
        last.rows.append({"y": line.y, "size": line.size, "cells": line.cells})
        last.gaps.append(line.gap_xs)
    for b in out:
        if b.kind == "Heading":
            continue
        tabular = sum(map(bool, b.gaps))
        if tabular >= 2 and 2 * tabular >= len(b.gaps) and has_aligned_column(b.gaps):
            b.kind = "Table"
            lattice = find_lattice(list(rules), b.bbox)
            b.table = lattice and ruled_table(b.rows, lattice) or gap_table(b.rows, b.bbox)
        elif is_caption(b.text):
            b.kind = "Caption"
    return out


def union(a: list[float] | None, b: list[float] | None) -> list[float] | None:
    if a is None or b is None:
        return a or b
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]


def image_bbox(m: tuple[float, ...]) -> list[float]:
    """The unit square through a matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    xs, ys = (e, e + a, e + c, e + a + c), (f, f + b, f + d, f + b + d)
    return [min(xs), min(ys), max(xs), max(ys)]


def caption_for(box: list[float], lines: list[Line]) -> str | None:
    """The nearest caption below an image, else the nearest above, that overlaps it sideways and is close."""
    near = []
    for k, line in enumerate(lines):
        if min(line.x1, box[2]) <= max(line.x0, box[0]) or not is_caption(line.text):
            continue
        reach = CAPTION_REACH * max(line.size, 1.0)
        if box[1] - reach <= line.y <= box[1]:
            near.append((0, box[1] - line.y, k))
        elif box[3] <= line.y <= box[3] + reach:
            near.append((1, line.y - box[3], k))
    return lines[min(near)[2]].text if near else None


def with_figures(blocks: list[Block], images: list[tuple[float, ...]], lines: list[Line], page: int) -> list[Block]:
    """A page's blocks with its images, each with the caption it adopts, by column and from the top."""
    if not images:
        return blocks
    figures = [(image_bbox(m), caption_for(image_bbox(m), lines)) for m in images]
    adopted = {c for _, c in figures if c is not None}
    blocks = [b for b in blocks if b.kind != "Caption" or b.text not in adopted]
    reach: dict[int, list[float]] = {}
    for b in blocks:
        lo, hi = reach.get(b.column, [math.inf, -math.inf])
        reach[b.column] = [min(lo, b.bbox[0]), max(hi, b.bbox[2])]
    for box, text in figures:
        center = (box[0] + box[2]) / 2
        away = [(max(lo - center, center - hi, 0.0), k) for k, (lo, hi) in sorted(reach.items())]
        blocks = [*blocks, Block(text or NO_FIGURE_TEXT, page, "Figure", box, 1.0, min(away)[1] if away else 0, box[1])]
    return sorted(blocks, key=lambda b: (b.column, -b.bbox[3]))


def geometry_blocks(pages: dict[int, dict]) -> list[Block]:
    """pages: number -> {"runs": [(text, x0, y0, x1, y1, size)], "images": [matrix], "rules": [rule]}."""
    body = body_size([r[5] for p in pages.values() for r in p["runs"]])
    out: list[Block] = []
    for number in sorted(pages):
        page = pages[number]
        lines = group_lines(page["runs"])
        blocks = group_blocks(lines, body, number, page.get("rules") or ())
        out += with_figures(blocks, page.get("images") or [], lines, number)
    return out


def pack(blocks: list[Block], *, target_tokens: int = 512, overlap_tokens: int = 0) -> list[dict]:
    """Chunks: headings alone, other blocks of one page, path and kind together up to the target; tables alone."""
    out: list[dict] = []
    stack: list[tuple[float, str]] = []
    open_: dict | None = None
    used = 0

    def add(b: Block, path: list[str], text: str) -> dict:
        out.append({"text": text, "page": b.page, "kind": b.kind, "heading_path": path, "bbox": b.bbox, "table": b.table})
        return out[-1]

    for b in blocks:
        if b.kind == "Heading":
            while stack and stack[-1][0] <= b.size:
                stack.pop()
            add(b, [t for _, t in stack], b.text)
            stack.append((b.size, b.text))
            open_ = None
            continue
        path, cost, seed = [t for _, t in stack], estimate_tokens(b.text), ""
        if open_ is not None:
            here = open_["page"] == b.page and open_["heading_path"] == path
            alike, full = open_["kind"] == b.kind, used + cost > target_tokens
            if here and alike and not full and open_["kind"] != "Table":
                open_["text"] += "\n" + b.text
                open_["bbox"] = union(open_["bbox"], b.bbox)
                used += cost
                continue
            if overlap_tokens > 0 and here and alike and full:
                seed = tail_tokens(open_["text"], overlap_tokens)
        open_ = add(b, path, f"{seed}\n{b.text}" if seed else b.text)
        used = cost
    for c in out:
        c["token_estimate"] = estimate_tokens(c["text"])
    return out
