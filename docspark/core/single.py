"""One document from bytes to chunks, text, trees and figures; what the command line and the fused operators use."""

from __future__ import annotations

import json

from ..pdf.document import parse
from .blocks import Block, caption_for, geometry_blocks, image_bbox, pack, union
from .captions import stable_id
from .layout import group_lines, reflow
from .tables import tagged_table

HEADINGS = {f"H{i}": i for i in range(1, 7)} | {"H": 1}
PARAGRAPHS = {"P", "Formula", "BlockQuote", "Quote", "Note", "Reference", "BibEntry"}
SAME = {"L": "List", "Table": "Table", "Figure": "Figure", "Caption": "Caption"}
NO_FIGURE_TEXT = "[figure]"
RUN = ("text", "x0", "y0", "x1", "y1", "font_size")


def pages_of(parsed: dict) -> dict[int, dict]:
    out = {p["page"]: {"runs": [], "images": [], "rules": []} for p in parsed["pages"]}
    for r in parsed["runs"]:
        out[r["page"]]["runs"].append(tuple(r[c] for c in RUN))
    for d in parsed["draws"]:
        out[d["page"]]["images"].append(tuple(d[c] for c in "abcdef"))
    for r in parsed["rules"]:
        out[r["page"]]["rules"].append((r["vertical"], r["pos"], r["lo"], r["hi"]))
    return out


def with_content(parsed: dict) -> list[dict]:
    """Nodes with own text and box out of their marked content, and box and full text of their subtrees."""
    held: dict[tuple[int, int], list] = {}
    for r in parsed["runs"]:
        if r["mcid"] is not None:
            had = held.setdefault((r["page"], r["mcid"]), ["", None])
            had[0] += r["text"]
            had[1] = union(had[1], [r["x0"], r["y0"], r["x1"], r["y1"]])
    nodes = [dict(n, own="", box=None) for n in parsed["nodes"]]
    for k in parsed["kids"]:
        text, box = held.get((k["page"], k["mcid"]), ("", None))
        nodes[k["node_ix"]]["own"] += text
        nodes[k["node_ix"]]["box"] = union(nodes[k["node_ix"]]["box"], box)
    for n in reversed(nodes):
        if n["parent_ix"] >= 0:
            nodes[n["parent_ix"]]["box"] = union(nodes[n["parent_ix"]]["box"], n["box"])
    return nodes


def full_text(nodes: list[dict], n: dict) -> str:
    return "\n".join(t for x in nodes[n["node_ix"] : n["last_ix"] + 1] if (t := x["own"]))


def grid_of(nodes: list[dict], table: dict) -> dict | None:
    rows, end = [], -1
    for n in nodes[table["node_ix"] + 1 : table["last_ix"] + 1]:
        if n["tag"] == "TR" and n["node_ix"] > end:
            rows.append(n)
            end = n["last_ix"]
    cells = lambda r: [{"tag": c["tag"], "text": full_text(nodes, c), "bbox": c["box"], "col_span": c["col_span"], "row_span": c["row_span"]} for c in nodes[r["node_ix"] + 1 : r["last_ix"] + 1] if c["parent_ix"] == r["node_ix"] and c["tag"] in ("TH", "TD")]
    return tagged_table([cells(r) for r in rows]) if rows else None


def tagged_blocks(parsed: dict) -> list[Block]:
    nodes, out, page, end = with_content(parsed), [], 1, -1
    for n in nodes:
        page = n["page"] or page
        tag = n["tag"]
        kind = "Heading" if tag in HEADINGS else "Paragraph" if tag in PARAGRAPHS else SAME.get(tag)
        if kind is None or n["node_ix"] <= end:
            continue
        end = n["last_ix"]
        text = full_text(nodes, n)
        if kind == "Figure":
            text = n["alt"] or text or NO_FIGURE_TEXT
        if text or kind == "Table":
            out.append(Block(text, page, kind, n["box"], 7.0 - HEADINGS[tag] if kind == "Heading" else 0.0, table=grid_of(nodes, n) if kind == "Table" else None))
    return [b for b in out if b.text]


def chunk_parsed(parsed: dict, *, target_tokens: int = 512, overlap_tokens: int = 0, contextual_prefix: bool = False) -> list[dict]:
    """Chunks of a parsed document: by its tags if they make any block, else by its layout."""
    blocks = tagged_blocks(parsed) if parsed["tagged"] else []
    out = pack(blocks or geometry_blocks(pages_of(parsed)), target_tokens=target_tokens, overlap_tokens=overlap_tokens)
    at = 0
    for c in out:
        c["char_start"], c["char_len"] = at, len(c["text"])
        at += len(c["text"]) + 2
        c["id"] = stable_id(c["page"], c["kind"], c["text"])
        trail = " > ".join([*filter(None, [parsed["meta"]["title"]]), *c["heading_path"]])
        c["context"] = f"{trail} (p.{c['page']})".strip() if contextual_prefix else None
    return out


def chunk_document(data: bytes, password: str | None = None, **options) -> list[dict]:
    return chunk_parsed(parse(data, password), **options)


def page_texts(parsed: dict) -> list[str]:
    pages = pages_of(parsed)
    return [reflow(group_lines(pages[p["page"]]["runs"])) for p in parsed["pages"]]


def join_capped(texts: list[str], cap: int) -> tuple[str, bool]:
    out = ""
    for t in texts:
        if out and len(out) < cap:
            out += "\n"
        room = cap - len(out)
        out += t[:room]
        if len(t) > room:
            return out, True
    return out, False


def outline_tree(rows: list[dict]) -> list[dict]:
    made = [{"title": r["title"], "page": r["page"], "children": []} for r in rows]
    for r in rows:
        if r["parent_ix"] >= 0:
            made[r["parent_ix"]]["children"].append(made[r["node_ix"]])
    return [made[r["node_ix"]] for r in rows if r["parent_ix"] < 0]


def structure_tree(parsed: dict) -> dict | None:
    if not parsed["tagged"]:
        return None
    nodes = with_content(parsed)
    made = [{"tag": n["tag"], "raw_tag": n["raw_tag"], "text": n["own"], "alt": n["alt"], "page": n["page"], "children": []} for n in nodes]
    for n in nodes[1:]:
        made[n["parent_ix"]]["children"].append(made[n["node_ix"]])
    return made[0]


def figures(parsed: dict) -> list[dict]:
    out = []
    for number, page in sorted(pages_of(parsed).items()):
        lines = group_lines(page["runs"]) if page["images"] else []
        out += [{"page": number, "bbox": image_bbox(m), "caption": caption_for(image_bbox(m), lines)} for m in page["images"]]
    return out


def to_json(chunks: list[dict]) -> str:
    names = ["id", "text", "context", "page", "bbox", "kind", "heading_path", "char_start", "char_len", "token_estimate"]
    return json.dumps([{k: c[k] for k in names} | ({"table": c["table"]} if c["table"] else {}) for c in chunks], indent=2, ensure_ascii=False)


def document_text(chunks: list[dict]) -> str:
    return "\n\n".join(c["text"] for c in chunks)
