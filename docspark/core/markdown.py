"""Chunks of one document as Markdown; the Spark form is operators.serialize.to_markdown."""

from __future__ import annotations

import re

_MARKER = re.compile(r"^(\s*?)([#>|])")


def escape_markers(text: str) -> str:
    return "\n".join(_MARKER.sub(r"\1\\\2", line) if line.lstrip()[:1] in ("#", ">", "|") else line for line in text.split("\n"))


def pipe_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in row + [""] * (width - len(row))) + " |" for row in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) if lines else ""


def chunk_markdown(c: dict) -> str:
    text, kind = c["text"], c["kind"]
    if kind == "Heading":
        return "#" * min(len(c["heading_path"]) + 1, 6) + " " + escape_markers(text.strip())
    if kind in ("Caption", "Figure"):
        return f"*{text.strip()}*"
    if kind == "Table":
        rows = [[x["text"] for x in row] for row in c["table"]["rows"]] if c["table"] else [[x.strip() for x in line.split("\t")] for line in text.splitlines()]
        return pipe_table(rows) if c["table"] or max(map(len, rows), default=0) >= 2 else text.rstrip()
    return text.rstrip() if kind == "List" else escape_markers(text.rstrip())


def to_markdown(chunks: list[dict]) -> str:
    out = ""
    for c in chunks:
        out += ("\n\n" if out else "") + chunk_markdown(c)
    return out
