"""Texts that announce a figure or table, list items, and other tests of one string."""

from __future__ import annotations

import re

#: The words a caption begins with, and what its number may end in.
CAPTION_WORDS = ("figure", "fig", "table", "exhibit", "chart", "diagram", "plate")
CAPTION_ENDS = ":.)-–—"
CAPTION_MAX_WORDS = 15
BULLETS = "•-*–·‣◦"

_SPACE = re.compile(r"\s")
_NUMBERED = re.compile(r"[0-9]+[.)]")


def is_caption(text: str) -> bool:
    words = text.split()
    if len(words) > CAPTION_MAX_WORDS or len(words) < 2:
        return False
    head = words[0].rstrip(".")
    return head.isascii() and head.lower() in CAPTION_WORDS and words[1][0] in "0123456789" and words[1][-1] in CAPTION_ENDS


def classify_text(text: str) -> str:
    text = text.strip()
    return "List" if text[:1] and text[0] in BULLETS or _NUMBERED.match(text) else "Paragraph"


def estimate_tokens(text: str) -> int:
    return max(1, -(-len(text) // 4))


def tail_tokens(text: str, tokens: int) -> str:
    """The last `tokens` tokens or so, from a whole word on."""
    if len(text) <= 4 * tokens:
        return text.strip()
    tail = text[len(text) - 4 * tokens :] if tokens else text
    space = _SPACE.search(tail)
    return tail[space.start() :].strip() if space else tail.strip()


def stable_id(page: int, kind: str, text: str) -> str:
    """FNV-1a, 64 bits, over the page (8 bytes, little endian), the kind in lower case, a NUL and the text."""
    h = 0xCBF29CE484222325
    for b in page.to_bytes(8, "little") + kind.lower().encode() + b"\0" + text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"
