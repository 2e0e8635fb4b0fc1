"""Column functions over text: native expressions, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..core.captions import BULLETS, CAPTION_ENDS, CAPTION_MAX_WORDS, CAPTION_WORDS

#: A class with the Unicode white space that Java's \s leaves out.
SPACE = r"(?U)\s"
_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in CAPTION_WORDS)


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def word_count(text: Column) -> Column:
    trimmed = trim(text)
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"(?U)\s+")))


def non_space_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def is_caption(text: Column) -> Column:
    pattern = rf"(?U)^\s*(?:{_ANY_CASE})\.*\s+[0-9]\S*[{CAPTION_ENDS[:-3]}\-–—](?:\s|\z)"
    return (word_count(text) <= CAPTION_MAX_WORDS) & text.rlike(pattern)


def classify_text(text: Column) -> Column:
    trimmed = trim(text)
    marks = BULLETS.replace("-", "\\-")
    return F.when(trimmed.rlike(f"^(?:[{marks}]|[0-9]+[.)])"), "List").otherwise("Paragraph")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("bigint")


def tail_tokens(text: Column, tokens: int) -> Column:
    """The last `tokens` tokens or so, from a whole word on."""
    n = 4 * tokens
    tail = F.substring(text, -n, n)
    cut = F.when(tail.rlike(SPACE), F.regexp_replace(tail, r"(?U)^\S+", "")).otherwise(tail)
    return trim(F.when(F.length(text) <= n, text).otherwise(cut))


def context_prefix(title: Column, path: Column, page: Column) -> Column:
    """Title > H1 > H2 (p.N); only (p.N) without a trail."""
    head = F.when(F.coalesce(title, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(title))
    trail = F.array_join(F.concat(head, path), " > ")
    place = F.concat(F.lit("(p."), page.cast("string"), F.lit(")"))
    return F.when(trail == "", place).otherwise(F.concat(trail, F.lit(" "), place))


def escape_block_markers(text: Column) -> Column:
    """A backslash before #, > or | that a line begins with; only LF ends a line."""
    return F.regexp_replace(text, r"(?mdU)^([^\S\n]*)([#>\|])", r"$1\\$2")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def csv_field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(r'(?U)[,"\n\r]|^\s|\s\z'), quoted).otherwise(text)


def fold_breaks(text: Column) -> Column:
    """Line ends and tabs to spaces, as shown text has them."""
    return F.translate(text, "\n\r\t", "   ")


def is_pdf(content: Column) -> Column:
    """%PDF- among the first 1024 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0


def base64_line(content: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def data_url(content: Column, media_type: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{media_type};base64,"), base64_line(content))
