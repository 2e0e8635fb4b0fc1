"""Main text of web pages by equivalence-class template deduction.

Pages of one host are taken in groups. Their tokens are tags with the path they stand at, and text blocks;
tokens of one occurrence vector over the group's pages form a class. A class is valid if it occurs on
two different pages or more, has two tokens or more, its tokens keep one order on all pages, and it nests: between
two neighbours of a wider class it lies in one gap only. The valid classes make the template. What lies between
template tokens are slots; slots whose template tags are menus, adverts, notices, forms, comments and the like are
left out, constant text belongs to the template, and the text of the remaining slots is the result.

Text counts as constant by the share of the group's versions that hold it: pages that have half of their text in
common are copies of each other and one version, so copies and near copies keep their text. Outside an article it
takes half of the versions, two at least, and four for long text; inside, four fifths and four at least, and only
for text in a container of the article, not for its own paragraphs. An article (a tag, a role, or the word main in a
class or id) counts where it holds half of the page's slots or more. A page alone on its host has no vectors to
compare; its own tags then are its template.

A class or role names what an element is for, and so does the id of a container; the id of a heading, a paragraph or
a piece of text is a link target and says nothing. An element that is left out inside a line takes only its own text
with it, and the line goes on. Formulas are text.

Pages travel compressed. Hosts of more than CELL pages are spread by page id into cells of about that size (hosts of
more than CELL pages and a HEAVY_SHARE-th of all; so at most HEAVY_SHARE host names reach the driver, and no key holds
more than such a share). Groups are streamed, GROUP pages at a time, and the last of a cell's pages are dealt to
two groups of like size, so that none is left to a page or two.

Defined results: null or empty html gives an empty text; a url without a host is a host of its own kind; repeated
rows give a row each; markup that breaks off is closed at its end. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches

GROUP = 32
#: Characters from which on a text is long, and the versions that hold a template's long text, or text in an article, at least.
LONG, SURE = 120, 4
#: Pages of a cell that a host is spread into, and the share of all pages that a host not spread may hold.
CELL, HEAVY_SHARE = 64, 100_000

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea noscript template iframe noembed noframes title xmp".split())
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody
    td tfoot th thead title tr ul""".split()
)
_DROPPED = frozenset(
    """nav footer aside form script style noscript template iframe noembed noframes textarea button select option input label
    fieldset head title svg annotation annotation-xml canvas object audio video dialog menu search""".split()
)
#: Parts of class names, ids and roles that mark what is no article text.
_WORDS = frozenset(
    """nav navbar navigation menu menubar sidebar side footer foot header masthead ad ads adv advert adverts advertisement
    advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal
    overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments
    disqus respond reply replies breadcrumb breadcrumbs pagination pager widget toolbar search skip contentinfo complementary
    paywall toc tags""".split()
)
#: Inside an article these mark its own title.
_HEADS = frozenset(("header", "masthead", "banner"))
_CLOSES_P = _BLOCK - {"body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption", "li", "dd", "dt"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements whose id is a link target, not a name.
_TARGETS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd a span b i em strong tr td th caption figcaption summary sup sub cite code pre".split())
_BOXES = frozenset("div section ul ol dl table figure details blockquote center address".split())
_SCOPE = frozenset("article main section div nav aside footer header form table td th body blockquote ul ol dl".split())


class Element:
    """An open element: its tag, path, and whether its text is dropped, in an article (1 by a word, 2 by a tag or role), or in a container there."""

    __slots__ = ("tag", "path", "drop", "main", "boxed")

    def __init__(self, tag: str, attrs: str, parent: Element | None) -> None:
        words, hidden, role = set(), False, False
        for name, value in _ATTR.findall(attrs) if attrs else ():
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "role") or name == "id" and tag not in _TARGETS:
                words |= set(re.split(r"[^a-z0-9]+", value))
                words |= set(value.split())
                role |= name == "role" and value == "main"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
        up_drop, up_main = (parent.drop, parent.main) if parent else (False, 0)
        self.tag = tag
        self.main = max(up_main, 2 if tag in ("article", "main") or role else int("main" in words))
        self.boxed = bool(parent and parent.boxed or up_main and tag in _BOXES)
        marks = words & _WORDS - (_HEADS if up_main else frozenset())
        named = bool(marks) and tag not in ("html", "body", "article", "main")
        self.drop = up_drop or hidden or tag in _DROPPED or tag == "header" and not up_main or named or tag == "article" and bool(words & {"comment", "comments", "reply"})
        self.path = hash32((parent.path if parent else 0, tag, " ".join(sorted(words))))


def hash32(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


class Page:
    """One page's tokens in order, its text blocks: (place among the tokens, drop, main, text), and of each kept text's token (main, boxed, length)."""

    __slots__ = ("tokens", "blocks", "texts", "has_main")

    def __init__(self, source: str) -> None:
        self.tokens: list[int] = []
        self.blocks: list[tuple[int, bool, int, str]] = []
        self.texts: dict[int, tuple[int, bool, int]] = {}
        self.has_main = 0
        stack: list[Element] = []
        seen: dict[tuple, Element] = {}
        text: list[str] = []
        lines: list[tuple[int, list[str]]] = []  # where an element that is left out stands inside a line: its depth, the line so far

        def flush() -> None:
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if joined:
                    e = stack[-1] if stack else None
                    drop, main = (e.drop, e.main) if e else (False, 0)
                    self.blocks.append((len(self.tokens), drop, main, joined))
                    token = hash32((e.path if e else 0, "text", "" if drop else joined))
                    self.tokens.append(token)
                    if not drop:
                        self.texts[token] = (main, bool(e and e.boxed), len(joined))

        def pop(n: int) -> None:
            while len(stack) > n:
                e = stack[-1]
                if e.tag in _BLOCK or e.drop:
                    flush()
                stack.pop()
                if lines and lines[-1][0] == len(stack):
                    text[:] = lines.pop()[1]

        at, end = 0, len(source)
        while at < end:
            m = _MARKUP.search(source, at)
            if m is None:
                text.append(source[at:])
                break
            if m.start() > at:
                text.append(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    text.append(entities.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag = m[2].lower()
            if m[1]:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), -1)
                if k >= 0 and (tag in _SCOPE or not any(e.tag in _SCOPE for e in stack[k + 1 :])):
                    pop(k)
                    self.tokens.append(hash32((stack[-1].path if stack else 0, "/" + tag)))
                elif tag in _BLOCK:
                    flush()
                continue
            if tag in _CLOSES_P:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "p" or stack[i].tag in _SCOPE), -1)
                if k >= 0 and stack[k].tag == "p":
                    pop(k)
            if tag in _SIBLINGS:
                same, stop = _SIBLINGS[tag]
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in same or stack[i].tag in stop), -1)
                if k >= 0 and stack[k].tag in same:
                    while k and stack[k - 1].tag in same:
                        k -= 1
                    pop(k)
            if tag in _BLOCK:
                flush()
            if tag in _VOID:
                text.append(" " if tag in ("br", "wbr", "hr") else "")
                continue
            parent = stack[-1] if stack else None
            key = (parent.path if parent else 0, parent.drop if parent else False, parent.main if parent else 0, parent.boxed if parent else False, tag, m[3])
            e = seen.get(key)
            if e is None:
                e = seen[key] = Element(tag, m[3], parent)
            self.has_main = max(self.has_main, 0 if e.drop else e.main)
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if m[3].endswith("/") and tag not in _BLOCK:
                continue
            if e.drop and text and not (parent and parent.drop):
                lines.append((len(stack), text[:]))
                text.clear()
            stack.append(e)
            self.tokens.append(e.path)
        pop(0)
        flush()


def _constant(pages: list[Page]) -> set[int]:
    """The text tokens that enough versions hold."""
    root = list(range(len(pages)))
    sizes = [sum(x[2] for x in p.texts.values()) for p in pages]
    for b in range(len(pages)):
        for a in range(b):
            if root[a] != root[b]:
                both = sum(pages[a].texts[t][2] for t in pages[a].texts.keys() & pages[b].texts.keys())
                if 2 * both >= max(sizes[a], sizes[b]):
                    old, new = root[b], root[a]
                    root = [new if x == old else x for x in root]
    versions: dict[int, set[int]] = defaultdict(set)
    kinds: dict[int, tuple[int, bool, int]] = {}
    for p, x in zip(pages, root, strict=True):
        for t, kind in p.texts.items():
            versions[t].add(x)
            kinds[t] = kind
    n, out = len(set(root)), set()
    for t, held in versions.items():
        main, boxed, length = kinds[t]
        if main:
            if boxed and len(held) >= SURE and 5 * len(held) >= 4 * n:
                out.add(t)
        elif 2 * len(held) >= n and len(held) >= (2 if length < LONG else SURE):
            out.add(t)
    return out


def deduce(pages: list[Page]) -> set[int]:
    """The tokens of the template: the union of the valid equivalence classes."""
    different = list({tuple(p.tokens): p for p in pages}.values())
    if len(different) < 2:
        return set()
    constant = _constant(different)
    vectors: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(len(different), np.int32))
    places: list[dict[int, list[int]]] = []
    for k, p in enumerate(different):
        at: dict[int, list[int]] = defaultdict(list)
        for i, t in enumerate(p.tokens):
            if t in constant or t not in p.texts:
                at[t].append(i)
        places.append(at)
        for t, x in at.items():
            vectors[t][k] = len(x)
    classes: dict[bytes, list[int]] = defaultdict(list)
    for t, v in vectors.items():
        classes[v.tobytes()].append(t)
    found: list[tuple[int, list[int], np.ndarray]] = []
    for tokens in classes.values():
        v = vectors[tokens[0]]
        if len(tokens) < 2 or np.count_nonzero(v) < 2:
            continue
        orders = set()
        for k in np.flatnonzero(v).tolist():
            spots = sorted((places[k][t][r], t) for t in tokens for r in range(int(v[k])))
            turns = [tuple(t for _, t in spots[i : i + len(tokens)]) for i in range(0, len(spots), len(tokens))]
            orders |= set(turns)
        if len(orders) == 1:
            found.append((int(np.count_nonzero(v)), list(orders.pop()), v))
    found.sort(key=lambda x: (-x[0], int(x[2].sum()), -len(x[1])))
    template: set[int] = set()
    wider: list[list[int]] = []
    for _, tokens, v in found:
        k = int(np.flatnonzero(v)[0])
        if all(_nests(tokens, w, places[k]) for w in wider):
            template |= set(tokens)
            if int(v.max()) == 1:
                wider.append(tokens)
    return template


def _nests(tokens: list[int], wider: list[int], at: dict[int, list[int]]) -> bool:
    """Each turn of tokens lies in one gap of a class that occurs once, or around it whole."""
    if not all(at.get(t) for t in wider):
        return True
    marks = np.array([at[t][0] for t in wider])
    for turn in zip(*(at[t] for t in tokens), strict=True):
        gaps = {int(x) for x in np.searchsorted(marks, turn)}
        if len(gaps) > 1 and not gaps <= {min(gaps), max(gaps)} and len(gaps) <= len(tokens) // 2:
            return False
    return True


def extract(sources: list[str | None]) -> list[str]:
    """The main text of each page of one host's group."""
    pages = [Page(x or "") for x in sources]
    template = deduce(pages)
    out = []
    for p in pages:
        slots = [(main, text) for place, drop, main, text in p.blocks if not drop and p.tokens[place] not in template]
        inside = sum(len(text) for main, text in slots if main)
        if p.has_main and 2 * inside >= sum(len(text) for _, text in slots) or p.has_main == 2 and not inside:
            slots = [x for x in slots if x[0]]
        out.append("\n".join(text for _, text in slots))
    return out


def _groups(batches):
    plain = zstandard.ZstdDecompressor()
    key, ids, urls, sources = None, [], [], []

    def done(n: int):
        texts = extract([plain.decompress(x).decode() if x else "" for x in sources[:n]])
        made = record(ids[:n], urls[:n], texts)
        del ids[:n], urls[:n], sources[:n]
        return made

    def rest():
        """What a host has left, in two groups of like size where it is more than one."""
        if len(ids) > GROUP:
            yield done(len(ids) // 2)
        if ids:
            yield done(len(ids))

    def record(ids, urls, texts):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    for b in batches:
        for host, salt, i, u, packed in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
            if key != (host, salt):
                yield from rest()
            elif len(ids) >= 2 * GROUP:
                yield done(GROUP)
            key = (host, salt)
            ids.append(i)
            urls.append(u)
            sources.append(packed)
    yield from rest()


def _press(batches):
    press = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for b in batches:
        packed = pa.array([press.compress(x.encode()) if x else b"" for x in b.column(4).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], packed], names=["host", "salt", "page_id", "url", "packed"])


def main_text(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))
    rows = pages.select(host.alias("host"), F.col(id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    counts = rows.groupBy("host").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("n") > max(CELL, -(-total // HEAVY_SHARE))).select("host", F.floor(F.col("n") / CELL).cast("bigint").alias("cells")).collect()  # at most HEAVY_SHARE rows
    spread = F.broadcast(spark.createDataFrame([tuple(r) for r in heavy], "host string, cells bigint"))
    salt = F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("cells")), F.lit(0)).cast("bigint")
    packed = rows.join(spread, "host", "left").select("host", salt.alias("salt"), "page_id", "url", "html").mapInArrow(_press, "host string, salt bigint, page_id bigint, url string, packed binary")
    return packed.repartition("host", "salt").sortWithinPartitions("host", "salt", "page_id").mapInArrow(_groups, "page_id bigint, url string, text string, n_chars bigint")
