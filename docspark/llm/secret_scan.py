"""Secret scans: three base patterns, and the guess cost of values that stand in a credential context.

The guess cost is the least sum, over all ways to cut a value into common words, dates, repeats, keyboard walks and
brute-force characters, of the parts' log10 guesses. Words are ranked: usual passwords first, then the whole words of
public vocabularies, whose files list the most frequent first. A costly value is one that a person would hardly have
typed as prose, so it is taken for a secret.

Every value in quotes, after a sign (: = := == => ->), after Authorization: Bearer or in a URL is scored, whatever it
is made of. A bare value after a space, is, are or was may be the next word of a sentence, so its cost is held against
that of prose as well: it must cost BARE_COST for each character, which words and what is joined of words do not, and
if it is letters only, those outside listed words must follow each other less likely than letters drawn at random would under a
letter-pair model of the vocabularies' words. Bare values of less than MIN_LENGTH characters are words to this test.
A value that holds a redaction's mark is not scored.

Defined results: a null or empty text has no spans. Spans are code points, end exclusive. Spans of the base
patterns always stay; a guess span is added only where its value touches no base span, and of guess values that touch
the first in the text wins. Rows are read one by one, so repeated rows agree and an empty table gives an empty one. A
value of any length is cut in time that grows with it, and no further than it takes to know that it costs ENOUGH.
Extra columns pass through, one named like the result as input_<name>.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import apart, bounded_batches

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|bearer|authorization)["']?[\x20\t]*(?:(?:is|are|was)(?![^\s"'`])|=>|:=|->|==?|:|\x20)[\x20\t]*(?:"([^"\n]+)"|'([^'\n]+)'|`([^`\n]+)`|([^\s"'`<>]+))""", re.I | re.A)
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s/:@]+:([^\s/@]+)@")
#: Every match of _CONTEXT holds one of these.
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization")
#: log10 of the guesses from which on a value counts as a secret.
MIN_COST = 9.0
#: Where the least cost passes this, the value is cut no further.
ENOUGH = 36.0
#: Least length of a bare value that no sign stands before, and the least cost of each of its characters.
MIN_LENGTH, BARE_COST = 8, 0.9
#: Files of public vocabularies (a rank and a token a line, the most frequent first) that words are ranked by.
VOCABULARY = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: What a redacted span begins with.
MARK = "[REDACTED:"
#: A run of one character, and a keyboard walk: least length, log10 guesses, and more for each character.
RUN_LEAST, RUN_COST, RUN_SLOPE = 3, 1.4, 0.05
WALK_LEAST, WALK_COST, WALK_SLOPE = 4, 2.0, 0.3

#: Common password words, the most usual first.
COMMON_WORDS = """password qwerty abc letmein monkey dragon iloveyou admin welcome login master hello sunshine princess football
shadow superman batman trustno charlie michael jordan michelle jessica daniel thomas secret summer winter spring autumn
freedom whatever computer internet hunter soccer hockey baseball basketball killer pepper ginger cookie cheese banana orange
purple silver golden starwars pokemon matrix ninja samsung google apple windows linux server default guest root user test
testing demo example sample changeme change please access manager system database service account private public token key
value none null true false required optional string number name email phone address reset forgot policy field enter your
their this that with from have here there when what which about every other should would could must will the and for not
are was has its all any can may new old one two use set get put see company office market house family love money world""".split()
_LEET = str.maketrans("4@30157$", "aaeoists")
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_MONTH, _DAY = "(?:1[0-2]|0?[1-9])", "(?:3[01]|[12][0-9]|0?[1-9])"
_DATE = re.compile(rf"(?:19|20)[0-9]{{2}}(?P<more>([-/._]?){_MONTH}(?:\2{_DAY})?)?|(?P<short>{_DAY}([-/._]?){_MONTH}\4(?:19|20)?[0-9]{{2}})")
YEAR_COST, DATE_COST = 2.2, 4.6
#: Longest block that may stand twice; a longer repeat is cut into shorter ones.
REPEAT_MOST = 32


def _adjacent() -> set[tuple[str, str]]:
    """Keys next to each other, and neighbours in the alphabet."""
    out: set[tuple[str, str]] = set()
    for r, row in enumerate(_ROWS):
        out |= set(zip(row, row[1:], strict=False))
        if r + 1 < len(_ROWS):
            under = _ROWS[r + 1]
            out |= {(k, under[i + d]) for i, k in enumerate(row) for d in (-1, 0) if 0 <= i + d < len(under)}
    out |= {(chr(c), chr(c + 1)) for c in range(97, 122)}
    return out | {(b, a) for a, b in out}


_NEXT = _adjacent()


def _card(c: str) -> float:
    """log10 of the characters that one like c is guessed among."""
    return 1.0 if c.isdigit() else 1.415 if c.isalpha() and c.isascii() else 1.52 if c.isascii() else 2.0


class Lexicon:
    """Ranks of words of three letters or more, and how likely letters follow each other in them."""

    def __init__(self, usual: list[str], listed: list[list[str]]) -> None:
        self.rank = {w: i + 1 for i, w in enumerate(usual)}
        for turn in zip_longest(*listed):
            for w in turn:
                if w and w not in self.rank:
                    self.rank[w] = len(self.rank) + 1
        self.longest = max(map(len, self.rank), default=0)
        seen = np.ones((27, 27))
        for w in self.rank:
            if w.isascii() and w.isalpha():
                a = np.frombuffer(w.encode(), np.uint8).astype(int) - 96
                np.add.at(seen, (np.r_[0, a[:-1]], a), 1)
        self.pair = -np.log10(seen / seen.sum(axis=1, keepdims=True))

    def prose(self, value: str) -> bool:
        """Listed words, and letters that follow each other as in words, joined by signs that join words."""
        if any(not c.isalpha() and c not in _JOINS for c in value):
            return False
        if not value.isascii() and any(c.isalpha() and not c.isascii() for c in value):
            return True
        parts = [np.frombuffer(x.encode(), np.uint8).astype(int) - 96 for x in _JOINED.split(value.lower()) if x and x not in self.rank]
        told = sum(float(self.pair[np.r_[0, a[:-1]], a].sum()) for a in parts)
        return told <= math.log10(26) * sum(map(len, parts))


_JOINS = frozenset("-/'\u2019&.,;:!?()")
_JOINED = re.compile(r"[^a-z]+")


@functools.lru_cache(maxsize=4)
def lexicon(vocabulary: tuple[str, ...] = VOCABULARY) -> Lexicon:
    """COMMON_WORDS, then the whole words of the vocabulary files (names for public_tokenizers.path, or paths) in their order."""
    listed = []
    for name in vocabulary:
        if "/" not in name:
            import public_tokenizers

            name = public_tokenizers.path(name)
        with open(name, "rb") as f:
            rows = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
        words = (t[1:].decode(errors="replace").lower() for _, t in rows if t[:1] == b" ")
        listed.append([w for w in dict.fromkeys(words) if len(w) >= 4 and w.isalpha()])
    return Lexicon(COMMON_WORDS, listed)


def guess_cost(value: str, enough: float = float("inf"), words: Lexicon | None = None) -> float:
    """The least log10 guesses over all segmentations; where that is `enough` or more, a number between `enough` and it."""
    words = words or lexicon()
    ranks, longest = words.rank, words.longest
    low = value.lower()
    low = low if len(low) == len(value) else value
    plain = low.translate(_LEET)
    n = len(value)
    best = [0.0] + [float("inf")] * n
    run = walk = 0  # where the run of one character, and the keyboard walk, that end here begin
    run_low = walk_low = float("inf")  # the least of best[s] less the part's slope times s, over the places s a run or walk may begin at
    dates: dict[int, list[tuple[int, float]]] = {}
    for e in range(1, n + 1):
        i = e - 1
        if low[i].isdigit() and (m := _DATE.match(low, i)):
            dates.setdefault(m.end(), []).append((i, DATE_COST if m["more"] or m["short"] else YEAR_COST))
        low_cost = best[i] + _card(value[i])
        if i and low[i] != low[i - 1]:
            run, run_low = i, float("inf")
        if i and (low[i - 1], low[i]) not in _NEXT:
            walk, walk_low = i, float("inf")
        if e - RUN_LEAST >= run:
            run_low = min(run_low, best[e - RUN_LEAST] - RUN_SLOPE * (e - RUN_LEAST))
            low_cost = min(low_cost, run_low + RUN_COST + RUN_SLOPE * e)
        if e - WALK_LEAST >= walk:
            walk_low = min(walk_low, best[e - WALK_LEAST] - WALK_SLOPE * (e - WALK_LEAST))
            low_cost = min(low_cost, walk_low + WALK_COST + WALK_SLOPE * e)
        for s, cost in dates.pop(e, ()):
            low_cost = min(low_cost, best[s] + cost)
        for s in range(max(0, e - longest), e - 2):
            if rank := ranks.get(low[s:e]) or ranks.get(plain[s:e], 0) * 4:
                part = value[s:e]
                turned = 0.0 if part.islower() or part[0].isupper() and part[1:].islower() or part.isupper() else 1.0
                low_cost = min(low_cost, best[s] + 0.3 + math.log10(rank) + turned)
        for size in range(2, min(REPEAT_MOST + 1, e // 2 + 1)):  # a block that stands twice
            if low[e - size : e] == low[e - 2 * size : e - size]:
                low_cost = min(low_cost, best[e - size] + 0.7)
        best[e] = low_cost
        if low_cost >= enough:  # every cut of the whole has a place among the last ones, or in a run or walk that goes on
            least = min(min(best[max(0, e - max(REPEAT_MOST, longest)) : e + 1]), run_low + RUN_COST + RUN_SLOPE * e, walk_low + WALK_COST + WALK_SLOPE * e)
            if least >= enough:
                return least
    return best[n]


_HEADER = re.compile(r"""authorization["']?[\x20\t]*(?:=>|:=|->|==?|:)[\x20\t]*["'`]?\Z""", re.I | re.A)


def context_values(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, bare) of values that follow a credential word, or stand as the password of a URL; bare ones may be prose."""
    out, low = [], text.lower()
    if any(h in low for h in _HINTS):
        at = 0
        while m := _CONTEXT.search(text, at):
            k = m.lastindex or 0
            s, e = m.span(k)
            bare = k == 4 and text[m.start() : s].rstrip(" \t")[-1] not in "=:>"
            if bare and text[m.start() : m.start() + 6].lower() == "bearer":
                bare = not _HEADER.search(text[max(0, m.start() - 40) : m.start()])
            at = max(s, m.start() + 1)  # a value may be a credential word itself, as in Authorization: Bearer
            if k == 4:
                while e > s and text[e - 1] in ".,;:!?)]}":
                    e -= 1
            out.append((s, e, bare))
    if "://" in text:
        out += [(*m.span(1), False) for m in _URL.finditer(text)]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns; a kind is its place in KINDS."""
    out, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def secret_cost(value: str, bare: bool, min_cost: float = MIN_COST, words: Lexicon | None = None) -> float | None:
    """The cost of a value that is taken for a secret, else null."""
    words = words or lexicon()
    if bare and (len(value) < MIN_LENGTH or words.prose(value)):
        return None
    least = max(min_cost, BARE_COST * len(value)) if bare else min_cost
    cost = guess_cost(value, max(ENOUGH, least), words)
    return cost if cost >= least else None


def scan(text: str | None, min_cost: float = MIN_COST, vocabulary: tuple[str, ...] = VOCABULARY) -> list[tuple[int, int, int, float | None]]:
    """(kind, start, end, cost) of all spans by start, then kind; cost is that of guess spans (ENOUGH or more is a lower bound), else null."""
    if not text:
        return []
    base = base_spans(text)
    out: list[tuple[int, int, int, float | None]] = [(k, s, e, None) for k, s, e in base]
    done: set[tuple[int, int]] = set()
    for s, e, bare in context_values(text):
        value = text[s:e]
        if MARK in value or (s, e) in done or any(s < be and bs < e for _, bs, be in base) or any(s < de and ds < e for ds, de in done):
            continue
        if (cost := secret_cost(value, bare, min_cost, lexicon(vocabulary))) is not None:
            done.add((s, e))
            out.append((3, s, e, cost))
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


SCHEMA = "array<struct<kind:string,start:bigint,end:bigint,cost:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))


def _scan(text: pa.Array) -> pa.Array:
    return pa.array([[{"kind": KINDS[k], "start": s, "end": e, "cost": c} for k, s, e, c in scan(x)] for x in text.to_pylist()], _ARROW)


def find(docs: DataFrame, text: str = "text", to: str = "secret_spans") -> DataFrame:
    """docs with an array of spans."""
    bounded_batches(docs.sparkSession)
    return apart(docs, to).withColumn(to, F.arrow_udf(_scan, SCHEMA).asNondeterministic()(F.col(text)))


def _redact(text: pa.Array) -> pa.Array:
    out = []
    for x in text.to_pylist():
        parts, at = [], 0
        for k, s, e, _ in scan(x):
            if e <= at:
                continue
            if s >= at:
                parts += [x[at:s], f"{MARK}{KINDS[k]}]"]
            at = e
        out.append(x if not at else "".join(parts) + x[at:])
    return pa.array(out, pa.string())


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by a mark that no pattern matches; other text stays as it is."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(text, F.arrow_udf(_redact, "string")(F.col(text)))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """Lowercase hex SHA-256 of kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
