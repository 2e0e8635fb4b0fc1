"""Licence scans: canonical texts, looked up whole by their digests.

A unit is a whole document, one of its paragraphs (of two lines or more), one of its lines, or a run of adjacent
paragraphs that has a known text's length and first word. Its canonical form
drops copyright lines, lowers case, turns punctuation and white space into single spaces and replaces equivalent
spellings; the digest of that form is joined by hash to the digests of known licence texts and notices. The table of
known digests is part of the program, so sending it to every task is bounded.

Defined results: a null or empty text, and a unit whose canonical form is empty, match nothing; repeated rows match
each on their own; a text that is one line is a document unit only. Positions are code points, end exclusive. An
empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches
from .licenses import KNOWN, WHOLE

#: Equivalent spellings, the canonical one last.
EQUIVALENT = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("share alike", "sharealike"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"),
    ("v 2 0", "version 2 0"), ("v2 0", "version 2 0"), ("v 3", "version 3"), ("v3", "version 3"), ("whilst", "while"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("initialise", "initialize"), ("organisation", "organization"), ("per cent", "percent"), ("http", "https"), ("neighbouring", "neighboring"),
]
COPYRIGHT = r"(?m)^[^A-Za-z0-9©\n]*(?:(?:\([cC]\)|©)[ \t]*(?:[Cc]opyright|COPYRIGHT|[12][0-9]{3})|[Cc]opyright|COPYRIGHT|©|[Aa]ll [Rr]ights [Rr]eserved|ALL RIGHTS RESERVED)(?:[^A-Za-z\n].*)?$"
SIGNS = "[\\x00-/:-`{-\\x7f\\u00a0\\u00a9\\u2013\\u2014\\u2018\\u2019\\u201c\\u201d\\u2022]+"
_COPYRIGHT, _SIGNS, _BLANK = re.compile(COPYRIGHT), re.compile(SIGNS), re.compile(r"\n(?:[ \t\r\x0b\x0c]*\n)+")
_SPELLING = [(f" {a} ", f" {b} ") for a, b in EQUIVALENT]


def canonical(text: str) -> str:
    if "opyright" in text or "OPYRIGHT" in text or "©" in text or "(c)" in text or "(C)" in text or "eserved" in text or "ESERVED" in text:
        text = _COPYRIGHT.sub("", text)
    out = " " + _SIGNS.sub(" ", text.lower()).strip(" ") + " "
    for a, b in _SPELLING:
        if a in out:
            out = out.replace(a, b)
    return out.strip(" ")


def digest(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()


def known() -> list[tuple[str, str]]:
    """(digest, license) of every known text."""
    return sorted({(digest(canonical(t)), name) for name, texts in KNOWN.items() for t in texts})


def units(text: str):
    """(unit, ordinal, start, end) of the document, its paragraphs of two lines or more, and its lines."""
    yield "document", 0, 0, len(text)
    if "\n" not in text:
        return
    marks = [m.span() for m in _BLANK.finditer(text)]
    if marks:
        at = 0
        for k, (s, e) in enumerate([*marks, (len(text), len(text))]):
            if "\n" in text[at:s]:
                yield "paragraph", k, at, s
            at = e
    at = 0
    for k, line in enumerate(text.split("\n")):
        yield "line", k, at, at + len(line)
        at += len(line) + 1


def runs(text: str, sizes: frozenset[int], firsts: frozenset[str]):
    """(ordinal, start, end, form) of the runs of two paragraphs or more that are of a known size and less than the document."""
    marks = [m.span() for m in _BLANK.finditer(text)]
    if not marks:
        return
    forms, at = [], 0
    for k, (s, e) in enumerate([*marks, (len(text), len(text))]):
        if form := canonical(text[at:s]):
            forms.append((k, at, s, form))
        at = e
    most = max(sizes, default=0)
    for i, (k, start, _, form) in enumerate(forms):
        if form.split(" ", 1)[0] not in firsts:
            continue
        n = len(form)
        for j in range(i + 1, len(forms)):
            n += 1 + len(forms[j][3])
            if n > most:
                break
            if n in sizes and j - i + 1 < len(forms):
                yield k, start, forms[j][2], " ".join(x[3] for x in forms[i : j + 1])


SCHEMA = "array<struct<unit:string,ordinal:bigint,start:bigint,end:bigint,digest:string>>"
_ARROW = pa.list_(pa.struct([("unit", pa.string()), ("ordinal", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.string())]))


def _digests(sizes: frozenset[int], firsts: frozenset[str]):
    def of(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            rows = []
            for unit, k, s, e in units(text) if text else ():
                form = canonical(text[s:e])
                if form and len(form) in sizes:  # a form of another length has another digest
                    rows.append({"unit": unit, "ordinal": k, "start": s, "end": e, "digest": digest(form)})
            rows += [{"unit": "run", "ordinal": k, "start": s, "end": e, "digest": digest(form)} for k, s, e, form in (runs(text, sizes, firsts) if text else ())]
            out.append(rows)
        return pa.array(out, _ARROW)

    return F.arrow_udf(of, SCHEMA).asNondeterministic()


def scan(docs: DataFrame, *, id: str = "doc_id", text: str = "text", texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, license, unit, ordinal, start, end): one row for each unit that is a known text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    forms = {name: [canonical(t) for t in ts] for name, ts in (KNOWN if texts is None else texts).items()}
    whole = WHOLE if texts is None else []
    rows = sorted({(digest(f), name) for name, fs in forms.items() for f in fs if f} | {(d, name) for name, d, _, _ in whole})
    table = spark.createDataFrame(rows, "known string, license string")
    sizes = frozenset(len(f) for fs in forms.values() for f in fs if f) | {n for _, _, n, _ in whole}
    made = _digests(sizes, frozenset(f.split(" ", 1)[0] for fs in forms.values() for f in fs if f) | {first for _, _, _, first in whole})
    found = docs.select(F.col(id).alias("_id"), F.explode(made(F.col(text))).alias("u"))
    return found.join(F.broadcast(table), F.col("u.digest") == table.known).select(F.col("_id").alias(id), "license", "u.unit", "u.ordinal", "u.start", "u.end")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(documents: str = "documents") -> str:
    """The same rows in DuckDB's SQL, by the canonical forms themselves."""
    rows = sorted({(canonical(t), name) for name, ts in KNOWN.items() for t in ts})
    form = "' ' || trim(regexp_replace(lower(regexp_replace(u, " + quoted(COPYRIGHT) + ", '', 'g')), " + quoted(SIGNS.encode().decode("unicode_escape").replace("\x00", "\\x00").replace("\x7f", "\\x7f")) + ", ' ', 'g'), ' ') || ' '"
    for a, b in _SPELLING:
        form = f"replace({form}, {quoted(a)}, {quoted(b)})"
    return f"""
with parts as (
  select doc_id, 'document' as unit, 0 as ordinal, text as u from {documents} where text is not null
  union all
  select doc_id, 'paragraph', k - 1, p[k] from (select doc_id, string_split_regex(text, '\\n(?:[ \\t\\r\\x0b\\x0c]*\\n)+') as p from {documents}), unnest(range(1, len(p) + 1)) as t(k) where len(p) > 1 and contains(p[k], chr(10))
  union all
  select doc_id, 'line', k - 1, p[k] from (select doc_id, string_split(text, chr(10)) as p from {documents}), unnest(range(1, len(p) + 1)) as t(k) where len(p) > 1),
known(form, license) as (values {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows)})
select doc_id, license, unit, ordinal::bigint as ordinal from (select *, trim({form}, ' ') as form from parts) join known using (form)
"""
