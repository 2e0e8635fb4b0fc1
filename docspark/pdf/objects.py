"""PDF objects as Python values, read from and written to bytes.

null None, booleans, int, float, strings bytes, names Name, arrays list, dictionaries dict by plain str, references Ref, streams Stream."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

from .errors import malformed


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int = 0


class Keyword(str):
    """An operator or any other bare word."""

    __slots__ = ()


@dataclass
class Stream:
    dict: dict
    raw: bytes
    id: tuple[int, int] | None = field(default=None, compare=False)


_TOKEN = re.compile(
    rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)*+(?:(?P<num>[+-]*(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z))|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<open><<|\[)|(?P<close>>>|\])|(?P<hex><[0-9A-Fa-f\x00\t\n\x0c\r ]*>?)|(?P<text>\()|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<odd>[)>{}])|(?P<end>\Z))"
)
_ESCAPED = re.compile(rb"\\(?:([nrtbf()\\])|([0-7]{1,3})|(\r\n|\r|\n)|(.)|\Z)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}
_PAREN = re.compile(rb"\\.|[()]", re.S)
_HEXNAME = re.compile(rb"#([0-9A-Fa-f]{2})")
MAX_NESTING = 200
#: Names and words up to this length are kept once read or written, as most come again and again.
MAX_KEPT = 64


def unescape(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        if m[1]:
            return _NAMED[m[1]]
        if m[2]:
            return bytes([int(m[2], 8) & 255])
        return m[4] or b""

    return _ESCAPED.sub(one, raw) if b"\\" in raw else raw.replace(b"\r\n", b"\n")


def _number(raw: bytes) -> int | float:
    if raw.isdigit():
        return int(raw)
    sign = -1 if raw.lstrip(b"+").startswith(b"-") else 1
    raw = raw.lstrip(b"+-")
    return sign * (float(raw) if b"." in raw else int(raw))


@lru_cache(1024)
def _word(raw: bytes) -> Keyword | bool:
    word = raw.decode("latin-1")
    return {"true": True, "false": False}.get(word, Keyword(word))


@lru_cache(1024)
def _name(raw: bytes) -> Name:
    return Name(_HEXNAME.sub(lambda h: bytes([int(h[1], 16)]), raw[1:]).decode("latin-1"))


class Lexer:
    """Reads objects one after another from bytes."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None) -> None:
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def string(self) -> bytes:
        """A literal string; self.at stands after its opening bracket."""
        depth, start = 1, self.at
        for m in _PAREN.finditer(self.data, self.at, self.end):
            if m[0] == b"(":
                depth += 1
            elif m[0] == b")":
                depth -= 1
                if not depth:
                    self.at = m.end()
                    return unescape(self.data[start : m.start()])
        self.at = self.end
        return unescape(self.data[start : self.end])

    def token(self):
        """The next simple object, bracket or word; None at the end."""
        while self.at < self.end:
            m = _TOKEN.match(self.data, self.at, self.end)
            self.at = m.end()
            kind = m.lastgroup
            if kind == "num":
                return _number(m["num"])
            if kind == "word" or kind == "name":
                raw, read = m[kind], _word if kind == "word" else _name
                return read(raw) if len(raw) <= MAX_KEPT else read.__wrapped__(raw)
            if kind == "text":
                return self.string()
            if kind == "hex":
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", m["hex"])
                return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            if kind in ("open", "close"):
                return _word(m[kind])
        return None

    def object(self, depth: int = 0):
        """The next whole object; a Keyword where none begins. References are read where two numbers and R stand."""
        got = self.token()
        if isinstance(got, Keyword):
            if depth > MAX_NESTING:
                raise malformed("objects nest too deeply")
            if got == "[":
                return self._list(depth)
            if got == "<<":
                return self._dict(depth)
            if got == "null":
                return NULL
            return got
        if type(got) is int and got >= 0:
            m = _REF.match(self.data, self.at, self.end)
            if m:
                self.at = m.end()
                return Ref(got, int(m[1]))
        return got

    def _list(self, depth: int) -> list:
        out = []
        while True:
            got = self.object(depth + 1)
            if got is None or isinstance(got, Keyword) and got in ("]", ">>", "endobj"):
                return out
            if not isinstance(got, Keyword):
                out.append(None if got is NULL else got)

    def _dict(self, depth: int) -> dict:
        out: dict = {}
        while True:
            key = self.object(depth + 1)
            if key is None or isinstance(key, Keyword) and key in (">>", "endobj", "stream"):
                return out
            if not isinstance(key, Name):
                continue
            at = self.at
            value = self.object(depth + 1)
            if isinstance(value, Keyword):
                if value == ">>" or value == "endobj":
                    return out
                continue
            if value is None:
                return out
            if value is not NULL:
                out[str(key)] = value
            assert self.at > at


_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)")


class _Null:
    """null inside a container, told from the end of input."""

    def __repr__(self) -> str:
        return "null"


NULL = _Null()


def number(x, default: float | None = None) -> float | None:
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else default


# Writing.

_NAME_ODD = set("()<>[]{}/%# ")


def format_number(x: float) -> str:
    if isinstance(x, int):
        return str(x)
    return f"{x:.5f}".rstrip("0").rstrip(".") if x == x and abs(x) < 1e15 else "0"


@lru_cache(1024)
def _written_name(x: str) -> bytes:
    return ("/" + "".join(c if "!" <= c <= "~" and c not in _NAME_ODD else f"#{ord(c):02X}" for c in x)).encode("ascii")


def write(x) -> bytes:
    """An object as bytes; streams are written by the file writer."""
    if x is None or x is NULL:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, Ref):
        return f"{x.num} {x.gen} R".encode()
    if isinstance(x, int | float):
        return format_number(x).encode()
    if isinstance(x, Name):
        return _written_name(x) if len(x) <= MAX_KEPT else _written_name.__wrapped__(x)
    if isinstance(x, bytes | bytearray):
        return b"(" + bytes(x).replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"
    if isinstance(x, Keyword):
        return x.encode("latin-1")
    if isinstance(x, list | tuple):
        return b"[" + b" ".join(write(v) for v in x) + b"]"
    if isinstance(x, dict):
        return b"<<" + b" ".join(write(Name(k)) + b" " + write(v) for k, v in x.items()) + b">>"
    raise TypeError(f"no PDF object: {type(x).__name__}")
