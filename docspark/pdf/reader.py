"""The file structure: cross-reference tables and streams, object streams, repair, decryption."""

from __future__ import annotations

import re

from . import crypt, filters
from .errors import PdfError, malformed
from .objects import NULL, Keyword, Lexer, Name, Ref, Stream

_OBJ = re.compile(rb"(?<!\d)(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj\b")
_STREAM = re.compile(rb"[\x00\t\n\x0c\r ]*stream(?:\r\n|\n|\r)?")
_ENDSTREAM = re.compile(rb"\r?\n?endstream")
_VERSION = re.compile(rb"%PDF-(\d\.\d)")
_XREF_TYPE = re.compile(rb"/Type\s*/XRef")
#: The widest field of a cross-reference stream.
MAX_FIELD = 16
MAX_OBJECTS, MAX_HOPS = 8_000_000, 64


def check_widths(data: bytes) -> None:
    """Refuse a cross-reference stream whose field widths are negative or huge, before any other object is parsed.

    Only its own dictionary tells: the bytes around it are of other streams, and may spell a /W by chance."""
    for m in _XREF_TYPE.finditer(data):
        start = data.rfind(b"obj", 0, m.start())
        try:
            d = Lexer(data, start + len(b"obj")).object() if start >= 0 else None
        except (PdfError, ValueError, RecursionError):
            continue
        widths = d.get("W") if isinstance(d, dict) else None
        if isinstance(widths, list) and any(type(w) is int and not 0 <= w <= MAX_FIELD for w in widths[:3]):
            raise malformed("a cross-reference stream has a field of impossible width")


class File:
    """Objects of one file by number, read when asked for."""

    def __init__(self, data: bytes, password: str | None = None) -> None:
        if not isinstance(data, bytes | bytearray) or not data:
            raise malformed("the file is empty")
        self.data = bytes(data)
        head = _VERSION.search(self.data[:1024])
        if head is None:
            raise malformed("no PDF header")
        self.start = head.start()
        self.version = head[1].decode()
        check_widths(self.data)
        self.offsets: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.cache: dict[int, object] = {}
        self.held: dict[int, dict[int, object]] = {}
        self.busy: set[int] = set()
        self.security: crypt.Security | None = None
        self.repaired = False
        try:
            self._read_xref()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise malformed("no catalog")
        except (PdfError, ValueError, IndexError, OverflowError, KeyError, TypeError, RecursionError) as e:
            if isinstance(e, PdfError) and e.code != "malformed_pdf":
                raise
            self._repair()
        self.encrypted = "Encrypt" in self.trailer
        if self.encrypted:
            self._unlock(password)
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise malformed("no catalog")
        if not self.encrypted and not isinstance(self.get(root.get("Pages")), dict) and not self.repaired:
            self._repair()

    # Cross-references.

    def _read_xref(self) -> None:
        tail = self.data.rfind(b"startxref")
        m = re.compile(rb"startxref\s*(\d+)").match(self.data, tail) if tail >= 0 else None
        if m is None:
            raise malformed("no startxref")
        todo, seen = [int(m[1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at + self.start < len(self.data):
                if at in seen:
                    continue
                raise malformed("a cross-reference lies outside the file")
            seen.add(at)
            trailer = self._xref_at(at + self.start)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            for k in ("XRefStm", "Prev"):
                if isinstance(trailer.get(k), int):
                    todo.append(trailer[k])
        if "Root" not in self.trailer:
            raise malformed("no root")

    def _xref_at(self, at: int) -> dict:
        lexer = Lexer(self.data, at)
        if lexer.token() == "xref":
            return self._xref_table(lexer)
        m = _OBJ.search(self.data, max(0, at - 1), at + 64)
        if m is None:
            raise malformed("no cross-reference where one should be")
        stream = self._object_at(m.start(), None)
        if not isinstance(stream, Stream):
            raise malformed("no cross-reference stream")
        return self._xref_stream(stream)

    def _xref_table(self, lexer: Lexer) -> dict:
        while True:
            first = lexer.token()
            if first == "trailer":
                got = lexer.object()
                if not isinstance(got, dict):
                    raise malformed("no trailer")
                return got
            count = lexer.token()
            if type(first) is not int or type(count) is not int or not 0 <= count <= MAX_OBJECTS:
                raise malformed("a broken cross-reference table")
            for num in range(first, first + count):
                offset, gen, kind = lexer.token(), lexer.token(), lexer.token()
                if type(offset) is not int or type(gen) is not int:
                    raise malformed("a broken cross-reference entry")
                if kind == "n":
                    self.offsets.setdefault(num, ("at", offset + self.start, gen))
                else:
                    self.offsets.setdefault(num, ("free",))

    def _xref_stream(self, stream: Stream) -> dict:
        d = stream.dict
        widths = [w if type(w) is int and 0 <= w <= MAX_FIELD else -1 for w in d.get("W", [])][:3]
        if len(widths) < 3 or min(widths) < 0 or not sum(widths):
            raise malformed("a cross-reference stream without widths")
        size = d.get("Size", 0)
        index = d.get("Index") or [0, size]
        data, row = self.stream_bytes(stream), sum(widths)
        at = 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            if type(first) is not int or type(count) is not int or count < 0:
                raise malformed("a broken cross-reference index")
            for num in range(first, first + min(count, (len(data) - at) // row)):
                cuts = [at, at + widths[0], at + widths[0] + widths[1], at + row]
                kind, a, b = (int.from_bytes(data[s:e], "big") for s, e in zip(cuts, cuts[1:], strict=False))
                kind = kind if widths[0] else 1
                if kind == 1:
                    self.offsets.setdefault(num, ("at", a + self.start, b))
                elif kind == 2:
                    self.offsets.setdefault(num, ("in", a, b))
                else:
                    self.offsets.setdefault(num, ("free",))
                at += row
        return d

    def _repair(self) -> None:
        """Find every object where it stands; the last of a number counts."""
        self.repaired = True
        self.cache.clear()
        self.held.clear()
        self.offsets = {int(m[1]): ("at", m.start(), int(m[2])) for m in _OBJ.finditer(self.data)}
        trailer: dict = {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                got = Lexer(self.data, m.end()).object()
            except (PdfError, ValueError, RecursionError):
                continue
            if isinstance(got, dict):
                trailer |= got
        for num in sorted(self.offsets):
            try:
                got = self.get(Ref(num))
            except (PdfError, ValueError, RecursionError):
                continue
            if isinstance(got, Stream) and got.dict.get("Type") == "XRef":
                trailer |= {k: v for k, v in got.dict.items() if k in ("Root", "Info", "Encrypt", "ID")}
            if isinstance(got, Stream) and got.dict.get("Type") == "ObjStm" and "Encrypt" not in trailer:
                for k, inner in enumerate(self._stream_numbers(num)):
                    self.offsets.setdefault(inner, ("in", num, k))
        if not isinstance(self.get(trailer.get("Root")), dict):
            for num in sorted(self.offsets):
                try:
                    got = self.get(Ref(num))
                except (PdfError, ValueError, RecursionError):
                    continue
                if isinstance(got, dict) and got.get("Type") == "Catalog":
                    trailer["Root"] = Ref(num)
        if not isinstance(trailer.get("Root"), Ref):
            raise malformed("no catalog")
        self.trailer = trailer

    # Objects.

    def get(self, x):
        """x itself, or the object it refers to; None if there is none."""
        for _ in range(MAX_HOPS):
            if not isinstance(x, Ref):
                return None if x is NULL else x
            x = self._load(x.num)
        return None

    def _load(self, num: int):
        if num in self.cache:
            return self.cache[num]
        where = self.offsets.get(num)
        if where is None or where[0] == "free" or num in self.busy:
            return None
        self.busy.add(num)
        try:
            if where[0] == "at":
                got = self._object_at(where[1], num)
            else:
                got = self._packed(where[1]).get(num)
        finally:
            self.busy.discard(num)
        self.cache[num] = got
        return got

    def _object_at(self, at: int, num: int | None):
        m = _OBJ.match(self.data, at) or _OBJ.search(self.data, at, at + 32)
        if m is None or num is not None and int(m[1]) != num:
            if num is None or self.repaired:
                return None
            raise malformed(f"object {num} is not where it should be")
        lexer = Lexer(self.data, m.end())
        got = lexer.object()
        id = (int(m[1]), int(m[2]))
        if isinstance(got, dict):
            s = _STREAM.match(self.data, lexer.at)
            if s:
                got = Stream(got, self._raw(got, s.end()), id)
        got = None if got is NULL or isinstance(got, Keyword) else got
        if self.security is not None and not (isinstance(got, Stream) and got.dict.get("Type") == "XRef"):
            got = self._decrypted(got, *id)
        return got

    def _raw(self, d: dict, at: int) -> bytes:
        length = d.get("Length")
        length = self.get(length) if isinstance(length, Ref) else length
        if type(length) is int and 0 <= length <= len(self.data) - at:
            if re.compile(rb"[\x00\t\n\x0c\r ]*endstream").match(self.data, at + length):
                return self.data[at : at + length]
        m = _ENDSTREAM.search(self.data, at)
        return self.data[at : m.start() if m else len(self.data)]

    def _decrypted(self, x, num: int, gen: int):
        s = self.security
        if isinstance(x, bytes):
            return s.decrypt(x, num, gen, s.text)
        if isinstance(x, list):
            return [self._decrypted(v, num, gen) for v in x]
        if isinstance(x, dict):
            return {k: self._decrypted(v, num, gen) for k, v in x.items()}
        if isinstance(x, Stream):
            names = self._filter_names(x.dict)
            keep = names[:1] == ["Crypt"] or x.dict.get("Type") == "Metadata" and s.plain_meta
            raw = x.raw if keep else s.decrypt(x.raw, num, gen, s.stream)
            return Stream(self._decrypted(x.dict, num, gen), raw, x.id)
        return x

    def _unlock(self, password: str | None) -> None:
        encrypt = self.get(self.trailer["Encrypt"])
        if not isinstance(encrypt, dict):
            raise PdfError("unsupported_security_handler", "no encryption dictionary")
        encrypt = {k: self.get(v) for k, v in encrypt.items()}
        ids = self.get(self.trailer.get("ID")) or [b""]
        self.security = crypt.Security(encrypt, ids[0] if isinstance(ids[0], bytes) else b"", password)
        at = self.trailer["Encrypt"]
        self.cache = {at.num: encrypt} if isinstance(at, Ref) else {}
        self.held.clear()

    def _numbers(self, stream: Stream) -> list[tuple[int, int]]:
        n = self.get(stream.dict.get("N"))
        lexer = Lexer(self.stream_bytes(stream))
        out = []
        for _ in range(min(n, MAX_OBJECTS) if type(n) is int else 0):
            num, at = lexer.token(), lexer.token()
            if type(num) is not int or type(at) is not int:
                break
            out.append((num, at))
        return out

    def _stream_numbers(self, num: int) -> list[int]:
        stream = self.get(Ref(num))
        return [n for n, _ in self._numbers(stream)] if isinstance(stream, Stream) else []

    def _packed(self, num: int) -> dict[int, object]:
        if num not in self.held:
            stream = self.get(Ref(num))
            out: dict[int, object] = {}
            if isinstance(stream, Stream):
                data, first = self.stream_bytes(stream), self.get(stream.dict.get("First"))
                for n, at in self._numbers(stream):
                    got = Lexer(data, (first if type(first) is int else 0) + at).object()
                    out.setdefault(n, None if got is NULL or isinstance(got, Keyword) else got)
            self.held[num] = out
        return self.held[num]

    # Streams.

    def _filter_names(self, d: dict) -> list[str]:
        f = self.get(d.get("Filter", d.get("F")))
        return [str(f)] if isinstance(f, Name) else [str(self.get(x)) for x in f] if isinstance(f, list) else []

    def stream_parts(self, stream: Stream) -> tuple[bytes, list[str]]:
        """(bytes, filters left undone)."""
        p = self.get(stream.dict.get("DecodeParms", stream.dict.get("DP")))
        parms = [self.get(x) or {} for x in (p if isinstance(p, list) else [p])]
        parms = [{k: self.get(v) for k, v in x.items()} if isinstance(x, dict) else {} for x in parms]
        return filters.decode(stream.raw, self._filter_names(stream.dict), parms)

    def stream_bytes(self, stream: Stream) -> bytes:
        return self.stream_parts(stream)[0]
