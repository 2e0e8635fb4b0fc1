"""Writing documents: a builder, an editor, and the two forms of a file."""

from __future__ import annotations

import copy
import math
import zlib

from . import crypt
from .document import Document
from .errors import PdfError, page_out_of_range
from .image import decode_png
from .objects import Keyword, Name, Ref, Stream, write

LETTER, A4 = (612.0, 792.0), (595.0, 842.0)
BASE_FONTS = tuple(f"Helvetica{s}" for s in ("", "-Bold", "-Oblique", "-BoldOblique")) + tuple(f"Times-{s}" for s in ("Roman", "Bold", "Italic", "BoldItalic")) + tuple(f"Courier{s}" for s in ("", "-Bold", "-Oblique", "-BoldOblique")) + ("Symbol", "ZapfDingbats")
WATERMARK_FONT, WATERMARK_AT = "WatermarkFont", (120.0, 400.0)


def encode_text(text: str) -> bytes:
    return text.encode("cp1252", "replace")


def text_string(text: str) -> bytes:
    """A text string for metadata and forms: ASCII as it is, the rest as UTF-16."""
    return text.encode() if text.isascii() else b"\xfe\xff" + text.encode("utf-16-be")


def operators(ops: list[tuple[str, list]]) -> bytes:
    return b"\n".join(b" ".join([*(write(x) for x in args), op.encode()]) for op, args in ops)


class Store:
    """Objects by number, and the trailer."""

    def __init__(self, version: str = "1.7") -> None:
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        self.version = version

    def add(self, x) -> Ref:
        num = max(self.objects, default=0) + 1 if not self.objects else self._next()
        self.objects[num] = x
        return Ref(num)

    def _next(self) -> int:
        self._top = max(getattr(self, "_top", 0), next(reversed(self.objects)), 0) + 1
        while self._top in self.objects:
            self._top += 1
        return self._top

    def get(self, x):
        for _ in range(64):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x.num)
        return None

    def _reached(self) -> list[int]:
        """Numbers of all objects that the trailer leads to, in order."""
        seen: set[int] = set()
        todo: list = [self.trailer]
        while todo:
            x = todo.pop()
            if isinstance(x, Ref):
                if x.num not in seen and x.num in self.objects:
                    seen.add(x.num)
                    todo.append(self.objects[x.num])
            elif isinstance(x, dict):
                todo += x.values()
            elif isinstance(x, list):
                todo += x
            elif isinstance(x, Stream):
                todo += x.dict.values()
        return sorted(seen)

    def _body(self, num: int, x) -> bytes:
        if isinstance(x, Stream):
            d = {k: v for k, v in x.dict.items() if k != "Length"} | {"Length": len(x.raw)}
            return f"{num} 0 obj\n".encode() + write(d) + b"\nstream\n" + x.raw + b"\nendstream\nendobj\n"
        return f"{num} 0 obj\n".encode() + write(x) + b"\nendobj\n"

    def save_classic(self, *, user: str | None = None, owner: str | None = None) -> bytes:
        """A file with a cross-reference table; with a password, its strings and streams are encrypted."""
        objects = {n: self.objects[n] for n in self._reached()}
        trailer = {k: v for k, v in self.trailer.items() if k not in ("Prev", "XRefStm", "Size", "Type", "W", "Index", "Length", "Filter", "DecodeParms")}
        if user is not None:
            first = (trailer.get("ID") or [b"0123456789abcdef"])[0]
            trailer["ID"] = [first, first]
            d, key = crypt.rc4_40(user.encode("latin-1"), (owner or user).encode("latin-1"), first)
            objects = {n: _locked(x, key, n) for n, x in objects.items()}
            num = max(objects, default=0) + 1
            objects[num] = d
            trailer["Encrypt"] = Ref(num)
        out, places = bytearray(f"%PDF-{self.version}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1")), {}
        for n, x in objects.items():
            places[n] = len(out)
            out += self._body(n, x)
        at, size = len(out), max(objects, default=0) + 1
        out += f"xref\n0 {size}\n".encode()
        out += b"".join(f"{places[n]:010} 00000 n \n".encode() if n in places else b"0000000000 65535 f \n" for n in range(size))
        return bytes(out + b"trailer\n" + write(trailer | {"Size": size}) + f"\nstartxref\n{at}\n%%EOF\n".encode())

    def save(self) -> bytes:
        """A file with object streams and a cross-reference stream."""
        objects = {n: self.objects[n] for n in self._reached()}
        out, rows = bytearray(f"%PDF-{max(self.version, '1.5')}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1")), {0: (0, 0, 65535)}
        plain = [n for n, x in objects.items() if not isinstance(x, Stream)]
        for n, x in objects.items():
            if isinstance(x, Stream):
                rows[n] = (1, len(out), 0)
                out += self._body(n, x)
        top = max(objects, default=0)
        for k in range(0, len(plain), 100):
            part = plain[k : k + 100]
            bodies = [write(objects[n]) for n in part]
            heads, at = [], 0
            for n, b in zip(part, bodies, strict=True):
                heads.append(f"{n} {at}")
                at += len(b) + 1
            head = " ".join(heads).encode() + b"\n"
            top += 1
            raw = zlib.compress(head + b"\n".join(bodies))
            rows[top] = (1, len(out), 0)
            out += self._body(top, Stream({"Type": Name("ObjStm"), "N": len(part), "First": len(head), "Filter": Name("FlateDecode")}, raw))
            rows |= {n: (2, top, i) for i, n in enumerate(part)}
        top += 1
        rows[top] = (1, len(out), 0)
        table = b"".join(bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in (rows.get(n, (0, 0, 65535)) for n in range(top + 1)))
        trailer = {k: v for k, v in self.trailer.items() if k in ("Root", "Info", "ID")}
        at = len(out)
        out += self._body(top, Stream({"Type": Name("XRef"), "Size": top + 1, "W": [1, 4, 2], "Filter": Name("FlateDecode")} | trailer, zlib.compress(table)))
        return bytes(out + f"startxref\n{at}\n%%EOF\n".encode())


def _locked(x, key: bytes, num: int):
    import hashlib

    own = hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0").digest()[:10]
    if isinstance(x, bytes):
        return crypt.rc4(own, x)
    if isinstance(x, list):
        return [_locked(v, key, num) for v in x]
    if isinstance(x, dict):
        return {k: _locked(v, key, num) for k, v in x.items()}
    if isinstance(x, Stream):
        return Stream(_locked(x.dict, key, num), crypt.rc4(own, x.raw), x.id)
    return x


class Builder:
    """A new document, page by page."""

    def __init__(self, *, title: str | None = None, author: str | None = None, compress: bool = False) -> None:
        self.pages: list[dict] = []
        self.info = {k: text_string(v) for k, v in (("Title", title), ("Author", author)) if v is not None}
        self.compress = compress

    def add_page(self, size: tuple[float, float] = LETTER) -> int:
        self.pages.append({"size": size, "ops": [], "fonts": {}, "images": []})
        return len(self.pages) - 1

    def _page(self, page: int) -> dict:
        if not 0 <= page < len(self.pages):
            raise page_out_of_range(page + 1)
        return self.pages[page]

    def draw_text(self, page: int, text: str, at: tuple[float, float], *, font: str = "Helvetica", size: float = 12.0, matrix: tuple | None = None) -> None:
        p = self._page(page)
        if font not in BASE_FONTS:
            raise PdfError("backend_error", f"no base font {font!r}")
        name = p["fonts"].setdefault(font, f"F{len(p['fonts']) + 1}")
        p["ops"] += [("BT", []), ("Tf", [Name(name), float(size)]), ("Tm", list(matrix or (1.0, 0.0, 0.0, 1.0, float(at[0]), float(at[1])))), ("Tj", [encode_text(text)]), ("ET", [])]

    def place_image(self, page: int, png: bytes, rect: tuple[float, float, float, float]) -> None:
        pixels = decode_png(png)
        self.place_samples(page, pixels.tobytes(), pixels.shape[1], pixels.shape[0], "DeviceRGB", rect)

    def place_samples(self, page: int, samples: bytes, width: int, height: int, space: str, rect: tuple[float, float, float, float]) -> None:
        p = self._page(page)
        name = f"Im{len(p['images']) + 1}"
        p["images"].append((name, Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "ColorSpace": Name(space), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}, zlib.compress(samples))))
        x0, y0, x1, y1 = map(float, rect)
        p["ops"] += [("q", []), ("cm", [x1 - x0, 0.0, 0.0, y1 - y0, x0, y0]), ("Do", [Name(name)]), ("Q", [])]

    def draw_rule(self, page: int, a: tuple[float, float], b: tuple[float, float]) -> None:
        self._page(page)["ops"] += [("m", list(map(float, a))), ("l", list(map(float, b))), ("S", [])]

    def assemble(self) -> Store:
        s = Store()
        root = s.add({})
        kids = []
        for p in self.pages:
            resources: dict = {}
            if p["fonts"]:
                resources["Font"] = {n: s.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(f), "Encoding": Name("WinAnsiEncoding")}) for f, n in p["fonts"].items()}
            if p["images"]:
                resources["XObject"] = {n: s.add(x) for n, x in p["images"]}
            raw = operators(p["ops"])
            content = s.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(raw)) if self.compress else Stream({}, raw))
            kids.append(s.add({"Type": Name("Page"), "Parent": root, "MediaBox": [0.0, 0.0, *map(float, p["size"])], "Contents": content, "Resources": s.add(resources)}))
        s.objects[root.num] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
        s.trailer["Root"] = s.add({"Type": Name("Catalog"), "Pages": root})
        if self.info:
            s.trailer["Info"] = s.add(dict(self.info))
        return s

    def save(self) -> bytes:
        return self.assemble().save()

    def save_classic(self, **password) -> bytes:
        return self.assemble().save_classic(**password)


class Editor:
    """Changes to a document that needs no password."""

    def __init__(self, data: bytes) -> None:
        doc = Document(data)
        self.store = Store(doc.file.version)
        for num in sorted(doc.file.offsets):
            got = doc.get(Ref(num))
            if got is not None and not (isinstance(got, Stream) and got.dict.get("Type") in ("XRef", "ObjStm")):
                self.store.objects[num] = copy.deepcopy(got)
        self.store.trailer = {k: copy.deepcopy(v) for k, v in doc.file.trailer.items() if k in ("Root", "Info", "ID")}
        self._flatten([r for r in doc.page_refs if r is not None], doc)

    def _catalog(self) -> dict:
        return self.store.get(self.store.trailer["Root"])

    def _flatten(self, pages: list[Ref], doc: Document) -> None:
        """One level of pages: what a page inherits becomes its own."""
        for ref, d in zip(pages, (doc.page_dicts[doc.number[r.num] - 1] for r in pages), strict=True):
            own = self.store.objects[ref.num]
            for k in ("Resources", "MediaBox", "CropBox", "Rotate"):
                if k not in own and (got := doc.inherited(d, k)) is not None:
                    own[k] = copy.deepcopy(got)
        self._set_pages(pages)

    def _set_pages(self, pages: list[Ref]) -> None:
        root = self._catalog().get("Pages")
        if not isinstance(root, Ref):
            root = self.store.add({})
            self._catalog()["Pages"] = root
        self.store.objects[root.num] = {"Type": Name("Pages"), "Kids": list(pages), "Count": len(pages)}
        for r in pages:
            self.store.objects[r.num]["Parent"] = root

    @property
    def pages(self) -> list[Ref]:
        return list(self.store.get(self._catalog()["Pages"])["Kids"])

    @property
    def page_count(self) -> int:
        return len(self.pages)

    def _check(self, numbers) -> None:
        for n in numbers:
            if not 1 <= n <= self.page_count:
                raise page_out_of_range(n)

    def merge(self, other: Editor) -> None:
        """Append another document's pages; its objects are renumbered."""
        shift = max(self.store.objects, default=0)
        for num, x in other.store.objects.items():
            self.store.objects[num + shift] = _shifted(x, shift)
        self._set_pages(self.pages + [Ref(r.num + shift) for r in other.pages])

    def split(self, ranges: list[tuple[int, int]]) -> list[bytes]:
        """A document for each inclusive range of pages."""
        out = []
        for a, b in ranges:
            if a < 1 or a > b or b > self.page_count:
                raise page_out_of_range(a if a < 1 else b)
            part = copy.copy(self)
            part.store = Store(self.store.version)
            part.store.objects, part.store.trailer = copy.deepcopy(self.store.objects), copy.deepcopy(self.store.trailer)
            part._set_pages(self.pages[a - 1 : b])
            part._drop_dead_links()
            out.append(part.store.save_classic())
        return out

    def _drop_dead_links(self) -> None:
        """What leads to pages that are gone would keep them."""
        for k in ("Outlines", "Dests", "Names", "StructTreeRoot", "OpenAction", "PageLabels"):
            self._catalog().pop(k, None)

    def remove_pages(self, numbers: list[int]) -> None:
        self._check(numbers)
        gone = set(numbers)
        self._set_pages([r for n, r in enumerate(self.pages, 1) if n not in gone])

    def rotate_page(self, page: int, degrees: int) -> None:
        self._check([page])
        self.store.objects[self.pages[page - 1].num]["Rotate"] = degrees % 360

    def watermark(self, text: str, *, size: float = 48.0, gray: float = 0.75, degrees: float = 45.0) -> None:
        """Text across every page."""
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        ops = [("q", []), ("rg", [gray] * 3), ("BT", []), ("Tf", [Name(WATERMARK_FONT), size]), ("Tm", [c, s, -s, c, *WATERMARK_AT]), ("Tj", [encode_text(text)]), ("ET", []), ("Q", [])]
        font = self.store.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
        mark = self.store.add(Stream({}, operators(ops)))
        for r in self.pages:
            page = self.store.objects[r.num]
            resources = dict(self.store.get(page.get("Resources")) or {})
            resources["Font"] = dict(self.store.get(resources.get("Font")) or {}) | {WATERMARK_FONT: font}
            page["Resources"] = resources
            was = page.get("Contents")
            held = self.store.get(was)
            page["Contents"] = [*(held if isinstance(held, list) else [was] if was is not None else []), mark]

    def _fields(self) -> list[dict]:
        form = self.store.get(self._catalog().get("AcroForm"))
        found = [self.store.get(x) for x in self.store.get(form.get("Fields")) or []] if isinstance(form, dict) else []
        return [x for x in found if isinstance(x, dict)]

    def fill_form(self, values: dict[str, str]) -> None:
        """Set top-level fields by name; other names are passed over."""
        for d in self._fields():
            name = self.store.get(d.get("T"))
            if isinstance(name, bytes) and name.decode("utf-8", "replace") in values:
                d["V"] = values[name.decode("utf-8", "replace")].encode()
        form = self.store.get(self._catalog().get("AcroForm"))
        if isinstance(form, dict):
            form["NeedAppearances"] = True

    def form_field_value(self, name: str) -> str | None:
        for d in self._fields():
            own = self.store.get(d.get("T"))
            if isinstance(own, bytes) and own.decode("utf-8", "replace") == name:
                value = self.store.get(d.get("V"))
                return value.decode("utf-8", "replace") if isinstance(value, bytes) else None
        return None

    def save(self) -> bytes:
        return self.store.save()

    def save_classic(self, **password) -> bytes:
        return self.store.save_classic(**password)


def _shifted(x, by: int):
    if isinstance(x, Ref):
        return Ref(x.num + by, x.gen)
    if isinstance(x, list):
        return [_shifted(v, by) for v in x]
    if isinstance(x, dict):
        return {k: _shifted(v, by) for k, v in x.items()}
    if isinstance(x, Stream):
        return Stream(_shifted(x.dict, by), x.raw)
    return Keyword(x) if isinstance(x, Keyword) else x
