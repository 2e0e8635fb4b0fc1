"""Documents made of a text's lines, with outlines, links, forms, tags and fonts of their own, for the readers' queries."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..pdf.objects import Name, Ref, Stream
from ..pdf.writer import Store, text_string
from .registry import table

LINES_PER_PAGE = 40
SIZE = 11
#: Widths, in thousandths, of a to z and of all others in the two-byte font.
NARROW, WIDE = 250, 600


def lines_of(text: str | None, dropped: str) -> list[tuple[int, str]]:
    """(line number, text) of the lines that hold something once the dropped characters are gone."""
    cleaned = ((i, re.sub(dropped, "", line).strip(" ")) for i, line in enumerate((text or "").split("\n")))
    return [(i, x) for i, x in cleaned if x]


class Book:
    """A document of 40 lines to a page; a catalog and pages that a maker adds to."""

    def __init__(self, lines: list[tuple[int, str]], draw: Callable[[int, str], bytes]) -> None:
        self.s = Store("1.7")
        self.lines = lines
        root = self.s.add({})
        self.font = self.s.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
        self.catalog: dict = {"Type": Name("Catalog"), "Pages": root}
        self.on: dict[int, list[tuple[int, str]]] = {}
        for i, x in lines:
            self.on.setdefault(i // LINES_PER_PAGE + 1, []).append((i, x))
        self.pages: list[Ref] = []
        for p in range(1, max(self.on, default=1) + 1):
            body = b"\n".join(draw(i, x) for i, x in self.on.get(p, []))
            self.pages.append(self.s.add({"Type": Name("Page"), "Parent": root, "Contents": self.s.add(Stream({}, body))}))
        self.s.objects[root.num] = {"Type": Name("Pages"), "Kids": self.pages, "Count": len(self.pages), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": self.font}}}
        self.s.trailer["Root"] = self.s.add(self.catalog)

    def title(self, page: int) -> str:
        return self.on[page][0][1][:20] if page in self.on else "Empty"


def at(i: int) -> str:
    return f"1 0 0 1 72 {740 - 18 * (i % LINES_PER_PAGE)} Tm"


def latin(i: int, x: str) -> bytes:
    shown = x.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    return f"BT /F1 {SIZE} Tf {at(i)} (".encode() + shown + b") Tj ET"


def wide(i: int, x: str) -> bytes:
    return f"BT /F1 {SIZE} Tf {at(i)} <{x.encode('utf-16-be').hex()}> Tj ET".encode()


LATIN, BMP = "[^ -~À-ÿ]", "[^ -~À-ɏ]"


def cid_font(lines: list[tuple[int, str]]) -> bytes:
    """A two-byte font whose codes a ToUnicode stream explains; a to z are narrow."""
    b = Book(lines, wide)
    used = sorted({c for _, x in lines for c in x})
    pairs = "\n".join(f"<{ord(c):04x}> <{ord(c):04x}>" for c in used)
    cmap = f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(used)} beginbfchar\n{pairs}\nendbfchar\n".encode()
    child = b.s.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Own"), "W": [97, 122, NARROW], "DW": WIDE})
    b.s.objects[b.font.num] = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Own"), "Encoding": Name("Identity-H"), "DescendantFonts": [child], "ToUnicode": b.s.add(Stream({}, cmap))}
    return b.s.save()


def outlined(lines: list[tuple[int, str]]) -> bytes:
    """An item for each page, an even page's below the odd one before; destinations in three forms by turns."""
    b = Book(lines, latin)
    n = len(b.pages)
    dest = lambda p: [b.pages[p - 1], Name("Fit")]
    top = b.s.add({})
    items = {p: b.s.add({}) for p in range(1, n + 1)}
    for p, ref in items.items():
        d = b.s.objects[ref.num]
        d["Title"] = text_string(b.title(p))
        d |= ({"A": {"S": Name("GoTo"), "D": f"named {p}".encode()}}, {"Dest": dest(p)}, {"Dest": Name(f"old{p}")})[p % 3]
        d["Parent"] = top if p % 2 else items[p - 1]
        if p % 2 and p + 1 in items:
            d["First"] = d["Last"] = items[p + 1]
        if p % 2 and p + 2 in items:
            d["Next"] = items[p + 2]
    b.s.objects[top.num] = {"Type": Name("Outlines"), "First": items[1], "Last": items[n if n % 2 else n - 1], "Count": n}
    names = [x for p in sorted(items, key=lambda p: f"named {p}") if p % 3 == 0 for x in (f"named {p}".encode(), {"D": dest(p)})]
    b.catalog |= {"Outlines": top, "Dests": {f"old{p}": dest(p) for p in items if p % 3 == 2}, "Names": {"Dests": b.s.add({"Kids": [b.s.add({"Names": names})]})}}
    return b.s.save()


def linked(lines: list[tuple[int, str]]) -> bytes:
    """On each page an address, its corners in reverse, a link to the next page or from the last to the first, and one that leads nowhere."""
    b = Book(lines, latin)
    for p, ref in enumerate(b.pages, 1):
        link = lambda rect, **t: b.s.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": rect} | t)
        b.s.objects[ref.num]["Annots"] = [
            link([150, 720, 50, 700], A={"S": Name("URI"), "URI": f"https://example.com/é/{p}".encode()}), link([0, 0, 1, 1]),
            link([200, 700, 300 + p, 720], Dest=[b.pages[p % len(b.pages)], Name("Fit")]),
        ]
    return b.s.save_classic()


def tagged(lines: list[tuple[int, str]]) -> bytes:
    """Chapters (a role that stands for another that stands for H1), figures with an alternative text, paragraphs."""
    first: dict[int, int] = {}
    numbers: dict[int, int] = {}
    for i, _ in lines:
        numbers[i] = first.get(i // LINES_PER_PAGE, 0)
        first[i // LINES_PER_PAGE] = numbers[i] + 1
    b = Book(lines, lambda i, x: f"/P <</MCID {numbers[i]}>> BDC ".encode() + latin(i, x) + b" EMC")
    root, doc = b.s.add({}), b.s.add({})
    kids = []
    for i, _ in lines:
        raw = tag_of(i)
        page = b.pages[i // LINES_PER_PAGE]
        more = {"Alt": text_string(f"Bild № {i}")} if raw == "Figure" else {}
        kid = {"Type": Name("MCR"), "MCID": numbers[i], "Pg": page} if i % 2 else numbers[i]
        kids.append(b.s.add({"Type": Name("StructElem"), "S": Name(raw), "P": doc, "Pg": page, "K": kid} | more))
    b.s.objects[doc.num] = {"Type": Name("StructElem"), "S": Name("Document"), "P": root, "K": kids}
    b.s.objects[root.num] = {"Type": Name("StructTreeRoot"), "K": [doc], "RoleMap": {"Chapter": Name("Title1"), "Title1": Name("H1"), "Loop": Name("Loop2"), "Loop2": Name("Loop")}}
    b.catalog |= {"MarkInfo": {"Marked": True}, "StructTreeRoot": root}
    return b.s.save()


def tag_of(i: int) -> str:
    return "Chapter" if i % 17 == 0 else "Figure" if i % 7 == 3 else "P"


def sized(lines: list[tuple[int, str]]) -> bytes:
    """Even pages have a box of their own, the others that of their parent; every third is turned."""
    b = Book(lines, latin)
    for p, ref in enumerate(b.pages, 1):
        b.s.objects[ref.num] |= ({"MediaBox": [10, 20, 310 + p, 420 + len(lines)]} if p % 2 == 0 else {}) | ({"Rotate": 90 * p} if p % 3 == 0 else {})
    return b.s.save()


def locked(lines: list[tuple[int, str]]) -> bytes:
    return Book(lines, latin).s.save_classic(user="open", owner="owner")


def form(names: list[str]) -> bytes:
    """Empty text fields."""
    b = Book([], latin)
    fields = [b.s.add({"FT": Name("Tx"), "T": n.encode(), "V": b"", "Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": [100, 700 - 30 * k, 300, 720 - 30 * k], "P": b.pages[0]}) for k, n in enumerate(names)]
    b.s.objects[b.pages[0].num]["Annots"] = fields
    b.catalog["AcroForm"] = b.s.add({"Fields": fields})
    return b.s.save()


def documents(spark: SparkSession, sf_dir: str, make: Callable[[list[tuple[int, str]]], bytes], dropped: str = LATIN) -> DataFrame:
    """(doc_id, content): a document of each text that has a line."""

    def of(batches):
        for batch in batches:
            ids, out = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lines := lines_of(text, dropped):
                    ids.append(doc)
                    out.append(make(lines))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(of, "doc_id bigint, content binary")
