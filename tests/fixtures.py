"""Small documents whose content is known: built by our own writer, for tests."""

from __future__ import annotations

from docspark.pdf.objects import Name, Ref, Stream
from docspark.pdf.writer import Builder, Store

LETTER = [0, 0, 612, 792]


def text_page(lines: list[tuple[str, float, float, float]], *, title: str | None = None, author: str | None = None, **password) -> bytes:
    """One page of (text, x, y, size)."""
    b = Builder(title=title, author=author)
    b.add_page()
    for text, x, y, size in lines:
        b.draw_text(0, text, (x, y), size=size)
    return b.save_classic(**password) if password else b.save()


def born_digital() -> bytes:
    return text_page([(f"Line {i + 1} of the born digital page.", 72, 740 - 18 * i, 14) for i in range(8)], title="Born Digital", author="writer")


def scanned(share: float = 1.0, lines: int = 0) -> bytes:
    b = Builder()
    b.add_page()
    b.place_samples(0, bytes([160] * 16), 4, 4, "DeviceGray", (0, 792 * (1 - share), 612, 792))
    for i in range(lines):
        b.draw_text(0, f"A line of text below the image, number {i}.", (72, 200 - 18 * i))
    return b.save()


HEADED = [("Chapter One", 22), ("Section A", 16), ("Alpha body paragraph first line of text.", 11), ("Alpha body paragraph second line of it.", 11), ("Section B", 16), ("Beta body paragraph line.", 11), ("Chapter Two", 22), ("Gamma paragraph.", 11), ("", 11), ("Delta paragraph.", 11)]


def multi_heading() -> bytes:
    y, lines = 740.0, []
    for text, size in HEADED:
        if text:
            lines.append((text, 72, y, size))
        y -= 1.6 * size + 6
    return text_page(lines, title="Headed")


ROSTER = [["Name", "Role", "Level"], ["Ada", "Engineering", "Senior"], ["Linus", "Systems", "Staff"]]


def table_doc() -> bytes:
    cells = [(t, x, 700 - 20 * r, 11) for r, row in enumerate(ROSTER) for t, x in zip(row, (72, 250, 430), strict=True)]
    return text_page([*cells, ("Figure 1: Team roster table.", 72, 630, 11)])


def two_tables() -> bytes:
    rows = [(("A1", "B1"), 700), (("A2", "B2"), 680), (("C1", "D1"), 600), (("C2", "D2"), 580)]
    return text_page([(t, x, y, 11) for row, y in rows for t, x in zip(row, (72, 250), strict=True)])


def figure_with_caption() -> bytes:
    b = Builder()
    b.add_page()
    b.place_samples(0, bytes([90] * 12), 2, 2, "DeviceRGB", (100, 400, 500, 700))
    b.draw_text(0, "Figure 1: A sample chart.", (100, 385), size=14)
    return b.save()


def ruled_spanning() -> bytes:
    b = Builder()
    b.add_page()
    for y in (712, 690, 670, 650):
        b.draw_rule(0, (72, y), (430, y))
    for x, top in ((72, 712), (250, 690), (430, 712)):
        b.draw_rule(0, (x, 650), (x, top))
    for text, x, y in (("Header", 80, 696), ("Ada", 80, 676), ("Engineer", 258, 676), ("Linus", 80, 656), ("Systems", 258, 656)):
        b.draw_text(0, text, (x, y), size=11)
    return b.save()


def rotated() -> bytes:
    b = Builder()
    b.add_page()
    b.draw_text(0, "Rotated", (0, 0), size=12, matrix=(0.0, 1.0, -1.0, 0.0, 200.0, 400.0))
    return b.save()


def encrypted() -> bytes:
    return text_page([("This page is encrypted.", 72, 700, 14), ("Second line.", 72, 680, 14)], user="open-sesame", owner="owner-secret")


def pages_doc(n: int) -> bytes:
    b = Builder(title=f"{n} pages")
    for i in range(n):
        b.draw_text(b.add_page(), f"Page number {i + 1} body", (72, 700))
    return b.save()


class Raw:
    """A document put together object by object; pages inherit their resources."""

    def __init__(self) -> None:
        self.s = Store("1.5")
        self.root = self.s.add({})
        self.font = self.s.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")})
        self.resources: dict = {"Font": {"F1": self.font}}
        self.pages: list[Ref] = []
        self.catalog: dict = {"Type": Name("Catalog"), "Pages": self.root}

    def page(self, content: bytes | None, **more) -> Ref:
        d = {"Type": Name("Page"), "Parent": self.root} | more
        if content is not None:
            d["Contents"] = self.s.add(Stream({}, content))
        self.pages.append(self.s.add(d))
        return self.pages[-1]

    def save(self, classic: bool = False) -> bytes:
        self.s.objects[self.root.num] = {"Type": Name("Pages"), "Kids": self.pages, "Count": len(self.pages), "MediaBox": LETTER, "Resources": self.resources}
        self.s.trailer["Root"] = self.s.add(self.catalog)
        return self.s.save_classic() if classic else self.s.save()


def form() -> bytes:
    r = Raw()
    page = r.page(None)
    field = r.s.add({"FT": Name("Tx"), "T": b"name", "V": b"", "Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": [100, 700, 300, 720], "P": page})
    r.s.objects[page.num]["Annots"] = [field]
    r.catalog["AcroForm"] = r.s.add({"Fields": [field]})
    return r.save()


def type0() -> bytes:
    r = Raw()
    child = r.s.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("X"), "W": [0, [2000, 1000]], "DW": 1000})
    r.resources["Font"] = {"F1": r.s.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("X"), "Encoding": Name("Identity-H"), "DescendantFonts": [child]})}
    r.page(b"BT /F1 10 Tf 100 700 Td <00000001> Tj ET")
    return r.save()


def outline_and_links() -> bytes:
    r = Raw()
    a, b = r.page(b"BT /F1 12 Tf 72 700 Td (One) Tj ET"), r.page(b"BT /F1 12 Tf 72 700 Td (Two) Tj ET")
    top, one, sub, two = (r.s.add({}) for _ in range(4))
    dest = lambda p: [p, Name("Fit")]
    r.s.objects[top.num] = {"Type": Name("Outlines"), "First": one, "Last": two, "Count": 3}
    r.s.objects[one.num] = {"Title": b"Chapter 1", "Parent": top, "Next": two, "First": sub, "Last": sub, "Dest": dest(a)}
    r.s.objects[sub.num] = {"Title": b"\xfe\xff\x00S\x00e\x00c\x20\x13", "Parent": one, "A": {"S": Name("GoTo"), "D": b"named"}}
    r.s.objects[two.num] = {"Title": b"Chapter 2", "Parent": top, "Prev": one, "Dest": Name("old")}
    r.catalog |= {"Outlines": top, "Dests": {"old": dest(b)}, "Names": {"Dests": r.s.add({"Kids": [r.s.add({"Names": [b"named", {"D": dest(b)}]})]})}}
    link = lambda rect, **t: r.s.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": rect} | t)
    r.s.objects[a.num]["Annots"] = [link([150, 720, 50, 700], A={"S": Name("URI"), "URI": b"https://example.com"}), link([200, 700, 350, 720], Dest=dest(b)), link([0, 0, 1, 1])]
    r.s.trailer["Info"] = r.s.add({k: k.lower().encode() for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")} | {"CreationDate": b"D:20240101000000Z", "ModDate": b"D:20240202000000Z"})
    return r.save()


def cyclic_outline() -> bytes:
    r = Raw()
    page = r.page(None)
    top, item = r.s.add({}), r.s.add({})
    r.s.objects[top.num] = {"First": item}
    r.s.objects[item.num] = {"Title": b"Loop", "First": item, "Next": item, "Dest": [page, Name("Fit")]}
    r.catalog["Outlines"] = top
    return r.save()


def _tagged(content: bytes, tree, roles: dict | None = None) -> bytes:
    """tree: (tag, more, kids) with kids of the same or marked-content numbers."""
    r = Raw()
    page = r.page(content)
    root = r.s.add({})

    def node(t, parent: Ref) -> Ref:
        tag, more, kids = t
        own = r.s.add({})
        made = [k if isinstance(k, int) else {"Type": Name("MCR"), "MCID": k["mcr"], "Pg": page} if isinstance(k, dict) else node(k, own) for k in kids]
        r.s.objects[own.num] = {"Type": Name("StructElem"), "S": Name(tag), "P": parent, "Pg": page, "K": made[0] if len(made) == 1 else made} | more
        return own

    r.s.objects[root.num] = {"Type": Name("StructTreeRoot"), "K": [node(tree, root)]} | ({"RoleMap": {k: Name(v) for k, v in roles.items()}} if roles else {})
    r.catalog |= {"MarkInfo": {"Marked": True}, "StructTreeRoot": root}
    return r.save()


def marked(texts: list[tuple[str, float, float]], size: int = 14) -> bytes:
    return b"\n".join(f"/P <</MCID {i}>> BDC BT /F1 {size} Tf 1 0 0 1 {x} {y} Tm ({t}) Tj ET EMC".encode() for i, (t, x, y) in enumerate(texts))


def tagged_minimal() -> bytes:
    content = marked([("Title", 72, 700), ("Paragraph.", 72, 680), ("Figure", 72, 660)])
    return _tagged(content, ("Document", {}, [("Heading1", {}, [0]), ("P", {}, [{"mcr": 1}]), ("Figure", {"Alt": b"A pie chart"}, [2])]), {"Heading1": "Title1", "Title1": "H1", "Loop": "Loop2", "Loop2": "Loop"})


def tagged_table() -> bytes:
    texts = [("Name", 72, 700), ("Role", 250, 700), ("Ada", 72, 680), ("Eng", 250, 680), ("Note", 72, 660)]
    span = {"A": [{"O": Name("Layout")}, {"O": Name("Table"), "ColSpan": 2}]}
    rows = [("TR", {}, [("TH", {}, [0]), ("TH", {}, [1])]), ("TBody", {}, [("TR", {}, [("TD", {}, [2]), ("TD", {}, [3])]), ("TR", {}, [("TD", span, [4])])])]
    return _tagged(marked(texts, 11), ("Table", {}, rows))


ALL = {f.__name__: f for f in (born_digital, scanned, multi_heading, table_doc, two_tables, figure_with_caption, ruled_spanning, rotated, form, type0, outline_and_links, cyclic_outline, tagged_minimal, tagged_table)}
