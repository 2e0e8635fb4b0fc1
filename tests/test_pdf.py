from __future__ import annotations

import random
import zlib

import fixtures as X
import numpy as np
import pytest

from docspark.core.layout import group_lines, reflow
from docspark.operators.edit import _merge
from docspark.pdf import crypt, filters
from docspark.pdf.document import Document, parse
from docspark.pdf.errors import STATUS, PdfError
from docspark.pdf.fonts import CMap, Font, base_encoding, cid_widths, glyph, pdf_text
from docspark.pdf.image import NativeRenderer, crop_region, decode_png, encode_png, output_dimensions
from docspark.pdf.objects import Lexer, Name, Ref, write
from docspark.pdf.writer import Builder, Editor


def text_of(data: bytes, page: int = 1, password: str | None = None) -> str:
    runs = [(r["text"], r["x0"], r["y0"], r["x1"], r["y1"], r["font_size"]) for r in parse(data, password)["runs"] if r["page"] == page]
    return reflow(group_lines(runs))


def code(f, *args, **more) -> str:
    with pytest.raises(PdfError) as e:
        f(*args, **more)
    assert e.value.code in STATUS
    return e.value.code


def test_text_and_metadata():
    got = parse(X.born_digital())
    assert text_of(X.born_digital()).split("\n") == [f"Line {i + 1} of the born digital page." for i in range(8)]
    assert (got["meta"]["title"], got["meta"]["author"], got["meta"]["page_count"], got["meta"]["encrypted"]) == ("Born Digital", "writer", 1, False)
    assert got["pages"] == [{"page": 1, "w_pt": 612.0, "h_pt": 792.0, "rotation": 0}]
    doc = Document(X.born_digital())
    assert code(doc.page, 0) == code(doc.page, 2) == "page_out_of_range"
    assert code(parse, X.pages_doc(3), pages=[1, 4]) == "page_out_of_range"
    assert [p["page"] for p in parse(X.pages_doc(5), pages=[4, 2], max_pages=1)["pages"]] == [4]


def test_passwords():
    data = X.encrypted()
    assert code(parse, data) == code(parse, data, "wrong") == "password_required_or_incorrect"
    for word in ("open-sesame", "owner-secret"):
        assert "encrypted" in text_of(data, password=word) and parse(data, word)["meta"]["encrypted"]


def test_impossible_widths_are_refused():
    data = X.multi_heading()
    assert b"/W [1 4 2]" in data
    assert code(parse, data.replace(b"/W [1 4 2]", b"/W [1 4777777777777777 2]")) == "malformed_pdf"
    assert code(parse, data.replace(b"/W [1 4 2]", b"/W [1 -4 2]")) == "malformed_pdf"
    assert code(parse, b"") == code(parse, b"not a document") == "malformed_pdf"


def test_other_streams_may_spell_widths():
    """Only the dictionary of a cross-reference stream tells its widths, not a text beside it."""
    b = Builder()
    b.add_page()
    b.draw_text(0, "/W[99 -1 17]", (72.0, 700.0))
    assert text_of(b.save()) == "/W[99 -1 17]"


def test_merge_of_documents_whose_bytes_spell_widths():
    b = Builder()
    b.add_page()
    b.draw_text(0, "/W[99 -1 17]", (72.0, 700.0))
    merged = _merge([X.multi_heading(), b.save(), b.save()])
    assert Document(merged).page_count == Document(X.multi_heading()).page_count + 2


def test_fonts_and_places():
    run = parse(X.type0())["runs"]
    assert len(run) == 1 and abs(run[0]["x1"] - run[0]["x0"] - 30) < 0.6
    run = parse(X.rotated())["runs"][0]
    assert run["y1"] - run["y0"] > run["x1"] - run["x0"] and abs(run["font_size"] - 12) < 1e-9
    file = Document(X.type0()).file
    assert cid_widths(file, [1, [500, 600], 10, 12, 700]) == {1: 500.0, 2: 600.0, 10: 700.0, 11: 700.0, 12: 700.0}
    assert cid_widths(file, [-5, 1, [400], 99999, 3, 4, 250]) == {1: 400.0, 3: 250.0, 4: 250.0}
    assert cid_widths(file, [65535, [1, 2, 3]]) == {65535: 1.0}
    simple = Font(file, {"Subtype": Name("Type1"), "Widths": [100, None, 300], "FirstChar": 65, "FontDescriptor": {"MissingWidth": 42}})
    assert simple.advance(b"ABCZ", "ABCZ") == 100 + 0 + 300 + 42
    assert Font(file, {"Subtype": Name("Type1")}).advance(b"ab", "ab") == 1000


def test_encodings():
    assert base_encoding("WinAnsiEncoding")[0x93] == "“" and base_encoding(None)[0x27] == "’" and base_encoding("MacRomanEncoding")[0x8E] == "é"
    assert [glyph(n) for n in ("A", "eacute", "uni20AC", "u1F600", "ff_i", "Scaron", "germandbls", "nonsense", "a.alt")] == ["A", "é", "€", "😀", "ﬀi", "Š", "ß", "", "a"]
    cmap = CMap(b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfchar <01> <0041> <02> <d83dde00> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0058> <0059>] endbfrange")
    assert cmap.text(b"\x01\x02\x10\x12\x20\x21\x99") == "A😀acXY�"
    assert pdf_text(b"\xfe\xff\x00A\x20\xac") == "A€" and pdf_text(b"\xfe\xff\x00A\x00") == "A�" and pdf_text(b"caf\xe9 \x80\x9f\xa0") == "café •�€"


def test_outline_links_and_destinations():
    got = parse(X.outline_and_links())
    assert [(r["title"], r["page"], r["depth"], r["parent_ix"], r["ordinal"]) for r in got["outline"]] == [("Chapter 1", 1, 0, -1, 0), ("Sec–", 2, 1, 0, 0), ("Chapter 2", 2, 0, -1, 1)]
    links = [(r["x0"], r["y0"], r["x1"], r["y1"], r["kind"], r["uri"], r["target_page"]) for r in got["links"]]
    assert links == [(50, 700, 150, 720, "uri", "https://example.com", None), (200, 700, 350, 720, "page", None, 2)]
    assert got["meta"]["subject"] == "subject" and got["meta"]["creation_date"] == "D:20240101000000Z"
    loop = parse(X.cyclic_outline())["outline"]
    assert [(r["title"], r["page"]) for r in loop] == [("Loop", 1)]


def test_structure():
    got = parse(X.tagged_minimal())
    assert got["tagged"] and [(n["tag"], n["raw_tag"], n["alt"]) for n in got["nodes"]] == [("Root", "Root", None), ("Document", "Document", None), ("H1", "Heading1", None), ("P", "P", None), ("Figure", "Figure", "A pie chart")]
    assert [(n["node_ix"], n["parent_ix"], n["depth"], n["last_ix"]) for n in got["nodes"]] == [(0, -1, 0, 4), (1, 0, 1, 4), (2, 1, 2, 2), (3, 1, 2, 3), (4, 1, 2, 4)]
    assert [(k["node_ix"], k["mcid"], k["page"]) for k in got["kids"]] == [(2, 0, 1), (3, 1, 1), (4, 2, 1)]
    assert [r["mcid"] for r in got["runs"]] == [0, 1, 2]
    spans = {n["tag"]: n["col_span"] for n in parse(X.tagged_table())["nodes"]}
    assert spans["TD"] == 2 and not parse(X.born_digital())["tagged"]


def test_images_rules_and_rendering():
    got = parse(X.scanned())
    assert len(got["draws"]) == 1 and [got["draws"][0][c] for c in "abcdef"] == [612, 0, 0, 792, 0, 0]
    assert len(parse(X.ruled_spanning())["rules"]) == 7
    doc = Document(X.scanned())
    bitmap = NativeRenderer().render(doc, 1, {"width": 120})
    assert bitmap.shape == (155, 120, 4) and bitmap[77, 60].tolist() == [160, 160, 160, 255]
    assert NativeRenderer().render(Document(X.born_digital()), 1, {"width": 50, "background": "transparent"}).max() == 0
    assert code(NativeRenderer().render, doc, 1, {"width": 20_000}) == "budget_exceeded"
    assert output_dimensions(612, 792) == (1275, 1650) and output_dimensions(612, 792, width=10, height=10) == (10, 10)
    assert code(output_dimensions, 612, 792, dpi=600) == "budget_exceeded"
    png = encode_png(bitmap)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and (decode_png(png) == bitmap[:, :, :3]).all() and len(encode_png(bitmap, False)) > len(png)
    assert code(encode_png, bitmap[:, :, :3]) == code(decode_png, b"nope") == "backend_error"
    assert crop_region(bitmap, 612, 792, (0, 0, 306, 396)).shape == (78, 60, 4) and crop_region(bitmap, 612, 792, (700, 0, 800, 9)).size == 0


def test_builder_and_editor():
    five = Editor(X.pages_doc(5))
    five.merge(Editor(X.pages_doc(2)))
    assert five.page_count == 7
    assert [text_of(five.save(), n) for n in (5, 6, 7)] == ["Page number 5 body", "Page number 1 body", "Page number 2 body"]
    parts = five.split([(1, 2), (6, 7)])
    assert [parse(p)["meta"]["page_count"] for p in parts] == [2, 2] and text_of(parts[1], 2) == "Page number 2 body" and len(parts[0]) < len(five.save_classic())
    for bad in [(0, 1), (2, 1), (1, 8)]:
        assert code(five.split, [bad]) == "page_out_of_range"
    five.remove_pages([1, 3])
    assert five.page_count == 5 and text_of(five.save(), 1) == "Page number 2 body" and code(five.remove_pages, [9]) == "page_out_of_range"
    five.rotate_page(1, -90)
    assert parse(five.save())["pages"][0]["rotation"] == 270 and code(five.rotate_page, 6, 90) == "page_out_of_range"
    five.watermark("DRAFT")
    marked = parse(five.save())
    assert sum(r["text"] == "DRAFT" for r in marked["runs"]) == 5 and "Page number 2 body" in text_of(five.save_classic(), 1)
    filled = Editor(X.form())
    assert filled.form_field_value("name") == "" and filled.form_field_value("other") is None
    filled.fill_form({"name": "Ada Lovelace", "gone": "x"})
    assert Editor(filled.save()).form_field_value("name") == "Ada Lovelace" == parse(filled.save_classic())["form"][0]["value"]
    b = Builder()
    assert code(b.draw_text, 0, "x", (1, 1)) == "page_out_of_range"
    b.add_page()
    assert code(b.draw_text, 0, "x", (1, 1), font="Comic") == "backend_error"
    b.place_image(0, encode_png(np.full((3, 2, 4), 7, np.uint8)), (0, 0, 100, 100))
    assert len(parse(b.save())["draws"]) == 1


def test_inherited_and_odd_page_trees():
    r = X.Raw()
    r.page(b"BT /F1 10 Tf 1 1 Td (in) Tj ET", Rotate=-90, MediaBox=[10, 10, 110, 60])
    got = parse(r.save(classic=True))
    assert got["pages"][0] == {"page": 1, "w_pt": 100.0, "h_pt": 50.0, "rotation": 270} and got["runs"][0]["text"] == "in"


def test_filters():
    raw = bytes(range(256)) * 9
    assert filters.flate(zlib.compress(raw)) == raw and filters.flate(zlib.compress(raw)[:-9])[:50] == raw[:50] and filters.flate(b"garbage") == b""
    import base64

    assert filters.ascii85(base64.a85encode(raw) + b"~>") == raw and filters.ascii85(b"z~>") == bytes(4) and filters.ascii_hex(b"41 4 2>") == b"AB"
    assert filters.run_length(bytes([2, 65, 66, 67, 254, 68, 128, 1])) == b"ABCDDD"
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (6, 12), np.uint8)
    for kind in range(5):
        above, out = np.zeros(12, int), b""
        for row in rows.astype(int):
            left, corner = np.r_[[0] * 3, row[:-3]], np.r_[[0] * 3, above[:-3]]
            p = left + above - corner
            far = np.abs([p - left, p - above, p - corner])
            paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
            out += bytes([kind]) + ((row - [0 * row, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
            above = row
        assert filters.unpredict(out, {"Predictor": 15, "Colors": 3, "Columns": 4}) == rows.tobytes(), kind
    diff = np.diff(rows.reshape(6, 4, 3).astype(int), axis=1, prepend=0) % 256
    assert filters.unpredict(diff.astype(np.uint8).tobytes(), {"Predictor": 2, "Colors": 3, "Columns": 4}) == rows.tobytes()


def test_ciphers():
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, block = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.aes_cbc(key, bytes(16), block, encrypt=True).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypt.aes_cbc(bytes(range(32)), bytes(16), block, encrypt=True).hex() == "8ea2b7ca516745bfeafc49904b496089"
    data = bytes(range(64))
    assert crypt.aes_cbc(key, block, crypt.aes_cbc(key, block, data, encrypt=True)) == data


def test_objects_round_trip():
    x = {"A": [1, -2.5, b"a(b)\\c\r\n\xff", Name("N #/x"), Ref(3, 0), None, True, {"B": []}], "C": 1e-7}
    got = Lexer(write(x)).object()
    assert got["A"] == [1, -2.5, b"a(b)\\c\r\n\xff", "N #/x", Ref(3, 0), None, True, {"B": []}]
    assert Lexer(b"(a\\(b\\)\\101\\\n(x))").object() == b"a(b)A(x)" and Lexer(b"<48 65 6>").object() == b"He`"


def test_damaged_documents_give_data_or_an_error():
    rng = random.Random(0x9E37)
    for make in X.ALL.values():
        whole = make()
        cases = [whole[: len(whole) // k] for k in (1, 2, 4, 8, 16)]
        for _ in range(16):
            b = bytearray(whole)
            for _ in range(rng.randint(1, 8)):
                b[rng.randrange(len(b))] ^= rng.randint(1, 255)
            cases.append(bytes(b))
        for data in cases:
            try:
                assert parse(data)["meta"]["page_count"] >= 0
            except PdfError as e:
                assert e.code in STATUS
    for _ in range(64):
        assert code(parse, rng.randbytes(rng.randint(1, 4096))) == "malformed_pdf"


def test_repair_without_cross_references():
    data = X.pages_doc(3)
    for cut in (data[: data.rfind(b"startxref")], Editor(data).save_classic()[:-30], b"junk before\n" + data):
        assert parse(cut)["meta"]["page_count"] == 3
