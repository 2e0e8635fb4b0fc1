"""Text of shown strings and their widths."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .objects import Lexer, Name, Stream, number
from .reader import File

DEFAULT_ADVANCE, DEFAULT_CID_WIDTH, MAX_CID = 500.0, 1000.0, 0xFFFF
#: Glyph names that no rule gives.
SIGNS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_",
    "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£", "fraction": "⁄", "yen": "¥", "florin": "ƒ", "section": "§", "currency": "¤",
    "quotedblleft": "“", "quotedblright": "”", "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ", "endash": "–", "emdash": "—", "dagger": "†", "daggerdbl": "‡",
    "periodcentered": "·", "paragraph": "¶", "bullet": "•", "quotesinglbase": "‚", "quotedblbase": "„", "ellipsis": "…", "perthousand": "‰", "questiondown": "¿", "acute": "´", "circumflex": "ˆ", "tilde": "˜", "macron": "¯",
    "breve": "˘", "dotaccent": "˙", "dieresis": "¨", "ring": "˚", "cedilla": "¸", "hungarumlaut": "˝", "ogonek": "˛", "caron": "ˇ", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł",
    "lslash": "ł", "dotlessi": "ı", "germandbls": "ß", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "mu": "µ", "degree": "°", "plusminus": "±", "multiply": "×", "divide": "÷", "brokenbar": "¦", "copyright": "©",
    "registered": "®", "trademark": "™", "logicalnot": "¬", "ordfeminine": "ª", "ordmasculine": "º", "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "Euro": "€", "nbspace": " ",
}
_ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌", "macron": "̄", "breve": "̆", "ogonek": "̨", "dotaccent": "̇", "hungarumlaut": "̋"}
#: Where the standard encoding leaves ASCII or Latin-1, by glyph name.
STANDARD = {
    0x27: "quoteright", 0x60: "quoteleft", 0xA1: "exclamdown", 0xA2: "cent", 0xA3: "sterling", 0xA4: "fraction", 0xA5: "yen", 0xA6: "florin", 0xA7: "section", 0xA8: "currency", 0xA9: "quotesingle", 0xAA: "quotedblleft",
    0xAB: "guillemotleft", 0xAC: "guilsinglleft", 0xAD: "guilsinglright", 0xAE: "fi", 0xAF: "fl", 0xB1: "endash", 0xB2: "dagger", 0xB3: "daggerdbl", 0xB4: "periodcentered", 0xB6: "paragraph", 0xB7: "bullet", 0xB8: "quotesinglbase",
    0xB9: "quotedblbase", 0xBA: "quotedblright", 0xBB: "guillemotright", 0xBC: "ellipsis", 0xBD: "perthousand", 0xBF: "questiondown", 0xC1: "grave", 0xC2: "acute", 0xC3: "circumflex", 0xC4: "tilde", 0xC5: "macron", 0xC6: "breve",
    0xC7: "dotaccent", 0xC8: "dieresis", 0xCA: "ring", 0xCB: "cedilla", 0xCD: "hungarumlaut", 0xCE: "ogonek", 0xCF: "caron", 0xD0: "emdash", 0xE1: "AE", 0xE3: "ordfeminine", 0xE8: "Lslash", 0xE9: "Oslash", 0xEA: "OE",
    0xEB: "ordmasculine", 0xF1: "ae", 0xF5: "dotlessi", 0xF8: "lslash", 0xF9: "oslash", 0xFA: "oe", 0xFB: "germandbls",
}
#: PDFDocEncoding where it is not Latin-1; 0x7F, 0x9F and 0xAD have no character.
PDF_DOC = dict(zip(range(0x18, 0x20), "˘ˇˆ˙˝˛˚˜", strict=True)) | dict(zip(range(0x80, 0xA1), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€", strict=True))


def pdf_text(raw: bytes) -> str:
    """A text string: UTF-16 with its mark, else PDFDocEncoding."""
    if raw[:2] == b"\xfe\xff":
        body = raw[2:]
        return (body[: len(body) // 2 * 2]).decode("utf-16-be", "replace") + "�" * (len(body) % 2)
    return "".join(PDF_DOC.get(b) or chr(b) for b in raw)


def glyph(name: str) -> str:
    """The text of a glyph name, empty if it is not known."""
    base = name.partition(".")[0]
    if base in SIGNS:
        return SIGNS[base]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"uni((?:[0-9A-Fa-f]{4})+)|u([0-9A-Fa-f]{4,6})", base):
        codes = [int(m[1][i : i + 4], 16) for i in range(0, len(m[1]), 4)] if m[1] else [int(m[2], 16)]
        return "".join(chr(c) for c in codes if c < 0x110000 and not 0xD800 <= c < 0xE000)
    for accent, mark in _ACCENTS.items():
        if base.endswith(accent) and len(base) == len(accent) + 1:
            return unicodedata.normalize("NFC", base[0] + mark)
    return "".join(map(glyph, base.split("_"))) if "_" in base else ""


def _codec(name: str) -> list[str]:
    return [bytes([c]).decode(name, "replace") if c >= 32 else chr(c) for c in range(256)]


@lru_cache
def base_encoding(name: str | None) -> tuple[str, ...]:
    if name == "WinAnsiEncoding":
        return tuple("•" if c == "�" else c for c in _codec("cp1252"))
    if name == "MacRomanEncoding":
        return tuple(_codec("mac_roman"))
    out = [chr(c) if c < 0x80 else "" for c in range(256)]
    for c, n in STANDARD.items():
        out[c] = SIGNS[n]
    return tuple(out[c] or chr(c) for c in range(256))


class CMap:
    """Codes of one or two bytes to text, out of a ToUnicode stream."""

    def __init__(self, data: bytes) -> None:
        self.map: dict[tuple[int, int], str] = {}
        self.ranges: list[tuple[int, int, int, bytes]] = []
        self.lengths: set[int] = set()
        lexer, stack = Lexer(data), []
        while (got := lexer.object()) is not None:
            if got == "endbfchar":
                for a, b in zip(stack[::2], stack[1::2], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        self.map[len(a), int.from_bytes(a, "big")] = _utf16(b)
                        self.lengths.add(len(a))
            elif got == "endbfrange":
                for a, b, c in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        self._range(a, b, c)
            elif got == "endcodespacerange":
                self.lengths |= {len(x) for x in stack if isinstance(x, bytes)}
            if isinstance(got, str) and not isinstance(got, Name):
                stack = []
            else:
                stack.append(got)

    def _range(self, a: bytes, b: bytes, c) -> None:
        lo, hi = int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 0xFFFF)
        self.lengths.add(len(a))
        if isinstance(c, list):
            self.map |= {(len(a), lo + i): _utf16(x) for i, x in enumerate(c[: hi - lo + 1]) if isinstance(x, bytes)}
        elif isinstance(c, bytes) and c:
            self.ranges.append((len(a), lo, hi, c))

    def code(self, n: int, code: int) -> str | None:
        found = self.map.get((n, code))
        if found is None:
            for size, lo, hi, c in self.ranges:
                if size == n and lo <= code <= hi:
                    return _utf16((int.from_bytes(c, "big") + code - lo).to_bytes(len(c) + 1, "big")[-len(c) :])
        return found

    def text(self, raw: bytes) -> str:
        out, i = [], 0
        sizes = sorted(self.lengths) or [1]
        while i < len(raw):
            for n in sizes:
                found = self.code(n, int.from_bytes(raw[i : i + n], "big")) if i + n <= len(raw) else None
                if found is not None:
                    out.append(found)
                    i += n
                    break
            else:
                i += sizes[-1] if len(sizes) == 1 else sizes[0]
                out.append("�")
        return "".join(out)


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")


def cid_widths(file: File, items: list) -> dict[int, float]:
    """Widths of a W array: `c [w ...]` or `first last w`; what fits neither is passed by one element."""
    out: dict[int, float] = {}
    items = [file.get(x) for x in items]
    cid = lambda x: x if type(x) is int and 0 <= x <= MAX_CID else None
    i = 0
    while i + 1 < len(items):
        first, second = cid(items[i]), items[i + 1]
        if first is not None and isinstance(second, list):
            out |= {first + k: w for k, w in enumerate(number(file.get(x)) for x in second) if w is not None and first + k <= MAX_CID}
            i += 2
            continue
        width = number(items[i + 2]) if i + 2 < len(items) else None
        if first is None or cid(second) is None or width is None:
            i += 1
            continue
        out |= dict.fromkeys(range(first, max(first, second) + 1), width)
        i += 3
    return out


class Font:
    """Decodes and measures the strings shown in one font."""

    def __init__(self, file: File, d: dict) -> None:
        self.cmap: CMap | None = None
        to_unicode = file.get(d.get("ToUnicode"))
        if isinstance(to_unicode, Stream):
            self.cmap = CMap(file.stream_bytes(to_unicode))
        self.composite = d.get("Subtype") == "Type0"
        self.widths: list[float] | None = None
        self.known = False
        self._composite(file, d) if self.composite else self._simple(file, d)

    def _simple(self, file: File, d: dict) -> None:
        encoding = file.get(d.get("Encoding"))
        base = encoding if isinstance(encoding, Name) else file.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else None
        self.table = list(base_encoding(base if base in ("WinAnsiEncoding", "MacRomanEncoding") else None))
        if isinstance(encoding, dict):
            code = 0
            for x in file.get(encoding.get("Differences")) or []:
                x = file.get(x)
                if type(x) is int:
                    code = x
                elif isinstance(x, Name):
                    if 0 <= code < 256:
                        self.table[code] = glyph(x) or self.table[code]
                    code += 1
        widths = file.get(d.get("Widths"))
        if isinstance(widths, list) and widths:
            self.known = True
            self.widths = [number(file.get(w), 0.0) for w in widths]
            first = file.get(d.get("FirstChar"))
            self.first = first if type(first) is int else 0
            descriptor = file.get(d.get("FontDescriptor"))
            self.default = number(file.get(descriptor.get("MissingWidth")) if isinstance(descriptor, dict) else None, DEFAULT_ADVANCE)

    def _composite(self, file: File, d: dict) -> None:
        encoding = file.get(d.get("Encoding"))
        self.identity = encoding in ("Identity-H", "Identity-V")
        inner = file.get(d.get("DescendantFonts"))
        child = file.get(inner[0]) if isinstance(inner, list) and inner else None
        if isinstance(child, dict):
            self.known = True
            self.default = number(file.get(child.get("DW")), DEFAULT_CID_WIDTH)
            w = file.get(child.get("W"))
            self.by_cid = cid_widths(file, w) if isinstance(w, list) else {}

    def text(self, raw: bytes) -> str:
        if self.cmap is not None:
            return self.cmap.text(raw)
        if self.composite:
            return raw[: len(raw) // 2 * 2].decode("utf-16-be", "replace") + ("�" if len(raw) % 2 else "")
        return raw.decode("latin-1").translate(self.table)

    def advance(self, raw: bytes, text: str) -> float:
        """Width in thousandths of the size."""
        if not self.known:
            return len(text) * DEFAULT_ADVANCE
        if self.composite:
            codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)]
            odd = self.default if len(raw) % 2 else 0.0
            return odd + sum(self.by_cid.get(c, self.default) if self.identity else self.default for c in codes)
        return sum(self.widths[b - self.first] if 0 <= b - self.first < len(self.widths) else self.default for b in raw)
