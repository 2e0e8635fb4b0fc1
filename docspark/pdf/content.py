"""A page's content stream: shown text, drawn images, ruled lines, in one pass."""

from __future__ import annotations

import math

from .objects import Keyword, Lexer, Name, number

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
DEFAULT_ADVANCE = 500.0
MAX_PATH_OPS, AXIS = 20_000, 0.5
_FOLD = str.maketrans("\n\r\t", "   ")


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def matrix(ops: list) -> Matrix | None:
    got = tuple(number(x) for x in ops)
    return got if len(got) == 6 and None not in got else None


def operations(data: bytes):
    """(operator, operands); inline images are passed over."""
    lexer, operands = Lexer(data), []
    while (got := lexer.object()) is not None:
        if not isinstance(got, Keyword):
            operands.append(got)
            continue
        if got == "BI":
            end = lexer.data.find(b"ID", lexer.at)
            close = _inline_end(lexer.data, end + 2) if end >= 0 else -1
            lexer.at = close if close >= 0 else lexer.end
        else:
            yield str(got), operands
        operands = []


def _inline_end(data: bytes, at: int) -> int:
    while (k := data.find(b"EI", at)) >= 0:
        if data[k - 1 : k] in (b"\n", b"\r", b" ", b"\t") and data[k + 2 : k + 3] in (b"", b"\n", b"\r", b" ", b"\t"):
            return k + 2
        at = k + 2
    return -1


class Interpreter:
    """runs: (text, x0, y0, x1, y1, size, mcid); draws: (name, matrix); rules: (vertical, pos, lo, hi)."""

    def __init__(self, fonts: dict, images: dict, mcid_of) -> None:
        self.fonts, self.images, self.mcid_of = fonts, images, mcid_of
        self.runs: list[tuple] = []
        self.draws: list[tuple[str, Matrix]] = []
        self.rules: list[tuple[bool, float, float, float]] = []

    def run(self, data: bytes) -> Interpreter:
        ctm, saved = IDENTITY, []
        tm = line = IDENTITY
        size = leading = 0.0
        font = None
        marks: list[int | None] = []
        path = _Path(self.rules)
        for k, (op, args) in enumerate(operations(data)):
            if k < MAX_PATH_OPS:
                path.step(op, args, ctm)
            if op == "q":
                saved.append(ctm)
            elif op == "Q":
                ctm = saved.pop() if saved else ctm
            elif op == "cm":
                ctm = multiply(m, ctm) if (m := matrix(args)) else ctm
            elif op == "Do":
                if args and isinstance(args[0], Name) and args[0] in self.images:
                    self.draws.append((str(args[0]), ctm))
            elif op in ("BDC", "BMC"):
                marks.append(self.mcid_of(args) if op == "BDC" else None)
            elif op == "EMC":
                marks and marks.pop()
            elif op == "BT":
                tm = line = IDENTITY
            elif op == "Tf":
                size = number(args[1], size) if len(args) > 1 else size
                font = self.fonts.get(args[0]) if args and isinstance(args[0], Name) else None
            elif op == "TL":
                leading = number(args[0], leading) if args else leading
            elif op in ("Td", "TD"):
                xy = [number(x) for x in args[:2]]
                if len(xy) == 2 and None not in xy:
                    leading = -xy[1] if op == "TD" else leading
                    tm = line = multiply((1.0, 0.0, 0.0, 1.0, xy[0], xy[1]), line)
            elif op == "Tm":
                tm = line = m if (m := matrix(args)) else line
            elif op in ("T*", "'", '"'):
                tm = line = multiply((1.0, 0.0, 0.0, 1.0, 0.0, -leading), line)
            shown = args[:1] if op in ("Tj", "'") else args[2:3] if op == '"' else args[0] if op == "TJ" and args and isinstance(args[0], list) else []
            for x in shown:
                if isinstance(x, bytes):
                    tm = self.show(x, font, size, ctm, tm, next((m for m in reversed(marks) if m is not None), None))
                elif op == "TJ" and number(x) is not None:
                    tm = multiply((1.0, 0.0, 0.0, 1.0, -number(x) / 1000 * size, 0.0), tm)
        return self

    def show(self, raw: bytes, font, size: float, ctm: Matrix, tm: Matrix, mcid: int | None) -> Matrix:
        text = (font.text(raw) if font else raw.decode("latin-1")).translate(_FOLD)
        if not text:
            return tm
        width = (font.advance(raw, text) if font else len(text) * DEFAULT_ADVANCE) / 1000 * size
        both = multiply(tm, ctm)
        tall = math.hypot(both[2], both[3])
        corners = [apply(both, x, y) for x in (0.0, width) for y in (0.0, size if size > 0 else 1.0)]
        xs, ys = zip(*corners, strict=True)
        self.runs.append((text, min(xs), min(ys), max(xs), max(ys), size * tall if size > 0 else tall, mcid))
        return multiply((1.0, 0.0, 0.0, 1.0, width, 0.0), tm)


class _Path:
    """Collects the straight segments of a path; they become rules when it is stroked."""

    def __init__(self, out: list) -> None:
        self.out, self.pending = out, []
        self.at = self.start = None

    def segment(self, a, b) -> None:
        if a is None or b is None or not all(map(math.isfinite, (*a, *b))):
            return
        dx, dy = abs(b[0] - a[0]), abs(b[1] - a[1])
        if dx <= AXIS < dy:
            self.pending.append((True, (a[0] + b[0]) / 2, min(a[1], b[1]), max(a[1], b[1])))
        elif dy <= AXIS < dx:
            self.pending.append((False, (a[1] + b[1]) / 2, min(a[0], b[0]), max(a[0], b[0])))

    def step(self, op: str, args: list, ctm: Matrix) -> None:
        if op in ("m", "l"):
            xy = [number(x) for x in args[:2]]
            point = apply(ctm, *xy) if len(xy) == 2 and None not in xy and all(map(math.isfinite, xy)) else None
            if op == "m":
                self.at = self.start = point
            elif self.at is not None and point is not None:
                self.segment(self.at, point)
                self.at = point
        elif op == "re":
            box = [number(x) for x in args[:4]]
            if len(box) == 4 and None not in box and all(map(math.isfinite, box)):
                x, y, w, h = box
                ring = [apply(ctm, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]
                for a, b in zip(ring, ring[1:], strict=False):
                    self.segment(a, b)
            self.at = self.start = None
        elif op == "h":
            self.segment(self.at, self.start)
            self.at = self.start
        elif op in ("S", "s", "B", "B*", "b", "b*"):
            if op in ("s", "b", "b*"):
                self.segment(self.at, self.start)
            self.out += self.pending
            self.pending, self.at, self.start = [], None, None
        elif op in ("f", "F", "f*", "n"):
            self.pending, self.at, self.start = [], None, None
