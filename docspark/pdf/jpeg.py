"""Baseline JPEG: Huffman-coded, eight bits, one to four components. Other kinds are None."""

from __future__ import annotations

import math

import numpy as np

MAX_PIXELS = 1 << 26


def _zigzag() -> list[int]:
    """Places of an 8 x 8 block along its diagonals, turning at the edges."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return [r * 8 + c for r, c in sorted(cells, key=lambda x: (x[0] + x[1], x[1] if (x[0] + x[1]) % 2 == 0 else x[0]))]


ZIGZAG = np.array(_zigzag())
_COS = np.array([[(math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    """Bits of a scan, most significant first; stuffed zeros are gone, markers end it."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.n += 8
        return self.held >> (self.n - n) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.n -= n
        self.held &= (1 << self.n) - 1

    def number(self, n: int) -> int:
        """A signed value of n bits: those that begin with 0 are negative."""
        if not n:
            return 0
        v = self.peek(n)
        self.skip(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


def _table(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For each 16 bits ahead: the code's length and its symbol."""
    out: list[tuple[int, int]] = []
    k = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out += [(length, symbols[k])] * (1 << (16 - length))
            k += 1
    return out[:65536] + [(16, 0)] * (65536 - len(out))


def decode(data: bytes) -> np.ndarray | None:
    """RGB of shape (height, width, 3), or None for what is not baseline."""
    at, quant, tables, parts, adobe, every = 2, {}, {}, [], None, 0
    size: tuple[int, int] | None = None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if kind in (0xFF, 0x00) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if kind == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[which] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(float)
                body = body[1 + n :]
        elif kind == 0xC4:
            while len(body) > 17:
                n = sum(body[1:17])
                tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1):
            if body[0] != 8:
                return None
            size = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= kind <= 0xCF:
            return None
        elif kind == 0xDD:
            every = int.from_bytes(body[:2], "big")
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind == 0xDA:
            if size is None or not all(size) or size[0] * size[1] > MAX_PIXELS or body[0] != len(parts) or len(parts) not in (1, 3, 4):
                return None
            use = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            planes = _scan(data[at:], size, parts, use, tables, quant, every)
            return _colors(planes, adobe)
        elif kind == 0xD9:
            break
    return None


def _segments(data: bytes) -> list[bytes]:
    """The scan's parts between restart marks, without stuffing."""
    out, at, start = [], 0, 0
    while (k := data.find(b"\xff", at)) >= 0 and k + 1 < len(data):
        mark = data[k + 1]
        if mark == 0:
            at = k + 2
        elif 0xD0 <= mark <= 0xD7:
            out.append(data[start:k])
            at = start = k + 2
        elif mark == 0xFF:
            at = k + 1
        else:
            return [x.replace(b"\xff\x00", b"\xff") for x in [*out, data[start:k]]]
    return [x.replace(b"\xff\x00", b"\xff") for x in [*out, data[start:]]]


def _scan(data: bytes, size, parts, use, tables, quant, every: int) -> list[np.ndarray]:
    h, w = size
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-w // (8 * most_h)), -(-h // (8 * most_v))
    held = [np.zeros((down * p[2], across * p[1], 64)) for p in parts]
    segments, total = _segments(data), across * down
    for s, segment in enumerate(segments):
        bits, before = _Bits(segment), [0] * len(parts)
        first = s * every
        for m in range(first, min(first + every, total) if every else total):
            y, x = divmod(m, across)
            for k, (name, ph, pv, _) in enumerate(parts):
                dc, ac = tables.get(use[name] >> 4), tables.get(16 | use[name] & 15)
                if dc is None or ac is None:
                    raise ValueError("a scan without its codes")
                for v in range(pv):
                    for u in range(ph):
                        before[k] = _block(bits, dc, ac, before[k], held[k][y * pv + v, x * ph + u])
    out = []
    for k, (_, ph, pv, q) in enumerate(parts):
        rows, cols, _ = held[k].shape
        flat = np.zeros((rows, cols, 64))
        flat[:, :, ZIGZAG] = held[k] * quant[q][:64]
        blocks = np.einsum("ux,rcuv,vy->rcxy", _COS, flat.reshape(rows, cols, 8, 8), _COS)
        plane = np.clip(np.rint(blocks + 128), 0, 255).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        out.append(np.repeat(np.repeat(plane, most_v // pv, axis=0), most_h // ph, axis=1)[:h, :w])
    return out


def _block(bits: _Bits, dc, ac, before: int, out: np.ndarray) -> int:
    n, symbol = dc[bits.peek(16)]
    bits.skip(n)
    out[0] = before + bits.number(symbol)
    k = 1
    while k < 64:
        n, symbol = ac[bits.peek(16)]
        bits.skip(n)
        if not symbol & 15:
            if symbol != 0xF0:
                break
            k += 16
            continue
        k += symbol >> 4
        if k > 63:
            break
        out[k] = bits.number(symbol & 15)
        k += 1
    return int(out[0])


def _colors(planes: list[np.ndarray], adobe: int | None) -> np.ndarray:
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    a = np.stack(planes, axis=2)
    if adobe in (1, 2) or adobe is None and len(planes) == 3:
        y, cb, cr = a[:, :, 0], a[:, :, 1] - 128, a[:, :, 2] - 128
        a[:, :, :3] = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    if len(planes) == 4:  # inverted inks, as such files have them
        a = np.clip(a[:, :, :3], 0, 255) * a[:, :, 3:] / 255
    return np.clip(np.rint(a[:, :, :3]), 0, 255).astype(np.uint8)
