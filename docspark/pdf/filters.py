"""Stream filters: Flate and LZW with predictors, ASCII85, ASCIIHex, RunLength."""

from __future__ import annotations

import re
import zlib

import numpy as np

from .errors import malformed

#: Bytes that one stream may grow to.
MAX_OUTPUT = 1 << 28
IMAGE_FILTERS = ("DCTDecode", "DCT", "JPXDecode", "CCITTFaxDecode", "CCF", "JBIG2Decode")


def flate(data: bytes) -> bytes:
    """What can be inflated: a broken end loses only what follows it."""
    for wbits in (15, -15):
        worker, out = zlib.decompressobj(wbits), []
        size = 0
        try:
            for i in range(0, len(data), 1 << 16):
                out.append(worker.decompress(data[i : i + (1 << 16)]))
                size += len(out[-1])
                if size > MAX_OUTPUT:
                    raise malformed("a stream grows too large")
            return b"".join(out) + worker.flush()
        except zlib.error:
            if size:
                return b"".join(out)
    return b""


def lzw(data: bytes, early: int = 1) -> bytes:
    table: list[bytes] = []
    out: list[bytes] = []
    width, bits, held, before, size = 9, 0, 0, b"", 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 256:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return b"".join(out)
            if not table:
                table = [bytes([i]) for i in range(256)] + [b"", b""]
            if code < len(table):
                entry = table[code]
            elif code == len(table) and before:
                entry = before + before[:1]
            else:
                return b"".join(out)
            out.append(entry)
            size += len(entry)
            if size > MAX_OUTPUT:
                raise malformed("a stream grows too large")
            if before and len(table) < 4096:
                table.append(before + entry[:1])
            before = entry
            width = min(12, max(9, (len(table) + early).bit_length()))
    return b"".join(out)


def ascii85(data: bytes) -> bytes:
    data = re.sub(rb"[\x00\t\n\x0c\r ]", b"", data).removeprefix(b"<~").partition(b"~")[0]
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group) - 1
        group += [84] * (5 - len(group))
        out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[:n]
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def unpredict(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if not isinstance(kind, int) or kind < 2:
        return data
    colors, bits, columns = (max(1, int(parms.get(k, d) or d)) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    step, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if row > MAX_OUTPUT:
        raise malformed("a predictor's row is too long")
    if kind == 2:
        if bits != 8:
            return data
        n = len(data) // row
        a = np.frombuffer(data[: n * row], np.uint8).reshape(n, columns, colors)
        return np.cumsum(a, axis=1, dtype=np.uint8).tobytes()
    out, above = [], np.zeros(row, np.int32)
    for i in range(0, len(data), row + 1):
        line = np.frombuffer(data[i + 1 : i + 1 + row], np.uint8).astype(np.int32)
        if len(line) < row:
            line = np.r_[line, np.zeros(row - len(line), np.int32)]
        line = _unfilter(data[i], line, above, step)
        out.append(line.astype(np.uint8).tobytes())
        above = line
    return b"".join(out)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0 or kind > 4:
        return line
    if kind == 2:
        return (line + above) & 255
    if kind == 1:
        pad = -len(line) % step
        whole = np.r_[line, np.zeros(pad, np.int32)].reshape(-1, step)
        return (np.cumsum(whole, axis=0) & 255).reshape(-1)[: len(line)]
    now = line.tolist()
    up = above.tolist()
    for i in range(len(now)):
        left = now[i - step] if i >= step else 0
        if kind == 3:
            add = (left + up[i]) >> 1
        else:
            corner = up[i - step] if i >= step else 0
            guess = left + up[i] - corner
            far = (abs(guess - left), abs(guess - up[i]), abs(guess - corner))
            add = left if far[0] <= far[1] and far[0] <= far[2] else up[i] if far[1] <= far[2] else corner
        now[i] = (now[i] + add) & 255
    return np.array(now, np.int32)


_SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode"}


def decode(data: bytes, names: list[str], parms: list[dict]) -> tuple[bytes, list[str]]:
    """(bytes, the filters left undone): stops at an image filter or one it does not know."""
    for k, name in enumerate(names):
        name = _SHORT.get(name, name)
        own = parms[k] if k < len(parms) else {}
        if name == "FlateDecode":
            data = unpredict(flate(data), own)
        elif name == "LZWDecode":
            data = unpredict(lzw(data, own.get("EarlyChange", 1)), own)
        elif name == "ASCII85Decode":
            data = ascii85(data)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
        elif name != "Crypt":
            return data, names[k:]
    return data, []
