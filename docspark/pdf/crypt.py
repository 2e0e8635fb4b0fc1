"""The standard security handler: RC4 and AES, revisions 2 to 6. MD5 and SHA from hashlib, the ciphers here."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from .errors import PdfError

#: Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@lru_cache(maxsize=1)
def _boxes() -> tuple[bytes, bytes]:
    """The substitution box and its inverse, from inverses in the field."""
    box = bytearray(256)
    for x in range(256):
        inv = next((y for y in range(256) if _times(x, y) == 1), 0)
        out = 0x63
        for k in range(5):
            out ^= (inv << k | inv >> (8 - k)) & 255
        box[x] = out
    back = bytearray(256)
    for x, y in enumerate(box):
        back[y] = x
    return bytes(box), bytes(back)


@lru_cache(maxsize=8)
def _multiples(n: int) -> bytes:
    return bytes(_times(x, n) & 255 for x in range(256))


@lru_cache(maxsize=64)
def _round_keys(key: bytes) -> list[bytes]:
    box, n = _boxes()[0], len(key) // 4
    words = [key[4 * i : 4 * i + 4] for i in range(n)]
    turn = 1
    while len(words) < 4 * (n + 7):
        w = words[-1]
        if len(words) % n == 0:
            w = bytes(box[c] for c in w[1:] + w[:1])
            w = bytes([w[0] ^ turn]) + w[1:]
            turn = _times(turn, 2)
        elif n > 6 and len(words) % n == 4:
            w = bytes(box[c] for c in w)
        words.append(bytes(a ^ b for a, b in zip(words[-n], w, strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


_SHIFT = [0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11]
_UNSHIFT = [_SHIFT.index(i) for i in range(16)]


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(16, "big")


def _mix(block: bytes, by: tuple[int, int, int, int]) -> bytes:
    t = [_multiples(k) for k in by]
    out = bytearray(16)
    for c in range(0, 16, 4):
        for r in range(4):
            out[c + r] = t[0][block[c + r]] ^ t[1][block[c + (r + 1) % 4]] ^ t[2][block[c + (r + 2) % 4]] ^ t[3][block[c + (r + 3) % 4]]
    return bytes(out)


def _encrypt_block(keys: list[bytes], block: bytes) -> bytes:
    box = _boxes()[0]
    block = _xor(block, keys[0])
    for k in keys[1:-1]:
        block = _xor(_mix(bytes(box[block[i]] for i in _SHIFT), (2, 3, 1, 1)), k)
    return _xor(bytes(box[block[i]] for i in _SHIFT), keys[-1])


def _decrypt_block(keys: list[bytes], block: bytes) -> bytes:
    back = _boxes()[1]
    block = _xor(block, keys[-1])
    for k in keys[-2:0:-1]:
        block = _mix(_xor(bytes(back[block[i]] for i in _UNSHIFT), k), (14, 11, 13, 9))
    return _xor(bytes(back[block[i]] for i in _UNSHIFT), keys[0])


def aes_cbc(key: bytes, iv: bytes, data: bytes, *, encrypt: bool = False) -> bytes:
    """Whole blocks, no padding."""
    keys, out = _round_keys(key), []
    for i in range(0, len(data) - len(data) % 16, 16):
        block = data[i : i + 16]
        if encrypt:
            iv = _encrypt_block(keys, _xor(block, iv))
            out.append(iv)
        else:
            out.append(_xor(_decrypt_block(keys, block), iv))
            iv = block
    return b"".join(out)


def aes_decrypt(key: bytes, data: bytes) -> bytes:
    """The first block is the vector, the last byte tells the padding."""
    if len(data) < 32:
        return b""
    out = aes_cbc(key, data[:16], data[16:])
    return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out


def _hash6(password: bytes, salt: bytes, more: bytes, revision: int) -> bytes:
    k = hashlib.sha256(password + salt + more).digest()
    if revision < 6:
        return k
    i, last = 0, 0
    while i < 64 or last > i - 32:
        e = aes_cbc(k[:16], k[16:32], (password + k + more) * 64, encrypt=True)
        kind = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3]
        k, last = kind(e).digest(), e[-1]
        i += 1
    return k[:32]


class Security:
    """Keys of one encrypted document; raises password_required_or_incorrect if the password opens nothing."""

    def __init__(self, encrypt: dict, first_id: bytes, password: str | None) -> None:
        if encrypt.get("Filter") != "Standard":
            raise PdfError("unsupported_security_handler", f"security handler {encrypt.get('Filter')!r}")
        self.v, self.r = int(encrypt.get("V", 0)), int(encrypt.get("R", 2))
        if self.v not in (1, 2, 4, 5):
            raise PdfError("unsupported_security_handler", f"encryption version {self.v}")
        self.o, self.u = bytes(encrypt.get("O", b"")), bytes(encrypt.get("U", b""))
        self.p = int(encrypt.get("P", 0)) & 0xFFFFFFFF
        self.n = 5 if self.v == 1 else min(16, max(5, int(encrypt.get("Length", 40 if self.v < 4 else 128)) // 8))
        self.id, self.plain_meta = first_id, encrypt.get("EncryptMetadata") is False
        self.stream = self._method(encrypt, "StmF")
        self.text = self._method(encrypt, "StrF")
        self.key = self._open(encrypt, password or "")

    def _method(self, encrypt: dict, which: str) -> str:
        if self.v < 4:
            return "V2"
        name = encrypt.get(which, "Identity")
        found = (encrypt.get("CF") or {}).get(name) or {}
        return str(found.get("CFM", "None")) if name != "Identity" else "None"

    def _open(self, encrypt: dict, password: str) -> bytes:
        if self.v == 5:
            return self._open5(encrypt, password.encode()[:127])
        raw = password.encode("latin-1", "replace")
        for user in (raw, self._user_of_owner(raw)):
            key = self._key(user)
            if self._fits(key):
                return key
        raise PdfError("password_required_or_incorrect", "a password is needed, or it is not the right one")

    def _open5(self, encrypt: dict, password: bytes) -> bytes:
        for salt, held, more, wrapped in ((self.u[32:48], self.u[:32], b"", "UE"), (self.o[32:48], self.o[:32], self.u[:48], "OE")):
            if _hash6(password, salt[:8], more, self.r) == held:
                return aes_cbc(_hash6(password, salt[8:16], more, self.r), bytes(16), bytes(encrypt.get(wrapped, b""))[:32])
        raise PdfError("password_required_or_incorrect", "a password is needed, or it is not the right one")

    def _key(self, password: bytes) -> bytes:
        more = b"\xff\xff\xff\xff" if self.r >= 4 and self.plain_meta else b""
        k = hashlib.md5((password + PAD)[:32] + self.o[:32] + self.p.to_bytes(4, "little") + self.id + more).digest()
        for _ in range(50 if self.r >= 3 else 0):
            k = hashlib.md5(k[: self.n]).digest()
        return k[: self.n]

    def _fits(self, key: bytes) -> bool:
        if self.r == 2:
            return rc4(key, PAD) == self.u[:32]
        x = rc4(key, hashlib.md5(PAD + self.id).digest())
        for i in range(1, 20):
            x = rc4(bytes(b ^ i for b in key), x)
        return x == self.u[:16]

    def _user_of_owner(self, owner: bytes) -> bytes:
        k = owner_key(owner, self.r, self.n)
        x = self.o[:32]
        for i in range(19 if self.r >= 3 else 0, -1, -1):
            x = rc4(bytes(b ^ i for b in k), x)
        return x

    def decrypt(self, data: bytes, num: int, gen: int, method: str) -> bytes:
        if method == "None" or method == "Identity":
            return data
        if method == "AESV3":
            return aes_decrypt(self.key, data)
        salted = hashlib.md5(self.key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if method == "AESV2" else b"")).digest()
        k = salted[: min(16, self.n + 5)]
        return aes_decrypt(k, data) if method == "AESV2" else rc4(k, data)


def owner_key(owner: bytes, r: int, n: int) -> bytes:
    k = hashlib.md5((owner + PAD)[:32]).digest()
    for _ in range(50 if r >= 3 else 0):
        k = hashlib.md5(k).digest()
    return k[:n]


def rc4_40(user: bytes, owner: bytes, first_id: bytes, permissions: int = -4) -> tuple[dict, bytes]:
    """(encryption dictionary, key) of version 1, revision 2."""
    from .objects import Name

    o = rc4(owner_key(owner or user, 2, 5), (user + PAD)[:32])
    key = hashlib.md5((user + PAD)[:32] + o + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + first_id).digest()[:5]
    return {"Filter": Name("Standard"), "V": 1, "R": 2, "O": o, "U": rc4(key, PAD), "P": permissions}, key
