"""Decryption of password-protected PDFs: the standard security handler with RC4 and AES, on the standard library.

AES works from tables that are built by rule (field inverses and the affine map of the published standard).
"""

from __future__ import annotations

import functools
import hashlib

from .model import ConvertError

# What short passwords are filled up with.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def times(a: int, b: int) -> int:
    """Product in the field of 256 elements."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@functools.cache
def boxes() -> tuple[bytes, bytes]:
    """Substitution box and its inverse."""
    box = bytearray(256)
    for x in range(256):
        v = 1
        for _ in range(254):
            v = times(v, x)
        box[x] = functools.reduce(lambda a, k: a ^ ((v << k | v >> (8 - k)) & 255), range(5), 0) ^ 0x63  # noqa: B023
    back = bytearray(256)
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


@functools.cache
def products(k: int) -> bytes:
    return bytes(times(x, k) for x in range(256))


@functools.lru_cache(64)
def round_keys(key: bytes) -> tuple[bytes, ...]:
    box, n = boxes()[0], len(key) // 4
    words = [key[4 * i : 4 * i + 4] for i in range(n)]
    rcon = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(box[b] for b in w[1:] + w[:1])
            w = bytes([w[0] ^ rcon]) + w[1:]
            rcon = times(rcon, 2)
        elif n > 6 and i % n == 4:
            w = bytes(box[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], w)))
    return tuple(b"".join(words[i : i + 4]) for i in range(0, len(words), 4))


# Places that the bytes of a block are taken from when its rows are shifted, and when they are shifted back.
SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
SHIFT_BACK = [(i - 4 * (i % 4)) % 16 for i in range(16)]


def encrypt_block(block: bytes, keys: tuple[bytes, ...]) -> bytes:
    box, m2, m3 = boxes()[0], products(2), products(3)
    s = [a ^ b for a, b in zip(block, keys[0])]
    for r, k in enumerate(keys[1:], 1):
        s = [box[s[i]] for i in SHIFT]
        if r < len(keys) - 1:
            s = [m2[s[c + i]] ^ m3[s[c + (i + 1) % 4]] ^ s[c + (i + 2) % 4] ^ s[c + (i + 3) % 4] for c in (0, 4, 8, 12) for i in range(4)]
        s = [a ^ b for a, b in zip(s, k)]
    return bytes(s)


def decrypt_block(block: bytes, keys: tuple[bytes, ...]) -> bytes:
    box, m9, m11, m13, m14 = boxes()[1], products(9), products(11), products(13), products(14)
    s = [a ^ b for a, b in zip(block, keys[-1])]
    for r in range(len(keys) - 2, -1, -1):
        s = [box[s[i]] ^ k for i, k in zip(SHIFT_BACK, keys[r])]
        if r:
            s = [m14[s[c + i]] ^ m11[s[c + (i + 1) % 4]] ^ m13[s[c + (i + 2) % 4]] ^ m9[s[c + (i + 3) % 4]] for c in (0, 4, 8, 12) for i in range(4)]
    return bytes(s)


def aes_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC without padding."""
    keys, out = round_keys(key), []
    for i in range(0, len(data) - 15, 16):
        iv = encrypt_block(bytes(a ^ b for a, b in zip(data[i : i + 16], iv)), keys)
        out.append(iv)
    return b"".join(out)


def aes_decrypt(key: bytes, iv: bytes, data: bytes, padded: bool = True) -> bytes:
    keys, out = round_keys(key), []
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out.append(bytes(a ^ b for a, b in zip(decrypt_block(block, keys), iv)))
        iv = block
    plain = b"".join(out)
    return plain[: -plain[-1]] if padded and plain and 1 <= plain[-1] <= 16 else plain


def hardened(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """The hash of the newest revision: rounds of AES and a hash chosen by what came out."""
    k = hashlib.sha256(password + salt + extra).digest()
    i = 0
    while True:
        e = aes_encrypt(k[:16], k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Crypt:
    """The handler of one document. A wrong password raises ConvertError('encrypted')."""

    def __init__(self, d: dict, doc_id: bytes, password: str = ""):
        self.version, self.revision = int(d.get("V") or 0), int(d.get("R") or 0)
        if d.get("Filter") != "Standard" or self.version not in (1, 2, 4, 5):
            raise ConvertError("encrypted", "an unknown security handler")
        self.methods = {"stream": "V2", "string": "V2"}
        if self.version >= 4:
            filters = d.get("CF") or {}
            for kind, key in (("stream", "StmF"), ("string", "StrF")):
                own = filters.get(str(d.get(key) or "Identity"))
                self.methods[kind] = str((own or {}).get("CFM") or "None")
        self.metadata = d.get("EncryptMetadata") is not False
        owner, user = d.get("O") or b"", d.get("U") or b""
        if self.version == 5:
            self.key = self._new_key(d, password.encode()[:127], owner, user)
        else:
            size = 5 if self.revision == 2 else max(5, min(16, int(d.get("Length") or 40) // 8))
            if self.version == 4:
                size = 16
            self.key = self._old_key(password, owner, user, int(d.get("P") or 0), doc_id, size)
        if self.key is None:
            raise ConvertError("encrypted", "the password doesn't open this document")

    def _old_key(self, password: str, owner: bytes, user: bytes, rights: int, doc_id: bytes, size: int) -> bytes | None:
        pw = password.encode("latin-1", "replace")[:32]
        tries = [pw]
        # The owner's password gives the user's.
        k = hashlib.md5((pw + PAD)[:32]).digest()
        if self.revision >= 3:
            for _ in range(50):
                k = hashlib.md5(k[:size]).digest()
        inner = owner[:32]
        for i in range(19 if self.revision >= 3 else 0, -1, -1):
            inner = rc4(bytes(b ^ i for b in k[:size]), inner)
        tries.append(inner)
        for p in tries:
            m = hashlib.md5((p + PAD)[:32] + owner[:32] + (rights & 0xFFFFFFFF).to_bytes(4, "little") + doc_id)
            if self.revision >= 4 and not self.metadata:
                m.update(b"\xff\xff\xff\xff")
            key = m.digest()
            if self.revision >= 3:
                for _ in range(50):
                    key = hashlib.md5(key[:size]).digest()
            key = key[:size]
            if self.revision == 2:
                ok = rc4(key, PAD) == user[:32]
            else:
                u = hashlib.md5(PAD + doc_id).digest()
                for i in range(20):
                    u = rc4(bytes(b ^ i for b in key), u)
                ok = u == user[:16]
            if ok:
                return key
        return None

    def _new_key(self, d: dict, pw: bytes, owner: bytes, user: bytes) -> bytes | None:
        make = hardened if self.revision >= 6 else lambda p, salt, extra=b"": hashlib.sha256(p + salt + extra).digest()
        if make(pw, user[32:40]) == user[:32]:
            return aes_decrypt(make(pw, user[40:48]), bytes(16), (d.get("UE") or b"")[:32], False)
        if make(pw, owner[32:40], user[:48]) == owner[:32]:
            return aes_decrypt(make(pw, owner[40:48], user[:48]), bytes(16), (d.get("OE") or b"")[:32], False)
        return None

    def decrypt(self, data: bytes, n: int, gen: int, kind: str) -> bytes:
        """A string's or stream's bytes, by its object's number and generation."""
        method = self.methods[kind]
        if method in ("None", "Identity"):
            return data
        if method == "AESV3":
            return aes_decrypt(self.key, data[:16], data[16:])
        salt = b"sAlT" if method == "AESV2" else b""
        key = hashlib.md5(self.key + n.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + salt).digest()[: min(16, len(self.key) + 5)]
        return aes_decrypt(key, data[:16], data[16:]) if salt else rc4(key, data)
