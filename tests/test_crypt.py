"""Encrypted PDFs: published test values, and documents encrypted here by each method."""

import hashlib

import pytest

from quirel.plans.convert_queries import make_pdf
from quirel.sources import crypt as C
from quirel.sources import pdf as P
from quirel.sources.model import ConvertError


def test_published_values():
    assert C.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        keys = C.round_keys(bytes(range(size)))
        assert C.encrypt_block(plain, keys).hex() == want and C.decrypt_block(bytes.fromhex(want), keys) == plain


def hexed(b):
    return "<" + b.hex() + ">"


def encrypted(method: str, password: str) -> bytes:
    """A PDF of one page whose content is encrypted by a method."""
    body, pw, ids = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (hidden words here) Tj 0 -20 Td (more) Tj 0 -20 Td (and more) Tj ET", password.encode(), b"0123456789abcdef"
    owner = b"o" * 32
    if method == "AESV3":
        file_key, salts = bytes(range(32)), b"valisaltkeysalt!"
        u = C.hardened(pw, salts[:8]) + salts
        ue = C.aes_encrypt(C.hardened(pw, salts[8:]), bytes(16), file_key)
        d = f"/V 5/R 6/Length 256/P -4/U {hexed(u)}/O {hexed(b'x' * 48)}/UE {hexed(ue)}/OE {hexed(bytes(32))}/StmF/Std/StrF/Std/CF<</Std<</CFM/AESV3>>>>"
    else:
        size, rev, ver = {"RC4-40": (5, 2, 1), "V2": (16, 3, 2), "AESV2": (16, 4, 4)}[method]
        key = hashlib.md5((pw + C.PAD)[:32] + owner + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + ids).digest()
        for _ in range(50 if rev >= 3 else 0):
            key = hashlib.md5(key[:size]).digest()
        file_key = key[:size]
        u = C.rc4(file_key, C.PAD) if rev == 2 else hashlib.md5(C.PAD + ids).digest()
        for i in range(20 if rev >= 3 else 0):
            u = C.rc4(bytes(b ^ i for b in file_key), u)
        d = f"/V {ver}/R {rev}/Length {size * 8}/P -4/U {hexed(u.ljust(32, bytes(1)))}/O {hexed(owner)}" + ("/StmF/Std/StrF/Std/CF<</Std<</CFM/AESV2>>>>" if rev == 4 else "")
    own = hashlib.md5(file_key + (5).to_bytes(3, "little") + bytes(2) + (b"sAlT" if method == "AESV2" else b"")).digest()[: min(16, len(file_key) + 5)]
    pad = bytes([16 - len(body) % 16]) * (16 - len(body) % 16)
    raw = C.rc4(own, body) if method in ("V2", "RC4-40") else b"i" * 16 + C.aes_encrypt(file_key if method == "AESV3" else own, b"i" * 16, body + pad)
    objs = {1: "<</Type/Catalog/Pages 2 0 R>>", 2: "<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: "<</Type/Page/Parent 2 0 R/Contents 5 0 R/Resources<</Font<</F1 4 0 R>>>>>>", 4: "<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", 6: f"<</Filter/Standard{d}>>"}
    out = b"%PDF-1.7\n" + b"".join(f"{n} 0 obj\n{o}\nendobj\n".encode() for n, o in objs.items()) + b"5 0 obj\n<</Length %d>>stream\n" % len(raw) + raw + b"\nendstream\nendobj\n"
    return out + f"trailer<</Root 1 0 R/Encrypt 6 0 R/ID[{hexed(ids)}{hexed(ids)}]>>\n%%EOF".encode()


@pytest.mark.parametrize("method", ["RC4-40", "V2", "AESV2", "AESV3"])
@pytest.mark.parametrize("password", ["", "open sesame"])
def test_documents(method, password):
    data = encrypted(method, password)
    assert "hidden words here" in P.process(data, password)["markdown"]
    with pytest.raises(ConvertError) as e:
        P.process(data, "wrong")
    assert e.value.code == "encrypted"


def test_detection_strategies_and_page_filters():
    data = make_pdf([[("some words on a page", 50, 700 - 20 * k, 12) for k in range(4)] if i % 2 == 0 else [] for i in range(9)])
    assert P.chosen_pages(9, ("sample", 3)) == [1, 5, 9] and P.chosen_pages(9, ("pages", [2, 2, 99])) == [2] and P.chosen_pages(0, ("sample", 1)) == [] and P.chosen_pages(4, ("sample", 9)) == [1, 2, 3, 4]
    assert len(P.detect(data)["signals"]) == 9 and len(P.detect(data, strategy="early")["signals"]) == 1
    assert P.detect(data, strategy=("pages", [2]))["needs_ocr"] == [2] and P.detect(data)["page_count"] == 9
    assert [p.no for p in P.process(data, only={3, 4})["pages"]] == [3, 4]
