"""Legacy files, made here byte by byte."""

import struct

import pytest

from quirel.sources import convert, model, ole, render


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file whose streams are all in full sectors."""
    size = 512
    body, fat, entries = b"", [], []
    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        start = len(fat)
        n = -(-len(data) // size)
        fat += [*range(start + 1, start + n), 0xFFFFFFFE]
        body += data.ljust(n * size, b"\0")
        entries.append((name, 2, start, len(data)))
    first_dir = len(fat)
    raw = b""
    for name, kind, start, length in [("Root Entry", 5, 0xFFFFFFFE, 0), *entries]:
        e = name.encode("utf-16-le")
        raw += e.ljust(64, b"\0") + struct.pack("<HBB", len(e) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, length)
    raw = raw.ljust(-(-len(raw) // size) * size, b"\0")
    n = len(raw) // size
    fat += [*range(first_dir + 1, first_dir + n), 0xFFFFFFFE]
    fat_at = len(fat)
    fat.append(0xFFFFFFFD)
    assert len(fat) <= 128
    fat += [0xFFFFFFFF] * (128 - len(fat))
    head = ole.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIIII", 1, first_dir, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, fat_at) + b"\xff" * (108 * 4)
    return head[:512] + body + raw + struct.pack("<128I", *fat)


def rec(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def text16(s: str) -> bytes:
    return struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")


def test_xls():
    book = rec(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0)) + rec(0xE0, struct.pack("<HH", 0, 0) + b"\0" * 16) + rec(0xE0, struct.pack("<HH", 0, 14) + b"\0" * 16)
    book += rec(0x85, b"\0" * 6 + b"\x01\x00S") + rec(0xFC, struct.pack("<II", 2, 2) + text16("name") + text16("größe"))
    book += rec(0x809, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0)) + rec(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + rec(0xFD, struct.pack("<HHHI", 0, 1, 0, 1))
    book += rec(0x203, struct.pack("<HHHd", 1, 0, 1, 45000.0)) + rec(0x27E, struct.pack("<HHHI", 1, 1, 0, (150 << 2) | 3)) + rec(0x205, struct.pack("<HHHBB", 2, 0, 0, 1, 0)) + rec(0x0A, b"")
    data = compound({"Workbook": book})
    assert render.to_markdown(convert.to_document(data, "xls")) == "| name | größe |\n| --- | --- |\n| 2023-03-15 | 1.5 |\n| TRUE |  |\n"
    assert convert.convert_one("a.xls", data)[6] is None and ole.Compound(data).stream("missing") is None
    with pytest.raises(model.ConvertError) as e:
        ole.xls(compound({"Workbook": rec(0x2F, b"\0\0")}))
    assert e.value.code == "encrypted"


def test_doc():
    text = "Hello \x13HYPERLINK \"http://x.invalid\"\x14link\x15\rA\x07B\x07\x07\x31\x07\x32\x07\x07End\r"
    raw = text.encode("utf-16-le")
    fib = bytearray(0x400)
    struct.pack_into("<H", fib, 10, 0x200)
    struct.pack_into("<I", fib, 0x4C, len(text))
    plc = struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 0x400, 0)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", fib, 0x1A2, 0, len(clx))
    data = compound({"WordDocument": bytes(fib) + raw, "1Table": clx})
    assert render.to_markdown(ole.doc(data)) == "Hello [link](http://x.invalid)\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n\nEnd\n"


def test_ppt():
    atom = lambda t, b, v=0: struct.pack("<HHI", v, t, len(b)) + b
    slides = atom(3999, struct.pack("<I", 0)) + atom(4000, "Top".encode("utf-16-le")) + atom(3999, struct.pack("<I", 1)) + atom(4008, b"one\rtwo")
    data = compound({"PowerPoint Document": atom(1000, atom(4080, slides, 15), 15)})
    assert render.to_markdown(ole.ppt(data)) == "## Top\n\n- one\n- two\n"
    assert convert.convert_one("x.ppt", b"junk")[6] == "unsupported"
