"""Headings, lists and emphasis of a legacy text whose formatting pages are made here."""

import struct

from test_ole import compound

from quirel.sources import ole, render, wordbin

TEXT = "Report\rplain bold\rone\rtwo\rinner\rA\x07B\x07\x07\x31\x07\x32\x07\x07end\r"
BASE = 0x800


def chpx(rows):
    """A page of character runs: (first, after last, properties)."""
    page, at = bytearray(512), 500
    fcs = [rows[0][0], *[r[1] for r in rows]]
    struct.pack_into(f"<{len(fcs)}I", page, 0, *fcs)
    for k, (_, _, p) in enumerate(rows):
        if p:
            at -= (len(p) + 2) // 2 * 2
            page[at] = len(p)
            page[at + 1 : at + 1 + len(p)] = p
            page[4 * len(fcs) + k] = at // 2
    page[511] = len(rows)
    return bytes(page)


def papx(rows):
    page, at = bytearray(512), 500
    fcs = [rows[0][0], *[r[1] for r in rows]]
    struct.pack_into(f"<{len(fcs)}I", page, 0, *fcs)
    for k, (_, _, style, p) in enumerate(rows):
        body = struct.pack("<H", style) + p
        body += b"\0" * (1 - len(body) % 2)
        at -= len(body) + 1
        at -= at % 2
        page[at] = (len(body) + 1) // 2
        page[at + 1 : at + 1 + len(body)] = body
        page[4 * len(fcs) + 13 * k] = at // 2
    page[511] = len(rows)
    return bytes(page)


def document():
    raw = TEXT.encode("utf-16-le")
    fib = bytearray(0x400)
    struct.pack_into("<H", fib, 10, 0x200)
    struct.pack_into("<I", fib, 0x4C, len(TEXT))
    fc = lambda s, after=False: BASE + 2 * (TEXT.index(s) + (len(s) if after else 0))
    word = bytes(fib) + b"\0" * 0x400 + raw
    word += b"\0" * (-len(word) % 512)
    first = len(word) // 512
    word += chpx([(BASE, fc("bold"), b""), (fc("bold"), fc("bold", True), struct.pack("<HBHB", wordbin.BOLD, 1, wordbin.ITALIC, 1)), (fc("bold", True), BASE + len(raw), b"")])
    entry = lambda lv: struct.pack("<HHHB", wordbin.LIST, 1, wordbin.LEVEL, lv)
    word += papx([(BASE, fc("plain"), 2, b""), (fc("plain"), fc("one"), 0, b""), (fc("one"), fc("two"), 0, entry(0)), (fc("two"), fc("inner"), 0, entry(0)), (fc("inner"), fc("A\x07"), 0, entry(1)), (fc("A\x07"), BASE + len(raw), 0, b"")])
    table, at = b"", {}

    def put(key, data):
        nonlocal table
        at[key] = (len(table), len(data))
        table += data

    std = lambda number, base: struct.pack("<HHHHH", number, base << 4, 0, 0, 0)
    put(0xA2, struct.pack("<HHH", 4, 3, 10) + b"".join(struct.pack("<H", len(s)) + s for s in (std(0, 0xFFF), std(1, 0), std(4094, 1))))
    put(0xFA, struct.pack("<III", BASE, BASE + len(raw), first))
    put(0x102, struct.pack("<III", BASE, BASE + len(raw), first + 1))
    plc = struct.pack("<II", 0, len(TEXT)) + struct.pack("<HIH", 0, BASE, 0)
    put(0x1A2, b"\x02" + struct.pack("<I", len(plc)) + plc)
    put(0x2EA, struct.pack("<I", 1) + struct.pack("<i", 77) + b"\0" * 12)
    put(0x2E2, struct.pack("<H", 1) + struct.pack("<i", 77) + b"\0" * 24)
    for level in range(9):
        table += struct.pack("<iB", 3 if level == 0 else 1, 0 if level == 0 else 23) + b"\0" * 23 + struct.pack("<H", 1) + "x".encode("utf-16-le")
    for key, (a, n) in at.items():
        struct.pack_into("<II", fib, key, a, n)
    return compound({"WordDocument": bytes(fib) + word[0x400:], "1Table": table})


def test_headings_lists_and_emphasis():
    assert render.to_markdown(ole.doc(document())) == "# Report\n\nplain ***bold***\n\n3. one\n4. two\n   - inner\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n\nend\n"


def test_properties_and_cycles():
    assert wordbin.properties(b"\x08\xd6\x03\x00ab" + struct.pack("<HB", 0x0836, 1))[0x0836] == 1
    f = wordbin.Formats.__new__(wordbin.Formats)
    f.pieces, f.first, f.styles, f.lists = [(0, 9, 100, 2)], [0], [(50, 1), (51, 0)], []
    f.paras, f.chars = wordbin.Runs.of([(100, 120, (0, {wordbin.OUTLINE: 1, wordbin.LIST: 4}))]), wordbin.Runs()
    assert f.heading(0) == 2 and f.heading(99) is None and f.entry(0) is None and f.emphasis(3) == (False, False, False)
