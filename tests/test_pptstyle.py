"""Style runs of legacy presentations."""

import struct

from test_ole import compound

from quirel.sources import ole, pptstyle, render


def runs(paras, chars):
    """paras: (characters, level, bullet or None); chars: (characters, bold, italic)."""
    out = b""
    for n, level, bullet in paras:
        out += struct.pack("<IH", n, level) + (struct.pack("<IH", 1, int(bullet)) if bullet is not None else struct.pack("<I", 0))
    for n, bold, italic in chars:
        out += struct.pack("<IIH", n, 3, bold | italic << 1) if bold or italic else struct.pack("<I", n) + struct.pack("<I", 0)
    return out


def test_runs_and_masks():
    got = pptstyle.parse_style_text(runs([(4, 0, True), (4, 1, None)], [(2, True, False), (6, False, True)]), 7)
    assert got.paragraphs == [(4, 0, True), (4, 1, None)] and got.characters == [(2, True, False), (6, False, True)]
    assert got.paragraph(5) == (1, None) and got.emphasis(3) == [(True, False), (True, False), (False, True)]
    tabs = struct.pack("<IHI", 3, 0, 1 << 20) + struct.pack("<HHH", 1, 5, 6) + struct.pack("<II", 3, 0)
    assert pptstyle.parse_style_text(tabs, 2).characters == [(3, False, False)]
    assert pptstyle.parse_style_text(b"", 5).paragraphs == [] and pptstyle.parse_style_text(runs([(9, 0, None)], [])[:7], 8).paragraphs == []


def test_slides():
    atom = lambda t, b, v=0: struct.pack("<HHI", v, t, len(b)) + b
    text = "one\rtwo\rplain"
    styles = runs([(4, 0, None), (4, 1, True), (6, 0, False)], [(4, False, False), (3, True, False), (7, False, False)])
    slides = atom(3999, struct.pack("<I", 0)) + atom(4000, "Top".encode("utf-16-le")) + atom(3999, struct.pack("<I", 1)) + atom(4008, text.encode()) + atom(4001, styles)
    data = compound({"PowerPoint Document": atom(1000, atom(4080, slides, 15), 15)})
    assert render.to_markdown(ole.ppt(data)) == "## Top\n\n- one\n  - **two**\n\nplain\n"
