"""Standard widths, predefined encodings, embedded character tables; bullets that slides take over."""

import struct

from test_drawings import A, P, R, rels
from test_wholes import zipped

from quirel.sources import convert, fonts, render
from quirel.sources import pdf as pdf_reader


def test_standard_widths():
    w = fonts.standard_widths("ABCDEF+Helvetica-Bold")
    assert w[ord("i")] == 222 and w[ord("W")] == 944 and w[0xE9] == 556 and fonts.standard_widths("Courier")[65] == 600
    assert fonts.standard_widths("TimesNewRoman")[ord("A")] == 722 and fonts.standard_widths("Other") == {} and len(fonts.SANS) == len(fonts.SERIF) == 95


def test_predefined_encodings():
    for name, text in (("UniJIS-UCS2-H", "日本"), ("90ms-RKSJ-H", "日本a"), ("GBK-EUC-H", "中文"), ("KSCms-UHC-H", "한국"), ("ETen-B5-H", "中文"), ("UniGB-UTF16-V", "😀中")):
        codec = fonts.predefined_codec(name)
        assert "".join(c for c, _ in fonts.decode_codes(text.encode(codec), codec)) == text
    assert fonts.predefined_codec("Identity-H") is None and fonts.decode_codes(b"\xff", "gb2312")[0][0] == "�"


def table(chars: dict[int, int]) -> bytes:
    """A font file with nothing but a character table of format 4 (character -> glyph)."""
    segs = [(c, c, (g - c) & 0xFFFF) for c, g in sorted(chars.items())] + [(0xFFFF, 0xFFFF, 1)]
    n = len(segs)
    body = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + b"".join(struct.pack(">H", s[1]) for s in segs) + b"\0\0" + b"".join(struct.pack(">H", s[0]) for s in segs) + b"".join(struct.pack(">H", s[2]) for s in segs) + b"\0\0" * n
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + body
    return struct.pack(">IHHHH", 0x00010000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap


def test_embedded_tables():
    font = table({0x41: 3, 0xE9: 7})
    assert fonts.glyph_unicode(font) == {3: "A", 7: "é"} and fonts.glyph_unicode(b"") == {} and fonts.glyph_unicode(font[:40]) == {}
    body = b"BT /F1 10 Tf 50 700 Td <000300070003> Tj ET BT /F2 10 Tf 50 600 Td <65E5672C> Tj ET"
    objs = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 5 0 R/Resources<</Font<</F1 4 0 R/F2 9 0 R>>>>>>", 4: b"<</Type/Font/Subtype/Type0/BaseFont/X/Encoding/Identity-H/DescendantFonts[6 0 R]>>", 6: b"<</Type/Font/Subtype/CIDFontType2/FontDescriptor 7 0 R>>", 7: b"<</FontFile2 8 0 R>>", 9: b"<</Type/Font/Subtype/Type0/BaseFont/Y/Encoding/UniJIS-UCS2-H/DescendantFonts[<</DW 1000>>]>>"}
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in objs.items()) + b"".join(b"%d 0 obj\n<</Length %d>>stream\n" % (n, len(s)) + s + b"\nendstream\nendobj\n" for n, s in ((5, body), (8, font))) + b"trailer<</Root 1 0 R>>"
    got = pdf_reader.process(data)
    assert [t.text for t in got["pages"][0].items] == ["AéA", "日本"] and not got["signals"][0]["has_identity_h_no_tounicode"]


def test_bullets_of_placeholders():
    sp = lambda ph, body, style="": f'<p:sp><p:nvSpPr><p:cNvPr/><p:cNvSpPr/><p:nvPr><p:ph {ph}/></p:nvPr></p:nvSpPr><p:txBody><a:lstStyle>{style}</a:lstStyle>{body}</p:txBody></p:sp>'
    par = lambda t, lv=0: f'<a:p><a:pPr lvl="{lv}"/><a:r><a:t>{t}</a:t></a:r></a:p>'
    page = lambda tag, inner: f'<p:{tag} xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:{tag}>'
    master = page("sldMaster", sp('type="body" idx="1"', "")).replace("</p:sldMaster>", '<p:txStyles><p:bodyStyle><a:lvl1pPr><a:buChar char="x"/></a:lvl1pPr><a:lvl2pPr><a:buNone/></a:lvl2pPr></p:bodyStyle></p:txStyles></p:sldMaster>')
    layout = page("sldLayout", sp('type="body" idx="7"', "", "<a:lvl1pPr><a:buNone/></a:lvl1pPr>") + sp('type="body" idx="1"', ""))
    slide = page("sld", sp('idx="7"', par("no bullet")) + sp('type="body" idx="1"', par("bullet") + par("plain", 1)))
    data = zipped({"_rels/.rels": rels(("m", "officeDocument", "ppt/p.xml")), "ppt/p.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="1" r:id="s1"/></p:sldIdLst></p:presentation>', "ppt/_rels/p.xml.rels": rels(("s1", "slide", "s.xml")), "ppt/s.xml": slide, "ppt/_rels/s.xml.rels": rels(("l", "slideLayout", "l.xml")), "ppt/l.xml": layout, "ppt/_rels/l.xml.rels": rels(("m", "slideMaster", "m.xml")), "ppt/m.xml": master})
    assert render.to_markdown(convert.to_document(data, "pptx")) == "no bullet\n\n- bullet\n\nplain\n"
