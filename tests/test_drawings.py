"""Charts, diagrams and pictures of office files; fetching; the command."""

import json
import struct
import xml.etree.ElementTree as ET
import zlib

import pytest
from test_wholes import zipped

from quirel import __main__ as command
from quirel.sources import convert, drawings, fetch, render
from quirel.sources.model import Cell, ConvertError, Run, para

C = "http://schemas.openxmlformats.org/drawingml/2006/chart"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def points(tag, values):
    return f"<c:{tag}><c:strRef><c:strCache>" + "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in values) + f"</c:strCache></c:strRef></c:{tag}>"


CHART = f'<c:chartSpace xmlns:c="{C}" xmlns:a="{A}"><c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>Harvest</a:t></a:r></a:p></c:rich></c:tx></c:title><c:plotArea><c:barChart><c:ser>{points("tx", [(0, "Mill")])}{points("cat", [(0, "May"), (1, "June")])}{points("val", [(0, "3"), (1, "5")])}</c:ser><c:ser>{points("val", [(1, "7")])}</c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>'
DIAGRAM = f'<d:dataModel xmlns:d="x" xmlns:a="{A}"><d:ptLst><d:pt><d:t><a:p><a:r><a:t>First</a:t></a:r></a:p></d:t></d:pt><d:pt type="pres"><d:t><a:p><a:r><a:t>no</a:t></a:r></a:p></d:t></d:pt><d:pt><d:t><a:p><a:r><a:t>Second</a:t></a:r></a:p></d:t></d:pt></d:ptLst></d:dataModel>'
TABLE = "|  | Mill | Series 2 |\n| --- | --- | --- |\n| May | 3 |  |\n| June | 5 | 7 |"


def rels(*rows):
    return f'<Relationships xmlns="{REL}">' + "".join(f'<Relationship Id="{i}" Type="{R}/{k}" Target="{t}"/>' for i, k, t in rows) + "</Relationships>"


def test_charts_and_diagrams_of_slides_texts_and_sheets():
    frame = f'<p:graphicFrame><a:graphic><a:graphicData><c:chart xmlns:c="{C}" r:id="c1"/></a:graphicData></a:graphic></p:graphicFrame><p:graphicFrame><a:graphic><a:graphicData><d:relIds xmlns:d="x" r:dm="d1"/></a:graphicData></a:graphic></p:graphicFrame>'
    slide = f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"><p:cSld><p:spTree>{frame}</p:spTree></p:cSld></p:sld>'
    pptx = zipped({"_rels/.rels": rels(("m", "officeDocument", "ppt/p.xml")), "ppt/p.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="1" r:id="s1"/></p:sldIdLst></p:presentation>', "ppt/_rels/p.xml.rels": rels(("s1", "slide", "s.xml")), "ppt/s.xml": slide, "ppt/_rels/s.xml.rels": rels(("c1", "chart", "c.xml"), ("d1", "diagramData", "d.xml")), "ppt/c.xml": CHART, "ppt/d.xml": DIAGRAM})
    assert render.to_markdown(convert.to_document(pptx, "pptx")) == f"**Harvest**\n\n{TABLE}\n\n- First\n- Second\n"
    body = f'<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body><w:p><w:r><w:t>before</w:t></w:r><w:r><w:drawing><c:chart xmlns:c="{C}" r:id="c1"/></w:drawing></w:r></w:p></w:body></w:document>'
    docx = zipped({"_rels/.rels": rels(("m", "officeDocument", "w/d.xml")), "w/d.xml": body, "w/_rels/d.xml.rels": rels(("c1", "chart", "c.xml")), "w/c.xml": CHART})
    assert render.to_markdown(convert.to_document(docx, "docx")) == f"before\n\n**Harvest**\n\n{TABLE}\n"
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    xlsx = zipped({"_rels/.rels": rels(("m", "officeDocument", "x/b.xml")), "x/b.xml": f'<workbook xmlns="{s}" xmlns:r="{R}"><sheets><sheet name="S" r:id="s1"/></sheets></workbook>', "x/_rels/b.xml.rels": rels(("s1", "worksheet", "s.xml")), "x/s.xml": f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="str"><v>x</v></c></row></sheetData></worksheet>', "x/_rels/s.xml.rels": rels(("d1", "drawing", "d.xml")), "x/d.xml": f'<d><c:chart xmlns:c="{C}" xmlns:r="{R}" r:id="c1"/></d>', "x/_rels/d.xml.rels": rels(("c1", "chart", "c.xml")), "x/c.xml": CHART})
    assert render.to_markdown(convert.to_document(xlsx, "xlsx")).endswith(f"**Harvest**\n\n{TABLE}\n")
    assert drawings.chart_blocks(ET.fromstring("<x/>")) == [] and drawings.diagram_blocks(ET.fromstring("<x/>")) == []


def test_pictures():
    emf = b"m" * 16 + struct.pack("<I", 9) + b"h" * 24 + struct.pack("<I", len(zlib.compress(b"metafile"))) + b"\0\xfe" + zlib.compress(b"metafile")
    assert drawings.decode_blip(0x3D4, 0xF01A, emf) == ("image/x-emf", b"metafile")
    assert drawings.decode_blip(0x3D4, 0xF01A, emf, 3) is None and drawings.decode_blip(0, 0xF01A, b"short") is None and drawings.decode_blip(0, 1, b"") is None
    png = b"m" * 16 + b"\xff" + b"\x89PNG"
    record = struct.pack("<HHI", 0x6E0 << 4, 0xF01E, len(png)) + png
    entry = struct.pack("<HHI", 2, 0xF007, 36 + len(record)) + b"\0" * 36 + record
    store = struct.pack("<HHI", 15, 0xF001, len(entry)) + entry
    assert drawings.stored_pictures(store) == [("image/png", b"\x89PNG")]
    a = drawings.Assets(5)
    assert a.add("image/png", "p", b"1234") == a.add("image/png", "p", b"1234")
    with pytest.raises(ConvertError):
        a.add("image/png", "q", b"12")


def test_styles_and_emptiness():
    assert drawings.merged_style({"b": True, "i": False}, {"b": None, "i": True}) == {"b": True, "i": True}
    assert [r.bold for r in drawings.without_base([Run("a", bold=True)], {"bold": True})] == [False]
    assert drawings.runs_are_empty([Run(" "), Run(kind="break")]) and not drawings.runs_are_empty([Run("x", kind="image")])
    assert drawings.cell_is_empty(Cell([para(" ")])) and not drawings.cell_is_empty(Cell([para("x")]))


def test_fetching(spark):
    pages = {"http://a.invalid/x": (302, {"location": "/y%20z.pdf"}, []), "http://a.invalid/y%20z.pdf": (200, {"content-type": "application/pdf; q=1"}, [b"ab", b"cd"]), "http://a.invalid/loop": (302, {"location": "/loop"}, []), "http://a.invalid/in": (302, {"location": "http://inner.invalid/"}, []), "http://a.invalid/n": (200, {"content-disposition": 'attachment; filename="n.txt"'}, [b""]), "http://a.invalid/none": (404, {}, [])}
    lookup = lambda h, p: ["10.0.0.1"] if h == "inner.invalid" else ["93.184.216.34"]
    get = lambda u, **kw: fetch.fetch_url(u, lookup=lookup, request=lambda url, where: pages[url], **kw)
    assert get("http://a.invalid/x") == (b"abcd", "y z.pdf", "application/pdf") and get("http://a.invalid/n")[1] == "n.txt"
    for u, code, kw in (("ftp://a.invalid", "INVALID_URL", {}), ("http://inner.invalid", "BLOCKED_ADDRESS", {}), ("http://a.invalid/in", "BLOCKED_ADDRESS", {}), ("http://a.invalid/loop", "FETCH_FAILED", {}), ("http://a.invalid/none", "FETCH_FAILED", {}), ("http://a.invalid/x", "resourceLimit", {"most": 3})):
        with pytest.raises(ConvertError) as e:
            get(u, **kw)
        assert e.value.code == code
    for a in ("127.0.0.1", "10.1.2.3", "169.254.0.1", "0.0.0.0", "255.255.255.255", "192.0.2.1", "::1", "fe80::1", "fc00::1", "::ffff:10.0.0.1", "224.0.0.1"):
        assert fetch.blocked(a)
    assert not fetch.blocked("93.184.216.34")
    got = fetch.fetch(spark.createDataFrame([(1, "ftp://x.invalid"), (2, None)], "doc_id int, url string")).collect()
    assert {r["error_code"] for r in got} == {"INVALID_URL"}


def test_command(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.html").write_text("<h1>Mill</h1>")
    assert command.main(["convert", "a.html"]) == 0 and capsys.readouterr().out == "# Mill\n"
    assert command.main(["convert", "--json", "a.html"]) == 0 and json.loads(capsys.readouterr().out)["n_blocks"] == 1
    assert command.main(["convert", "/etc/hostname"]) == 1 and command.main(["convert", "none.html"]) == 1
    (tmp_path / "a.docx").write_bytes(b"PK\x03\x04no")
    assert command.main(["convert", "a.docx"]) == 1 and capsys.readouterr().err.splitlines()[-1] == "malformed"
    assert command.main(["formats"]) == 0
