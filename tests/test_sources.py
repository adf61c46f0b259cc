"""Readers and renderer on small files made here."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirel.plans.convert_queries import make_pdf
from quirel.sources import convert, model, office, odf, package, pdf, plain, render, web

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package_of(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def rels(*rows: tuple[str, str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{k}" Target="{t}"{" TargetMode=%sExternal%s" % (chr(34), chr(34)) if "://" in t else ""}/>' for i, k, t in rows) + "</Relationships>"


def docx_of(body: str, **more: str) -> bytes:
    return package_of({"_rels/.rels": rels(("r1", "officeDocument", "word/document.xml")), "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", **more})


def md(fmt: str, data: bytes) -> str:
    return render.to_markdown(convert.to_document(data, fmt))


def test_docx_heading_list_table_note_link():
    styles = f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style><w:style w:styleId="B"><w:name w:val="x"/><w:rPr><w:b/></w:rPr></w:style></w:styles>'
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    notes = f'<w:footnotes {W}><w:footnote w:id="2"><w:p><w:r><w:t>the note</w:t></w:r></w:p></w:footnote></w:footnotes>'
    li = lambda t, lvl=0: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="5"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = (
        '<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>'
        '<w:p><w:r><w:t xml:space="preserve">Some </w:t></w:r><w:r><w:rPr><w:rStyle w:val="B"/></w:rPr><w:t>bold</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r><w:hyperlink r:id="k"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
        + li("three") + li("inner", 1) + li("four")
        + '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    )
    data = docx_of(body, **{"word/_rels/document.xml.rels": rels(("s", "styles", "styles.xml"), ("n", "numbering", "numbering.xml"), ("f", "footnotes", "footnotes.xml"), ("k", "hyperlink", "https://x.invalid/a b")), "word/styles.xml": styles, "word/numbering.xml": numbering, "word/footnotes.xml": notes})
    assert package.detect(data) == "docx"
    assert md("docx", data) == "## Head\n\nSome **bold**[^1][link](<https://x.invalid/a b>)\n\n3. three\n   - inner\n4. four\n\n|  |  |\n| --- | --- |\n| wide |  |\n| a\\|b | c |\n\n[^1]: the note\n"


def test_style_switches_cancel():
    root = package.parse_xml(f'<w:styles {W}><w:style w:styleId="A"><w:rPr><w:b/></w:rPr></w:style><w:style w:styleId="C"><w:basedOn w:val="A"/><w:rPr><w:b/></w:rPr></w:style><w:style w:styleId="X"><w:basedOn w:val="X"/></w:style></w:styles>'.encode())
    s = office.Styles(root)
    assert s.toggles("A")["b"] and not s.toggles("C")["b"] and not s.toggles("X")["b"]


def test_xlsx_kinds_and_merge():
    sheet = '<worksheet xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c></row><row r="2"><c r="A2"><v>0.1</v></c><c r="B2" s="1"><v>45000.5</v></c></row><row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3" s="2"><v>1.5</v></c></row></sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>'
    data = package_of({"_rels/.rels": rels(("r", "officeDocument", "xl/workbook.xml")), "xl/workbook.xml": f'<workbook xmlns:r="{OFFICE}"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("a", "worksheet", "worksheets/s.xml"), ("b", "sharedStrings", "ss.xml"), ("c", "styles", "st.xml")), "xl/ss.xml": "<sst><si><t>what</t></si></sst>", "xl/st.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="46"/></cellXfs></styleSheet>', "xl/worksheets/s.xml": sheet})
    assert md("xlsx", data) == "| what | when |\n| --- | --- |\n| 0.1 | 2023-03-15 12:00:00 |\n|  | 36:00:00 |\n"


def test_pptx():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    sp = lambda ph, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{ph}"/></p:nvPr></p:nvSpPr><p:txBody>{text}</p:txBody></p:sp>'
    p = lambda t, lvl=0: f'<a:p><a:pPr lvl="{lvl}"/><a:r><a:t>{t}</a:t></a:r></a:p>'
    slide = f"<p:sld {a}><p:cSld><p:spTree>{sp('title', p('Top'))}{sp('body', p('one') + p('two', 1))}</p:spTree></p:cSld></p:sld>"
    data = package_of({"_rels/.rels": rels(("r", "officeDocument", "ppt/presentation.xml")), "ppt/presentation.xml": f'<p:presentation {a} xmlns:r="{OFFICE}"><p:sldIdLst><p:sldId id="256" r:id="s1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(("s1", "slide", "slides/slide1.xml")), "ppt/slides/slide1.xml": slide})
    assert md("pptx", data) == "## Top\n\n- one\n  - two\n"


def test_odt_ods_epub():
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:table="tb" xmlns:style="st" xmlns:fo="f"'
    content = f'<office:document-content {ns}><office:automatic-styles><style:style style:name="T"><style:text-properties fo:font-weight="bold"/></style:style></office:automatic-styles><office:body><office:text><text:h text:outline-level="1">H</text:h><text:p>a <text:span text:style-name="T">b</text:span><text:s text:c="2"/>c</text:p><text:list><text:list-item><text:p>x</text:p></text:list-item></text:list></office:text></office:body></office:document-content>'
    assert md("odt", package_of({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": content})) == "# H\n\na **b**  c\n\n- x\n"
    sheet = f'<office:document-content {ns}><office:body><office:spreadsheet><table:table table:name="S"><table:table-row><table:table-cell table:number-columns-repeated="2"><text:p>k</text:p></table:table-cell></table:table-row><table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="float" office:value="2.50"/></table:table-row><table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="1000"/></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>'
    assert md("ods", package_of({"content.xml": sheet})) == "|  |  |\n| --- | --- |\n| k | k |\n| 2.5 |  |\n| 2.5 |  |\n"
    opf = '<package xmlns:dc="d"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>'
    book = package_of({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>', "o/c.opf": opf, "o/a.xhtml": "<html><body><h2>A</h2></body></html>", "o/b.xhtml": '<html><body><p>B <a href="a.xhtml">to a</a></p></body></html>'})
    assert md("epub", book) == "# Book\n\nB [to a](#a)\n\n## A\n"
    assert odf.duration_text("P1DT2H3M4.5S") == "26:03:04.500" and odf.duration_text("P1Y") == "P1Y"


def test_html_spans_lists_and_escapes():
    got = md("html", b"<style>.h{display:none}</style><h1>T</h1><p class=h>no</p><ol start=0><li>z<li>o</ol><table><thead><tr><th>A<th>B</thead><tr><td rowspan=2>1<td>2 | x<tr><td>3</table><p># not a heading<p>1. not a list<p>a*b*c_d")
    assert got == "# T\n\n- 0. z\n- 1. o\n\n| A | B |\n| --- | --- |\n| 1 | 2 \\| x |\n|  | 3 |\n\n\\# not a heading\n\n1\\. not a list\n\na\\*b\\*c_d\n"


def test_delimited_and_rtf():
    assert plain.sniff("a;b,c\n1;2\n3;4,5\n") == ";"
    assert plain.parse_records('a,"b ""q"" ,\nx"\n\nc', ",") == [["a", 'b "q" ,\nx'], [""], ["c"]]
    assert plain.decode(b"\xff\xfea\x00") == "a" and plain.decode(b"caf\xe9 \x81") == "café \x81"
    assert md("rtf", rb"{\rtf1\ansi{\*\foo bar}{\b x}\u8364? \'e9\par{\field{\*\fldinst HYPERLINK " + b'"http://x.invalid"' + rb"}{\fldrslt go}}\par}") == "**x**€ é\n\n[go](http://x.invalid)\n"


def test_pdf_text_table_and_faults():
    data = make_pdf([[("Title", 72, 720, 20), ("Body (one) line", 72, 690, 11), ("and more.", 72, 676, 11)]])
    assert pdf.process(data)["markdown"] == "# Title\n\nBody (one) line and more.\n"
    assert pdf.to_unicode(b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <03> <0062> endbfrange") == {1: "A", 2: "b", 3: "c"}
    assert pdf.glyph("eacute") == "é" and pdf.glyph("uni20AC") == "€" and pdf.glyph("one") == "1" and pdf.glyph("a.alt") == "a"
    with pytest.raises(model.ConvertError):
        pdf.process(b"<html>")
    grid = pdf.ruled_table([pdf.TextItem(t, x, y, 8, 10, "F", 1) for t, x, y in (("a", 15, 85), ("b", 65, 85), ("c", 15, 65), ("d", 65, 65))], [(10, y, 110, y) for y in (60, 80, 100)] + [(x, 60, x, 100) for x in (10, 60, 110)])
    assert grid[0] == [["a", "b"], ["c", "d"]]


def test_faults_have_codes(spark):
    deep = b"<a>" * 300 + b"</a>" * 300
    rows = [(1, "a.docx", b""), (2, "a.docx", b"PK\x03\x04junk"), (3, "b.xyz", b"x"), (4, "c.png", b"x"), (5, "d.docx", package.OLE + b"x"), (6, "e.txt", b"ok"), (7, "f.docx", docx_of("<w:p/>").replace(b"word/document.xml", b"word/documenu.xml")), (8, None, None), (9, "g.txt", b"\xff")]
    df = spark.createDataFrame(rows, "doc_id int, file_name string, data binary")
    got = {r["doc_id"]: r["error_code"] for r in convert.convert(df).collect()}
    assert got == {1: "malformed", 2: "malformed", 3: "unsupported", 4: "PROVIDER_REQUIRED", 5: "encrypted", 6: None, 7: got[7], 8: "io", 9: "malformed"}
    assert got[7] in ("missingPart", "malformed")
    with pytest.raises(model.ConvertError) as e:
        package.parse_xml(deep)
    assert e.value.code == "resourceLimit"
    assert convert.convert(df.limit(0)).count() == 0


def test_stream_converts_each_file_once(spark, tmp_path):
    from quirel.streaming.files import convert_stream

    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    (src / "a.csv").write_bytes(b"x,y\n1,2\n")
    convert_stream(spark, str(src), out, cp).awaitTermination(60)
    (src / "b.html").write_bytes(b"<p>hi")
    convert_stream(spark, str(src), out, cp).awaitTermination(60)
    assert sorted(r["markdown"] for r in spark.read.parquet(out).collect()) == ["hi\n", "| x | y |\n| --- | --- |\n| 1 | 2 |\n"]


@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), max_size=4), max_size=5))
@settings(max_examples=60, deadline=None)
def test_grid_has_every_place_once(rows):
    g = model.GridBuilder()
    for r in rows:
        g.add_row([model.cell("x", a, b) for a, b in r])
    grid = g.finish()
    assert len({len(r) for r in grid}) <= 1
    seen = {}
    for i, r in enumerate(grid):
        for j, c in enumerate(r):
            if c is not None:
                for a in range(c.rows):
                    for b in range(c.cols):
                        if i + a < len(grid):
                            assert (i + a, j + b) not in seen
                            seen[i + a, j + b] = True
    assert all((i, j) in seen for i, r in enumerate(grid) for j, _ in enumerate(r))


@given(st.text(alphabet="ab *_`#-+>[]|\\1.)<&;\n", max_size=30))
@settings(max_examples=60, deadline=None)
def test_escaping_never_makes_blocks(s):
    out = render.to_markdown(model.Document([model.para(s.replace("\n", " "))]))
    assert not out.startswith(("# ", "- ", "+ ", "> ")) and not __import__("re").match(r"\d+[.)] ", out)


def test_web_helpers():
    assert web.Sheet.declarations("font-weight: BOLD !important; x") == {"font-weight": ("bold", True)}
    assert office.hyperlink(r'HYPERLINK \l "b" \o "tip"') == "#b"
    assert package.resolve("a/b/c.xml", "../d%20e.xml#f") == "a/d e.xml"
    assert model.number_label("roman", 14) == "xiv." and model.number_label("Alpha", 28) == "AB."
