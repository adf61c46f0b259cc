"""Reading order, columns, letter spacing, headings over several lines, scripts from right to left; checks of names and values."""

from pyspark.sql import functions as F

from quirel.functions import checks as K
from quirel.operators import flow as W


def it(text, x, y, width=None, size=10.0, **kw):
    return {"text": text, "x": float(x), "y": float(y), "width": float(width if width is not None else 5 * len(text)), "font_size": size, **kw}


def ln(text, y, size=10.0, bold=False, x=50.0):
    return {"text": text, "x": x, "y": float(y), "font_size": size, "bold": bold}


def two_columns(n, text="some words of a line"):
    return [it(text, x, 700 - 14 * k, 200) for x in (50, 330) for k in range(n)]


def test_a_full_width_item_parts_the_columns_above_and_below():
    items = two_columns(6) + [it("a caption over the whole width of the page", 50, 600, 480)] + [{**t, "y": t["y"] - 130} for t in two_columns(4)]
    got = W.regions(items)
    assert [len(r) for r in got] == [6, 6, 1, 4, 4] and [items[r[0]]["x"] for r in got] == [50, 330, 50, 50, 330]
    assert [len(r) for r in W.regions(two_columns(2))] == [4] and W.regions([]) == []
    figures = [it(str(k), x, 700 - 14 * k) for x in (50, 330) for k in range(8)]
    assert len(W.regions(figures)) == 1


def test_gutters_and_sides():
    assert W.xy_cut(two_columns(12)) == 290.0 and W.xy_cut(two_columns(3)) is None
    assert 320 <= W.side_by_side(two_columns(22)) <= 330
    assert W.side_by_side([it("label", 50, 700 - 14 * k, 200) for k in range(22)] + [it("1,200", 330, 700 - 14 * k, 200) for k in range(22)]) is None
    assert W.relative_valleys([0, 0, 9, 9, 9, 1, 1, 9, 9, 9, 0, 0], 2) == [(5, 7)]
    assert W.columns_at(two_columns(8), [(250, 330)]) == [(50, 290.0), (290.0, 530.0)] and len(W.columns_at(two_columns(2), [(250, 330)])) == 1
    assert W.have_prose([(50, 290), (290, 530)], two_columns(8)) and not W.have_prose([(50, 290), (290, 530)], two_columns(8, "1.5"))
    assert W.hint_bands(two_columns(12), [(45, 0, 255, 800), (325, 0, 535, 800)]) == [(50.0, 290.0), (290.0, 530.0)]


def test_newspapers():
    lines = [700 - 14 * k for k in range(20)]
    assert W.is_newspaper([lines, lines[:16]], [200, 200]) and not W.is_newspaper([lines, lines[:4]], [200, 200])
    assert W.is_newspaper([lines + [400 - 14 * k for k in range(10)], [700 - 40 * k for k in range(6)]], [300, 100])
    assert not W.is_newspaper([lines, [700 - 14 * k for k in range(8)]], [200, 200])
    assert W.stream_is_order(two_columns(8)) and not W.stream_is_order([it("x", 0, y) for y in (1, 99, 2, 99, 3, 99)])


def test_letter_spacing():
    items = [it("m i l l", 50 + 60 * k, 700, 35) for k in range(6)]
    got, limit = W.fix_letterspacing(items)
    assert {t["text"] for t in got} == {"mill"} and 0.05 <= limit <= 2
    chars = [it(c, 50 + 16 * k + (20 if k >= 6 else 0), 700, 10) for k, c in enumerate("orchardbakery")]
    assert 0.6 < W.fix_letterspacing(chars)[1] < 2.6
    assert W.fix_letterspacing([it("plain", 0, 0)]) == ([it("plain", 0, 0)], 0.10)
    assert W.two_classes([1, 1, 1, 9, 9]) == 5 and W.two_classes([2, 2]) is None


def test_scripts_from_right_to_left(spark):
    assert W.reverse_visual("םולש") == "שלום" and W.reverse_visual("םולש 12.5") == "12.5 שלום" and W.reverse_visual("") == ""
    got = W.visual_order(spark.createDataFrame([("םולש",), (None,)], "text string")).collect()
    assert [r["logical_text"] for r in got] == ["שלום", None]


def test_headings_over_lines():
    assert W.merge_drop_caps([ln("T", 700, 30), ln("he mill", 698)])[0]["text"] == "The mill" and len(W.merge_drop_caps([ln("T", 700, 30), ln("He mill", 698)])) == 2
    assert [x["text"] for x in W.merge_headings([ln("The report of", 700, 16), ln("the council", 682, 16), ln("body", 660)], 10)] == ["The report of the council", "body"]
    bold = [ln("This is a bold paragraph that goes on", 700, bold=True), ln("over two lines. And it has sentences.", 688, bold=True), ln("plain", 660)]
    assert W.bold_paragraph_lines(bold, 10, 15) == {0, 1} and len(W.merge_bold_headings(bold, 10, 15)) == 3
    assert W.merge_bold_headings([ln("A bold heading", 700, bold=True), ln("over two lines", 688, bold=True)], 10, 15)[0]["text"] == "A bold heading over two lines"
    assert W.is_fragment("x = y + 2") and W.is_fragment("and then of") and W.is_fragment("12 34") and not W.is_fragment("Report of the Council")
    assert W.heading_sequences(["1. Mill", "text", "1.1 Ferry", "1.2 Orchard", "2. Bakery", "9. odd", "I. x"]) == [(0, "decimal", 1), (2, "decimal", 2), (3, "decimal", 2), (4, "decimal", 1)]
    assert W.folio_items([[(20, 7), (700, None)], [(21, 8), (700, 3)], [(400, 9)]]) == [{0}, {0}, set()]


def test_marks_and_small_items():
    assert W.formatted(" a ", bold=True, italic=True) == " ***a*** " and W.formatted("a", bold=True, underline=True) == "<u>a</u>" and W.formatted("a", underline=True, strike=True) == "~~a~~" and W.formatted("  ") == "  "
    assert W.formatted("a", bold=True, options=W.MarkdownOptions(bold=False)) == "a"
    assert [t["text"] for t in W.merge_subscripts([it("H", 50, 700, 6), it("2", 56, 697, 3, 6.0), it("O", 60, 700, 6)])] == ["H2", "O"]
    assert [t["is_underline"] for t in W.drop_table_underlines([it("a", 60, 690, is_underline=True), it("b", 60, 100, is_underline=True)], [(50, 680, 200, 720)])] == [False, True]
    assert W.image_box((0, 10, -20, 0, 100, 100)) == (80, 100, 100, 110)


def test_fragments_of_headings(spark):
    df = spark.createDataFrame([("Report",), ("x = 1",), (None,), ("",)], "text string")
    assert [r["fragment"] for r in W.heading_fragments(df).collect()] == [False, True, None, True]


def test_checks(spark):
    rows = [("a/b.pdf",), ("a/..",), ("x\x00y",), ("/",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(K.safe_file_name(F.col("s"))).collect()]
    assert got == ["b.pdf", None, None, None, None]
    paths = [("/tmp/a",), ("/tmp/../etc",), ("/knowledge",), ("tmp",), ("/workspacex",)]
    ok = spark.createDataFrame(paths, "s string").select(K.guest_path_ok(F.col("s"), False), K.guest_path_ok(F.col("s"), True)).collect()
    assert [tuple(r) for r in ok] == [(True, True), (False, False), (True, False), (False, False), (False, False)]
    depth = [r[0] for r in spark.createDataFrame([("1",), ('{"a":[1,{"b":"]]}"}]}',), ('"\\"[["',), (None,)], "j string").select(K.json_depth(F.col("j"))).collect()]
    assert depth == [0, 3, 0, None]


def test_addresses_and_ids(spark):
    rows = [("::1", True), ("::", True), ("fd12::1", True), ("fe80::1", True), ("::ffff:10.0.0.1", True), ("::ffff:93.184.216.34", False), ("2606:2800:220:1::1", False), ("0:0:0:0:0:0:0:1", True), ("10.0.0.1", None), (None, None)]
    got = spark.createDataFrame(rows, "ip string, want boolean").select("ip", "want", K.blocked_ipv6(F.col("ip")).alias("got"), K.new_id("run").alias("id")).collect()
    assert [r["got"] for r in got] == [w for _, w in rows], [(r["ip"], r["got"]) for r in got]
    assert len({r["id"] for r in got}) == len(rows) and all(r["id"].startswith("run_") for r in got)
