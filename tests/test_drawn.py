"""Detectors of drawn tables, charts and edit bands; tagged tables, links and fields of PDFs."""

from quirel.operators import drawn as D
from quirel.plans.pdf_queries import tagged_pdf
from quirel.sources import pdf, tagged


def it(text, x, y, width=None, size=10.0, **kw):
    return {"text": text, "x": float(x), "y": float(y), "width": float(width if width is not None else 5 * len(text)), "font_size": size, **kw}


def grid(n, m, left=50, top=500, wide=80, high=20):
    return [it(f"r{i}c{j}", left + wide * j + 5, top - high * i - 14) for i in range(n) for j in range(m)]


def cells(n, m, left=50, top=500, wide=80, high=20):
    return [(left + wide * j, top - high * (i + 1), left + wide * (j + 1), top - high * i) for i in range(n) for j in range(m)]


def test_uniform_cells_are_no_chart_and_bars_are():
    items, rects = grid(4, 3), cells(4, 3)
    assert D.chart_regions(items, rects) == []
    found, hints = D.rect_tables(items, [*rects, *rects])
    assert [(t.detector, len(t.rows), len(t.rows[0])) for t in found] == [("rects", 4, 3)] and hints == []
    bars = [(100 + 30 * k, 100, 115 + 30 * k, 150 + h) for k, h in enumerate((10, 60, 35, 90, 20))]
    assert D.chart_regions([], bars) == [(100, 100, 235, 240)]
    assert D.rect_tables(grid(2, 2, 100, 300), bars)[0] == []


def test_variable_heights_are_a_grid_and_merged_cells_repeat():
    ys = [500, 470, 455, 400, 380]
    rects = [(50 + 80 * j, b, 130 + 80 * j, a) for a, b in zip(ys, ys[1:]) for j in range(1, 3)] + [(50, 455, 130, 500), (50, 400, 130, 455), (50, 380, 130, 400)]
    items = [it("both", 60, 480), *[it(f"v{i}{j}", 60 + 80 * j, (a + b) / 2 - 3) for i, (a, b) in enumerate(zip(ys, ys[1:])) for j in (1, 2)], it("third", 60, 430), it("last", 60, 387)]
    t = D.rect_tables(items, rects)[0][0]
    assert [r[0] for r in t.rows] == ["both", "both", "third", "last"]


def test_rules_open_edges_and_dense_rows():
    items = grid(4, 3)
    level = [(50, 500 - 20 * i, 290, 500 - 20 * i) for i in range(5)]
    inner = [(x, 420, x, 500) for x in (130, 210)]
    assert D.line_grid(items, level + inner).detector == "open_edges"
    assert D.line_grid(items, level + inner + [(50, 420, 50, 500), (290, 420, 290, 500)]).detector == "rules"
    assert D.line_grid(items, level) is None and [len(r) for r in D.dense_row_table(items, level).rows] == [3] * 4
    three = [level[0], level[1], level[4]]
    t = D.anchor_rule_table(items, three)
    assert t.rows[0] == ["r0c0", "r0c1", "r0c2"] and len(t.rows) == 4
    assert D.split_rules([(0, 5, 50, 5), (50, 5, 90, 5), (3, 3, 3, 3)]) == ([(0, 90, 5.0)], [])


def test_stripes_boxes_and_hints():
    items = grid(6, 3, wide=100)
    stripes = [(50, 500 - 20 * (i + 1), 350, 500 - 20 * i) for i in (1, 3, 5)]
    assert D.stripe_table(items, stripes).rows == [[f"r{i}c{j}" for j in range(3)] for i in range(6)]
    boxes = [(b[0] + 4, b[1] + 3, b[2] - 4, b[3] - 1) for b in cells(3, 2, wide=120, high=40)]
    assert D.box_table(grid(3, 2, wide=120, high=40), boxes).detector == "boxes"
    assert D.merge_hints([(0, 0, 50, 100), (60, 10, 90, 90), (300, 0, 350, 100), (0, 200, 50, 300)]) == [(0, 200, 50, 300), (0, 0, 90, 100), (300, 0, 350, 100)]


def test_plots_and_edit_bands():
    zigzag = [(100 + 5 * k, 100 + 20 * (k % 2), 105 + 5 * k, 120 - 20 * (k % 2)) for k in range(24)]
    assert D.line_chart_regions(zigzag) == [(100, 100, 220, 120)] and D.line_chart_regions([(0, 10 * k, 90, 10 * k) for k in range(30)]) == []
    items = [it("plain text here", 50, 700), it("old words", 50, 680, is_strikeout=True), it("new words", 120, 680, is_underline=True), it("more", 50, 640)]
    assert D.redline_regions(items, 600.0) == [(0.0, 677.0, 600.0, 690.0)]


def test_text_only_steps():
    kv = [it("Name:", 50, 700), it("Orchard", 150, 700), it("Place:", 50, 680), it("Mill", 150, 680), it("Year:", 50, 660), it("1890", 150, 660), it("prose", 50, 500)]
    assert D.key_value_table(kv).rows == [["Name:", "Orchard"], ["Place:", "Mill"], ["Year:", "1890"]]
    assert D.column_table(grid(5, 3), [(50, 130), (130, 210), (210, 290)]).rows[2] == ["r2c0", "r2c1", "r2c2"]
    assert D.table_regions(grid(3, 2) + grid(1, 2, top=200)) == [(441.0, 491.0)] and D.table_regions([]) == []
    assert len(D.strict_regions(grid(4, 3) + [it("a long line of text", 50, 300)])) == 1
    assert D.table_like([["a", "b"], ["1", "2"]], True) and not D.table_like([["a", "b"], ["a long run of words goes on", "and on it goes for ever more"]], True)
    assert D.page_number_toc([["The mill", "3"], ["The ferry", "9"], ["Index", "12"]]) and not D.page_number_toc([["a", "3"]])
    assert D.tabular_toc([["1", "Mill", "3"], ["1.2", "Ferry", "9"], ["II.", "Index", "12"]])
    assert D.parallel_prose([["Wenn der Hafen nicht bald sicher wird, muss die Schule schließen.", "If the harbour is not safe soon, the school must be closed."]] * 2)
    assert D.financial_values("$ 5,147 (3.2) — 12%") == ["$ 5,147", "(3.2)", "—", "12%"] and D.financial_values("Land $ 7") is None and D.financial_values("$") is None
    assert [t["text"] for t in D.expand_values([it("1 2 3", 0, 0, 300), it("1 2 3", 0, 0, 30)])] == ["1", "2", "3", "1 2 3"]
    assert [(t["text"], t["x"]) for t in D.split_numbers(it("10 11 12", 50, 0, 200), [50, 120, 190, 400])] == [("10", 50), ("11", 120), ("12", 190)] and len(D.split_numbers(it("a b", 0, 0), [0, 5])) == 1
    out, made = D.merge_preserving([it("a", 0, 0, 5), it("b", 5, 0, 5), it("c", 10, 0, 5)], {2})
    assert [t["text"] for t in out] == ["ab", "c"] and made == [[0, 1], [2]]
    assert D.first_table_row([["Form 7", "", ""], ["", "", ""], ["a", "b", "c"], ["1", "2", "3"]]) == 2 and D.first_table_row([]) == 0


def test_header_and_labels_are_recovered():
    small = [it(f"{i}{j}", 150 + 60 * j, 480 - 12 * i, size=7.0) for i in range(3) for j in range(3)]
    head = [it(h, 150 + 60 * j, 495) for j, h in enumerate(("A", "B", "C"))]
    t = D.Table([[f"{i}{j}" for j in range(3)] for i in range(3)], set(range(9)), 480.0, "x")
    assert D.recover_header(t, small + head, 9.0).rows[0] == ["A", "B", "C"]
    labels = [it(f"row {i}", 50, 480 - 12 * i) for i in range(3)]
    assert [r[0] for r in D.add_labels(t, small + labels).rows] == ["row 0", "row 1", "row 2"]


def test_tagged_tables_links_and_fields():
    data = tagged_pdf([["a", "b"], ["1", "2"], ["3", "4"]], True, "http://x.invalid/1", ("name", "v"))
    p = pdf.Pdf(data)
    nodes = tagged.structure(p)
    assert [n.role for n in nodes][:3] == ["Table", "TR", "TH"] and nodes[0].alt == "orders" and nodes[2].content == [(0, 1)]
    page = pdf.read_page(p, p.pages[0], 1)
    assert tagged.tables_of_page(page.items, tagged.tagged_tables(nodes), 1)[0][0] == [["a", "b"], ["1", "2"], ["3", "4"]]
    for t in page.items[1:]:
        t.mcid = None
    assert tagged.tables_of_page(page.items, tagged.tagged_tables(nodes), 1) == []
    assert tagged.links(p) == [(1, 50.0, 10.0, 200.0, 20.0, "http://x.invalid/1")] and tagged.form_fields(p) == [("name", "Tx", 1, "v")]
    assert pdf.process(data)["markdown"] == "|a|b|\n|---|---|\n|1|2|\n|3|4|\n"
    assert tagged.mapped_role("a", {"a": "b", "b": "a"}) == "a" and tagged.decode_text(b"\xfe\xff\x00A") == "A" and tagged.decode_text(b"\xe9") == "é"
    assert tagged.repair_names(b"StructTreeRoot /S P /S /H1 /S\nTD>") == b"StructTreeRoot /S /P /S /H1 /S\n/TD>"


def test_structure_cycles_end():
    data = b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R/StructTreeRoot 3 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[]/Count 0>>\nendobj\n3 0 obj\n<</K 4 0 R>>\nendobj\n4 0 obj\n<</S/Sect/K[5 0 R]>>\nendobj\n5 0 obj\n<</S/P/K[4 0 R 5 0 R 7]>>\nendobj\ntrailer<</Root 1 0 R>>"
    assert [n.role for n in tagged.structure(pdf.Pdf(data))] == ["Sect", "P"]
