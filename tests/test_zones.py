"""Tables in regions, structures of a recognizer filled, expanded or replaced by the page's own table."""

from test_drawn import cells, grid, it

from quirel.operators import zones as Z


def test_regions_are_tried_by_rectangles_rules_and_text():
    items = grid(4, 3) + [it("prose below the table", 50, 300)]
    rules = [(50, 500 - 20 * i, 290, 500 - 20 * i) for i in range(5)] + [(x, 420, x, 500) for x in (50, 130, 210, 290)]
    want = "|r0c0|r0c1|r0c2|\n|---|---|---|\n|r1c0|r1c1|r1c2|\n|r2c0|r2c1|r2c2|\n|r3c0|r3c1|r3c2|"
    region, below = (45, 415, 295, 505), (45, 250, 295, 320)
    assert Z.tables_in_regions(items, cells(4, 3), [], [region, below]) == [(want, "rects"), ("", None)]
    assert Z.tables_in_regions(items, [], rules, [region]) == [(want, "rules")]
    figures = [it(str(10 * i + j) if i else f"h{j}", 50 + 80 * j, 486 - 20 * i) for i in range(4) for j in range(3)]
    assert Z.tables_in_regions(figures, [], [], [region])[0][1] == "text"


def test_vector_grid_gives_tokens_and_pixels():
    tokens, boxes = Z.vector_grid(cells(2, 2), [], (50, 460, 210, 500), 144.0)
    assert tokens == ["<tr>", "<td></td>", "<td></td>", "</tr>"] * 2 and boxes[0] == (0, 0, 160, 40) and boxes[3] == (160, 40, 320, 80)
    assert Z.vector_grid([], [], (0, 0, 9, 9)) is None
    assert Z.structure_markdown(grid(2, 2), tokens, boxes, 144.0, (50, 500)) == "|r0c0|r0c1|\n|---|---|\n|r1c0|r1c1|"


def test_issues_and_what_is_done_about_them():
    tokens, boxes = Z.vector_grid(cells(2, 2), [], (50, 460, 210, 500))
    crowded = [it(t, x, y) for x in (55, 135) for t, y in (("head", 486), ("one", 473), ("two", 463))]
    got = Z.structure_cells(crowded, tokens, boxes, 72.0, (50, 500))
    assert Z.issue(got, crowded) == Z.CROWDED and Z.issue(Z.structure_cells([], tokens, boxes, 72.0, (50, 500)), []) == Z.NO_TEXT
    md, source, why = Z.structure_auto(crowded, [], [], tokens, boxes, 72.0, (50, 500))
    assert (source, why) == ("expanded", Z.CROWDED) and md.split("\n")[2:] == ["|one|one|", "|two|two|"]
    three, pix = Z.vector_grid(cells(3, 2), [], (50, 440, 210, 500))
    items = [t for t in grid(3, 2) if "r1" not in t["text"]]
    md, source, why = Z.structure_auto(items, cells(1, 2) + cells(1, 2, top=480, high=40), [], three, pix, 72.0, (50, 500))
    assert why == Z.PHANTOM and source == "rects" and md == "|r0c0|r0c1|\n|---|---|\n|r2c0|r2c1|"
    assert Z.structure_auto(grid(2, 2), [], [], tokens, boxes, 72.0, (50, 500))[1:] == ("structure", None)


def test_partial_tables_and_merges():
    assert Z.looks_partial([["a", "b"]]) and Z.looks_partial([["and more", "of it"], ["1", "2"]]) and not Z.looks_partial([["A", "B"], ["1", "2"]])
    assert Z.looks_partial([["A", ""], ["", ""], ["", ""], ["b", ""]]) and not Z.looks_partial([["and", "of"], ["1", "2"]], True)
    assert Z.merged_in_use([(0, 0, 5, 0), (9, 9, 10, 10), (0, 0, 0, 3)], (0, 0, 2, 0)) == [(0, 0, 2, 0)]
    assert Z.data_share([["h"], ["1"], ["x"]]) == 0.5 and Z.data_share([]) == 0.0
