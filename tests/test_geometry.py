"""Geometric steps and scalar functions against plain Python."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirel.functions import labels as L
from quirel.functions import text as T
from quirel.operators import geometry as G
from quirel.sources.model import number_label


def it(text, x, y, width=None, size=10.0, **more):
    return {"text": text, "x": x, "y": y, "width": width if width is not None else 5.0 * len(text), "font_size": size, **more}


def test_merge_and_rows_and_columns():
    got = G.merge_items([it("wor", 10, 100), it("ld", 25, 101), it("far", 100, 100), it("bold", 36.5, 100, is_bold=True)])
    assert [t["text"] for t in got] == ["world", "bold", "far"]
    assert G.merge_items([it("a", 0, 0), it("b", 7, 0)])[0]["text"] == "a b"
    assert G.row_places([100, 99, 80, 60.5, 60], [10] * 5) == [99.5, 80, 60.25]
    assert G.column_places([10, 12, 100, 101, 200]) == [10, 100, 200]
    assert G.snap_edges([1, 2, 10], 3) == [1.5, 10] and G.merge_intervals([(0, 2), (2.5, 4), (9, 10)]) == [(0, 4), (9, 10)]


def test_tables_and_structure():
    rows = [["Name", "One", "Two"], ["alpha", "10", "20"], ["beta", "30", "4.5%"], ["gamma", "1", "2"]]
    items = [it(c, 10 + 90 * j, 200 - 15 * i) for i, r in enumerate(rows) for j, c in enumerate(r)]
    assert G.borderless_table(items, 12.0) == rows and G.borderless_table(items[:4], 12.0) is None
    assert G.table_markdown(rows[:2]) == "|Name|One|Two|\n|---|---|---|\n|alpha|10|20|"
    assert G.table_markdown([["Intro ....", "1"], ["More", "4"], ["End", "9"]]) == "Intro 1\nMore 4\nEnd 9"
    assert G.clean_cells([["h", "i"], ["a", "b"], ["", "more text"], ["", ""], ["(1) note", ""]]) == ([["h", "i"], ["a", "b more text"]], ["(1) note"])
    toks = ["<thead>", "<tr>", "<td", ' colspan="2"', ">", "</td>", "</tr>", "</thead>", "<tr>", "<td></td>", "<td></td>", "</tr>"]
    assert G.parse_structure(toks) == [(0, 0, 1, 2, True), (1, 0, 1, 1, False), (1, 1, 1, 1, False)]
    assert G.fill_cells([(0, 0, 50, 20), (50, 0, 100, 20)], [it("in", 5, 5, 10), it("near", 101, 5, 10)]) == ["in", "near"]
    cols = G.page_columns([it("x" * 10, 50 + 250 * (k % 2), 700 - 10 * k, 150) for k in range(40)])
    assert len(cols) == 2 and G.page_columns([]) == []


def test_structure_cells():
    cells = [{"row": 0, "col": 0, "box": (0, 0, 12, 10), "text": "a"}, {"row": 0, "col": 1, "box": (10, 0, 20, 11), "text": "b"}, {"row": 1, "col": 0, "box": (0, 9, 10, 20), "text": "c"}]
    got = {(c["row"], c["col"]): c["box"] for c in G.normalize_bands(cells)}
    assert got[0, 0] == (0, 0, 11.0, 10.0) and got[0, 1] == (11.0, 0, 20, 10.0) and got[1, 0] == (0, 10.0, 10, 20)
    assert G.cells_markdown(cells) == "|a|b|\n|---|---|\n|c||" and G.cells_markdown([]) == ""
    assert G.quality_issue([["a"], [""], ["b"]]) == "phantom_empty_row" and G.quality_issue([["a\nb", "c\nd"]]) == "multi_row_in_cell" and G.quality_issue([["a", "b"]]) is None
    assert G.best_candidate([("rects", [["a", ""], ["", "b"]]), ("lines", [["a", "b"], ["c", "d"]]), ("bad", [["a"], [""], ["b"]])])[0] == "lines" and G.best_candidate([]) is None


@given(st.lists(st.tuples(*[st.integers(0, 60)] * 4).map(lambda r: (min(r[0], r[2]), min(r[1], r[3]), max(r[0], r[2]), max(r[1], r[3]))), max_size=14))
@settings(max_examples=60, deadline=None)
def test_clusters_against_brute_force(rects):
    touch = lambda a, b: a[0] - 3 <= b[2] and b[0] - 3 <= a[2] and a[1] - 3 <= b[3] and b[1] - 3 <= a[3]
    left, want = set(range(len(rects))), []
    while left:
        group, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i not in group:
                group.add(i)
                todo += [j for j in left if touch(rects[i], rects[j])]
        left -= group
        want.append(sorted(group))
    assert sorted(map(sorted, G.clusters(rects))) == sorted(want)


def test_numerals_and_hashes(spark):
    df = spark.range(0, 4000).select(F.col("id").alias("n"), T.roman(F.col("id")).alias("r"), T.alpha(F.col("id")).alias("a"))
    for r in df.withColumn("v", L.roman_value(F.col("r"))).collect():
        if 0 < r["n"] < 4000:
            assert r["r"] == number_label("Roman", r["n"])[:-1]
            assert r["v"] == (r["n"] if len(r["r"]) <= 8 else None)
        if 0 < r["n"] <= 702:
            assert r["a"] == number_label("alpha", r["n"])[:-1]
    rows = spark.createDataFrame([("sandbox",), ("é",), ("",), (None,)], "s string").select("s", L.hash31(F.col("s")).alias("h")).collect()
    for s, h in rows:
        if s:
            v = 0
            for b in s.encode():
                v = (v * 31 + b) % 2**32
            assert h == 3 + v % (2**32 - 4)
    b = spark.range(1).select(L.box_of(F.array(*map(F.lit, [1.0, 2.0, 5.0, 1.0, 6.0, 7.0, 0.0, 3.0]))).alias("b"), L.pixels_to_points(F.array(*map(F.lit, [144.0, 0.0, 288.0, 72.0])), F.lit(144.0), F.lit(1.0), F.lit(2.0)).alias("p"), L.format_urls(F.lit("see http://x.invalid/a, [b](http://y.invalid)")).alias("u")).first()
    assert b["b"] == [0.0, 1.0, 6.0, 7.0] and b["p"] == [73.0, 2.0, 145.0, 38.0]
    assert b["u"] == "see [http://x.invalid/a](http://x.invalid/a), [b](http://y.invalid)"
