"""Pages of one layout share a run of the cascade: the same tables as page by page, whatever the texts, and no more runs than layouts."""

import random

import pyarrow as pa
import pytest
from test_drawn import cells, grid, it

from quirel.operators import drawn as D
from quirel.operators.geometry import exact_mean, mean, table_markdown
from quirel.plans import pdf_queries as Q


def batch(pages):
    """Pages (items, rects, rules) as a batch."""
    item = pa.struct([("text", pa.string()), *((k, pa.float64()) for k in ("x", "y", "width", "font_size")), ("is_underline", pa.bool_()), ("is_strikeout", pa.bool_())])
    box = pa.list_(pa.struct([(k, pa.float64()) for k in ("x1", "y1", "x2", "y2")]))
    boxes = lambda i: pa.array([[dict(zip(("x1", "y1", "x2", "y2"), map(float, r))) for r in p[i]] for p in pages], box)
    return pa.RecordBatch.from_arrays([pa.array([[{"is_underline": None, "is_strikeout": None} | t for t in p[0]] for p in pages], pa.list_(item)), boxes(1), boxes(2)], ["its", "rects", "rules"])


def alone(pages):
    return [(p, n, t.detector, len(t.rows), len(t.rows[0]), table_markdown(t.rows)) for p, page in enumerate(pages) for n, t in enumerate(D.page_tables(*page), 1)]


def drawings():
    """Items' places with rectangles and rules that each detector takes."""
    level = [(50, 500 - 20 * i, 290, 500 - 20 * i) for i in range(6)]
    upright = [(x, 400, x, 500) for x in (50, 130, 210, 290)]
    merged = [(130 + 80 * j, 480 - 20 * i, 210 + 80 * j, 500 - 20 * i) for i in range(5) for j in (0, 1)] + [(50, 460, 130, 500), (50, 400, 130, 460)]
    bars = [(100 + 30 * k, 100, 115 + 30 * k, 150 + h) for k, h in enumerate((10, 60, 35, 90, 20))]
    out = [([], level + upright), ([], level + upright[1:3]), (cells(5, 3), []), (merged, []), ([], level), ([], [level[0], level[1], level[5]]), ([(50, 500 - 20 * (i + 1), 290, 500 - 20 * i) for i in (0, 2, 4)], []), (bars, level), ([], [])]
    return [([tuple(map(float, r)) for r in rects], [tuple(map(float, r)) for r in rules]) for rects, rules in out]


def test_shared_layouts_give_what_single_pages_give():
    rnd, pages = random.Random(5), []
    words = ["mill", "P12", "7", "12", "3.5", "a b", "Name:", "a|b", "(1)", "1) note", "Note: so", " ", "", " x ", "é", "{0}", "100%", "the same", "long text that goes on", "٣", "—"]
    for k in range(3000):
        items = grid(5, 3)
        some = rnd.sample(words, rnd.choice((1, 3, len(words))))
        for t in items:
            if rnd.random() < 0.7:
                t["text"] = rnd.choice(some)
        if k % 3 == 0:  # texts that end no row with figures, so that most share
            for i, t in enumerate(items):
                t["text"] = f"w{rnd.randrange(100)}" if i % 3 else str(i)
        items = [t for t in items if rnd.random() < rnd.choice((1, 1, 0.8))]
        if k % 50 == 0:
            items += [it("more", 60, 486), it("out", 60, 300, is_strikeout=True)]
        pages.append((items, *rnd.choice(drawings())))
    want = alone(pages)
    assert {r[2] for r in want} >= {"rules", "open_edges", "rects", "dense_row", "anchor_rules", "stripes", "key_values"}
    D._layouts.clear()
    b = batch(pages)
    assert list(D.batch_tables(b)) == want
    assert list(D.batch_tables(b.slice(1000, 500))) == [(p - 1000, *r) for p, *r in want if 1000 <= p < 1500]
    assert list(D.batch_tables(b.slice(0, 0))) == [] and any(D._layouts.values())


@pytest.mark.parametrize("k", range(3))
def test_a_layout_is_searched_once(monkeypatch, k):
    pages = [([t | {"text": f"w{i}x{j}"[:5].ljust(5, "z")} for j, t in enumerate(grid(5, 3))], *drawings()[k]) for i in range(100)]
    pages = [([t | {"width": 25.0} for t in items], *d) for items, *d in pages]
    want, runs, run = alone(pages), [], D.page_tables
    monkeypatch.setattr(D, "page_tables", lambda *a: runs.append(1) or run(*a))
    D._layouts.clear()
    assert list(D.batch_tables(batch(pages))) == want and len(want) == 100 and len(runs) == 1


def test_layouts_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(D, "LAYOUTS_MAX", 3)
    pages = [([t | {"width": 20.0 + i} for t in grid(5, 3)], *drawings()[0]) for i in range(10)]
    D._layouts.clear()
    assert list(D.batch_tables(batch(pages))) == alone(pages) and len(D._layouts) <= 3


def test_means_are_exact():
    rnd = random.Random(3)
    for _ in range(2000):
        v = [rnd.choice((0.1, rnd.random() * 1e3, -7.3, 1e-9)) for _ in range(rnd.choice((1, 2, 2, 3, 7)))]
        assert mean(v) == exact_mean(v)
    assert mean([1, 2]) == 1.5 and mean(x for x in (1, 2, 6)) == 3


def test_pages_made_of_lines_are_those_of_the_tables(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(k, rnd.choice((None, 5, 1234567)) if rnd.random() < 0.1 else rnd.randrange(10**6), rnd.choice((i, 1, 11)), rnd.choice("ANR"), rnd.choice("OF")) for k in [*range(-30, 200), None] for i in range(1, 1 + (60 if k is None or k == 7 else rnd.randrange(1, 12)))]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(map(tuple, D.drawn_tables(*Q._order_pages(spark, str(tmp_path))).collect()))
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = Q.drawn_tables(spark, str(tmp_path))
            assert got.columns == ["result_id", "page_no", "table_no", "detector", "n_rows", "n_cols", "markdown"] and sorted(map(tuple, got.collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) > 200
