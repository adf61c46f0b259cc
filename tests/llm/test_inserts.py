"""Passages in lines that are set in, in market lists and on slanted scans."""

from quirel.llm import leakage, reading

BOX = "array<struct<line_no:int,x:int,y:int,w:int,h:int,conf:float>>"
ITEM = "Mrs Denmerbur was asked why the quarry of Wythdungar is still quiet and answered that the bakery of Bramstandun would be measured in the spring"


def page(lines, xs):
    return "\n".join(lines), [(i + 1, x, 100 + 25 * i, 9 * len(s), 20, 0.9) for i, (s, x) in enumerate(zip(lines, xs))]


def test_leaks_in_set_in_lines(spark):
    w = ITEM.split()
    part = [" ".join(w[k : k + 6]) for k in range(0, 24, 6)]
    around = ["Alderman Number said that the ferry was late", "and nothing more was said about it"]
    advert = page([around[0], *part, around[1]], [100, 130, 130, 130, 130, 100])
    slanted = page(part, [100, 112, 124, 136])
    strayed = page([around[0], *part], [60, 100, 100, 100, 100])
    market = page(["water tower......8884", *part[:2], "river bank......7296", *part[2:]], [100] * 6)
    docs = spark.createDataFrame([(1, *advert), (2, *slanted), (3, *strayed), (4, *market)], f"doc_id int, text string, line_boxes {BOX}")
    items = spark.createDataFrame([(7, ITEM)], "item_id int, text string")
    got = [(r["id"], r["item_id"]) for r in leakage.leaks(docs, items).collect()]
    assert sorted(got) == [(1, 7), (2, 7), (3, 7), (4, 7)]


def test_margin_is_the_usual_edge():
    lines = reading.page_lines("a\nb\nc\nd", [60, 100, 100, 130], [1, 2, 3, 4], [9] * 4, True)
    assert lines == [("a", False), ("b", False), ("c", False), ("d", True)]
