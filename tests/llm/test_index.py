"""The positional index of problem 6: longest passages, several passages, exact and proximity matches, short items, parts of long lists."""

from test_inserts import BOX, ITEM, page

from quirel.llm import leakage

WORDS = ITEM.split()


def leaks(spark, texts, items=((7, ITEM),), **kw):
    docs = spark.createDataFrame([(i, *page(t.split("\n"), [100] * len(t.split("\n")))) for i, t in texts.items()], f"doc_id int, text string, line_boxes {BOX}")
    return {(r["id"], r["item_id"]): r for r in leakage.leaks(docs, spark.createDataFrame(list(items), "item_id int, text string"), **kw).collect()}


def test_longest_passage_counts(spark):
    part = " ".join(WORDS[:20])
    other = "\n".join(["then something else was said about other matters by the council of the town and nobody knew why"] * 5)
    got = leaks(spark, {1: f"{part}\n{other}\n{ITEM}", 2: ITEM.replace("quarry", "quarrv"), 3: f"{ITEM} {' '.join(WORDS[:10])}"})
    assert got[1, 7]["n_words"] == len(WORDS) and got[1, 7]["exact"] and got[1, 7]["passages"] == 2
    assert got[2, 7]["n_words"] == len(WORDS) and not got[2, 7]["exact"]
    assert got[3, 7]["n_words"] == len(WORDS) and got[3, 7]["passages"] == 1


def test_parts_of_long_lists_and_frequent_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "LIST", 3)
    got = leaks(spark, {i: ITEM if i % 2 else "nothing of interest was said by anyone in the town" for i in range(40)})
    assert {k for k, _ in got} == set(range(1, 40, 2))


def test_passage_with_only_its_anchors_on_a_third_of_pages(spark):
    """However many pages an item leaked to, and however common its terms, it is found on each of them."""
    part = " ".join(WORDS[2:22])
    got = leaks(spark, {i: part if i % 3 == 0 else f"asked why the quarry of the bakery {i} is still measured in the spring" for i in range(60)})
    assert {k for k, _ in got} == set(range(0, 60, 3))


def test_shorter_least_passage_and_short_items(spark):
    short = " ".join(WORDS[4:14])
    got = leaks(spark, {1: ITEM, 2: " ".join(WORDS[:6])}, [(8, short)], least=9)
    assert set(got) == {(1, 8)} and got[1, 8]["n_words"] == 10


def test_shuffled_meetings(spark, monkeypatch):
    monkeypatch.setattr(leakage, "NARROW", 0)
    assert set(leaks(spark, {1: ITEM, 2: "nothing"})) == {(1, 7)}
