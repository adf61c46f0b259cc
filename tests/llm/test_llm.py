"""The eight problems on small tables made here: brute force, round trips, nulls, empties, repeats and clashing columns."""

import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirel.llm import garbled, language, leakage, mixing, neardup, quality, queries, reading, splitting, unicode_form

CLASH = {"id": 1, "t": "x", "h": 2, "cls": 3, "token": "y", "pos": 4}


def frame(spark, rows, schema):
    """Rows with extra columns of names the operators use inside."""
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    for k, v in CLASH.items():
        if k not in df.columns:
            df = df.withColumn(k, F.lit(v))
    return df


# Problem 1


def test_kinds_of_examples_and_edges(spark):
    rows = [(i, t) for i, (_, t) in enumerate(quality.EXAMPLES)] + [(100, None), (101, ""), (102, " \n\t"), (103, quality.EXAMPLES[0][1] * 200), (0, quality.EXAMPLES[0][1])]
    got = quality.text_kinds(frame(spark, rows, "result_id int, markdown string"), "result_id", "markdown").collect()
    kinds = {r["id"]: r["kind"] for r in got}
    assert len(got) == len(quality.EXAMPLES) + 2 and {100, 101, 102}.isdisjoint(kinds)
    assert [kinds[i] for i in range(len(quality.EXAMPLES))] == [k for k, _ in quality.EXAMPLES] and kinds[103] == "prose"
    empty = frame(spark, [], "result_id int, markdown string")
    assert quality.text_kinds(empty, "result_id", "markdown").count() == 0


# Problem 2


def pairs_of(spark, texts):
    return garbled.pair_scores(spark.createDataFrame([(t,) for t in texts], "t string"), "t")


WRONG = [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1250")]


def test_garbled_round_trip(spark):
    clean = ["Le théâtre à côté du château a été fermé « après » la soirée.", "Die Straße über die Brücke wäre schön gewesen, für Gäste.", "El salón del pueblo está vacío; ¿qué pasó mañana?", "It’s £500 – no more, “the note” said."] * 30
    ps = pairs_of(spark, clean)
    scores = garbled.PairScores(*ps)
    for t in clean[:4]:
        assert garbled.repair_text(t, scores, {})[2] == 0
        for real, read in WRONG:
            bad = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in t.encode(real))
            assert garbled.repair_text(bad, scores, {})[0] == t, (t, read)
    twice = "fermé".encode().decode("cp1252").encode().decode("cp1252")
    assert garbled.repair_token(twice, scores)[0] == "fermé"
    lost = garbled.repair_text("für die Stra�e", scores, {})
    assert lost[2] and lost[3]
    for decoy in ("Tãolãlã SÂNCOR", "Âmmõesser MÃLU", "offi­ce no-break space", "¬¢±¶ s§dd, ¢÷±o¤ r÷ee §¤", "naïve café", "IL CHE È PICCOLA, RIAPRÌ I POMPIERI"):
        assert garbled.repair_text(decoy, scores, {})[2] == 0, decoy


def test_garbled_tables(spark):
    df = frame(spark, [(1, None), (2, ""), (3, "Ã©tÃ©"), (4, "été"), (5, "ascii")], "rid int, md string")
    ps = garbled.pair_scores(df, "md")
    assert [r["rid"] for r in garbled.repair(df, ["rid"], "md", ps).collect()] == [3]
    cm = spark.createDataFrame([(1, {1: "Ã©", 2: "ffi", 3: "", 4: "é", 5: "â€™", 6: "├⌐"}), (2, None), (3, {})], "cmap_id int, char_map map<int,string>")
    got = {(r["cmap_id"], r["code"]): r["original"] for r in garbled.garbled_entries(cm, ps).collect()}
    assert got == {(1, 1): "é", (1, 5): "’", (1, 6): "é"}
    assert garbled.repair(df.limit(0), ["rid"], "md", ps).count() == 0


@given(st.lists(st.floats(-3, 3, allow_nan=False).map(lambda x: round(x, 2)), max_size=12))
@settings(max_examples=80, deadline=None)
def test_best_segment_is_among_maximal_ones(scores):
    segs = garbled.segments(scores)
    best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
    if best > 1e-9:
        assert max(sum(scores[a:b]) for a, b in segs) == pytest.approx(best)
    assert all(b <= c for (_, b), (c, _) in zip(segs, segs[1:]))


# Problem 3

FORMS = {
    "Ｔｈｅ ｍｉｌｌ 12": "The mill 12",
    "café ệ": "café ệ",
    "thе mi​ll": "the mill",
    "a b　c": "a b c",
    "𝐛𝐨𝐥𝐝 ﬁne of\xadfice": "bold fine office",
    "Μadrid Ροma": "Madrid Poma",
}
SAME = ["Флибеюдро сказал Ждаро", "Μελωσιθρυ λόγος", "x² ½ nº 1ª “q” – … ´ ¨ ©", "plain text", "naïve façade ñandú straße", "tab\there"]


def test_forms(spark):
    rows = [(i, t) for i, t in enumerate([*FORMS, *SAME])] + [(90, ""), (91, None), (0, next(iter(FORMS)))]
    df = frame(spark, rows, "rid int, md string")
    got = {r["rid"]: (r["text_form"], r["is_case"]) for r in unicode_form.normalize_forms(df, ["rid"], "md").collect()}
    for i, (_, want) in enumerate(FORMS.items()):
        assert got[i] == (want, True)
    for i, t in enumerate(SAME, len(FORMS)):
        assert got[i] == (t, False), t
    assert got[90] == ("", False) and got[91] == (None, False)
    assert sorted(r["rid"] for r in unicode_form.form_cases(df, ["rid"], "md").collect()) == list(range(len(FORMS)))
    assert unicode_form.normalize_forms(df.limit(0), ["rid"], "md").count() == 0
    assert all(unicodedata.is_normalized("NFC", t) for t, _ in got.values() if t)


# Problem 4


@given(st.lists(st.sampled_from(["word", "a", "longerword", ". ", "\n\n", "\n", ", ", "# H\n", "- x\n", "x" * 40, " "]), max_size=120), st.integers(20, 80), st.integers(0, 15))
@settings(max_examples=120, deadline=None)
def test_pieces_cover_and_fit(parts, limit, overlap):
    text = " ".join(parts)
    got = splitting.split_text(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert c == max(0, b - overlap) and d > b
    assert all(b - a <= limit for a, b in got)


def test_pieces_prefer_paragraphs(spark):
    text = "\n\n".join(f"Paragraph {i} has some words. And a second sentence here." for i in range(40))
    got = splitting.split_text(text, 300, 30)
    assert all(text[:b].endswith("\n\n") for _, b in got[:-1])
    lim = spark.createDataFrame([("a", 300, 30)], "tbl string, max_chars int, overlap_chars int")
    df = frame(spark, [("a", 1, text), ("a", 1, text), ("a", 2, "short"), ("a", 3, None), ("b", 4, text)], "tbl string, rec int, body string")
    rows = splitting.split_oversized(df, ["tbl", "rec"], "body", lim).collect()
    assert {r["rec"] for r in rows} == {1} and len(rows) == len(got)


# Problem 5


def brute(rows, size, threshold, least):
    sets = {}
    for i, h, t in rows:
        w = re.findall(r"[^\W_]+", f"{h or ''}\n{t or ''}".lower())
        if t and len(w) >= least:
            sets[i] = set(zip(*(w[k:] for k in range(size))))
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_pairs_and_groups_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = list(rng.choice(vocab, 60))
        for k in range(4):
            w = list(base)
            for _ in range(int(rng.integers(0, 9))):
                w[int(rng.integers(0, 60))] = str(rng.choice(vocab))
            rows.append((len(rows), f"T{g}" if k else None, " ".join(w)))
    hot = " ".join(rng.choice(vocab, 50))
    rows += [(1000 + k, None, hot) for k in range(40)] + [(2000, "x", ""), (2001, None, None), (2002, "y", "too short"), rows[0]]
    df = frame(spark, rows, "rid int, ti string, md string")
    links, members = neardup.similar(df, "rid", "ti", "md", size=3, threshold=0.6, min_words=30)
    want = brute({r[0]: r for r in rows}.values(), 3, 0.6, 30)
    got = neardup.record_pairs(links, members).collect()
    assert {(r["a_id"], r["b_id"]) for r in got} == want and len(got) == len(want)
    # Copies take part as one class: forty of them give no link.
    assert links.where("a >= 1000").count() == 0
    groups = {r["id"]: r["group_id"] for r in neardup.components(links, members).collect()}
    parent = {i: i for i in groups}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in sorted(want):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert groups == {i: root(i) for i in groups}
    links, members = neardup.similar(df.limit(0), "rid", "ti", "md")
    assert links.count() == 0 and neardup.components(links, members).count() == 0
    assert neardup.expected_recall(0.6, 0.6) >= neardup.TARGET_RECALL


# Problem 6


def page(lines, x0=100, y0=100):
    return "\n".join(lines), [(i + 1, x0, y0 + 25 * i, 9 * len(s), 20, 0.9) for i, s in enumerate(lines)]


BOX = "array<struct<line_no:int,x:int,y:int,w:int,h:int,conf:float>>"


def test_leaks_in_columns_with_misreadings(spark):
    item = "Mrs Denmerbur was asked why the quarry of Wythdungar is still quiet and answered that the bakery of Bramstandun would be measured in the spring after the harvest"
    w = item.split()
    left = ["THE NEWS", " ".join(w[:6]), " ".join(w[6:12]).replace("quarry", "quarrv")]
    right = [" ".join(w[12:17]) + " " + w[17][:4] + "-", w[17][4:] + " " + " ".join(w[18:24]).replace("the", "thc"), " ".join(w[24:])]
    text = "\n".join(x for p in zip(left, right) for x in p)
    boxes = [(k + 1, 100 if k % 2 == 0 else 600, 100 + 25 * (k // 2), 9 * len(s), 20, 0.9) for k, s in enumerate(text.split("\n"))]
    short = page([" ".join(w[:15]), "and then something else was said about other matters by the council of the town"])
    fill = [(100 + k, *page([f"Alderman Number{k} of Place{k} said that the ferry was late", "and nothing more was said about it in the evening"])) for k in range(30)]
    rows = [(1, text, boxes), (2, *short), (3, None, None), (4, "", []), (5, item, None), (5, item, None), *fill]
    docs = frame(spark, rows, f"doc_id int, text string, line_boxes {BOX}")
    items = spark.createDataFrame([(7, item), (7, item), (8, "too short to leak"), (9, None)], "item_id int, text string")
    got = {(r["id"], r["item_id"]) for r in leakage.leaks(docs, items).collect()}
    assert got == {(1, 7), (5, 7)}
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


def test_leaks_of_common_terms_and_misread_anchors(spark):
    item = "Mrs Denmerbur was asked why the quarry of Wythdungar is still quiet and answered that the bakery of Bramstandun would be measured in the spring after the harvest"
    w = item.split()
    items = spark.createDataFrame([(7, item)], "item_id int, text string")
    found = lambda rows: {r["id"] for r in leakage.leaks(frame(spark, rows, f"doc_id int, text string, line_boxes {BOX}"), items).collect()}
    # One page, the item on every page, and a part of it on a third of them: its terms tell pages apart little or not at all.
    assert found([(1, *page([item]))]) == {1}
    assert found([(k, *page([item])) for k in range(3)]) == {0, 1, 2}
    part, other = page([" ".join(w[3:23])]), page(["Alderman Number said that the ferry was late and nothing more"])
    assert found([(k, *(other if k % 3 else part)) for k in range(30)]) == set(range(0, 30, 3))
    # Two of the three rarest words of the only 20-word window are misread so that their terms change.
    rare = [" ".join(x.replace("quarry", "quarpy").replace("Wythdungar", "Wythdpngar") for x in w[3:23])]
    fill = [(100 + k, *page(["was asked why the of is still quiet and answered that the bakery of would be measured in the"])) for k in range(60)]
    assert found([(1, *page(rare)), *fill]) == {1}


def test_reading_order_and_words():
    text = "a b-\nd e\nc f\ng"
    lines = reading.page_lines(text, [10, 400, 10, 400], [1, 1, 30, 30], [50, 50, 50, 50])
    assert [x for x, _ in lines] == ["a b-", "c f", "d e", "g"]
    assert reading.running_words(lines, True)[0] == ["a", "bc", "f", "d", "e", "g"]
    assert reading.is_market("water tower......8884") and reading.is_market("river bank  7296 1I") and not reading.is_market("In 1890 the mill was sold for 500")
    assert reading.page_lines("", [], [], []) == [] and [x for x, _ in reading.page_lines("x\ny", [1], [1], [1])] == ["x", "y"]


# Problem 7


def test_mixture_meets_shares_and_caps(spark):
    rows = [(i, "some words of text number " + str(i) * (1 + i % 5), s) for s, a, b in (("big", 0, 3000), ("mid", 3000, 3600), ("tiny", 3600, 3650)) for i in range(a, b)]
    rows += [(9000, "", "big"), (9001, None, "mid"), (9002, "x", None), (9003, "unlisted text", "other")]
    docs = frame(spark, rows, "doc_id int, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 3), ("gone", 0.1, 1)], "source string, target_share double, max_repeat int")
    sh = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    total = 0.9
    for s, w in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        assert sh[s]["actual_share"] == pytest.approx(w / total, abs=0.01)
    assert sh["gone"]["tokens_taken"] == 0
    mix = mixing.mixture(docs, targets).toPandas()
    assert mix.groupby(["source", "doc_id"]).size().groupby("source").max().to_dict()["tiny"] <= 3
    again = mixing.mixture(docs, targets).toPandas()
    key = lambda d: sorted(zip(d.doc_id, d.copy_no))
    assert key(mix) == key(again) and set(mix.doc_id).isdisjoint({9000, 9001, 9002, 9003})
    assert mixing.mixture(docs.limit(0), targets).count() == 0


def test_thresholds_nest_and_fit(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 60, 500)
    n = rng.integers(1, 50, 500)
    tokens = spark.createDataFrame(pd.DataFrame({"id": range(500), "source": "a", "h": h, "n": n}))
    last = -1
    for total in (100, 1000, 5000):
        o = mixing.plan(tokens, [("a", 1.0, 1)], total)[0]
        taken = n[h < o["threshold"]].sum()
        assert taken == o["part"] <= total < taken + 50 and o["threshold"] > last
        last = o["threshold"]


# Problem 8


def test_forward_sums_all_segmentations():
    vocab = {p: i for i, p in enumerate(["_", "_a", "a", "b", "ab", "_ab", "_a" + "b" + "a"])}
    prob = np.linspace(0.05, 0.4, len(vocab) * 2).reshape(-1, 2)
    prob = np.vstack([prob, np.zeros(2), np.full(2, 1e-7)])

    def total(s):
        if not s:
            return np.ones(2)
        return sum((prob[vocab[s[:k]]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in vocab), np.zeros(2))

    for w in ("a", "ab", "aba", "abab"):
        assert np.allclose(language.forward(language.lattice([w], language.PieceTable(vocab)), prob)[0, -1], total("_" + w))


def test_best_path_against_brute_force():
    import itertools

    rng = np.random.default_rng(3)
    s = rng.uniform(-6, 0, (7, 3)).astype(np.float32)
    got = language.best_paths(np.vstack([s, s[:3]]), np.array([0, 7, 10]), np.array([7, 3, 0]))
    cost = lambda p: sum(s[i, x] for i, x in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
    assert cost(got[0]) == pytest.approx(max(map(cost, itertools.product(range(3), repeat=7))), abs=1e-4)
    assert len(got[1]) == 3 and len(got[2]) == 0


def test_languages_of_pages(spark):
    en = ["the road from the town is narrow because the mill was never repaired in the spring and the council did not know why".split() for _ in range(1)][0]
    de = "die Straße von der Stadt ist schmal weil die Mühle im Frühjahr nie repariert wurde und der Rat wusste nicht warum".split()
    rng = np.random.default_rng(0)
    rows = []
    for i in range(80):
        src, lab = (en, "EN") if i % 2 else (de, "de")
        rows.append((i, " ".join(rng.choice(src, 40)), lab, None))
    rows += [(200, " ".join(en * 2 + de * 2), "en", None), (201, " ".join(de * 2), "en", None), (202, "", "en", None), (203, None, "en", None), (204, "1234 56", "zz", None), (205, " ".join(en), None, None)]
    docs = frame(spark, rows, f"doc_id int, text string, lang string, line_boxes {BOX}")
    alias = spark.createDataFrame([("EN", "en"), ("en", "en"), ("de", "de")], "alias string, lang string")
    m = language.train(docs, alias)
    segs = language.stretches(docs, m).toPandas()
    by = segs.groupby("id").lang.agg(list).to_dict()
    assert by[200] == ["en", "de"] and by[201] == ["de"] and by[205] == ["en"] and {202, 203, 204}.isdisjoint(by)
    assert segs.confidence.between(0, 1).all() and (segs.groupby("id").n_chars.sum() == segs.groupby("id").page_chars.first()).all()
    assert language.train(docs.where("lang = 'zz'"), alias) is None
    assert language.stretches(docs, None).count() == 0


# The registered queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, data, name):
    df = queries.queries()[name](spark, data)
    df.collect()
    want = {"p1_found": ["result_id", "kind"], "p2_found": ["tbl", "rec_id", "cid"], "p3_found": ["tbl", "rec_id"], "p4_found": ["tbl", "rec_id", "block_no"], "p5_found": ["a_id", "b_id"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "lang"]}
    if name in want:
        assert df.columns == want[name]


# Very long and odd texts


@pytest.mark.parametrize("text", ["\n" * 50_000, "a" * 60_000, "é" * 30_000, "Ã©" * 20_000, "漢字" * 20_000, ("word. " * 20_000), ". " * 30_000, "| a | b |\n" * 8_000, "\t" * 30_000 + "x", "#" * 20_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.time()
    scores = garbled.PairScores(np.array([ord("a") << 21 | ord("b")]), np.array([5]))
    garbled.repair_text(text, scores, {})
    got = splitting.split_text(text, 4000, 200)
    assert got[-1][1] == len(text) and all(b - a <= 4000 for a, b in got)
    quality.shape(text)
    words = reading.running_words(reading.page_lines(text, None, None, None), True)[0]
    [leakage.plain(w) for w in words]
    neardup.shingles(words, 5, {})
    assert time.time() - began < 20
