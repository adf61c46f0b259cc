"""Problem 6: passages of test items inside a corpus of scanned pages.

Method: a distributed positional inverted index. The corpus is read once, for all items: each page, in its own reading order,
gives its terms by place (all of them, whatever the items ask for). Index terms are terms with the one that follows. In both halves of
every window of the items' words the index terms that are rarest in the corpus become anchors; their posting lists (index
term, page, position, signature of the neighbours) are stored sorted by index term, long lists in several parts. The lists, shifted
by the anchor's place in the item, are intersected: wherever anchors of an item and their neighbours that agree meet at nearly
one offset of a page, EVIDENCE of them at least, the phrase is followed word by word in both directions and given back as an exact
phrase or as a proximity match (misread letters, broken and run-together words, an insert between).

Terms are words with letters that a scanner confuses put into one class, so a misread letter mostly leaves its term alone.
How rare a term is decides only which lists are read: whatever meets is followed.

Defined results: null or empty pages and items give nothing; items shorter than the least passage can't leak; repeated
item rows count once (of different texts with one id, one is taken); repeated pages give their rows once; an item found
several times on a page is reported once, with its longest passage and how many passages it has there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirel.session import cut, spread

from .reading import streams

#: Words that must stand in a row, and anchors of each half of a window of that length.
PASSAGE, ANCHORS = 20, 2
#: Of the two terms before an anchor's first and the two after it so many must agree (the next one always does).
AGREE = 2
#: Anchors and agreeing neighbours that a meeting must have together: two whole anchors, or three with two neighbours each, of the
#: four or more that a passage has.
EVIDENCE = 10
#: Offsets of two anchors of one passage differ by this much at most (words broken or run together shift them).
DRIFT = 4
#: Postings of a list that one task sorts and stores; longer lists are stored in parts.
LIST = 1_000_000
#: Most ids of pages with a meeting that are broadcast, so that only these pages are shuffled to their meetings.
NARROW = 1_000_000
#: Words of padding between texts laid one after another, and pages laid so at once.
EDGE, TOGETHER = 6, 200
#: Words of a page that may be skipped (an insert, a heading) inside a passage.
SKIP = 60
# Classes of letters that scanners confuse, each written with its first letter.
CONFUSED = ["oaec0qöóòôõàáâäãåèéêëç6", "il1tfjíìîï!|ſ", "nuhbrüúùûñ8", "vyw", "s5zß", "g9"]
CLASS = {ord(c): g[0] for g in CONFUSED for c in g}
NOT_WORD = re.compile(r"[^\w]|_")


def plain(word: str) -> str:
    """Lower case, letters and digits only."""
    w = word.lower()
    if w.isalnum():
        return w
    w = unicodedata.normalize("NFKC", w)
    return NOT_WORD.sub("", w)


def term(word: str) -> str:
    """Index term of a plain word."""
    return word.replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("ii", "u").translate(CLASS)


class Letters(dict[str, int]):
    """Word -> set of its letters as bits (two letters may share one), kept while it is small."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        bits = 0
        for c in word:
            bits |= 1 << (ord(c) & 63)
        self[word] = bits
        return bits


LETTERS = Letters()


def near(a: str, b: str, memo: dict[tuple[str, str], bool]) -> bool:
    """Whether two words are the same but for misread letters: edits up to a third of the longer, one at least."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    most = max(1, (max(la, lb) + 1) // 3)
    if abs(la - lb) > most or max(la, lb) < 2:
        return max(la, lb) == 1
    # Each edit takes away or brings in one letter at most.
    x, y = LETTERS[a], LETTERS[b]
    if (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:
        return False
    got = memo.get((a, b))
    if got is None:
        if len(memo) > 300_000:
            memo.clear()
        row = list(range(lb + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
            if min(row) > most:
                break
        got = memo[(a, b)] = row[lb] <= most if min(row) <= most else False
    return got


def follow(doc: list[str], item: list[str], i: int, j: int, step: int, memo: dict[tuple[str, str], bool]) -> tuple[int, int, int]:
    """(item words matched in a row, doc place, item place after them), from (doc i, item j) in the given direction."""
    n, m, count = len(doc), len(item), 0
    while 0 <= j < m and 0 <= i < n:
        if near(doc[i], item[j], memo):
            i, j, count = i + step, j + step, count + 1
            continue
        i2, j2 = i + step, j + step
        if 0 <= i2 < n and near(doc[min(i, i2)] + doc[max(i, i2)], item[j], memo):
            i, j, count = i2 + step, j + step, count + 1
        elif 0 <= j2 < m and near(doc[i], item[min(j, j2)] + item[max(j, j2)], memo):
            i, j, count = i + step, j2 + step, count + 2
        elif 0 <= i2 < n and len(doc[i]) <= 2 and near(doc[i2], item[j], memo):
            i, j, count = i2 + step, j + step, count + 1
        else:
            break
    return count, i, j


def passage(doc: list[str], item: list[str], at: int, p: int, memo: dict[tuple[str, str], bool]) -> tuple[int, int, int, int, int]:
    """(item words in a row, lo, hi, left, right) around a meeting of the page's word at and the item's word p.

    From lo to hi the item's words stand word for word beside the page's: a meeting there leads to the same run.
    From left to right the passage takes words of the page.

    A passage of some length may be interrupted by an insert: it goes on where the next three item words stand together.
    """
    right, ri, rj = follow(doc, item, at, p, 1, memo)
    if not right:
        return 0, p, p + 1, at, at
    left, li, lj = follow(doc, item, at - 1, p - 1, -1, memo)
    total = right + left
    run = (lj + 1, rj) if ri - at == rj - p == right and li - at == lj - p == -left - 1 else (p, p + 1)
    ends = [ri, li]
    for side, (step, i, j) in enumerate(((1, ri, rj), (-1, li, lj))):
        while total >= 8 and 0 <= j + 2 * step < len(item):
            three = [item[j], item[j + step], item[j + 2 * step]]
            k = next((k for k in range(1, SKIP) if 0 <= i + (k + 2) * step < len(doc) and all(near(doc[i + (k + t) * step], three[t], memo) for t in range(3))), None)
            if k is None:
                break
            more, i, j = follow(doc, item, i + k * step, j, step, memo)
            total += more
            ends[side] = i
    return total, *run, ends[1] + 1, ends[0]


def letters(texts: list[list[str]], edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text starts, letters as bits, lengths) of the words of all texts, EDGE words of the impossible length edge around each."""
    pad = [""] * EDGE
    flat = [*pad, *(w for t in texts for w in (*t, *pad))]
    at = EDGE + np.concatenate([[0], np.cumsum([len(t) + EDGE for t in texts])])[:-1].astype(np.int64)
    return at, np.array([LETTERS[w] for w in flat], np.uint64), np.array([len(w) or edge for w in flat], np.int64)


def hopeful(pages: tuple[np.ndarray, np.ndarray], items: tuple[np.ndarray, np.ndarray], at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether follow() can get to eight words around each meeting, by the words' letters and lengths alone; no that is wrong is never said.

    Eight words need two steps to the left, or two more after the meeting's own to the right.
    """
    (dm, dl), (im, il) = pages, items

    def alike(xm, xl, ym, yl):
        most = np.maximum(1, (np.maximum(xl, yl) + 1) // 3)
        return (np.abs(xl - yl) <= most) & (np.bitwise_count(xm & ~ym) <= most) & (np.bitwise_count(ym & ~xm) <= most)

    def step(i, j, way):
        d, d2, t, t2 = at + i * way, at + (i + 1) * way, p + j * way, p + (j + 1) * way
        a, b, c, e = dm[d], dm[d2], im[t], im[t2]
        la, lb, lc, le = dl[d], dl[d2], il[t], il[t2]
        return alike(a, la, c, lc) | alike(a | b, la + lb, c, lc) | alike(a, la, c | e, lc + le) | ((la <= 2) & alike(b, lb, c, lc))

    def some(places, way):
        return np.logical_or.reduce([step(i, j, way) for i, j in places])

    right = some([(1, 1), (2, 1), (1, 2)], 1) & some([(2, 2), (3, 2), (2, 3), (4, 2), (3, 3), (2, 4)], 1)
    return right | step(1, 1, -1) & some([(2, 2), (3, 2), (2, 3)], -1)


def number_of(word: str) -> int:
    """32-bit number of a plain word's term; terms that share one only bring meetings that the words then deny."""
    return xxhash.xxh32_intdigest(term(word)) - (1 << 31)


def signature(before2: int, before: int, after: int, after2: int) -> int:
    """Eight bits of each of the four neighbouring terms, as a signed number of 32 bits."""
    x = (before2 & 255) | (before & 255) << 8 | (after & 255) << 16 | (after2 & 255) << 24
    return x - (1 << 32) if x >> 31 else x


def agreeing(x: Column, y: Column) -> Column:
    """How many of the four neighbours two signatures agree on."""
    z = x.bitwiseXOR(y)
    return sum(((z.bitwiseAND(F.lit(255 << k)) == 0).cast("int") for k in (0, 8, 16)), (F.shiftrightunsigned(z, 24) == 0).cast("int"))


def pair(first, second):
    """Number of two terms in a row, for numbers and for columns alike; stays far inside 64 bits."""
    return first * 1_000_003 + second


class Memo(dict):
    """Values of a function of one word, kept while they are few."""

    def __init__(self, f, most: int = 400_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, word: str):
        if len(self) > self.most:
            self.clear()
        got = self[word] = self.f(word)
        return got


NUMBER = Memo(number_of)
#: White-space word -> (plain word, number of its term), or None where nothing is left of it.
KNOWN = Memo(lambda raw: (p, number_of(p)) if (p := plain(raw)) else None)


def page_words(t: str | None, x, y, w) -> list[list[str]]:
    """Plain words of each of the page's streams (all its lines, and what runs on without inserts)."""
    return [[k[0] for k in map(KNOWN.__getitem__, raws) if k] for raws, _, _ in streams(t, x, y, w)]


def page_terms(t: str | None, x, y, w, least: int) -> Iterator[tuple[int, int, list[int], list[tuple[int, int, int]]]]:
    """(stream, first place, terms, joined) of the page's streams; of what runs on without inserts only the `least` words on
    both sides of what is left out, as all else stands in the first stream.

    joined are (index term, place, signature) with the word that the halves of one broken at a line end without a sign would make.
    """
    for stream, (raws, ends, joints) in enumerate(streams(t, x, y, w)):
        got = list(map(KNOWN.__getitem__, raws))
        if None in got:
            # Places among plain words.
            place, n = [], 0
            for k in got:
                place.append(n)
                n += k is not None
            place.append(n)
            ends = [place[i] for i in ends if got[i]]
            joints = [place[i] for i in joints]
            got = [k for k in got if k]
        own = [k[1] for k in got]
        size = len(own)
        joined = []
        for n in ends:
            if n + 1 < size and len(got[n][0]) > 2:
                both = NUMBER[got[n][0] + got[n + 1][0]]
                b3, b2, b1, a1, a2, a3 = (own[i] if 0 <= i < size else 0 for i in (n - 3, n - 2, n - 1, n + 2, n + 3, n + 4))
                joined.append((pair(both, a1), n, signature(b2, b1, a1, a2)))
                if n:
                    joined.append((pair(b1, both), n - 1, signature(b3, b2, both, a1)))
        if not stream:
            yield 0, 0, own, joined
            continue
        spans: list[list[int]] = []
        for j in joints:
            lo, hi = max(0, j - least - 3), min(size, j + least + 4)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        for lo, hi in spans:
            yield stream, lo, own[lo:hi], [z for z in joined if lo <= z[1] < hi]


def term_table(docs: DataFrame, key: str, text: str, boxes: str, least: int) -> DataFrame:
    """(id, stream, first, terms array<int>, joined array<struct<key, at, sig>>): each page's terms by place, in the shared folder."""
    kind = docs.schema[key].dataType.simpleString()
    recs = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("t"), *[F.col(f"{boxes}.{c}").alias(c) for c in "xyw"]).where("t <> ''"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, firsts, terms, ends, joined, jends = [], [], [], [], [0], [], [0]
            cols = [c.to_pylist() for c in batch.columns[1:]]
            for k, (t, x, y, w) in enumerate(zip(*cols)):
                for stream, first, own, more in page_terms(t, x, y, w, least):
                    row.append(k)
                    no.append(stream)
                    firsts.append(first)
                    terms += own
                    ends.append(len(terms))
                    joined += more
                    jends.append(len(joined))
            jk, ja, js = zip(*joined) if joined else ((), (), ())
            three = pa.StructArray.from_arrays([pa.array(np.array(jk, np.int64)), pa.array(np.array(ja, np.int32)), pa.array(np.array(js, np.int32))], names=["key", "at", "sig"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(no, pa.int32()),
                    pa.array(firsts, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(terms, np.int32))),
                    pa.ListArray.from_arrays(pa.array(jends, pa.int32()), three),
                ],
                names=["id", "stream", "first", "terms", "joined"],
            )

    return cut(recs.mapInArrow(run, f"id {kind}, stream int, first int, terms array<int>, joined array<struct<key:bigint,at:int,sig:int>>"), "p6-terms")


def item_terms(items: DataFrame, item_key: str, item_text: str, least: int) -> DataFrame:
    """(item, m, p, key, sig): the index terms of each item of at least `least` words, by place; m is the item's length."""
    its = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("s")).where("s <> ''").dropDuplicates(["i"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, s in zip(pdf["i"], pdf["s"]):
                ws = item_words(s)
                if len(ws) >= least:
                    own = [0, 0, *map(number_of, ws), 0, 0]
                    rows += [(i, len(ws), p, pair(own[p + 2], own[p + 3]), signature(own[p], own[p + 1], own[p + 3], own[p + 4])) for p in range(len(ws) - 1)]
            yield pd.DataFrame(rows, columns=["item", "m", "p", "key", "sig"])

    return its.mapInPandas(run, "item long, m int, p int, key long, sig int")


def item_words(text: str) -> list[str]:
    return [p for p in map(plain, text.split()) if p]


def _next(k: int) -> Column:
    """The term k places after the one at place `at`, or null."""
    return F.get("terms", F.col("at") + k)


def anchors(terms: DataFrame, pages: DataFrame, least: int) -> DataFrame:
    """(item, p, key, sig, n): in each half of each window of `least` words of an item the ANCHORS index terms with the shortest lists; n
    is a list's length. Halves, as one damaged place shall not touch all anchors of a window."""
    wanted = terms.select("key").distinct()
    every = pages.where("stream = 0").select("terms", F.posexplode("terms").alias("at", "term")).select(pair(F.col("term").cast("long"), _next(1)).alias("key"))
    lists = every.join(wanted, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # What stands nowhere can't meet anything.
    known = terms.join(lists, "key").withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - least + 1), F.least(F.col("p"), F.col("m") - least))))
    order = Window.partitionBy("item", "w", (F.col("p") - F.col("w")) * 2 >= least).orderBy("n", "p")
    return known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ANCHORS).select("item", "p", "key", "sig", "n").distinct()


def build_index(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, id, stream, at, sig): the posting lists of the wanted index terms (key, n), sorted by index term and page; lists of over
    LIST postings are split into parts by page. Written to the shared folder."""

    def byte(k: int, shift: int) -> Column:
        return F.shiftleft(F.coalesce(_next(k), F.lit(0)).bitwiseAND(F.lit(255)), shift)

    sig = byte(-2, 0).bitwiseOR(byte(-1, 8)).bitwiseOR(byte(1, 16)).bitwiseOR(byte(2, 24))
    plainly = pages.select("id", "stream", "first", "terms", F.posexplode("terms").alias("at", "term")).select("id", "stream", (F.col("first") + F.col("at")).alias("at"), pair(F.col("term").cast("long"), _next(1)).alias("key"), sig.alias("sig"))
    joined = pages.select("id", "stream", F.explode("joined").alias("j")).select("id", "stream", "j.at", "j.key", "j.sig")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / LIST).cast("int")).cast("int")
    posts = plainly.unionByName(joined).join(wanted, "key").select("key", part.alias("part"), "id", "stream", "at", "sig")
    return cut(posts.repartition("key", "part").sortWithinPartitions("key", "id", "stream", "at").drop("part"), "p6-index")


def meetings(index: DataFrame, laid: DataFrame) -> DataFrame:
    """(id, stream, item, ps, ats): pages and items of which two anchors' lists, shifted by the anchors' places, meet at nearly one
    offset with the evidence that it takes, with the anchors' places in the item and on the page, in order of the offset."""
    hits = index.alias("x").join(laid.alias("y"), F.col("x.key") == F.col("y.key")).select("id", "stream", "item", "p", "at", (1 + agreeing(F.col("x.sig"), F.col("y.sig"))).alias("e")).where(F.col("e") > AGREE)
    # One page and one item a group: bounded by the page's words times the item's anchors.
    met = hits.groupBy("id", "stream", "item").agg(F.sum("e").alias("e"), F.array_sort(F.collect_list(F.struct((F.col("at") - F.col("p")).alias("d"), "p", "at", "e"))).alias("z")).where(F.col("e") >= EVIDENCE)
    near_by = F.exists("z", lambda a: F.aggregate(F.filter("z", lambda b: (b["d"] >= a["d"]) & (b["d"] <= a["d"] + DRIFT)), F.lit(0), lambda n, b: n + b["e"]) >= EVIDENCE)
    return met.where(near_by).select("id", "stream", "item", F.col("z.p").alias("ps"), F.col("z.at").alias("ats"))


def meeting_points(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of a page's hits of one item, in order of at - p, stand within DRIFT of another one of the same window."""
    d = at - p
    hit = np.zeros(len(d), bool)
    for lag in range(1, len(d)):
        close = d[lag:] - d[:-lag] <= DRIFT
        if not close.any():
            break
        apart = np.abs(p[lag:] - p[:-lag])
        met = close & (apart > 0) & (apart < PASSAGE)
        hit[lag:] |= met
        hit[:-lag] |= met
    return hit


def follow_all(docs: list[list[str]], tests: list[list[str]], points: list[tuple], least: int) -> dict[tuple[int, int], list[tuple[int, bool, int, int]]]:
    """points (stream's number, item's number, ps, ats) -> passages (words, exact, left, right) of each stream and item."""
    start, dm, dl = letters(docs, -3000)
    first, im, il = letters(tests, -1000)
    found = []
    for d, t, ps, ats in points:
        p, at = np.asarray(ps, np.int64), np.asarray(ats, np.int64)
        hit = meeting_points(p, at) & (at < len(docs[d])) & (p < len(tests[t]))
        found.append((np.full(hit.sum(), d), np.full(hit.sum(), t), at[hit], p[hit]))
    page, item, at, p = (np.concatenate(c) for c in zip(*found))
    if least >= 8:
        keep = hopeful((dm, dl), (im, il), start[page] + at, first[item] + p)
        page, item, at, p = page[keep], item[keep], at[keep], p[keep]
    out: dict[tuple[int, int], list[tuple[int, bool, int, int]]] = {}
    done: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    memo: dict[tuple[str, str], bool] = {}
    for d, t, a, q in zip(page.tolist(), item.tolist(), at.tolist(), p.tolist()):
        runs = done.setdefault((d, t, a - q), [])
        if any(lo <= q < hi for lo, hi in runs):
            continue
        words, lo, hi, left, right = passage(docs[d], tests[t], a, q, memo)
        runs.append((lo, hi))
        if words >= least:
            same = right - left == words and f" {' '.join(docs[d][left:right])} " in f" {' '.join(tests[t])} "
            out.setdefault((d, t), []).append((words, same, left, right))
    return out


def apart(spans: list[tuple[int, int]]) -> int:
    """Most spans that don't overlap."""
    n, end = 0, -1
    for right, left in sorted((r, x) for x, r in spans):
        if left >= end:
            n, end = n + 1, right
    return n


def passages(pages: DataFrame, least: int) -> DataFrame:
    """pages(id, t, x, y, w, ms array<struct<stream, item, ps, ats, s>>) -> (id, item_id, n_words, exact, passages)."""
    kind = pages.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k in range(0, len(pdf), TOGETHER):
                docs, tests, points, owner, number = [], [], [], [], {}
                for i, t, x, y, w, ms in pdf.iloc[k : k + TOGETHER][["id", "t", "x", "y", "w", "ms"]].itertuples(index=False, name=None):
                    base = len(docs)
                    docs += page_words(t, x, y, w)
                    owner += [i] * (len(docs) - base)
                    for m in ms:
                        if m["item"] not in number:
                            number[m["item"]] = len(tests)
                            tests.append(item_words(m["s"]))
                        if base + m["stream"] < len(docs):
                            points.append((base + m["stream"], number[m["item"]], m["ps"], m["ats"]))
                if points:
                    names = list(number)
                    for (d, t), got in follow_all(docs, tests, points, least).items():
                        words, same = max(g[:2] for g in got)
                        rows.append((owner[d], names[t], words, same, apart([g[2:] for g in got])))
            yield pd.DataFrame(rows, columns=["id", "item_id", "n_words", "exact", "passages"])

    found = pages.mapInPandas(run, f"id {kind}, item_id long, n_words int, exact boolean, passages int")
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("n_words", "exact")).alias("b"), F.max("passages").alias("passages"))
    return best.select("id", "item_id", "b.n_words", "b.exact", "passages")


def leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", boxes: str = "line_boxes", item_key: str = "item_id", item_text: str = "text", least: int = PASSAGE) -> DataFrame:
    """(id, item_id, n_words, exact, passages): pages that hold at least `least` words in a row of an item's text.

    n_words is the longest passage; exact says whether it stands word for word; passages counts those that don't overlap.
    """
    pages = term_table(docs, key, text, boxes, least)
    laid = cut(anchors(item_terms(items, item_key, item_text, least), pages, least), "p6-anchors")
    index = build_index(pages, laid.groupBy("key").agg(F.first("n").alias("n")))
    met = cut(meetings(index, laid), "p6-meetings")
    texts = items.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("s")).where("s <> ''").dropDuplicates(["item"])
    mine = met.join(texts, "item").groupBy("id").agg(F.collect_list(F.struct("stream", "item", "ps", "ats", "s")).alias("ms"))
    # The pages themselves are read again, those with a meeting only.
    raw = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), *[F.col(f"{boxes}.{c}").alias(c) for c in "xyw"]).where("t <> ''")
    ids = met.select("id").distinct()
    if ids.count() <= NARROW:
        raw = raw.join(F.broadcast(ids), "id", "left_semi")
    return passages(raw.join(mine, "id"), least)
