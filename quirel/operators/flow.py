"""How a page reads: columns, bands and regions in order, letter spacing, scripts from right to left, headings over several lines.

Pure functions over one page's items (dicts with text, x, y, width, font_size and style flags; y grows upwards) or lines
(dicts with text, x, y, font_size, bold). `reading_order` runs over a DataFrame, whole pages at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import mean, median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import Item, _pages, row_places

#: Least width of a gutter, and lines and words a line of columns that are read one after another.
GUTTER, LINES, WORDS = 15.0, 3, 3.0


@dataclass
class MarkdownOptions:
    """What the Markdown of pages keeps and repairs."""

    bold: bool = True
    italic: bool = True
    decorations: bool = True
    headings: bool = True
    lists: bool = True
    code: bool = True
    captions: bool = True
    tables: bool = True
    images: bool = False
    links: bool = True
    page_comments: bool = False
    drop_page_numbers: bool = True
    drop_repeated_lines: bool = True
    join_hyphens: bool = True
    clean_urls: bool = True


# Scripts from right to left


def reverse_visual(text: str) -> str:
    """Text stored as shown, from left to right, in the order it is read: runs change places, runs of other letters are turned.

    A run of Latin letters and digits, with the signs that touch them, keeps its order.
    """
    keep = [c.isascii() and (c.isalnum() or not c.isspace() and c.isprintable() and any(n.isascii() and n.isalnum() for n in text[max(0, i - 1) : i + 2])) for i, c in enumerate(text)]
    runs: list[tuple[bool, list[str]]] = []
    for c, k in zip(text, keep):
        if not runs or runs[-1][0] != k:
            runs.append((k, []))
        runs[-1][1].append(c)
    return "".join("".join(r if k else reversed(r)) for k, r in reversed(runs))


# Letter spacing


def is_letterspaced(text: str) -> bool:
    """Single characters with single spaces between."""
    t = text.strip()
    return len(t) >= 3 and len(t) % 2 == 1 and all((c == " ") == (i % 2 == 1) for i, c in enumerate(t))


def two_classes(values: list[float]) -> float | None:
    """Otsu's threshold: where splitting sorted values in two makes the variance between the classes greatest."""
    v = sorted(values)
    n, total = len(v), sum(v)
    best, at, left = 0.0, None, 0.0
    for i in range(n - 1):
        left += v[i]
        if v[i + 1] - v[i] < 1e-6:
            continue
        w = (i + 1) / n
        between = w * (1 - w) * (left / (i + 1) - (total - left) / (n - i - 1)) ** 2
        if between > best:
            best, at = between, (v[i] + v[i + 1]) / 2
    return at


def fix_letterspacing(items: list[Item], default: float = 0.10) -> tuple[list[Item], float]:
    """(items, gap in ems up to which neighbours are one word): on a page half of whose items are letter-spaced the spaces go.

    A page of single characters keeps its items and only gets its own gap, if that is wide.
    """
    real = [t for t in items if len(t["text"].strip()) >= 3]
    spaced = [t for t in real if is_letterspaced(t["text"])]
    on_page = len(real) >= 4 and len(spaced) * 2 >= len(real)
    single = len(items) >= 10 and sum(len(t["text"].strip()) == 1 for t in items) * 2 >= len(items)
    if not on_page and not single:
        return items, default
    gaps = []
    row = sorted(items, key=lambda t: (-round(t["y"]), t["x"]))
    for a, b in zip(row, row[1:]):
        gap = (b["x"] - a["x"] - a["width"]) / max(a["font_size"], 1.0)
        if abs(a["y"] - b["y"]) <= 0.5 * max(a["font_size"], 4) and -0.5 <= gap <= 3:
            gaps.append(gap)
    limit = min(2.0, max(0.05, two_classes(gaps) or default)) if len(gaps) >= 4 else default
    if not on_page:
        return items, limit if limit > 0.40 else default
    return [{**t, "text": t["text"].replace(" ", "")} if is_letterspaced(t["text"]) else t for t in items], limit


def merge_subscripts(items: list[Item]) -> list[Item]:
    """Small items that touch a larger one, a little above or below its line, put into its text."""
    out: list[Item] = []
    for t in (items[k] for ln in line_bands(items) for k in sorted(ln, key=lambda k: items[k]["x"])):
        last = out[-1] if out else None
        if last and t["font_size"] <= 0.75 * last["font_size"] and len(t["text"].strip()) <= 4 and 0 < abs(t["y"] - last["y"]) <= 0.6 * last["font_size"] and -0.2 <= (t["x"] - last["x"] - last["width"]) / last["font_size"] <= 0.3:
            out[-1] = {**last, "text": last["text"] + t["text"].strip(), "width": t["x"] + t["width"] - last["x"]}
        else:
            out.append(t)
    return out


def drop_table_underlines(items: list[Item], boxes: list[tuple[float, float, float, float]]) -> list[Item]:
    """Items inside ruled tables lose their underline: it is the row's rule."""
    return [{**t, "is_underline": False} if t.get("is_underline") and any(a <= t["x"] and t["x"] + t["width"] <= c + 1 and b - 2 <= t["y"] <= d for a, b, c, d in boxes) else t for t in items]


def image_box(m: tuple[float, ...]) -> tuple[float, float, float, float]:
    """The unit square under a matrix, as a box."""
    xs = [m[4], m[4] + m[0], m[4] + m[2], m[4] + m[0] + m[2]]
    ys = [m[5], m[5] + m[1], m[5] + m[3], m[5] + m[1] + m[3]]
    return min(xs), min(ys), max(xs), max(ys)


# Columns


def free_stretches(items: list[Item], lo: float, hi: float) -> list[tuple[float, float]]:
    """Stretches between lo and hi that no item covers."""
    out, at = [], lo
    for a, b in sorted((t["x"], t["x"] + t["width"]) for t in items):
        if a - at >= GUTTER:
            out.append((at, a))
        at = max(at, b)
    if hi - at >= GUTTER:
        out.append((at, hi))
    return out


def shared_stretches(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> list[tuple[float, float]]:
    return [(max(p, r), min(q, s)) for p, q in a for r, s in b if min(q, s) - max(p, r) >= GUTTER]


def xy_cut(items: list[Item]) -> float | None:
    """The middle of the widest gutter off the margins, with ten items on one side, three on the other, and a fifth of height in common."""
    if len(items) < 13:
        return None
    lo, hi = min(t["x"] for t in items), max(t["x"] + t["width"] for t in items)
    best = None
    for a, b in free_stretches(items, lo, hi):
        left, right = [t for t in items if t["x"] < a + 0.01], [t for t in items if t["x"] >= b - 0.01]
        if a < lo + 0.1 * (hi - lo) or b > hi - 0.1 * (hi - lo) or max(len(left), len(right)) < 10 or min(len(left), len(right)) < 3:
            continue
        low, high = max(min(t["y"] for t in s) for s in (left, right)), min(max(t["y"] for t in s) for s in (left, right))
        if high - low >= 0.2 * (max(t["y"] for t in items) - min(t["y"] for t in items)) and (best is None or b - a > best[1] - best[0]):
            best = (a, b)
    return None if best is None else (best[0] + best[1]) / 2


def side_by_side(items: list[Item]) -> float | None:
    """Where two texts stand side by side: a jump of left edges by 30 points in the middle three fifths, twenty items on both
    sides, hardly any across. None if there are several such places far apart, or if it is a text with figures to its right."""
    if len(items) < 40:
        return None
    lo, hi = min(t["x"] for t in items), max(t["x"] + t["width"] for t in items)
    starts = sorted(t["x"] for t in items)
    found = []
    for a, b in zip(starts, starts[1:]):
        at = b - 1
        if b - a < 30 or not lo + 0.2 * (hi - lo) <= at <= hi - 0.2 * (hi - lo):
            continue
        left = [t for t in items if t["x"] + t["width"] / 2 < at]
        cross = sum(t["x"] < at < t["x"] + t["width"] for t in items)
        n = len(items)
        if min(len(left), n - len(left)) >= max(20, 0.2 * n) and cross <= max(0.05 * n, 2):
            found.append((cross, at, left))
    if not found or max(f[1] for f in found) - min(f[1] for f in found) > 60:
        return None
    _, at, left = min(found, key=lambda f: f[:2])
    right = [t for t in items if t["x"] + t["width"] / 2 >= at]
    figures = sum(re.fullmatch(r"[\d.,%$€£()\- ]+", t["text"].strip()) is not None for t in right)
    heights = {round(t["y"]) for t in left}
    if figures * 2 > len(right) and sum(round(t["y"]) in heights for t in right) * 2 > len(right):
        return None
    return at


def relative_valleys(bins: list[int], margin: int) -> list[tuple[int, int]]:
    """(first, after last) of the runs of bins that hold under 30 % of the lower of the two peaks beside them, off the margins."""
    out, k, n = [], margin, len(bins)
    while k < n - margin:
        peak = min(max(bins[:k], default=0), max(bins[k:], default=0))
        e = k
        while e < n - margin and bins[e] < 0.3 * peak:
            e += 1
        if e > k and max(bins[e:], default=0) >= peak:
            out.append((k, e))
        k = max(e, k + 1)
    return out


def columns_at(items: list[Item], valleys: list[tuple[float, float]], least: int = 5, span: float = 0.3) -> list[tuple[float, float]]:
    """Columns between valleys that hold: enough items on both sides, over a share of the page's height; one column otherwise."""
    lo, hi = min(t["x"] for t in items), max(t["x"] + t["width"] for t in items)
    tall = max(t["y"] for t in items) - min(t["y"] for t in items)
    cuts = []
    for a, b in valleys:
        at = (a + b) / 2
        sides = [t for t in items if t["x"] + t["width"] / 2 < at], [t for t in items if t["x"] + t["width"] / 2 >= at]
        if all(len(s) >= least and max(t["y"] for t in s) - min(t["y"] for t in s) >= span * tall for s in sides):
            cuts.append(at)
    edges = [lo, *cuts, hi]
    return list(zip(edges, edges[1:]))


def have_prose(columns: list[tuple[float, float]], items: list[Item]) -> bool:
    """Whether most columns hold running text: lines of three words and more on the average, hardly any of figures alone."""
    hits = 0
    for a, b in columns:
        mine = [t for t in items if a <= t["x"] + t["width"] / 2 < b]
        lines = row_places([t["y"] for t in mine], [t["font_size"] for t in mine])
        words = sum(len(t["text"].split()) for t in mine)
        figures = sum(re.fullmatch(r"[\d.,%$€£()\-–— ]+", t["text"].strip()) is not None for t in mine)
        hits += bool(lines) and words / len(lines) >= WORDS and figures * 5 <= len(mine)
    return hits * 2 > len(columns)


def is_newspaper(columns: list[list[float]], widths: list[float], gap: float = 12.0) -> bool:
    """Columns (heights of their lines) that are read one after another: balanced ones, or half of the shortest's lines beside
    another's; with few lines only a narrow sparse sidebar."""
    if len(columns) < 2 or min(map(len, columns)) < 5:
        return False
    short, long = min(columns, key=len), max(columns, key=len)
    balance = len(short) / len(long)
    if len(short) < 15:
        narrow, wide = widths[columns.index(short)], widths[columns.index(long)]
        steps = [a - b for a, b in zip(sorted(short, reverse=True), sorted(short, reverse=True)[1:])]
        return narrow < 0.5 * wide and balance < 0.35 and len(long) >= 20 and wide >= 160 and bool(steps) and median(steps) >= 2.5 * gap
    others = [y for c in columns if c is not short for y in c]
    return balance > 0.7 or sum(any(abs(y - o) <= 5 for o in others) for y in short) * 2 > len(short)


# Regions in reading order


def line_bands(items: list[Item]) -> list[list[int]]:
    """Item numbers by line, from the top: items whose heights differ from the first by up to 0.4 of its size."""
    out: list[list[int]] = []
    for k in sorted(range(len(items)), key=lambda k: (-items[k]["y"], items[k]["x"])):
        if out and abs(items[out[-1][0]]["y"] - items[k]["y"]) <= 0.4 * max(items[out[-1][0]]["font_size"], 4):
            out[-1].append(k)
        else:
            out.append([k])
    return out


def regions(items: list[Item]) -> list[list[int]]:
    """Regions in reading order, each its item numbers in order: above before below, left before right.

    Lines that keep a gutter in common make one band of the page; a band of several lines with running text on both sides of
    its gutters is read column by column, any other line by line. A line across the gutter (a title, a full-width picture's
    caption) ends the band, so what stands above it is read before what stands below.
    """
    if not items:
        return []
    lo, hi = min(t["x"] for t in items), max(t["x"] + t["width"] for t in items)
    out: list[list[int]] = []
    band: list[list[int]] = []
    free: list[tuple[float, float]] = []

    def close() -> None:
        at = [k for ln in band for k in ln]
        cuts = [(a + b) / 2 for a, b in free if any(items[k]["x"] < a + 0.01 for k in at) and any(items[k]["x"] >= b - 0.01 for k in at)]
        parts: list[list[list[int]]] = [[] for _ in range(len(cuts) + 1)]
        for ln in band:
            for i in range(len(cuts) + 1):
                mine = [k for k in ln if sum(items[k]["x"] >= c for c in cuts) == i]
                if mine:
                    parts[i].append(mine)
        words = [mean(sum(len(items[k]["text"].split()) for k in ln) for ln in p) for p in parts if p]
        if cuts and min(map(len, parts)) >= LINES and min(words) >= WORDS:
            out.extend([k for ln in p for k in sorted(ln, key=lambda k: items[k]["x"])] for p in parts)
        elif at:
            out.append([k for ln in band for k in sorted(ln, key=lambda k: items[k]["x"])])

    for ln in line_bands(items):
        mine = free_stretches([items[k] for k in ln], lo, hi)
        both = shared_stretches(free, mine) if band else mine
        if band and not both and (free or mine):
            close()
            band, both = [], mine
        band.append(ln)
        free = both
    close()
    return out


def stream_is_order(items: list[Item]) -> bool:
    """Whether items come in the order they are read: under a fifth of the steps go up by over a line."""
    up = sum(b["y"] - a["y"] > 1.5 * max(a["font_size"], 4) for a, b in zip(items, items[1:]))
    return up * 5 < max(1, len(items) - 1)


def reading_order(df: DataFrame) -> DataFrame:
    """(result_id, page_no, item_no, region_no, order_no): each page's items by region and in reading order.

    Null and empty texts and items without a place have none; repeated items count once; an empty table gives no rows.
    """

    def one(ts: list[Item]) -> Iterator[tuple]:
        n = 0
        for r, at in enumerate(regions(ts), 1):
            for k in at:
                n += 1
                yield ts[k]["item_no"], r, n

    return _pages(df, "item_no int, region_no int, order_no int", one)


def hint_bands(items: list[Item], hints: list[tuple[float, float, float, float]]) -> list[tuple[float, float]]:
    """Stretches of the page's width, split between hint boxes side by side that hold ten items each."""
    lo, hi = min(t["x"] for t in items), max(t["x"] + t["width"] for t in items)
    good = sorted(h for h in hints if sum(h[0] <= t["x"] + t["width"] / 2 <= h[2] and h[1] <= t["y"] <= h[3] for t in items) >= 10)
    cuts = [(a[2] + b[0]) / 2 for a, b in zip(good, good[1:]) if b[0] >= a[2] - 3 and min(a[3], b[3]) > max(a[1], b[1])]
    edges = [lo, *cuts, hi]
    return list(zip(edges, edges[1:]))


# Lines and headings


def formatted(text: str, bold: bool = False, italic: bool = False, underline: bool = False, strike: bool = False, options: MarkdownOptions | None = None) -> str:
    """Text with its inline marks outside of which white space stays; strike beats underline, and either stands alone."""
    o = options or MarkdownOptions()
    core = text.strip()
    if not core:
        return text
    if o.decorations and (strike or underline):
        mark = ("~~", "~~") if strike else ("<u>", "</u>")
    else:
        sign = "**" * (bold and o.bold) + "*" * (italic and o.italic)
        mark = (sign, sign[::-1])
    at = text.index(core)
    return text[:at] + mark[0] + core + mark[1] + text[at + len(core) :]


# Words that end a fragment rather than a heading.
OPEN_ENDS = frozenset("a an and as at by for from in is of on or that the to was were with which".split())


def is_fragment(text: str) -> bool:
    """A line that can't be a heading: formulas, text that starts in or ends in the middle of a sentence, signs more than letters."""
    t = text.strip()
    letters = sum(c.isalpha() for c in t)
    if not letters or letters * 2 < len(t.replace(" ", "")):
        return True
    if re.search(r"[=≤≥≠±∑∫√∞∂→]|\b\w\^\w|\\[a-z]+", t):
        return True
    words = t.split()
    return t[0].islower() and len(words) > 1 or words[-1].lower().strip(".,;:") in OPEN_ENDS or t[-1] in ",;" or t.count("(") != t.count(")")


def merge_drop_caps(lines: list[dict]) -> list[dict]:
    """A large single capital put before the line beside or below it that goes on with small letters."""
    out: list[dict] = []
    k = 0
    while k < len(lines):
        a, b = lines[k], lines[k + 1] if k + 1 < len(lines) else None
        if b and len(a["text"].strip()) == 1 and a["text"].strip().isupper() and a["font_size"] >= 1.8 * b["font_size"] and b["text"][:1].islower() and abs(a["y"] - b["y"]) <= 2 * a["font_size"]:
            out.append({**b, "text": a["text"].strip() + b["text"]})
            k += 2
        else:
            out.append(a)
            k += 1
    return out


def merge_headings(lines: list[dict], base: float) -> list[dict]:
    """Consecutive heading lines (1.2 of the base size) of one size that are near each other, as one."""
    out: list[dict] = []
    for ln in lines:
        last = out[-1] if out else None
        if last and min(ln["font_size"], last["font_size"]) >= 1.2 * base and abs(ln["font_size"] - last["font_size"]) <= 0.5 and 0 < last["y"] - ln["y"] <= 1.8 * ln["font_size"] and not re.search(r"[.!?:]$", last["text"]) and len((last["text"] + ln["text"]).split()) <= 20:
            out[-1] = {**last, "text": f"{last['text']} {ln['text']}", "y": ln["y"]}
        else:
            out.append(dict(ln))
    return out


def bold_paragraph_lines(lines: list[dict], base: float, gap: float) -> set[int]:
    """Numbers of bold lines of body size that are part of a bold paragraph over several lines: no headings."""
    out: set[int] = set()
    run: list[int] = []
    for k, ln in enumerate([*lines, {"bold": False, "font_size": 0, "y": 0, "text": ""}]):
        near = run and lines[run[-1]]["y"] - ln["y"] <= gap
        if ln["bold"] and ln["font_size"] <= 1.1 * base and (not run or near):
            run.append(k)
            continue
        text = " ".join(lines[i]["text"] for i in run)
        if len(run) >= 2 and (len(text.split()) > 15 or re.search(r"[.!?]\s", text)):
            out.update(run)
        run = [k] if ln["bold"] and ln["font_size"] <= 1.1 * base else []
    return out


def merge_bold_headings(lines: list[dict], base: float, gap: float) -> list[dict]:
    """Bold lines of body size that wrap over two or three lines and are no paragraph, as one heading line."""
    paragraph = bold_paragraph_lines(lines, base, gap)
    out: list[dict] = []
    run = 0
    for k, ln in enumerate(lines):
        last = out[-1] if out else None
        if last and k - 1 not in paragraph and k not in paragraph and last["bold"] and ln["bold"] and last["font_size"] <= 1.1 * base and abs(ln["font_size"] - last["font_size"]) <= 0.5 and 0 < last["y"] - ln["y"] <= gap and run < 3 and not re.search(r"[.!?:]$", last["text"]):
            out[-1] = {**last, "text": f"{last['text']} {ln['text']}", "y": ln["y"]}
            run += 1
        else:
            out.append(dict(ln))
            run = 1
    return out


SEQUENCES = [("decimal", re.compile(r"^(\d{1,3}(?:\.\d{1,3})*)[.)]?\s+\S")), ("roman", re.compile(r"^([IVXLC]{1,6})[.)]\s+\S")), ("letter", re.compile(r"^([A-Z])[.)]\s+\S"))]


def heading_sequences(lines: list[str]) -> list[tuple[int, str, int]]:
    """(line number, kind, depth) of the lines that go on a numbering: each number follows one of its kind and depth, or begins one."""
    values = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
    last: dict[tuple[str, int], int] = {}
    hits: list[tuple[int, str, int, int]] = []
    for k, ln in enumerate(lines):
        for kind, rx in SEQUENCES:
            m = rx.match(ln.strip())
            if not m:
                continue
            label = m[1]
            parts = label.split(".") if kind == "decimal" else [label]
            depth = len(parts)
            n = int(parts[-1]) if kind == "decimal" else ord(label) - 64 if kind == "letter" else sum(-values[a] if b and values[a] < values[b] else values[a] for a, b in zip(label, [*label[1:], ""]))
            before = last.get((kind, depth), 0)
            if n == before + 1 or n == 1:
                last[kind, depth] = n
                for key in [x for x in last if x[0] == kind and x[1] > depth]:
                    del last[key]
                hits.append((k, kind, depth, n))
                break
    often = Counter(h[1:3] for h in hits)
    return [h[:3] for h in hits if often[h[1:3]] >= 2]


def folio_items(pages: list[list[tuple[float, int | None]]]) -> list[set[int]]:
    """For each page, numbers of the edge items (height, value or None) that count the pages: a number at nearly one height whose
    difference to the page's place is that of the page before or after."""
    out: list[set[int]] = []
    for p, items in enumerate(pages):
        mine = set()
        for k, (y, v) in enumerate(items):
            if v is not None and any(w is not None and w - v == q - p and abs(y - z) <= 12 for q in (p - 1, p + 1) if 0 <= q < len(pages) for z, w in pages[q]):
                mine.add(k)
        out.append(mine)
    return out


def heading_fragments(df: DataFrame) -> DataFrame:
    """(block's columns, fragment): whether each heading's text could be none. Batches of rows, no shuffle."""
    kind = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else is_fragment(x) if x.strip() else True).astype(object), "boolean")
    return df.withColumn("fragment", kind("text"))


def visual_order(df: DataFrame, text: str = "text") -> DataFrame:
    """df with logical_text: what the text reads if it is stored as shown, from left to right."""

    @F.pandas_udf("string")
    def turn(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else reverse_visual(x))

    return df.withColumn("logical_text", turn(text))
