"""Geometric steps that need a page's items together: merging, rows, columns, borderless tables, regions, structure cells.

Each runs as one grouped map by document and page; a page is the unit that always fits a task. The pure functions take
items as (text, x, y, width, size, flags...) tuples and can be used without Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from statistics import mean as exact_mean

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Item = dict


def mean(values: list[float]) -> float:
    """statistics.mean, told at once of one place, of places that are all the same and of two (halves are exact)."""
    a = values[0] if type(values) is list and values else None
    if type(a) is float and values.count(a) == len(values):
        return a
    return (a + values[1]) / 2 if type(a) is float and len(values) == 2 and type(values[1]) is float else exact_mean(values)


def merge_items(items: list[Item]) -> list[Item]:
    """Items of one line (within 5 points) joined while style and size agree and the gap is between -0.5 and 0.5 em.

    A gap over 0.08 em is a space. Items keep the place of their first part.
    """
    rows: list[list[Item]] = []
    for t in sorted(items, key=lambda t: (-t["y"], t["x"])):
        row = next((r for r in rows if abs(r[0]["y"] - t["y"]) <= 5), None)
        if row is None:
            rows.append([t])
        else:
            row.append(t)
    out: list[Item] = []
    for row in rows:
        row.sort(key=lambda t: t["x"])
        cur = None
        for t in row:
            size = max(t["font_size"], 1.0)
            if cur is not None:
                gap = (t["x"] - cur["x"] - cur["width"]) / size
                same = all(bool(cur.get(k)) == bool(t.get(k)) for k in ("is_bold", "is_italic", "is_underline", "is_strikeout"))
                if same and abs(cur["font_size"] - t["font_size"]) <= 0.2 * max(cur["font_size"], size) and -0.5 <= gap <= 0.5:
                    space = " " if gap > 0.08 and not cur["text"].endswith(" ") and not t["text"].startswith(" ") else ""
                    cur["text"] += space + t["text"]
                    cur["width"] = t["x"] + t["width"] - cur["x"]
                    continue
                out.append(cur)
            cur = dict(t)
        if cur is not None:
            out.append(cur)
    return out


def row_places(ys: list[float], sizes: list[float]) -> list[float]:
    """Rows from the top: a new one where the running mean of the row lies max(0.8 of the upper median size, 4) above."""
    if not ys:
        return []
    step = max(0.8 * sorted(sizes)[len(sizes) // 2], 4.0)
    out: list[list[float]] = []
    for y in sorted(ys, reverse=True):
        if out and mean(out[-1]) - y < step:
            out[-1].append(y)
        else:
            out.append([y])
    return [mean(g) for g in out]


def column_places(xs: list[float]) -> list[float]:
    """Left edges of columns: places split where the gap is over the mean gap, held between 25 and 50 points."""
    s = sorted(xs)
    gaps = [b - a for a, b in zip(s, s[1:]) if b - a > 1]
    limit = min(50.0, max(25.0, mean(gaps))) if gaps else 25.0
    out: list[list[float]] = []
    for x in s:
        if out and x - out[-1][-1] < limit:
            out[-1].append(x)
        else:
            out.append([x])
    return [min(g) for g in out]


def snap_edges(values: list[float], tolerance: float) -> list[float]:
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - mean(out[-1]) <= tolerance:
            out[-1].append(v)
        else:
            out.append([v])
    return [mean(g) for g in out]


def merge_intervals(parts: list[tuple[float, float]], gap: float = 1.0) -> list[tuple[float, float]]:
    """Touching stretches as one."""
    out: list[tuple[float, float]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def clusters(rects: list[tuple[float, float, float, float]], tolerance: float = 3.0) -> list[list[int]]:
    """Rectangles (x1, y1, x2, y2) that overlap within a tolerance, as connected groups; swept from left to right."""
    parent = list(range(len(rects)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    live: list[int] = []
    for i in sorted(range(len(rects)), key=lambda i: rects[i][0]):
        a = rects[i]
        live = [j for j in live if rects[j][2] + tolerance >= a[0]]
        for j in live:
            b = rects[j]
            if a[1] - tolerance <= b[3] and b[1] - tolerance <= a[3]:
                parent[root(i)] = root(j)
        live.append(i)
    groups: dict[int, list[int]] = {}
    for i in range(len(rects)):
        groups.setdefault(root(i), []).append(i)
    return sorted(groups.values())


def page_columns(items: list[Item], bin_width: float = 2.0) -> list[tuple[float, float]]:
    """Columns of a page from the gutters of its occupancy histogram: at least 8 points wide, in the middle nine tenths.

    Items wider than 60 % of the page don't count; under 20 items or 200 points there is one column.
    """
    if not items:
        return []
    lo, hi = min(t["x"] for t in items), max(t["x"] + t["width"] for t in items)
    span = hi - lo
    narrow = [t for t in items if t["width"] <= 0.6 * span]
    if len(narrow) < 20 or span < 200:
        return [(lo, hi)]
    bins = [0] * (int(span / bin_width) + 1)
    for t in narrow:
        for k in range(int((t["x"] - lo) / bin_width), min(len(bins) - 1, int((t["x"] + t["width"] - lo) / bin_width)) + 1):
            bins[k] += 1
    noise = 0.15 * sorted(bins)[len(bins) * 3 // 4]
    cuts, k = [], 0
    while k < len(bins):
        if bins[k] <= noise:
            e = k
            while e < len(bins) and bins[e] <= noise:
                e += 1
            a, b = lo + k * bin_width, lo + e * bin_width
            if b - a >= 8 and a > lo + 0.05 * span and b < hi - 0.05 * span:
                left = sum(t["x"] + t["width"] / 2 < (a + b) / 2 for t in narrow)
                if min(left, len(narrow) - left) >= 5:
                    cuts.append((a + b) / 2)
            k = e
        k += 1
    edges = [lo, *cuts, hi]
    return list(zip(edges, edges[1:]))


DATA = re.compile(r"^[(+\-]?[$€£]?\s*[\d.,]+\s*%?\)?$|^–$")


def borderless_table(items: list[Item], base: float) -> list[list[str]] | None:
    """Rows and columns of aligned items without rules, or None: six items, two columns and rows, even rows, enough data."""
    if len(items) < 6:
        return None
    rows, cols = row_places([t["y"] for t in items], [t["font_size"] for t in items]), column_places([t["x"] for t in items])
    if len(rows) < 2 or not 2 <= len(cols) <= 25:
        return None
    grid = [["" for _ in cols] for _ in rows]
    for t in sorted(items, key=lambda t: (-t["y"], t["x"])):
        r = min(range(len(rows)), key=lambda i: abs(rows[i] - t["y"]))
        c = max(i for i in range(len(cols)) if cols[i] <= t["x"] + 0.01)
        grid[r][c] = (grid[r][c] + " " + t["text"].strip()).strip()
    filled = [sum(bool(x) for x in r) for r in grid]
    mode = max(Counter(filled).items(), key=lambda x: (x[1], x[0]))[0]
    even = sum(abs(f - mode) <= 2 for f in filled) / len(filled)
    cells = [x for r in grid[1:] for x in r if x]
    share = sum(bool(DATA.match(x)) for x in cells) / max(1, len(cells))
    if (len(rows) >= 3 and even <= 0.4) or mode < 2 or share <= (0.2 if base < 9 else 0.3):
        return None
    return clean_cells(grid)[0]


def clean_cells(grid: list[list[str]]) -> tuple[list[list[str]], list[str]]:
    """(rows, footnotes): empty rows go, footnote rows leave, a row that only continues the one above is put into it."""
    rows: list[list[str]] = []
    notes: list[str] = []
    for r in grid:
        text = " ".join(x for x in r if x).strip()
        if not text:
            continue
        if re.match(r"\(\d{1,2}\)|\d{1,2}\)|notes?:", text, re.I):
            notes.append(text)
            continue
        numeric = sum(bool(DATA.match(x)) for x in r if x) * 2 > sum(bool(x) for x in r)
        if rows and len(rows) > 1 and not r[0] and any(r[1:]) and not numeric and len(text.encode()) > 5:
            rows[-1] = [f"{a} {b}".strip() for a, b in zip(rows[-1], r)]
        else:
            rows.append(list(r))
    return rows, notes


def table_markdown(rows: list[list[str]], notes: list[str] = ()) -> str:
    """Compact pipe table; a table of contents (titles and page numbers) as lines."""
    if not rows:
        return ""
    last = [r[-1] for r in rows if r[-1]]
    if len(rows) >= 3 and len(rows[0]) <= 3 and len(last) * 10 >= len(rows) * 7 and all(re.fullmatch(r"\d{1,4}", x) for x in last) and [int(x) for x in last] == sorted(int(x) for x in last) and all(re.search(r"[^\W\d]", r[0]) for r in rows):
        return "\n".join(" ".join(x.strip(". ") for x in r if x) for r in rows)
    line = lambda r: "|" + "|".join(x.replace("|", "\\|") for x in r) + "|"
    return "\n".join([line(rows[0]), "|" + "---|" * len(rows[0]), *map(line, rows[1:]), *(["", *notes] if notes else [])])


def parse_structure(tokens: list[str]) -> list[tuple[int, int, int, int, bool]]:
    """(row, column, row span, column span, header) of each cell of a table-structure token list."""
    out, taken = [], set()
    row, head, spans = -1, False, [1, 1]

    def place() -> None:
        c = 0
        while (row, c) in taken:
            c += 1
        for i in range(spans[0]):
            for j in range(spans[1]):
                taken.add((row + i, c + j))
        out.append((row, c, spans[0], spans[1], head))

    for t in tokens:
        if t == "<thead>":
            head = True
        elif t == "</thead>":
            head = False
        elif t == "<tr>":
            row += 1
        elif t in ("<td>", "<td></td>"):
            spans = [1, 1]
            place()
        elif t == "<td":
            spans = [1, 1]
        elif m := re.match(r"\s*(row|col)span=\"?(\d{1,4})\"?", t):
            spans[m[1] == "col"] = max(1, min(1000, int(m[2])))
        elif t == ">":
            place()
    return out


def fill_cells(cells: list[tuple[float, float, float, float]], items: list[Item]) -> list[str]:
    """Text of each cell box (x1, y1, x2, y2): items by their centre; what lies in none goes to the nearest empty cell."""
    got: list[list[Item]] = [[] for _ in cells]
    rest = []
    for t in items:
        cx, cy = t["x"] + t["width"] / 2, t["y"] + t["font_size"] * 0.3
        k = next((i for i, (a, b, c, d) in enumerate(cells) if a <= cx <= c and b <= cy <= d), None)
        if k is None:
            rest.append((t, cx, cy))
        else:
            got[k].append(t)
    for t, cx, cy in rest:
        near = [(abs(cx - (a + c) / 2) / max(1.0, c - a) + abs(cy - (b + d) / 2) / max(1.0, d - b), i) for i, (a, b, c, d) in enumerate(cells) if not got[i]]
        if near and min(near)[0] <= 1.0:
            got[min(near)[1]].append(t)
    return [" ".join(t["text"].strip() for t in sorted(g, key=lambda t: (-round(t["y"]), t["x"]))) for g in got]


def _pages(df: DataFrame, schema: str, fn: Callable[[list[Item]], Iterator[tuple]]) -> DataFrame:
    """fn over each page's items, in order of their numbers; columns result_id and page_no come first.

    A page's items are gathered as one row, so that whole batches of pages go to Python at once; null and empty texts are left out.
    """
    page = ["result_id", "page_no"]
    names = ["item_no", *[c for c in ("text", "x", "y", "width", "height", "font", "font_size", "is_bold", "is_italic", "is_underline", "is_strikeout", "mcid") if c in df.columns]]
    its = df.where("text <> ''").dropna(subset=["x", "y", "width", "font_size"]).dropDuplicates([*page, "item_no"]).groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("its"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*page, *(f.split()[0] for f in schema.split(", "))]
        for pdf in batches:
            rows = [(r, p, *x) for r, p, ts in pdf.itertuples(index=False, name=None) for x in fn([dict(t) for t in ts])]
            yield pd.DataFrame(rows, columns=columns).astype(object)

    return its.mapInPandas(run, f"result_id long, page_no int, {schema}")


def merged(df: DataFrame) -> DataFrame:
    return _pages(df, "item_no int, text string, x float, y float, width float", lambda ts: ((i, t["text"], t["x"], t["y"], t["width"]) for i, t in enumerate(merge_items(ts), 1)))


def columns(df: DataFrame) -> DataFrame:
    return _pages(df, "col_no int, x1 double, x2 double, n_items int", lambda ts: ((i, a, b, sum(a <= t["x"] + t["width"] / 2 < b for t in ts)) for i, (a, b) in enumerate(page_columns(ts), 1)))


def tables(df: DataFrame, base: float = 12.0) -> DataFrame:
    def one(ts: list[Item]) -> Iterator[tuple]:
        rows = borderless_table(ts, base)
        if rows:
            yield len(rows), len(rows[0]), table_markdown(rows)

    return _pages(df, "n_rows int, n_cols int, markdown string", one)


def region_text(df: DataFrame, assigned: DataFrame) -> DataFrame:
    """(result_id, page_no, region_no, text): the text of each region, top to bottom and left to right, items exclusive."""
    j = df.select("result_id", "page_no", "item_no", "text", "x", "y").dropDuplicates(["result_id", "page_no", "item_no"]).join(assigned.select("result_id", "page_no", "item_no", "region_no"), ["result_id", "page_no", "item_no"])
    order = F.struct((-F.round("y")).alias("y"), "x", "item_no", F.coalesce("text", F.lit("")).alias("t"))
    return j.groupBy("result_id", "page_no", "region_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["t"]), " ").alias("text"))


def normalize_bands(cells: list[dict]) -> list[dict]:
    """Cells (row, col, box x1 y1 x2 y2) with row and column bands that don't overlap: neighbours meet half way."""
    out = [dict(c) for c in cells]
    for key, lo, hi in (("row", 1, 3), ("col", 0, 2)):
        bands: dict[int, list[float]] = {}
        for c in out:
            b = bands.setdefault(c[key], [c["box"][lo], c["box"][hi]])
            b[0], b[1] = min(b[0], c["box"][lo]), max(b[1], c["box"][hi])
        order = sorted(bands, key=lambda k: bands[k][0])
        for a, b in zip(order, order[1:]):
            if bands[a][1] > bands[b][0]:
                bands[a][1] = bands[b][0] = (bands[a][1] + bands[b][0]) / 2
        for c in out:
            box = list(c["box"])
            box[lo], box[hi] = max(box[lo], bands[c[key]][0]), min(box[hi], bands[c[key]][1])
            c["box"] = tuple(box)
    return out


def cells_markdown(cells: list[dict]) -> str:
    """Cells (row, col, text, spans allowed) as a compact pipe table; places without a cell are empty."""
    if not cells:
        return ""
    rows, cols = max(c["row"] for c in cells) + 1, max(c["col"] + c.get("cols", 1) for c in cells)
    grid = [["" for _ in range(cols)] for _ in range(rows)]
    for c in cells:
        grid[c["row"]][c["col"]] = c["text"]
    return table_markdown(grid)


def quality_issue(rows: list[list[str]]) -> str | None:
    """What is wrong with a filled structure: an empty row between full ones, or several lines in most cells of a row."""
    full = [any(x.strip() for x in r) for r in rows]
    if any(not f and any(full[:i]) and any(full[i + 1 :]) for i, f in enumerate(full)):
        return "phantom_empty_row"
    for r in rows:
        many = [x for x in r if x.count("\n") >= 1]
        if len(many) >= 2 and len(many) * 2 >= sum(bool(x) for x in r):
            return "multi_row_in_cell"
    return None


def best_candidate(candidates: list[tuple[str, list[list[str]]]]) -> tuple[str, list[list[str]]] | None:
    """Of detectors' tables the one with the most filled cells for its size; the earlier one in case of ties."""
    def evidence(rows: list[list[str]]) -> float:
        cells = [x for r in rows for x in r]
        return sum(bool(x) for x in cells) * (sum(bool(x) for x in cells) / max(1, len(cells)))

    good = [c for c in candidates if c[1] and quality_issue(c[1]) is None]
    return max(good, key=lambda c: evidence(c[1]), default=None)
