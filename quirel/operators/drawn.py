"""Tables of a page from what is drawn and how text stands: rectangles, stripes, boxes, rules, anchors; charts are kept out.

Pure functions over one page's items (dicts with text, x, y, width, font_size), rectangles (x1, y1, x2, y2) and rules
(horizontal: x1, x2, y; vertical: x, y1, y2); y grows upwards. A found table is Table(rows, used items, upper edge, detector).
`drawn_tables` runs the cascade over a DataFrame, a page at a time; pages of one layout (`layout`) share one run of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import median

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import DATA, Item, clean_cells, clusters, column_places, mean, merge_intervals, row_places, snap_edges, table_markdown

Box = tuple[float, float, float, float]
#: Edges within this are one; columns of the widest grid; share of a grid's cells that rectangles must back.
SNAP, COLUMNS_MAX, BACKED = 6.0, 25, 0.5
NUMBER = re.compile(r"^[0-9,.()\-+%]*[0-9][0-9,.()\-+%]*$")
#: Texts without signs that a step may look for (colons, brackets, pipes) and without outer spaces; layouts a worker keeps at most.
PLAIN, LAYOUTS_MAX = r"^[!-'*-9;-{}~](?:[ -'*-9;-{}~]*[!-'*-9;-{}~])?$", 20_000


@dataclass
class Table:
    rows: list[list[str]]
    used: set[int]
    top: float
    detector: str


def middle(t: Item) -> tuple[float, float]:
    return t["x"] + t["width"] / 2, t["y"] + t["font_size"] * 0.3


def inside(t: Item, box: Box, margin: float = 0.0) -> bool:
    x, y = middle(t)
    return box[0] - margin <= x <= box[2] + margin and box[1] - margin <= y <= box[3] + margin


def bounds(boxes: list[Box]) -> Box:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def joined(items: list[Item], at: list[int]) -> str:
    """Text of some items, top to bottom and left to right."""
    return " ".join(items[k]["text"].strip() for k in sorted(at, key=lambda k: (-round(items[k]["y"]), items[k]["x"])) if items[k]["text"].strip())


def into_grid(items: list[Item], xs: list[float], ys: list[float]) -> tuple[list[list[str]], set[int]]:
    """Items by the bands of ascending column edges and descending row edges."""
    cells: dict[tuple[int, int], list[int]] = {}
    for k, t in enumerate(items):
        x, y = middle(t)
        x = min(x, t["x"] + t["font_size"])
        c = next((i for i in range(len(xs) - 1) if xs[i] <= x < xs[i + 1]), None)
        r = next((i for i in range(len(ys) - 1) if ys[i] >= y > ys[i + 1]), None)
        if c is not None and r is not None:
            cells.setdefault((r, c), []).append(k)
    rows = [[joined(items, cells.get((r, c), [])) for c in range(len(xs) - 1)] for r in range(len(ys) - 1)]
    return rows, {k for at in cells.values() for k in at}


def dedup_rects(rects: list[Box], tolerance: float = 0.5) -> list[Box]:
    """Rectangles that aren't drawn before at nearly the same place; looked up by rounded corners and their neighbours."""
    seen: dict[tuple[int, int], list[Box]] = {}
    out = []
    for r in rects:
        a, b = int(r[0] // tolerance), int(r[1] // tolerance)
        near = [q for i in (a - 1, a, a + 1) for j in (b - 1, b, b + 1) for q in seen.get((i, j), ())]
        if not any(all(abs(u - v) <= tolerance for u, v in zip(r, q)) for q in near):
            seen.setdefault((a, b), []).append(r)
            out.append(r)
    return out


def good(rows: list[list[str]], least: int = 2) -> bool:
    """Whether a grid has text in two rows and two columns, and in a quarter of its places."""
    full = [(i, j) for i, r in enumerate(rows) for j, x in enumerate(r) if x]
    return len({i for i, _ in full}) >= least and len({j for _, j in full}) >= 2 and len(full) * 4 >= sum(map(len, rows))


def spread_merged(rows: list[list[str]], xs: list[float], ys: list[float], rects: list[Box], doubts: list[str] | None = None) -> list[list[str]]:
    """The text of a rectangle that spans several rows of one column, in each of these rows."""
    out = [list(r) for r in rows]
    for x1, y1, x2, y2 in rects:
        cols = [c for c in range(len(xs) - 1) if x1 - SNAP <= xs[c] and xs[c + 1] <= x2 + SNAP]
        band = [r for r in range(len(ys) - 1) if y1 - SNAP <= ys[r + 1] and ys[r] <= y2 + SNAP]
        if len(cols) == 1 and 2 <= len(band) < len(rows):
            texts = {out[r][cols[0]] for r in band if out[r][cols[0]]}
            if len(texts) == 1:
                for r in band:
                    out[r][cols[0]] = next(iter(texts))
            elif texts and doubts is not None:
                doubts.append("texts may be equal")
    return out


def rect_grid(items: list[Item], rects: list[Box], doubts: list[str] | None = None) -> Table | None:
    """Rectangles as cells of a grid: three edges across and down at least, half of the places backed by a rectangle."""
    xs = snap_edges([v for r in rects for v in (r[0], r[2])], SNAP)
    ys = snap_edges([v for r in rects for v in (r[1], r[3])], SNAP)[::-1]
    if len(xs) < 3 or len(ys) < 3 or len(xs) - 1 > COLUMNS_MAX:
        return None
    whole = bounds(rects)
    backed = set()
    for r in rects:
        if (r[2] - r[0]) > 0.95 * (whole[2] - whole[0]) and (r[3] - r[1]) > 0.95 * (whole[3] - whole[1]):
            continue
        backed |= {(i, j) for i in range(len(ys) - 1) for j in range(len(xs) - 1) if r[0] - SNAP <= xs[j] and xs[j + 1] <= r[2] + SNAP and r[1] - SNAP <= ys[i + 1] and ys[i] <= r[3] + SNAP}
    if len(backed) < BACKED * (len(xs) - 1) * (len(ys) - 1):
        return None
    rows, used = into_grid(items, xs, ys)
    return Table(spread_merged(rows, xs, ys, rects, doubts), used, ys[0], "rects") if good(rows) else None


def stripe_table(items: list[Item], rects: list[Box]) -> Table | None:
    """Zebra stripes: three or more bands of one width and left edge; rows are stripes and the gaps between, columns come from the text."""
    bands = [r for r in rects if r[2] - r[0] > 5 * (r[3] - r[1])]
    groups: dict[tuple[int, int], list[Box]] = {}
    for r in bands:
        groups.setdefault((round(r[0] / SNAP), round(r[2] / SNAP)), []).append(r)
    best = max(groups.values(), key=len, default=[])
    if len(best) < 3:
        return None
    best.sort(key=lambda r: -r[3])
    high = median(r[3] - r[1] for r in best)
    edges = sorted({round(v, 1) for r in best for v in (r[1], r[3])}, reverse=True)
    edges = [edges[0], *(b for a, b in zip(edges, edges[1:]) if a - b > 0.4 * high)]
    if any(not 0.5 * high <= a - b <= 2 * high for a, b in zip(edges, edges[1:])):
        return None
    edges = [edges[0] + high, *edges, edges[-1] - high]
    mine = [k for k, t in enumerate(items) if best[0][0] - SNAP <= t["x"] <= best[0][2] + SNAP and edges[-1] < middle(t)[1] <= edges[0]]
    if len(mine) < 6:
        return None
    xs = [*column_places([items[k]["x"] for k in mine]), best[0][2] + SNAP]
    xs[0] -= 1
    if not 3 <= len(xs) <= COLUMNS_MAX + 1:
        return None
    rows, used = into_grid([items[k] for k in mine], [x - 0.5 for x in xs], edges)
    rows = [r for r in rows if any(r)]
    return Table(rows, {mine[k] for k in used}, edges[1], "stripes") if good(rows, 3) else None


def box_table(items: list[Item], rects: list[Box]) -> Table | None:
    """Boxes stacked in columns of equal extent: each box is a cell, its items its text."""
    boxes = [r for r in rects if r[2] - r[0] > 20 and r[3] - r[1] > 8 and any(inside(t, r) for t in items)]
    boxes = [r for r in boxes if sum(q != r and q[0] >= r[0] - 1 and q[1] >= r[1] - 1 and q[2] <= r[2] + 1 and q[3] <= r[3] + 1 for q in boxes) == 0]
    if len(boxes) < 4:
        return None
    cols, rows_at = snap_edges([b[0] for b in boxes], SNAP), snap_edges([b[3] for b in boxes], SNAP)[::-1]
    if len(cols) < 2 or len(rows_at) < 2 or len(cols) > COLUMNS_MAX or len(boxes) < BACKED * len(cols) * len(rows_at):
        return None
    rows = [["" for _ in cols] for _ in rows_at]
    used: set[int] = set()
    for b in boxes:
        c = min(range(len(cols)), key=lambda i: abs(cols[i] - b[0]))
        r = min(range(len(rows_at)), key=lambda i: abs(rows_at[i] - b[3]))
        at = [k for k, t in enumerate(items) if inside(t, b)]
        rows[r][c] = joined(items, at)
        used.update(at)
    return Table(rows, used, rows_at[0], "boxes") if good(rows) else None


def chart_regions(items: list[Item], rects: list[Box]) -> list[Box]:
    """Bar charts: four or more filled bars on one base line (or from one left edge) of differing length, hardly any with text inside."""
    out = []
    for side in (0, 1):
        groups: dict[int, list[Box]] = {}
        for r in rects:
            groups.setdefault(round((r[1] if side else r[0]) / 3), []).append(r)
        for bars in groups.values():
            length = [b[2 + side] - b[side] for b in bars]
            thick = [b[3 - side] - b[1 - side] for b in bars]
            if len(bars) < 4 or max(thick) > 2 * min(thick) + 1 or len({round(v / 3) for v in length}) < max(3, len(bars) // 2):
                continue
            if sum(any(inside(t, b) for t in items) for b in bars) * 3 <= len(bars):
                out.append(bounds(bars))
    return merge_boxes(out)


def line_chart_regions(rules: list[tuple[float, float, float, float]]) -> list[Box]:
    """Plots: clusters of twenty or more strokes of which over a third are neither level nor upright."""
    boxes = [(min(a, c), min(b, d), max(a, c), max(b, d)) for a, b, c, d in rules]
    out = []
    for g in clusters(boxes):
        slanted = sum(min(boxes[k][2] - boxes[k][0], boxes[k][3] - boxes[k][1]) > 1 for k in g)
        if len(g) >= 20 and slanted * 3 > len(g):
            out.append(bounds([boxes[k] for k in g]))
    return merge_boxes(out)


def merge_boxes(boxes: list[Box], tolerance: float = 3.0) -> list[Box]:
    """Overlapping boxes as one."""
    return [bounds([boxes[k] for k in g]) for g in clusters(boxes, tolerance)] if boxes else []


def merge_hints(hints: list[Box], gap: float = 20.0) -> list[Box]:
    """Hint regions that share a band of heights (half of the lower one) and lie close, as one; from the top."""
    out: list[Box] = []
    for h in sorted(hints, key=lambda b: (-b[3], b[0])):
        for i, o in enumerate(out):
            shared = min(h[3], o[3]) - max(h[1], o[1])
            if shared >= 0.5 * min(h[3] - h[1], o[3] - o[1]) and h[0] <= o[2] + gap and o[0] <= h[2] + gap:
                out[i] = bounds([h, o])
                break
        else:
            out.append(h)
    return out


def rect_tables(items: list[Item], rects: list[Box], doubts: list[str] | None = None) -> tuple[list[Table], list[Box]]:
    """(tables, hint regions) of a page's rectangles: each cluster as grid, stripes or boxes, else a hint; then all as one grid."""
    charts = chart_regions(items, rects)
    rects = [r for r in dedup_rects(rects) if not any(c[0] - 1 <= r[0] and r[2] <= c[2] + 1 and c[1] - 1 <= r[1] and r[3] <= c[3] + 1 for c in charts)]
    tables, hints = [], []
    for g in clusters(rects):
        part = [rects[k] for k in g]
        found = rect_grid(items, part, doubts) or box_table(items, part)
        if found:
            tables.append(found)
        elif len(part) >= 2:
            hints.append(bounds(part))
    if not tables and len(rects) >= 3:
        found = stripe_table(items, rects) or box_table(items, rects) or rect_grid(items, rects, doubts)
        if found:
            found.detector = {"rects": "merged_clusters"}.get(found.detector, found.detector)
            return [found], []
    return tables, merge_hints(hints)


def split_rules(rules: list[tuple[float, float, float, float]]) -> tuple[list[tuple[float, float, float]], list[tuple[float, float, float]]]:
    """(horizontal x1, x2, y; vertical x, y1, y2) of straight strokes, touching ones of one line as one."""
    level: dict[float, list[tuple[float, float]]] = {}
    upright: dict[float, list[tuple[float, float]]] = {}
    for a, b, c, d in rules:
        if abs(b - d) < 1 <= abs(a - c):
            level.setdefault(round((b + d) / 2), []).append((min(a, c), max(a, c)))
        elif abs(a - c) < 1 <= abs(b - d):
            upright.setdefault(round((a + c) / 2), []).append((min(b, d), max(b, d)))
    hs = [(x1, x2, float(y)) for y, parts in level.items() for x1, x2 in merge_intervals(parts) if x2 - x1 > 10]
    vs = [(float(x), y1, y2) for x, parts in upright.items() for y1, y2 in merge_intervals(parts) if y2 - y1 > 5]
    return hs, vs


def line_grid(items: list[Item], rules: list[tuple[float, float, float, float]]) -> Table | None:
    """Ruled tables: a full grid; with outer uprights missing, the ends of the level rules are the outer edges."""
    hs, vs = split_rules(rules)
    if len(hs) < 2:
        return None
    ys = snap_edges([h[2] for h in hs], 3.0)[::-1]
    xs = snap_edges([v[0] for v in vs], 3.0)
    name = "rules"
    left, right = median(h[0] for h in hs), median(h[1] for h in hs)
    if xs and (xs[0] - left > SNAP or right - xs[-1] > SNAP) and len(hs) >= 3:
        xs = sorted({*xs, *([left] if xs[0] - left > SNAP else []), *([right] if right - xs[-1] > SNAP else [])})
        name = "open_edges"
    if len(xs) < 3 or len(ys) < 3 or len(xs) - 1 > COLUMNS_MAX:
        return None
    rows, used = into_grid(items, xs, ys)
    return Table([r for r in rows if any(r)], used, ys[0], name) if good(rows) else None


def dense_row_table(items: list[Item], rules: list[tuple[float, float, float, float]]) -> Table | None:
    """Level rules alone bound the rows; the row with the most items gives the columns' left edges."""
    hs, vs = split_rules(rules)
    ys = snap_edges([h[2] for h in hs], 3.0)[::-1]
    if vs or len(ys) < 4:
        return None
    left, right = min(h[0] for h in hs), max(h[1] for h in hs)
    bands = [[k for k, t in enumerate(items) if left - SNAP <= t["x"] <= right + SNAP and a >= middle(t)[1] > b] for a, b in zip(ys, ys[1:])]
    dense = max(bands, key=len)
    starts = sorted(items[k]["x"] for k in dense)
    starts = [x for i, x in enumerate(starts) if not i or x - starts[i - 1] > SNAP]
    if not 2 <= len(starts) <= COLUMNS_MAX or sum(len(b) >= 2 for b in bands) * 2 < len(bands):
        return None
    xs = [left - 2 * SNAP, *(x - SNAP / 2 for x in starts[1:]), right + 2 * SNAP]
    rows, used = into_grid(items, xs, ys)
    return Table([r for r in rows if any(r)], used, ys[0], "dense_row") if good(rows, 3) else None


def anchor_rule_table(items: list[Item], rules: list[tuple[float, float, float, float]]) -> Table | None:
    """Three or more rules of one extent (top, below the head, bottom): columns stand where the head's items do, rows where lines do."""
    hs, vs = split_rules(rules)
    groups: dict[tuple[int, int], list[float]] = {}
    for x1, x2, y in hs:
        groups.setdefault((round(x1 / SNAP), round(x2 / SNAP)), []).append(y)
    for (a, b), ys in sorted(groups.items(), key=lambda g: -len(g[1])):
        ys = sorted(ys, reverse=True)
        if vs or len(ys) < 3 or ys[0] - ys[1] > ys[1] - ys[-1]:
            continue
        mine = [k for k, t in enumerate(items) if a * SNAP - SNAP <= t["x"] <= b * SNAP + SNAP and ys[-1] < middle(t)[1] <= ys[0]]
        head = sorted((k for k in mine if middle(items[k])[1] > ys[1]), key=lambda k: items[k]["x"])
        body = [k for k in mine if middle(items[k])[1] <= ys[1]]
        if len(head) < 2 or len(body) < 4:
            continue
        centers = [middle(items[k])[0] for k in head]
        xs = [a * SNAP - 2 * SNAP, *((p + q) / 2 for p, q in zip(centers, centers[1:])), b * SNAP + 2 * SNAP]
        lines = row_places([items[k]["y"] for k in body], [items[k]["font_size"] for k in body])
        edges = [ys[0], ys[1], *((p + q) / 2 + items[body[0]]["font_size"] * 0.3 for p, q in zip(lines, lines[1:])), ys[-1]]
        rows, used = into_grid([items[k] for k in mine], xs, edges)
        if good(rows, 3):
            return Table([r for r in rows if any(r)], {mine[k] for k in used}, ys[0], "anchor_rules")
    return None


def table_regions(items: list[Item], gap: float = 30.0, least: int = 4, pad: float = 5.0) -> list[tuple[float, float]]:
    """Bands of heights between empty stretches of over `gap`, with enough items, padded; from below."""
    out: list[list[float]] = []
    for y in sorted(t["y"] for t in items):
        if out and y - out[-1][-1] <= gap:
            out[-1].append(y)
        else:
            out.append([y])
    return [(g[0] - pad, g[-1] + pad) for g in out if len(g) >= least]


def strict_regions(items: list[Item], least_rows: int = 3) -> list[Box]:
    """Runs of three or more consecutive lines that all have two items or more starting at shared left edges."""
    lines: list[list[int]] = []
    for k in sorted(range(len(items)), key=lambda k: -items[k]["y"]):
        if lines and abs(items[lines[-1][0]]["y"] - items[k]["y"]) <= 0.4 * max(items[k]["font_size"], 4):
            lines[-1].append(k)
        else:
            lines.append([k])
    out, run, edges = [], [], Counter()
    for ln in [*lines, []]:
        starts = {round(items[k]["x"] / SNAP) for k in ln}
        if len(starts) >= 2 and (not run or sum(s in edges or s - 1 in edges or s + 1 in edges for s in starts) * 2 >= len(starts)):
            run += [ln]
            edges.update(starts)
            continue
        if len(run) >= least_rows:
            at = [items[k] for r in run for k in r]
            out.append((min(t["x"] for t in at), min(t["y"] for t in at), max(t["x"] + t["width"] for t in at), max(t["y"] + t["font_size"] for t in at)))
        run, edges = ([ln], Counter(starts)) if len(starts) >= 2 else ([], Counter())
    return out


def table_like(cells: list[list[str]], body: bool) -> bool:
    """Whether cells are a table's: three columns, or enough data below the head, or two columns of short cells."""
    flat = [x for r in cells[1:] for x in r if x]
    if not flat:
        return False
    share = sum(bool(DATA.match(x)) for x in flat) / len(flat)
    if share > (0.3 if body else 0.2) or max(map(len, cells)) >= 3:
        return True
    return body and mean(len(x) for x in flat) <= 25


def page_number_toc(cells: list[list[str]]) -> bool:
    """A column of titles and one of page numbers that hardly ever fall."""
    last = [(r[-1], any(re.search(r"[^\W\d_]{2}", x) for x in r[:-1])) for r in cells if len(r) >= 2 and any(r)]
    nums = [int(x) for x, titled in last if titled and re.fullmatch(r"\d{1,4}", x)]
    return len(nums) >= 3 and len(nums) * 10 >= len(last) * 7 and sum(a <= b for a, b in zip(nums, nums[1:])) * 10 >= (len(nums) - 1) * 9


def tabular_toc(cells: list[list[str]]) -> bool:
    """Rows that begin with a section number and end with a page number."""
    rows = [[x for x in r if x] for r in cells if any(r)]
    hit = sum(len(r) >= 3 and re.fullmatch(r"(?:\d{1,3}(?:\.\d{1,3})*|[IVXLC]{1,6}|[A-Z])[.)]?", r[0]) is not None and re.fullmatch(r"\d{1,4}", r[-1]) is not None for r in rows)
    return len(rows) >= 3 and hit * 10 >= len(rows) * 6


def parallel_prose(cells: list[list[str]]) -> bool:
    """Two or three columns of running text side by side: long cells, most of them with sentences and few with data."""
    flat = [x for r in cells for x in r if x]
    if not flat or not 2 <= max(map(len, cells)) <= 3:
        return False
    words = [len(x.split()) for x in flat]
    return mean(words) >= 8 and sum(bool(DATA.match(x)) for x in flat) * 10 <= len(flat) and sum(x[-1] in ".!?;,”" for x in flat) * 3 >= len(flat)


def column_table(items: list[Item], columns: list[tuple[float, float]]) -> Table | None:
    """Layout columns whose lines stand at the same heights, as the columns of a table."""
    if not 2 <= len(columns) <= COLUMNS_MAX:
        return None
    rows_at = row_places([t["y"] for t in items], [t["font_size"] for t in items])
    per = [{min(range(len(rows_at)), key=lambda i: abs(rows_at[i] - t["y"])) for t in items if a <= t["x"] < b} for a, b in columns]
    if min(map(len, per)) < 3 or sum(len(set.intersection(*per)) >= 0.6 * len(p) for p in per) < len(per):
        return None
    edges = [rows_at[0] + 20, *((a + b) / 2 + 3 for a, b in zip(rows_at, rows_at[1:])), rows_at[-1] - 20]
    rows, used = into_grid(items, [columns[0][0] - 1, *(b for _, b in columns[:-1]), columns[-1][1] + 1], edges)
    return Table(rows, used, rows_at[0], "columns") if good(rows, 3) and not parallel_prose(rows) else None


def key_value_table(items: list[Item]) -> Table | None:
    """Labels that end with a colon at one left edge, each with what stands right of it on its line."""
    labels = [k for k, t in enumerate(items) if t["text"].strip().endswith(":") and len(t["text"].split()) <= 6]
    edge = Counter(round(items[k]["x"] / SNAP) for k in labels).most_common(1)
    if not edge or edge[0][1] < 3:
        return None
    rows, used = [], set()
    for k in sorted((k for k in labels if round(items[k]["x"] / SNAP) == edge[0][0]), key=lambda k: -items[k]["y"]):
        t = items[k]
        right = [j for j, u in enumerate(items) if abs(u["y"] - t["y"]) <= 0.4 * max(t["font_size"], 4) and u["x"] > t["x"] and j not in used]
        if right:
            rows.append([t["text"].strip(), joined(items, right)])
            used |= {k, *right}
    return Table(rows, used, max(items[k]["y"] for k in used), "key_values") if len(rows) >= 3 else None


def recover_header(table: Table, items: list[Item], small: float) -> Table:
    """A table of small items with the line of larger ones just above it as its head, if that has an item for two columns or more."""
    mine = [items[k] for k in table.used]
    step = 2.5 * median(t["font_size"] for t in mine)
    top = max(t["y"] for t in mine)
    head = [k for k, t in enumerate(items) if k not in table.used and t["font_size"] > small and top < t["y"] <= top + step]
    starts = column_places([t["x"] for t in mine])
    if len(head) < 2 or len(starts) != len(table.rows[0]):
        return table
    row = ["" for _ in starts]
    for k in sorted(head, key=lambda k: items[k]["x"]):
        c = min(range(len(starts)), key=lambda i: abs(starts[i] - items[k]["x"]))
        row[c] = f"{row[c]} {items[k]['text'].strip()}".strip()
    return Table([row, *table.rows], table.used | set(head), max(items[k]["y"] for k in head), table.detector) if sum(map(bool, row)) >= 2 else table


def add_labels(table: Table, items: list[Item]) -> Table:
    """A table of figures with the texts left of its rows as a first column, if most rows have one."""
    flat = [x for r in table.rows for x in r if x]
    if not flat or sum(bool(DATA.match(x)) for x in flat) * 2 < len(flat):
        return table
    left = min(items[k]["x"] for k in table.used)
    heights = row_places([items[k]["y"] for k in table.used], [items[k]["font_size"] for k in table.used])
    if len(heights) != len(table.rows):
        return table
    labels = [[k for k, t in enumerate(items) if k not in table.used and t["x"] + t["width"] <= left + 1 and abs(t["y"] - y) <= 0.5 * max(t["font_size"], 4)] for y in heights]
    if sum(map(bool, labels)) * 2 < len(heights):
        return table
    return Table([[joined(items, at), *r] for at, r in zip(labels, table.rows)], table.used | {k for at in labels for k in at}, table.top, table.detector)


def first_table_row(cells: list[list[str]]) -> int:
    """The row a table begins with, after lines of a form's head: the first that fills half of the usual number of columns."""
    filled = [sum(map(bool, r)) for r in cells]
    if not filled:
        return 0
    usual = Counter(filled).most_common(1)[0][0]
    return next((i for i, f in enumerate(filled) if f * 2 >= usual and f >= 2), 0)


def expand_values(items: list[Item]) -> list[Item]:
    """Items that hold three or more figures side by side (wide, without words), as one item a figure, evenly spread."""
    out = []
    for t in items:
        values = financial_values(t["text"]) if t["width"] > 20 * t["font_size"] and not re.search(r"[^\W\d_]{2}", t["text"]) else None
        if not values or len(values) < 3:
            out.append(t)
            continue
        step = t["width"] / len(values)
        out += [{**t, "text": v, "x": t["x"] + step * (i + 0.5), "width": 0.9 * step} for i, v in enumerate(values)]
    return out


def financial_values(text: str) -> list[str] | None:
    """Figures of a text of nothing else: numbers, a currency sign with its number, dashes for none."""
    toks, out, i = text.split(), [], 0
    while i < len(toks):
        if toks[i] == "$" and i + 1 < len(toks) and NUMBER.match(toks[i + 1]):
            out.append(f"$ {toks[i + 1]}")
            i += 1
        elif NUMBER.match(toks[i]) or toks[i] in ("—", "–", "-", "‒"):
            out.append(toks[i])
        else:
            return None
        i += 1
    return out or None


def split_numbers(t: Item, edges: list[float]) -> list[Item]:
    """An item of several numbers over several columns as one item a column, if there are as many numbers as columns it covers."""
    parts = t["text"].split()
    cols = [x for x in edges if t["x"] - SNAP <= x <= t["x"] + t["width"]]
    if len(parts) < 2 or len(parts) != len(cols) or not all(NUMBER.match(p) for p in parts):
        return [t]
    ends = [*cols[1:], t["x"] + t["width"]]
    return [{**t, "text": p, "x": x, "width": max(1.0, e - x - 1)} for p, x, e in zip(parts, cols, ends)]


def merge_preserving(items: list[Item], keep: set[int]) -> tuple[list[Item], list[list[int]]]:
    """Items of one line that touch (a gap under 0.15 em) as one, with the numbers of what each is made of; those to keep stay alone."""
    out: list[Item] = []
    made: list[list[int]] = []
    for k in sorted(range(len(items)), key=lambda k: (-round(items[k]["y"]), items[k]["x"])):
        t = items[k]
        last = out[-1] if out else None
        if last and k not in keep and made[-1][-1] not in keep and abs(last["y"] - t["y"]) <= 1 and -0.5 <= (t["x"] - last["x"] - last["width"]) / max(t["font_size"], 1) < 0.15:
            out[-1] = {**last, "text": last["text"] + t["text"], "width": t["x"] + t["width"] - last["x"]}
            made[-1].append(k)
        else:
            out.append(dict(t))
            made.append([k])
    return out, made


def redline_regions(items: list[Item], page_width: float) -> list[Box]:
    """Bands of tracked edits: runs of lines in which struck or underlined items make up half of the text, over the page's width."""
    if not any(t.get("is_strikeout") for t in items):
        return []
    lines = row_places([t["y"] for t in items], [t["font_size"] for t in items])
    marked: list[tuple[float, bool]] = []
    for y in lines:
        mine = [t for t in items if abs(t["y"] - y) <= 0.5 * max(t["font_size"], 4)]
        n = sum(len(t["text"]) for t in mine)
        m = sum(len(t["text"]) for t in mine if t.get("is_strikeout") or t.get("is_underline"))
        marked.append((y, n > 0 and m * 2 >= n and any(t.get("is_strikeout") for t in mine)))
    out: list[Box] = []
    high = median(t["font_size"] for t in items) if items else 0.0
    for y, hit in marked:
        if hit:
            if out and out[-1][1] - y <= 2.5 * high:
                out[-1] = (0.0, y - 0.3 * high, page_width, out[-1][3])
            else:
                out.append((0.0, y - 0.3 * high, page_width, y + high))
    return out


def page_tables(items: list[Item], rects: list[Box], rules: list[tuple[float, float, float, float]], doubts: list[str] | None = None) -> list[Table]:
    """The cascade of a page: rectangles, rules, open or dense or anchored rules, keys and values; each detector sees what the ones before left.

    Items in charts and in bands of tracked edits are no evidence for any of them. doubts: gets what other texts at the same places might decide otherwise.
    """
    masks = chart_regions(items, rects) + line_chart_regions(rules) + redline_regions(items, max((t["x"] + t["width"] for t in items), default=0.0))
    free = [k for k, t in enumerate(items) if not any(inside(t, m) for m in masks)]
    out: list[Table] = []

    def claim(found: Table | None, at: list[int]) -> None:
        nonlocal free
        if found and doubts is not None and any(not r[0] and any(r) for r in found.rows):
            doubts.append("rows may go on")
        if found and not page_number_toc(found.rows) and not tabular_toc(found.rows):
            t = Table(clean_cells(found.rows)[0], {at[k] for k in found.used}, found.top, found.detector)
            if t.rows:
                out.append(t)
                free = [k for k in free if k not in t.used]

    first = list(free)
    for found in rect_tables([items[k] for k in first], rects, doubts)[0]:
        claim(found, first)
    for f in (line_grid, anchor_rule_table, dense_row_table):
        claim(f([items[k] for k in free], rules), list(free))
    claim(key_value_table([items[k] for k in free]), list(free))
    return sorted(out, key=lambda t: -t.top)


def layout(places: list[tuple[float, float, float, float]], lettered: list[bool], rects: list[Box], rules: list[Box]) -> list[tuple[str, int, int, str]] | None:
    """(detector, n_rows, n_cols, Markdown to fill in) of each table of every page with items at these places (x, y, width, font_size)
    and these strokes, if the items are PLAIN texts, none of them struck out; None if it depends on the texts.

    The cascade runs over "{0}", "{1}", ... as texts. Of PLAIN ones it asks no more than that they are there, but for merged cells (equal?) and
    rows without a first cell (continued?), which page_tables tells, and for page numbers at the end of rows, which no cell with letters is.
    """
    doubts: list[str] = []
    tables = page_tables([{"text": f"{{{k}}}", "x": x, "y": y, "width": w, "font_size": s} for k, (x, y, w, s) in enumerate(places)], rects, rules, doubts)
    ends = [next(x for x in reversed(r) if x) for t in tables for r in t.rows]
    if doubts or not all(any(lettered[int(k)] for k in re.findall(r"\d+", x)) for x in ends):
        return None
    return [(t.detector, len(t.rows), len(t.rows[0]), table_markdown(t.rows)) for t in tables]


#: Of each worker: layouts by the bytes of their places.
_layouts: dict[bytes, list[tuple[str, int, int, str]] | None] = {}


def batch_tables(b: pa.RecordBatch) -> Iterator[tuple]:
    """(number of the page in the batch, number of the table, detector, n_rows, n_cols, Markdown) of the pages of a batch."""
    ends = {c: b.column(c).offsets.to_numpy() for c in ("its", "rects", "rules")}
    flat = {c: b.column(c).values.slice(v[0], v[-1] - v[0]) for c, v in ends.items()}
    ends = {c: v - v[0] for c, v in ends.items()}
    of = lambda c, names: np.column_stack([flat[c].field(k).to_numpy(zero_copy_only=False) for k in names]).astype(float, copy=False)
    places = of("its", ("x", "y", "width", "font_size"))
    strokes = {c: of(c, ("x1", "y1", "x2", "y2")) for c in ("rects", "rules")}
    text = flat["its"].field("text")
    plain = pc.match_substring_regex(text, PLAIN).to_numpy(zero_copy_only=False) & ~flat["its"].field("is_strikeout").fill_null(False).to_numpy(zero_copy_only=False)
    lettered = pc.match_substring_regex(text, "[A-Za-z]").to_numpy(zero_copy_only=False)
    texts, lined, struck = text.to_pylist(), flat["its"].field("is_underline"), flat["its"].field("is_strikeout")
    own = {c: (v[:-1].tolist(), v[1:].tolist()) for c, v in ends.items()}
    odd = np.concatenate([[0], np.cumsum(~plain)])
    odd = (odd[ends["its"][1:]] > odd[ends["its"][:-1]]).tolist()
    for p, (i, j, c, d, e, f) in enumerate(zip(*own["its"], *own["rects"], *own["rules"])):
        rects, rules = strokes["rects"][c:d], strokes["rules"][e:f]
        if not odd[p]:
            key = b"%d %d " % (j - i, d - c) + places[i:j].tobytes() + lettered[i:j].tobytes() + rects.tobytes() + rules.tobytes()
            try:
                known = _layouts[key]
            except KeyError:
                if len(_layouts) >= LAYOUTS_MAX:
                    _layouts.clear()
                known = _layouts[key] = layout(places[i:j].tolist(), lettered[i:j].tolist(), [*map(tuple, rects.tolist())], [*map(tuple, rules.tolist())])
            if known is not None:
                for n, (name, rows, cols, form) in enumerate(known, 1):
                    yield p, n, name, rows, cols, form.format(*texts[i:j])
                continue
        its = [{"text": t, "x": x, "y": y, "width": w, "font_size": s, "is_underline": u, "is_strikeout": o} for t, (x, y, w, s), u, o in zip(texts[i:j], places[i:j].tolist(), lined[i:j].to_pylist(), struck[i:j].to_pylist())]
        for n, t in enumerate(page_tables(its, [*map(tuple, rects.tolist())], [*map(tuple, rules.tolist())]), 1):
            yield p, n, t.detector, len(t.rows), len(t.rows[0]), table_markdown(t.rows)


def tables_of_pages(pages: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    """(result_id, page_no, table_no, detector, n_rows, n_cols, markdown) of pages, a row each.

    pages(result_id, page_no, its, rects, rules): its are structs of text, x, y, width, font_size, is_underline, is_strikeout, rects and rules of x1, y1, x2, y2; places are doubles and, as texts, never null.
    made: makes such pages of the rows' batches, where they aren't pages yet (rows that belong together then are in one partition, in order).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in made(batches):
            rows = list(zip(*batch_tables(b))) or [()] * 6
            at = pa.array(rows[0], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("result_id").take(at), b.column("page_no").take(at), *(pa.array(x, k.type) for x, k in zip(rows[1:], list(schema)[2:]))], schema=schema)

    schema = pa.schema([("result_id", pa.int64()), ("page_no", pa.int32()), ("table_no", pa.int32()), ("detector", pa.string()), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("markdown", pa.string())])
    return pages.mapInArrow(run, "result_id long, page_no int, table_no int, detector string, n_rows int, n_cols int, markdown string")


def drawn_tables(items: DataFrame, strokes: DataFrame) -> DataFrame:
    """tables_of_pages of pages with items and strokes.

    strokes(result_id, page_no, kind, x1, y1, x2, y2): kind is rect or rule. A page is the unit; pages without items have no table; null texts and places are left out; repeated items count once.
    """
    page, numbers, ends = ["result_id", "page_no"], ["x", "y", "width", "font_size"], ["x1", "y1", "x2", "y2"]
    it = items.dropDuplicates([*page, "item_no"]).dropna(subset=["text", *numbers])
    names = ["text", *numbers, "is_underline", "is_strikeout"]
    its = F.array_sort(F.collect_list(F.struct("item_no", "text", *[F.col(c).cast("double").alias(c) for c in numbers], "is_underline", "is_strikeout")))
    pages = it.groupBy(*page).agg(F.transform(its, lambda s: F.struct(*[s[c].alias(c) for c in names])).alias("its"))
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct(*[F.col(c).cast("double").alias(c) for c in ends]))).alias(f"{kind}s")
    drawn = strokes.dropna(subset=ends).groupBy(*page).agg(of("rect"), of("rule"))
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    return tables_of_pages(pages.join(drawn, page, "left").select(F.col("result_id").cast("long"), F.col("page_no").cast("int"), "its", *[F.coalesce(c, none).alias(c) for c in ("rects", "rules")]))
