"""Tables in given regions of a page, and table structures from a recognizer filled with the page's own text.

Pure functions over items (dicts with text, x, y, width, font_size; y grows upwards), regions (x1, y1, x2, y2) in the same
units and structure tokens with cell boxes. Regions aren't exclusive: an item may stand in several.
"""

from __future__ import annotations

from collections import Counter
from statistics import median

from . import drawn
from .drawn import Box, Table, inside
from .flow import OPEN_ENDS
from .geometry import DATA, Item, best_candidate, borderless_table, cells_markdown, fill_cells, normalize_bands, parse_structure, quality_issue, row_places, table_markdown

Rule = tuple[float, float, float, float]
# Stable names of what is wrong with a filled structure.
PHANTOM, CROWDED, NO_TEXT = "phantom_empty_row", "multi_row_in_cell", "no_text"


def within(box: Box, region: Box, margin: float = 3.0) -> bool:
    return region[0] - margin <= box[0] and box[2] <= region[2] + margin and region[1] - margin <= box[1] and box[3] <= region[3] + margin


def region_table(items: list[Item], rects: list[Box], rules: list[Rule], region: Box, base: float) -> tuple[list[list[str]], str] | None:
    """(rows, detector) of a region's table: rectangles, then rules, then aligned text; each must pass the quality checks."""
    its = [t for t in items if inside(t, region, 1.0)]
    mine = [r for r in rects if within(r, region)]
    lines = [r for r in rules if within((min(r[0], r[2]), min(r[1], r[3]), max(r[0], r[2]), max(r[1], r[3])), region)]
    candidates: list[tuple[str, list[list[str]]]] = []
    for name, found in (("rects", drawn.rect_grid(its, mine) if mine else None), ("rules", drawn.line_grid(its, lines)), ("anchors", drawn.anchor_rule_table(its, lines))):
        if isinstance(found, Table):
            candidates.append((name, found.rows))
    if not candidates and (rows := borderless_table(its, base)):
        candidates.append(("text", rows))
    best = best_candidate(candidates)
    return (best[1], best[0]) if best and not looks_partial(best[1]) else None


def looks_partial(rows: list[list[str]], assisted: bool = False) -> bool:
    """Whether rows are hardly the whole of a table: one row or column, a first row that continues, mostly empty, one column
    that holds all. What a layout model has seen as a table (assisted) may be emptier."""
    full = [[bool(x.strip()) for x in r] for r in rows]
    if len(rows) < 2 or max(map(len, rows), default=0) < 2:
        return True
    share = sum(map(sum, full)) / max(1, sum(map(len, full)))
    columns = [sum(r[j] for r in full if j < len(r)) for j in range(max(map(len, rows)))]
    if share < (0.15 if assisted else 0.25) or sum(c > 0 for c in columns) < 2:
        return True
    first = [x.strip() for x in rows[0] if x.strip()]
    return not assisted and bool(first) and (first[0][0] in ",;.)" or first[0].split()[0] in OPEN_ENDS)


def tables_in_regions(items: list[Item], rects: list[Box], rules: list[Rule], regions: list[Box]) -> list[tuple[str, str | None]]:
    """(Markdown, detector) of each region; the base size is that of all items. Regions without a table have an empty text."""
    sizes = Counter(int(t["font_size"] * 10) for t in items if t["font_size"] >= 9)
    base = max(sizes, key=lambda k: (sizes[k], -k)) / 10 if sizes else 12.0
    out = []
    for region in regions:
        found = region_table(items, rects, rules, region, base)
        out.append((table_markdown(found[0]), found[1]) if found else ("", None))
    return out


def vector_grid(rects: list[Box], rules: list[Rule], region: Box, dpi: float = 72.0) -> tuple[list[str], list[Box]] | None:
    """(structure tokens, cell boxes in pixels of the region's crop) of the full ruled grid in a region, or None.

    Pixels grow downwards from the region's upper left corner.
    """
    edges = rules + [e for a, b, c, d in rects for e in ((a, b, c, b), (a, d, c, d), (a, b, a, d), (c, b, c, d))]
    hs, vs = drawn.split_rules([e for e in edges if within((min(e[0], e[2]), min(e[1], e[3]), max(e[0], e[2]), max(e[1], e[3])), region)])
    xs, ys = drawn.snap_edges([v[0] for v in vs], 3.0), drawn.snap_edges([h[2] for h in hs], 3.0)[::-1]
    if len(xs) < 3 or len(ys) < 3 or len(xs) - 1 > drawn.COLUMNS_MAX:
        return None
    scale = dpi / 72.0
    tokens, boxes = [], []
    for a, b in zip(ys, ys[1:]):
        tokens.append("<tr>")
        for c, d in zip(xs, xs[1:]):
            tokens.append("<td></td>")
            boxes.append(((c - region[0]) * scale, (region[3] - a) * scale, (d - region[0]) * scale, (region[3] - b) * scale))
        tokens.append("</tr>")
    return tokens, boxes


def structure_cells(items: list[Item], tokens: list[str], boxes: list[Box], dpi: float, origin: tuple[float, float]) -> list[dict]:
    """Cells (row, col, rows, cols, header, box, text) of a recognizer's tokens and pixel boxes, filled from the page.

    origin is the crop's upper left corner in points; bands of rows and columns are made not to overlap first.
    """
    scale = 72.0 / dpi
    cells = []
    for (row, col, rows, cols, head), (x1, y1, x2, y2) in zip(parse_structure(tokens), boxes):
        box = (origin[0] + x1 * scale, origin[1] - y2 * scale, origin[0] + x2 * scale, origin[1] - y1 * scale)
        cells.append({"row": row, "col": col, "rows": rows, "cols": cols, "header": head, "box": box})
    if cells and all(c["rows"] == 1 and c["cols"] == 1 for c in cells):
        flipped = [{**c, "box": (c["box"][0], -c["box"][3], c["box"][2], -c["box"][1])} for c in cells]
        cells = [{**c, "box": (b["box"][0], -b["box"][3], b["box"][2], -b["box"][1])} for c, b in zip(cells, normalize_bands(flipped))]
    for c, text in zip(cells, fill_cells([c["box"] for c in cells], items)):
        c["text"] = text
    return cells


def expand_rows(cells: list[dict], items: list[Item]) -> list[dict]:
    """A row whose single cells hold several lines each, as many in at least half of its filled cells, as that many rows."""
    by: dict[int, list[dict]] = {}
    for c in cells:
        by.setdefault(c["row"], []).append(c)
    out, shift = [], 0
    for row in sorted(by):
        heights = []
        for c in by[row]:
            mine = [t for t in items if inside(t, c["box"])]
            heights.append(row_places([t["y"] for t in mine], [t["font_size"] for t in mine]) if c["rows"] == 1 else [])
        counts = Counter(len(h) for h in heights if h)
        n = counts.most_common(1)[0][0] if counts else 1
        if n < 2 or counts[n] * 2 < sum(counts.values()) or counts[n] < 2:
            out += [{**c, "row": row + shift} for c in by[row]]
            continue
        lines = next(h for h in heights if len(h) == n)
        for c in by[row]:
            mine = [t for t in items if inside(t, c["box"])]
            parts = [[t for t in mine if min(range(n), key=lambda i: abs(lines[i] - t["y"])) == k] for k in range(n)]
            out += [{**c, "row": row + shift + k, "text": " ".join(t["text"].strip() for t in sorted(p, key=lambda t: t["x"]))} for k, p in enumerate(parts)]
        shift += n - 1
    return out


def issue(cells: list[dict], items: list[Item]) -> str | None:
    """What is wrong with a filled structure, by a stable name: no text, an empty row between full ones, several lines in cells of a row."""
    if not any(c["text"] for c in cells):
        return NO_TEXT
    full: dict[int, bool] = {}
    for c in cells:
        full[c["row"]] = full.get(c["row"], False) or bool(c["text"])
    order = [full[r] for r in sorted(full)]
    if any(not f and any(order[:i]) and any(order[i + 1 :]) for i, f in enumerate(order)):
        return PHANTOM
    for row in full:
        many = 0
        mine = [c for c in cells if c["row"] == row and c["text"]]
        for c in mine:
            ts = [t for t in items if inside(t, c["box"])]
            many += c["rows"] == 1 and len(row_places([t["y"] for t in ts], [t["font_size"] for t in ts])) >= 2
        if many >= 2 and many * 2 >= len(mine):
            return CROWDED
    return None


def structure_markdown(items: list[Item], tokens: list[str], boxes: list[Box], dpi: float, origin: tuple[float, float]) -> str:
    return cells_markdown(structure_cells(items, tokens, boxes, dpi, origin))


def structure_auto(items: list[Item], rects: list[Box], rules: list[Rule], tokens: list[str], boxes: list[Box], dpi: float, origin: tuple[float, float]) -> tuple[str, str, str | None]:
    """(Markdown, source, issue): the filled structure; with crowded cells their rows expanded; with any other issue the page's own table there, if it has one."""
    cells = structure_cells(items, tokens, boxes, dpi, origin)
    wrong = issue(cells, items)
    if wrong is None:
        return cells_markdown(cells), "structure", None
    if wrong == CROWDED:
        return cells_markdown(expand_rows(cells, items)), "expanded", wrong
    if cells:
        box = drawn.bounds([c["box"] for c in cells])
        found = region_table(items, rects, rules, box, median([t["font_size"] for t in items]) if items else 12.0)
        if found and quality_issue(found[0]) is None:
            return table_markdown(found[0]), found[1], wrong
    return cells_markdown(cells), "structure", wrong


def data_share(rows: list[list[str]]) -> float:
    """Share of the filled cells below the head that are figures."""
    flat = [x for r in rows[1:] for x in r if x]
    return sum(bool(DATA.match(x)) for x in flat) / len(flat) if flat else 0.0


def merged_in_use(merges: list[tuple[int, int, int, int]], used: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
    """Merged regions (first row, first column, last row, last column) cut to the used range; what is left of one place only goes."""
    out = []
    for a, b, c, d in merges:
        box = max(a, used[0]), max(b, used[1]), min(c, used[2]), min(d, used[3])
        if box[0] <= box[2] and box[1] <= box[3] and (box[0], box[1]) != (box[2], box[3]):
            out.append(box)
    return out

