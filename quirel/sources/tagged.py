"""What a PDF says about itself beside its page contents: structure tree, tagged tables, links and form fields.

Every walk keeps the objects it has passed, so that cycles end; broken entries are skipped.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

from .pdf import Pdf, Ref, TextItem

#: Objects of one structure tree, and fields of one form, that are read; a document with more has a warning.
NODES_MAX, FIELDS_MAX = 2_000_000, 100_000
BARE_NAME = re.compile(rb"(/S[ \t\r\n]+)(?=[A-Z][A-Za-z0-9]{0,15}[ \t\r\n/>])")


def repair_names(data: bytes) -> bytes:
    """Structure types written without their slash (`/S P`) as names, in a document that has a structure tree."""
    return BARE_NAME.sub(rb"\1/", data) if b"StructTreeRoot" in data else data


def decode_text(raw) -> str | None:
    """A text string: UTF-16 by its mark, else one byte a character."""
    if not isinstance(raw, bytes):
        return None
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


@dataclass
class Node:
    elem_id: int
    parent_id: int | None
    child_no: int
    role: str
    alt: str | None = None
    actual: str | None = None
    lang: str | None = None
    rows: int = 1
    cols: int = 1
    #: (marked content number, page number) of the node's own content.
    content: list[tuple[int, int]] = field(default_factory=list)


def mapped_role(name: str, roles: dict) -> str:
    """A structure type by the role map, followed until it names none or one that it has been to."""
    seen: set[str] = set()
    while name in roles and name not in seen:
        seen.add(name)
        name = str(roles[name])
    return name


def structure(pdf: Pdf) -> list[Node]:
    """The structure tree's elements in document order; empty without a tree."""
    root = pdf.get(pdf.root.get("StructTreeRoot"))
    if not isinstance(root, dict):
        return []
    roles = pdf.get(root.get("RoleMap")) or {}
    out: list[Node] = []
    seen: set[int] = set()

    def page_of(o, otherwise: int | None) -> int | None:
        return pdf.page_no.get(o.n, otherwise) if isinstance(o, Ref) else otherwise

    def kids(o) -> list:
        o = pdf.get(o) if isinstance(pdf.get(o), list) else o
        return o if isinstance(o, list) else [] if o is None else [o]

    # Depth first with a stack of its own: (object, parent, place among siblings, page).
    todo = [(k, None, i, None) for i, k in reversed(list(enumerate(kids(root.get("K")))))]
    while todo and len(out) < NODES_MAX:
        ref, parent, place, page = todo.pop()
        node = pdf.get(ref)
        if isinstance(node, int) and not isinstance(node, bool):
            if parent is not None and page is not None:
                out[parent].content.append((node, page))
            continue
        if not isinstance(node, dict) or isinstance(ref, Ref) and ref.n in seen:
            continue
        if isinstance(ref, Ref):
            seen.add(ref.n)
        page = page_of(node.get("Pg"), page)
        if node.get("Type") == "MCR" or "MCID" in node and "S" not in node:
            mcid = pdf.get(node.get("MCID"))
            if parent is not None and page is not None and isinstance(mcid, int):
                out[parent].content.append((mcid, page))
            continue
        if "S" not in node:
            continue
        spans = {"RowSpan": 1, "ColSpan": 1}
        for a in kids(node.get("A")):
            a = pdf.get(a)
            if isinstance(a, dict):
                spans |= {k: max(1, min(1000, int(v))) for k in spans if isinstance(v := pdf.get(a.get(k)), int)}
        at = len(out)
        out.append(Node(at + 1, None if parent is None else parent + 1, place, mapped_role(str(pdf.get(node["S"])), roles), decode_text(pdf.get(node.get("Alt"))), decode_text(pdf.get(node.get("ActualText"))), decode_text(pdf.get(node.get("Lang"))), spans["RowSpan"], spans["ColSpan"]))
        todo += [(k, at, i, page) for i, k in reversed(list(enumerate(kids(node.get("K")))))]
    return out


@dataclass
class TaggedCell:
    header: bool
    rows: int
    cols: int
    content: list[tuple[int, int]]


def tagged_tables(nodes: list[Node]) -> list[list[list[TaggedCell]]]:
    """Rows of cells of each Table element, in order; a cell has all content below it, rows of inner tables are theirs."""
    below: dict[int | None, list[Node]] = defaultdict(list)
    for n in nodes:
        below[n.parent_id].append(n)

    def content(n: Node) -> list[tuple[int, int]]:
        out, todo = [], [n]
        while todo:
            x = todo.pop()
            out += x.content
            todo += [c for c in reversed(below[x.elem_id]) if c.role != "Table"]
        return out

    tables = []
    for t in nodes:
        if t.role != "Table":
            continue
        rows, todo = [], list(reversed(below[t.elem_id]))
        while todo:
            x = todo.pop()
            if x.role == "TR":
                rows.append([TaggedCell(c.role == "TH", c.rows, c.cols, content(c)) for c in below[x.elem_id] if c.role in ("TD", "TH")])
            elif x.role in ("THead", "TBody", "TFoot"):
                todo += reversed(below[x.elem_id])
        tables.append(rows)
    return tables


def tables_of_page(items: list[TextItem], tables: list[list[list[TaggedCell]]], page: int) -> list[tuple[list[list[str]], set[int], float]]:
    """(rows of text, item numbers, upper edge) of the tagged tables on a page.

    A table needs two rows and two columns there, and half of its cells must have text: otherwise the tree is stale.
    """
    by: dict[int, list[int]] = defaultdict(list)
    for k, t in enumerate(items):
        if t.mcid is not None:
            by[t.mcid].append(k)
    out = []
    for rows in tables:
        here = [r for r in rows if any(p == page for c in r for _, p in c.content)]
        if len(here) < 2 or max(sum(c.cols for c in r) for r in here) < 2:
            continue
        grid: dict[tuple[int, int], str] = {}
        taken: set[tuple[int, int]] = set()
        used: set[int] = set()
        cells = filled = 0
        for i, r in enumerate(here):
            j = 0
            for c in r:
                while (i, j) in taken:
                    j += 1
                mine = sorted({k for m, p in c.content if p == page for k in by[m]}, key=lambda k: (-round(items[k].y), items[k].x))
                grid[i, j] = " ".join(" ".join(items[k].text.split()) for k in mine)
                taken |= {(i + a, j + b) for a in range(c.rows) for b in range(c.cols)}
                used.update(mine)
                cells, filled = cells + 1, filled + bool(mine)
                j += c.cols
        if filled * 2 < cells or not used:
            continue
        width = max(j for _, j in taken) + 1
        out.append(([[grid.get((i, j), "") for j in range(width)] for i in range(len(here))], used, max(items[k].y for k in used)))
    return out


def links(pdf: Pdf) -> list[tuple[int, float, float, float, float, str]]:
    """(page number, x1, y1, x2, y2, target) of the link annotations with an address or a named place."""
    out = []
    for no, page in enumerate(pdf.pages, 1):
        for a in pdf.get(page.get("Annots")) or []:
            a = pdf.get(a)
            if not isinstance(a, dict) or a.get("Subtype") != "Link":
                continue
            box = [pdf.get(v) for v in pdf.get(a.get("Rect")) or []]
            action = pdf.get(a.get("A"))
            target = decode_text(pdf.get(action.get("URI"))) if isinstance(action, dict) else None
            if target is None:
                place = pdf.get(a.get("Dest")) or (pdf.get(action.get("D")) if isinstance(action, dict) else None)
                target = "#" + (decode_text(place) or str(place)) if isinstance(place, (bytes, str)) else None
            if target and len(box) == 4 and all(isinstance(v, (int, float)) for v in box):
                x, y = sorted((box[0], box[2])), sorted((box[1], box[3]))
                out.append((no, float(x[0]), float(y[0]), float(x[1]), float(y[1]), target))
    return out


def form_fields(pdf: Pdf) -> list[tuple[str, str, int | None, str]]:
    """(full name, kind, page number, value) of the form's leaf fields that have a value; names and kinds are inherited."""
    form = pdf.get(pdf.root.get("AcroForm"))
    if not isinstance(form, dict):
        return []
    home = {a.n: no for no, page in enumerate(pdf.pages, 1) for a in pdf.get(page.get("Annots")) or [] if isinstance(a, Ref)}
    out, seen = [], set()
    todo = [(k, "", None, None) for k in reversed(pdf.get(form.get("Fields")) or [])]
    while todo and len(seen) < FIELDS_MAX:
        ref, above, kind, value = todo.pop()
        f = pdf.get(ref)
        if not isinstance(f, dict) or id(f) in seen:
            continue
        seen.add(id(f))
        own = decode_text(pdf.get(f.get("T")))
        name = ".".join(x for x in (above, own) if x)
        kind = pdf.get(f.get("FT")) or kind
        value = pdf.get(f["V"]) if "V" in f else value
        below = [k for k in pdf.get(f.get("Kids")) or [] if isinstance(pdf.get(k), dict)]
        if any("T" in pdf.get(k) for k in below):
            todo += [(k, name, kind, value) for k in reversed(below)]
            continue
        shown = decode_text(value) if isinstance(value, bytes) else ", ".join(filter(None, map(decode_text, map(pdf.get, value)))) if isinstance(value, list) else str(value) if value is not None else ""
        page = next((home[k.n] for k in [ref, *below] if isinstance(k, Ref) and k.n in home), None)
        page = page or next((pdf.page_no[p.n] for k in [f, *map(pdf.get, below)] if isinstance(p := k.get("P"), Ref) and p.n in pdf.page_no), None)
        if shown and not (kind == "Btn" and shown == "Off"):
            out.append((name, str(kind or ""), page, shown))
    return out
