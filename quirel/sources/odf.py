"""OpenDocument texts, spreadsheets and presentations as documents."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from .model import Block, Cell, ConvertError, Document, GridBuilder, Item, Run, cell, plain
from .office import float_text, header_rows
from .package import Package, all_of, attr, kid, kids, local


def duration_text(iso: str) -> str:
    """ISO 8601 duration as a clock; with years or months it stays as it is."""
    m = re.fullmatch(r"(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:[.,](\d+))?S)?)?", iso.strip())
    if not m or int(m[2] or 0) or int(m[3] or 0):
        return iso
    h = (int(m[4] or 0) * 7 + int(m[5] or 0)) * 24 + int(m[6] or 0)
    secs = int(m[7] or 0) * 60 + int(m[8] or 0)
    h += secs // 3600
    ms = (m[9] or "")[:3].ljust(3, "0") if m[9] and int(m[9]) else ""
    return f"{m[1]}{h:02d}:{secs % 3600 // 60:02d}:{secs % 60:02d}{'.' + ms if ms else ''}"


class Styles:
    def __init__(self, *roots: ET.Element | None):
        self.by: dict[str, ET.Element] = {}
        self.lists: dict[str, ET.Element] = {}
        for r in roots:
            for s in all_of(r, "style") if r is not None else ():
                self.by[attr(s, "name") or ""] = s
            for s in all_of(r, "list-style") if r is not None else ():
                self.lists[attr(s, "name") or ""] = s

    def delta(self, name: str | None) -> dict[str, bool]:
        """Bold, italic, strike along the parents; the nearest explicit value wins."""
        out: dict[str, bool] = {}
        seen: set[str] = set()
        while name and name in self.by and name not in seen:
            seen.add(name)
            p = kid(self.by[name], "text-properties")
            if p is not None:
                w, i, s = attr(p, "font-weight"), attr(p, "font-style"), attr(p, "text-line-through-style")
                if w:
                    out.setdefault("bold", w == "bold" or (w.isdigit() and int(w) >= 600))
                if i:
                    out.setdefault("italic", i in ("italic", "oblique"))
                if s:
                    out.setdefault("strike", s != "none")
            name = attr(self.by[name], "parent-style-name")
        return out

    def names(self, name: str | None) -> list[str]:
        out: list[str] = []
        while name and name not in out:
            out.append(name)
            name = attr(self.by[name], "parent-style-name") if name in self.by else None
        return out


class Odf:
    def __init__(self, pkg: Package, content: ET.Element):
        self.styles = Styles(pkg.optional("styles.xml"), content)
        self.doc = Document()
        self.counters: dict[str, int] = {}

    def inline(self, e: ET.Element, s: dict, out: list[Run], href: str | None = None) -> None:
        def text(t: str | None) -> None:
            if t:
                out.append(Run(re.sub(r"[ \t\r\n]+", " ", t), href=href, **s))

        text(e.text)
        for c in e:
            t = local(c.tag)
            if t == "span":
                self.inline(c, {**s, **self.styles.delta(attr(c, "style-name"))}, out, href)
            elif t == "a":
                self.inline(c, s, out, attr(c, "href"))
            elif t == "s":
                out.append(Run(" " * min(1000, int(attr(c, "c") or 1)), href=href, **s))
            elif t == "tab":
                out.append(Run("\t", **s))
            elif t == "line-break":
                out.append(Run(kind="break"))
            elif t == "note":
                key = attr(c, "id") or f"n{len(self.doc.notes)}"
                self.doc.notes[key] = self.blocks(kid(c, "note-body"))
                out.append(Run(key, kind="note"))
            elif t in ("bookmark", "bookmark-start"):
                out.append(Run(attr(c, "name") or "", kind="anchor"))
            elif t == "frame":
                for x in all_of(c, "title") + all_of(c, "desc"):
                    if x.text:
                        out.append(Run(x.text, kind="image"))
                        break
            elif t not in ("annotation", "tracked-changes", "bookmark-end"):
                self.inline(c, s, out, href)
            text(c.tail)

    def para(self, e: ET.Element) -> Block | None:
        runs: list[Run] = []
        self.inline(e, self.styles.delta(attr(e, "style-name")) if local(e.tag) == "p" else {}, runs)
        if not plain(runs).strip() and not any(r.kind == "note" for r in runs):
            return None
        names = [n.lower().replace("_20_", " ") for n in self.styles.names(attr(e, "style-name"))]
        if local(e.tag) == "h":
            return Block("heading", runs=runs, level=int(attr(e, "outline-level") or 1))
        if "title" in names:
            return Block("heading", runs=runs, level=1)
        if any("quot" in n for n in names):
            return Block("quote", blocks=[Block("paragraph", runs=runs)])
        if any("preformatted" in n or "code" in n for n in names):
            return Block("code", text=plain(runs))
        return Block("paragraph", runs=runs)

    def blocks(self, parent: ET.Element | None) -> list[Block]:
        out: list[Block] = []
        for e in parent if parent is not None else ():
            t = local(e.tag)
            if t in ("p", "h"):
                b = self.para(e)
                if b is None:
                    continue
                if out and b.kind == out[-1].kind == "code":
                    out[-1].text += "\n" + b.text
                elif out and b.kind == out[-1].kind == "quote":
                    out[-1].blocks += b.blocks
                else:
                    out.append(b)
            elif t == "list":
                b = self.list(e, 1, None)
                if b.items:
                    out.append(b)
            elif t == "table":
                out += self.table(e)
            elif t in ("section", "index-body", "table-of-content", "text-box", "frame", "g", "custom-shape", "page", "list-header", "body"):
                out += self.blocks(e)
        return out

    def list(self, e: ET.Element, depth: int, style: str | None) -> Block:
        style = attr(e, "style-name") or style
        level = next((x for x in self.styles.lists.get(style or "", ()) if attr(x, "level") == str(depth)), None)
        kind, start = "", 1
        if level is not None and local(level.tag) == "list-level-style-number":
            kind = {"a": "alpha", "A": "Alpha", "i": "roman", "I": "Roman"}.get(attr(level, "num-format") or "1", "decimal")
            start = int(attr(level, "start-value") or 1)
        key = f"{style}/{depth}"
        if (attr(e, "continue-numbering") or "") == "true" and key in self.counters:
            start = self.counters[key] + 1
        b = Block("list", ordered=kind, start=start)
        for c in kids(e, "list-item", "list-header"):
            inner: list[Block] = []
            for x in c:
                if local(x.tag) == "list":
                    sub = self.list(x, depth + 1, style)
                    if sub.items:
                        inner.append(sub)
                elif local(x.tag) in ("p", "h") and (p := self.para(x)):
                    inner.append(p)
            if inner:
                b.items.append(Item(inner))
        self.counters[key] = start + len(b.items) - 1
        return b

    def value(self, c: ET.Element) -> str:
        kind, v = attr(c, "value-type"), attr(c, "value")
        if kind in ("float", "currency") and v:
            return float_text(float(v))
        if kind == "percentage" and v:
            return float_text(float(v) * 100) + "%"
        if kind == "date":
            return (attr(c, "date-value") or "").replace("T", " ")
        if kind == "time":
            return duration_text(attr(c, "time-value") or "")
        if kind == "boolean":
            return (attr(c, "boolean-value") or "").upper()
        return ""

    def table(self, e: ET.Element) -> list[Block]:
        g = GridBuilder()
        heads = 0

        def rows(parent: ET.Element, head: bool) -> None:
            nonlocal heads
            for r in parent:
                t = local(r.tag)
                if t in ("table-header-rows", "table-rows", "table-row-group"):
                    rows(r, head or t == "table-header-rows")
                elif t == "table-row":
                    cells: list[Cell] = []
                    for c in r:
                        n = local(c.tag)
                        if n not in ("table-cell", "covered-table-cell"):
                            continue
                        times = int(attr(c, "number-columns-repeated") or 1)
                        if n == "covered-table-cell":
                            continue
                        inner = self.blocks(c)
                        if not inner and (v := self.value(c)):
                            inner = cell(v).blocks
                        if not inner and times > 1000:
                            times = 1
                        g.spent += times * len(inner)
                        if g.spent > 4_000_000:
                            raise ConvertError("resourceLimit", "repeated cells")
                        for _ in range(times):
                            cells.append(Cell(inner, int(attr(c, "number-rows-spanned") or 1), int(attr(c, "number-columns-spanned") or 1)))
                    while cells and not cells[-1].blocks and cells[-1].cols == cells[-1].rows == 1:
                        cells.pop()
                    times = int(attr(r, "number-rows-repeated") or 1)
                    g.spent += times * len(cells)
                    if g.spent > 4_000_000:
                        raise ConvertError("resourceLimit", "repeated rows")
                    for _ in range(times if cells else min(times, 1)):
                        g.add_row([Cell(c.blocks, c.rows, c.cols) for c in cells])
                    heads += head

        rows(e, False)
        grid = g.finish()
        return [Block("table", grid=grid, header_rows=heads or header_rows(grid))] if grid else []


def odf(data: bytes) -> Document:
    pkg = Package(data)
    manifest = pkg.optional("META-INF/manifest.xml")
    if manifest is not None and all_of(manifest, "encryption-data"):
        raise ConvertError("encrypted", "an encrypted document")
    root = pkg.xml("content.xml")
    if root is None:
        raise ConvertError("missingPart", "content.xml")
    o = Odf(pkg, root)
    body = kid(root, "body")
    for part in body if body is not None else ():
        t = local(part.tag)
        if t == "spreadsheet":
            tables = kids(part, "table")
            for x in tables:
                got = o.table(x)
                if got and len(tables) > 1:
                    o.doc.blocks.append(Block("heading", runs=[Run(attr(x, "name") or "")], level=2))
                o.doc.blocks += got
        elif t == "presentation":
            for page in kids(part, "page"):
                for e in page:
                    if local(e.tag) == "notes":
                        inner = o.blocks(e)
                        if inner:
                            o.doc.blocks.append(Block("quote", blocks=inner))
                    elif attr(e, "class") == "title":
                        runs = [r for b in o.blocks(e) for r in b.runs]
                        if runs:
                            o.doc.blocks.append(Block("heading", runs=runs, level=2))
                    else:
                        wrap = ET.Element("g")
                        wrap.append(e)
                        o.doc.blocks += o.blocks(wrap)
        else:
            o.doc.blocks += o.blocks(part)
    return o.doc
