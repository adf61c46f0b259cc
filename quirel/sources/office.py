"""Word-processing, spreadsheet and presentation packages as documents."""

from __future__ import annotations

import datetime
import posixpath
import re
import xml.etree.ElementTree as ET

from .drawings import graphic_blocks
from .model import Block, Cell, ConvertError, Document, GridBuilder, Run, cell, fold_list, number_label, para, plain
from .package import Package, all_of, attr, kid, kids, local

OFF = {"0", "false", "off", "none"}


def flag(e: ET.Element | None) -> bool | None:
    return None if e is None else (attr(e, "val") or "true").lower() not in OFF


# Word processing


class Styles:
    """Paragraph and character styles along their base styles; a cycle ends the walk."""

    def __init__(self, root: ET.Element | None):
        self.by = {attr(s, "styleId") or "": s for s in kids(root, "style")}

    def chain(self, sid: str | None) -> list[ET.Element]:
        out: list[ET.Element] = []
        while sid and sid in self.by and self.by[sid] not in out:
            out.append(self.by[sid])
            base = kid(self.by[sid], "basedOn")
            sid = attr(base, "val") if base is not None else None
        return out

    def toggles(self, sid: str | None) -> dict[str, bool]:
        """Bold, italic and strike of a style: switches along the chain cancel one another."""
        out = {}
        for key in ("b", "i", "strike"):
            n = sum(flag(kid(s, "rPr", key)) is True for s in self.chain(sid))
            out[key] = n % 2 == 1
        return out

    def heading(self, sid: str | None) -> int | None:
        for s in self.chain(sid):
            lvl = kid(s, "pPr", "outlineLvl")
            if lvl is not None:
                n = int(attr(lvl, "val") or 9)
                return n + 1 if n < 9 else None
            name = kid(s, "name")
            text = (attr(name, "val") or "").lower() if name is not None else ""
            if m := re.fullmatch(r"heading ([1-9])", text):
                return int(m[1])
            if text == "title":
                return 1
        return None

    def container(self, sid: str | None) -> str | None:
        for s in self.chain(sid):
            name = kid(s, "name")
            text = (attr(name, "val") or "").lower() if name is not None else ""
            if text in ("quote", "intense quote", "block text"):
                return "quote"
            if re.search(r"\bcode\b|html preformatted|source", text):
                return "code"
        return None

    def numbering(self, sid: str | None) -> ET.Element | None:
        return next((n for s in self.chain(sid) if (n := kid(s, "pPr", "numPr")) is not None), None)


FORMATS = {"decimal": "decimal", "lowerLetter": "alpha", "upperLetter": "Alpha", "lowerRoman": "roman", "upperRoman": "Roman", "decimalZero": "decimal"}


class Numbering:
    """List counters: one state for each numbering, nine levels; a level starts again after a higher one was used."""

    def __init__(self, root: ET.Element | None):
        self.levels: dict[str, dict[int, tuple[str, int, str, int | None]]] = {}
        abstract = {attr(a, "abstractNumId"): a for a in kids(root, "abstractNum")}
        for n in kids(root, "num"):
            ref = kid(n, "abstractNumId")
            a = abstract.get(attr(ref, "val") if ref is not None else None)
            lv = {}
            for level in [*kids(a, "lvl"), *(x for o in kids(n, "lvlOverride") for x in kids(o, "lvl"))]:
                val = lambda k, d=None, level=level: attr(x, "val") if (x := kid(level, k)) is not None else d
                restart = val("lvlRestart")
                lv[int(attr(level, "ilvl") or 0)] = (val("numFmt", "decimal"), int(val("start", "1") or 1), val("lvlText", "") or "", int(restart) if restart is not None else None)
            for o in kids(n, "lvlOverride"):
                s, i = kid(o, "startOverride"), int(attr(o, "ilvl") or 0)
                if s is not None and i in lv:
                    lv[i] = (lv[i][0], int(attr(s, "val") or 1), *lv[i][2:])
            self.levels[attr(n, "numId") or ""] = lv
        self.count: dict[str, dict[int, int]] = {}

    def next(self, num: str, level: int) -> tuple[str, int, str | None] | None:
        lv = self.levels.get(num, {})
        if level not in lv:
            return None
        fmt, start, pattern, _ = lv[level]
        c = self.count.setdefault(num, {})
        c[level] = c[level] + 1 if level in c else start
        for deeper, (_, _, _, restart) in lv.items():
            if deeper > level and (restart is None or 0 < restart and level < restart):
                c.pop(deeper, None)
        if fmt in ("bullet", "none"):
            return "", c[level], None
        kind = FORMATS.get(fmt, "decimal")
        text = re.sub(r"%(\d)", lambda m: number_label(FORMATS.get(lv.get(int(m[1]) - 1, ("decimal",))[0], "decimal"), c.get(int(m[1]) - 1, lv.get(int(m[1]) - 1, ("", 1))[1]))[:-1], pattern)
        return kind, c[level], None if text == number_label(kind, c[level]) else text or None


def text_boxes(e: ET.Element) -> list[ET.Element]:
    """Text boxes below an element, in order: no fallback copies, and none inside another, which is found with that one's blocks."""
    out, todo = [], list(e)[::-1]
    while todo:
        c = todo.pop()
        if local(c.tag) == "txbxContent":
            out.append(c)
        elif local(c.tag) != "Fallback":
            todo += list(c)[::-1]
    return out


class Word:
    def __init__(self, pkg: Package, part: str):
        self.pkg, self.part = pkg, part
        self.rels = pkg.rels(part)
        by = {}
        for k, t, outside in self.rels.values():
            if not outside:
                by.setdefault(k, t)
        self.styles = Styles(pkg.optional(by.get("styles")))
        self.numbers = Numbering(pkg.optional(by.get("numbering")))
        self.doc = Document()
        for key, mark in (("footnotes", "fn"), ("endnotes", "en")):
            root = pkg.optional(by.get(key))
            for n in kids(root, "footnote", "endnote"):
                if (attr(n, "type") or "normal") == "normal":
                    self.doc.notes[f"{mark}{attr(n, 'id')}"] = self.blocks(n)

    def convert(self, root: ET.Element) -> Document:
        body = kid(root, "body")
        if body is None:
            raise ConvertError("missingPart", "document body")
        self.doc.blocks = self.blocks(body)
        return self.doc

    def blocks(self, parent: ET.Element) -> list[Block]:
        out: list[Block] = []
        entries: list[tuple[int, str, int, list[Block], str | None]] = []
        styled: tuple[str, list[list[Run]]] | None = None

        def flush() -> None:
            nonlocal styled
            if entries:
                out.extend(fold_list(entries))
                entries.clear()
            if styled:
                kind, ps = styled
                out.append(Block("code", text="\n".join(plain(p) for p in ps)) if kind == "code" else Block("quote", blocks=[Block("paragraph", runs=p) for p in ps]))
                styled = None

        for e in self.flat(parent):
            if local(e.tag) == "tbl":
                flush()
                out.append(self.table(e))
                continue
            ppr = kid(e, "pPr")
            sid = attr(s, "val") if (s := kid(ppr, "pStyle")) is not None else None
            runs, anchors = self.runs(e, sid)
            outline = kid(ppr, "outlineLvl")
            level = int(attr(outline, "val") or 9) + 1 if outline is not None else self.styles.heading(sid)
            num = self.number(ppr, sid)
            if level and level <= 9 and plain(runs).strip():
                flush()
                label = num[3] or (number_label(num[1], num[2]) if num[1] else "") if num else ""
                out.append(Block("heading", runs=[Run(label + " "), *runs] if label else runs, level=level, anchors=anchors))
            elif num:
                if styled:
                    flush()
                entries.append((num[0], num[1], num[2], [Block("paragraph", runs=runs, anchors=anchors)], num[3]))
            elif kind := self.styles.container(sid):
                if entries or styled and styled[0] != kind:
                    flush()
                styled = styled or (kind, [])
                styled[1].append(runs)
            elif runs:
                flush()
                out.append(Block("paragraph", runs=runs, anchors=anchors))
            for box in text_boxes(e):
                flush()
                out.extend(self.blocks(box))
            if any(local(x.tag) == "drawing" for x in e.iter()) and (drawn := graphic_blocks(e, self.rels, self.pkg)):
                flush()
                out.extend(drawn)
        flush()
        return out

    def flat(self, parent: ET.Element):
        for e in parent:
            t = local(e.tag)
            if t in ("p", "tbl"):
                yield e
            elif t in ("sdt", "customXml", "sdtContent", "ins", "smartTag", "moveTo"):
                yield from self.flat(e)
            elif t == "AlternateContent":
                yield from self.flat(kid(e, "Choice") if kid(e, "Choice") is not None else kid(e, "Fallback") or e)

    def number(self, ppr: ET.Element | None, sid: str | None) -> tuple[int, str, int, str | None] | None:
        own, base = kid(ppr, "numPr"), self.styles.numbering(sid)
        pick = lambda k: next((attr(x, "val") for n in (own, base) if n is not None and (x := kid(n, k)) is not None), None)
        num, level = pick("numId"), int(pick("ilvl") or 0)
        if not num or num == "0":
            return None
        got = self.numbers.next(num, level)
        return (level, *got) if got else None

    def runs(self, p: ET.Element, sid: str | None) -> tuple[list[Run], list[str]]:
        out: list[Run] = []
        anchors: list[str] = []
        base = self.styles.toggles(sid)
        field: list[str] = []
        state = {"in": 0, "href": None}

        def style(r: ET.Element) -> dict[str, bool]:
            rpr = kid(r, "rPr")
            rs = kid(rpr, "rStyle")
            own = self.styles.toggles(attr(rs, "val")) if rs is not None else {"b": False, "i": False, "strike": False}
            get = lambda k: flag(kid(rpr, k)) if flag(kid(rpr, k)) is not None else base[k] != own[k]
            return {"bold": get("b"), "italic": get("i"), "strike": get("strike")}

        def walk(e: ET.Element, href: str | None) -> None:
            for c in e:
                t = local(c.tag)
                if t == "r":
                    st = style(c)
                    for x in c:
                        k = local(x.tag)
                        if k == "fldChar":
                            ft = attr(x, "fldCharType")
                            if ft == "begin":
                                state["in"] = 1
                                field.clear()
                            elif ft == "separate":
                                state["in"] = 2
                                state["href"] = hyperlink("".join(field))
                            else:
                                state.update({"in": 0, "href": None})
                        elif k == "instrText":
                            field.append(x.text or "")
                        elif k == "t":
                            out.append(Run(x.text or "", href=href or state["href"], **st))
                        elif k == "tab":
                            out.append(Run("\t", **st))
                        elif k in ("br", "cr"):
                            out.append(Run(kind="break"))
                        elif k == "noBreakHyphen":
                            out.append(Run("-", **st))
                        elif k == "sym":
                            cp = int(attr(x, "char") or "0", 16)
                            out.append(Run(chr(cp - 0xF000 if 0xF000 <= cp <= 0xF0FF else cp) if cp else "", **st))
                        elif k in ("footnoteReference", "endnoteReference"):
                            out.append(Run(("fn" if k[0] == "f" else "en") + (attr(x, "id") or ""), kind="note"))
                        elif k in ("drawing", "pict", "object"):
                            for d in all_of(x, "docPr")[:1]:
                                if attr(d, "descr"):
                                    out.append(Run(attr(d, "descr") or "", kind="image"))
                elif t == "hyperlink":
                    rid, anchor = attr(c, "id"), attr(c, "anchor")
                    to = self.rels.get(rid or "", ("", None, False))[1] if rid else None
                    walk(c, (to or "") + (f"#{anchor}" if anchor and not to else "") or None)
                elif t == "bookmarkStart":
                    if (attr(c, "name") or "") not in ("", "_GoBack"):
                        anchors.append(attr(c, "name") or "")
                elif t == "fldSimple":
                    walk(c, hyperlink(attr(c, "instr") or "") or href)
                elif t in ("ins", "smartTag", "sdt", "sdtContent", "moveTo", "dir", "bdo"):
                    walk(c, href)

        walk(p, None)
        return out, anchors

    def table(self, tbl: ET.Element) -> Block:
        g = GridBuilder()
        merges: dict[int, Cell] = {}
        for tr in [x for e in tbl for x in ([e] if local(e.tag) == "tr" else kids(kid(e, "sdtContent"), "tr") if local(e.tag) == "sdt" else [])]:
            row: list[Cell | None] = []
            before = kid(tr, "trPr", "gridBefore")
            for _ in range(min(64, int(attr(before, "val") or 0) if before is not None else 0)):
                row.append(Cell())
            for tc in kids(tr, "tc"):
                pr = kid(tc, "tcPr")
                span = kid(pr, "gridSpan")
                cols = max(1, min(1000, int(attr(span, "val") or 1))) if span is not None else 1
                vm = kid(pr, "vMerge")
                at = len(row)
                if vm is not None and (attr(vm, "val") or "continue") == "continue" and at in merges:
                    merges[at].rows += 1
                    row += [None] * cols
                    continue
                c = Cell(self.blocks(tc), 1, cols)
                if vm is not None:
                    merges[at] = c
                else:
                    merges.pop(at, None)
                row += [c, *[None] * (cols - 1)]
            g.rows.append(row)
            g.spent += len(row)
            if g.spent > 4_000_000:
                raise ConvertError("resourceLimit", "table too large")
        heads = 0
        for tr in kids(tbl, "tr"):
            if flag(kid(tr, "trPr", "tblHeader")):
                heads += 1
            else:
                break
        grid = g.finish()
        return Block("table", grid=grid, header_rows=heads or header_rows(grid))


def header_rows(grid: list[list[Cell | None]]) -> int:
    """The vote for a header row on one table in memory."""
    if len(grid) < 2 or any(c is None or c.cols > 1 or c.rows > 1 for c in grid[0]):
        return 0
    text = [["" if c is None else " ".join(plain(b.runs) for b in c.blocks).strip() for c in row] for row in grid[:51]]
    labels = text[0]
    if any(not x for x in labels[1:]) or len({x.lower() for x in labels}) < len(labels) or any("\n" in x for x in labels):
        return 0
    pro = con = 0
    for k, label in enumerate(labels):
        vals = [r[k] for r in text[1:] if k < len(r) and r[k]]
        kinds = [value_kind(v) for v in vals]
        kind = next((n for n in ("number", "bool", "date", "text") if vals and kinds.count(n) * 10 >= len(vals) * 9), None)
        if kind in ("number", "bool", "date"):
            if value_kind(label) == "text":
                pro += 1
            else:
                con += 1
        elif any(v.lower() == label.lower() for v in vals):
            con += 1
    return int(all(len(x) <= 64 for x in labels)) if not pro and not con else int(pro > con)


def value_kind(v: str) -> str | None:
    from quirel.functions.text import NUMBER, TEMPORAL

    t = v.strip()
    if not t:
        return None
    bare = re.sub(r"[, _\xa0]", "", t.removesuffix("%"))
    if re.match(NUMBER, bare):
        return "number"
    if t.lower() in ("true", "false", "yes", "no"):
        return "bool"
    return "date" if re.match(TEMPORAL, t) else "text"


def hyperlink(instr: str) -> str | None:
    """Target of a HYPERLINK field instruction: address, or #anchor after its switch."""
    toks = re.findall(r'"((?:[^"\\]|\\.)*)"|(\S+)', instr)
    words = [a or b for a, b in toks]
    if not words or words[0].upper() != "HYPERLINK":
        return None
    url = anchor = None
    it = iter(words[1:])
    for w in it:
        if w == "\\l":
            anchor = next(it, None)
        elif w in ("\\o", "\\t"):
            next(it, None)
        elif not w.startswith("\\"):
            url = url or w
    return (url or "") + (f"#{anchor}" if anchor and not url else "") or None


def docx(data: bytes) -> Document:
    pkg = Package(data)
    part = pkg.main_part() or "word/document.xml"
    root = pkg.xml(part)
    if root is None:
        raise ConvertError("missingPart", part)
    return Word(pkg, part).convert(root)


# Spreadsheets

DATE_FORMATS = {*range(14, 18), 22, *range(27, 32), 36, *range(50, 59)}
TIME_FORMATS = {18, 19, 20, 21, 45, 47}


def serial_text(v: float, duration: bool = False) -> str:
    """A date serial as text: days and times, times alone below one day, durations as hours."""
    secs = round(v * 86400)
    if duration:
        a = abs(secs)
        return f"{'-' if secs < 0 else ''}{a // 3600}:{a % 3600 // 60:02d}:{a % 60:02d}"
    if 0 <= v < 1:
        s = secs % 86400
        return f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"
    try:
        t = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=secs)
    except OverflowError:
        return float_text(v)
    return t.strftime("%Y-%m-%d") if secs % 86400 == 0 else t.strftime("%Y-%m-%d %H:%M:%S")


def float_text(v: float) -> str:
    """Shortest form of 15 significant digits, never with an exponent."""
    s = f"{v:.15g}"
    if "e" in s or "E" in s:
        s = f"{v:.20f}".rstrip("0").rstrip(".") if abs(v) < 1 else f"{v:.0f}"
    return "0" if s == "-0" else s


def column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(data: bytes) -> Document:
    pkg = Package(data)
    part = pkg.main_part() or "xl/workbook.xml"
    book = pkg.xml(part)
    if book is None:
        raise ConvertError("missingPart", part)
    rels = pkg.rels(part)
    find = lambda kind: next((t for k, t, o in rels.values() if k == kind and not o), None)
    strings = ["".join(t.text or "" for t in all_of(si, "t")) for si in kids(pkg.optional(find("sharedStrings")), "si")]
    st = pkg.optional(find("styles"))
    custom = {int(attr(f, "numFmtId") or 0): attr(f, "formatCode") or "" for f in kids(kid(st, "numFmts"), "numFmt")}
    formats = [int(attr(x, "numFmtId") or 0) for x in kids(kid(st, "cellXfs"), "xf")]

    def kind_of(i: int) -> str:
        f = formats[i] if 0 <= i < len(formats) else 0
        code = re.sub(r'"[^"]*"|\\.|\[[^hms\]]*\]', "", custom.get(f, "")).lower()
        if f == 46 or re.search(r"\[[hms]+\]", code):
            return "duration"
        return "date" if f in DATE_FORMATS | TIME_FORMATS or re.search(r"[dmyhs]", code) and "0" not in code else ""

    doc = Document()
    sheets = kids(kid(book, "sheets"), "sheet")
    good = 0
    for s in sheets:
        path = rels.get(attr(s, "id") or "", ("", None, False))[1]
        root = pkg.optional(path)
        if root is None:
            doc.warnings.append(f"sheet {attr(s, 'name')} can't be read")
            continue
        good += 1
        cells: dict[tuple[int, int], str] = {}
        r = -1
        for row in kids(kid(root, "sheetData"), "row"):
            r = int(attr(row, "r") or r + 2) - 1
            c = -1
            for e in kids(row, "c"):
                c = column(attr(e, "r") or "") if attr(e, "r") else c + 1
                t, v = attr(e, "t") or "n", kid(e, "v")
                raw = v.text or "" if v is not None else ""
                if t == "s":
                    text = strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else ""
                elif t == "inlineStr":
                    text = "".join(x.text or "" for x in all_of(e, "t"))
                elif t == "b":
                    text = "TRUE" if raw == "1" else "FALSE"
                elif t in ("str", "e", "d"):
                    text = raw
                else:
                    try:
                        k = kind_of(int(attr(e, "s") or 0))
                        text = "" if not raw else serial_text(float(raw), k == "duration") if k else float_text(float(raw))
                    except ValueError:
                        text = raw
                if text:
                    cells[r, c] = text
        if not cells:
            continue
        r0, r1 = min(k[0] for k in cells), max(k[0] for k in cells)
        c0, c1 = min(k[1] for k in cells), max(k[1] for k in cells)
        if (r1 - r0 + 1) * (c1 - c0 + 1) > 4_000_000:
            raise ConvertError("resourceLimit", "sheet too large")
        grid: list[list[Cell | None]] = [[cell(cells.get((i, j), "")) for j in range(c0, c1 + 1)] for i in range(r0, r1 + 1)]
        for m in kids(kid(root, "mergeCells"), "mergeCell"):
            got = re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", attr(m, "ref") or "")
            if not got:
                continue
            a, b, x, y = max(int(got[2]) - 1, r0), min(int(got[4]) - 1, r1), max(column(got[1]), c0), min(column(got[3]), c1)
            if a > b or x > y or grid[a - r0][x - c0] is None:
                continue
            grid[a - r0][x - c0].rows, grid[a - r0][x - c0].cols = b - a + 1, y - x + 1
            for i in range(a, b + 1):
                for j in range(x, y + 1):
                    if (i, j) != (a, x):
                        grid[i - r0][j - c0] = None
        if len(sheets) > 1:
            doc.blocks.append(Block("heading", runs=[Run(attr(s, "name") or "")], level=2))
        doc.blocks.append(Block("table", grid=grid, header_rows=header_rows(grid)))
        for kind, target, outside in pkg.rels(path).values():
            drawing = pkg.optional(target) if kind == "drawing" and not outside else None
            if drawing is not None:
                doc.blocks += graphic_blocks(drawing, pkg.rels(target), pkg)
    if sheets and not good:
        raise ConvertError("malformed", "no sheet can be read")
    return doc


# Presentations


def pptx(data: bytes) -> Document:
    pkg = Package(data)
    part = pkg.main_part() or "ppt/presentation.xml"
    pres = pkg.xml(part)
    if pres is None:
        raise ConvertError("missingPart", part)
    rels = pkg.rels(part)
    doc = Document()
    for sid in kids(kid(pres, "sldIdLst"), "sldId"):
        rid = next((v for k, v in sid.attrib.items() if local(k) == "id" and k != "id"), None)
        path = rels.get(rid or "", ("", "", False))[1]
        root = pkg.optional(path)
        if root is None:
            doc.warnings.append(f"slide {path} can't be read")
            continue
        srels = pkg.rels(path)
        anchor = posixpath.basename(path)
        start = len(doc.blocks)
        shapes(kid(root, "cSld", "spTree"), srels, doc.blocks, pkg, Masters(pkg, srels))
        if len(doc.blocks) > start:
            doc.blocks[start].anchors.append(anchor)
        notes = next((t for k, t, o in srels.values() if k == "notesSlide"), None)
        nroot = pkg.optional(notes)
        if nroot is not None:
            inner: list[Block] = []
            for sp in all_of(nroot, "sp"):
                ph = kid(sp, "nvSpPr", "nvPr", "ph")
                if ph is not None and attr(ph, "type") == "body":
                    body_text(kid(sp, "txBody"), {}, False, inner)
            if inner:
                doc.blocks.append(Block("quote", blocks=inner))
    return doc


class Masters:
    """A slide's layout and its master: what a placeholder takes over from them, by its number first, then by its kind."""

    def __init__(self, pkg: Package, rels: dict):
        self.levels: list[ET.Element] = []
        self.styles: ET.Element | None = None
        for kind in ("slideLayout", "slideMaster"):
            path = next((t for k, t, o in rels.values() if k == kind and not o), None)
            root = pkg.optional(path)
            if root is None:
                break
            self.levels.append(root)
            self.styles = kid(root, "txStyles")
            rels = pkg.rels(path)

    def above(self, ph: ET.Element) -> list[ET.Element]:
        """The placeholders it goes back to, the nearest first."""
        out = []
        for root in self.levels:
            found = [(sp, x) for sp in all_of(root, "sp") if (x := kid(sp, "nvSpPr", "nvPr", "ph")) is not None]
            same = next((sp for sp, x in found if attr(ph, "idx") is not None and attr(x, "idx") == attr(ph, "idx")), None)
            same = same if same is not None else next((sp for sp, x in found if (attr(x, "type") or "body") == (attr(ph, "type") or "body")), None)
            if same is not None:
                out.append(same)
                ph = kid(same, "nvSpPr", "nvPr", "ph")
        return out

    def bulleted(self, sp: ET.Element, ph: ET.Element | None, level: int) -> bool | None:
        """Whether paragraphs of a level have a bullet by the shape's list style, those it goes back to, or the master's text style."""
        name = f"lvl{level + 1}pPr"
        chain = [kid(x, "txBody", "lstStyle", name) for x in [sp, *(self.above(ph) if ph is not None else [])]]
        if ph is not None:
            chain.append(kid(self.styles, "bodyStyle", name))
        for p in chain:
            if kid(p, "buNone") is not None:
                return False
            if kid(p, "buChar") is not None or kid(p, "buAutoNum") is not None:
                return True
        return None


def shapes(parent: ET.Element | None, rels: dict, out: list[Block], pkg: Package, masters: Masters) -> None:
    for e in parent if parent is not None else ():
        t = local(e.tag)
        if t == "grpSp":
            shapes(e, rels, out, pkg, masters)
        elif t == "sp":
            ph = kid(e, "nvSpPr", "nvPr", "ph")
            kind = attr(ph, "type") or "body" if ph is not None else ""
            if kind in ("dt", "ftr", "sldNum", "sldImg"):
                continue
            if kind in ("title", "ctrTitle"):
                runs = [r for p in kids(kid(e, "txBody"), "p") for r in [*text_runs(p, rels), Run(" ")]]
                if plain(runs).strip():
                    out.append(Block("heading", runs=runs, level=2))
            else:
                usual = ph is not None and kind in ("body", "obj")
                told = {lv: masters.bulleted(e, ph if usual else None, lv) for lv in range(9)}
                body_text(kid(e, "txBody"), rels, usual, out, told)
        elif t == "graphicFrame":
            for tbl in all_of(e, "tbl")[:1]:
                out.append(slide_table(tbl, rels))
            out += graphic_blocks(e, rels, pkg)
        elif t == "pic":
            d = kid(e, "nvPicPr", "cNvPr")
            if d is not None and attr(d, "descr"):
                out.append(Block("paragraph", runs=[Run(attr(d, "descr") or "", kind="image")]))


def text_runs(p: ET.Element, rels: dict) -> list[Run]:
    out = []
    for r in p:
        t = local(r.tag)
        if t in ("r", "fld"):
            pr = kid(r, "rPr")
            get = lambda k, pr=pr: pr is not None and (attr(pr, k) or "0") in ("1", "true")
            link = kid(pr, "hlinkClick")
            href = rels.get(attr(link, "id") or "", ("", None, False))[1] if link is not None else None
            x = kid(r, "t")
            out.append(Run(x.text or "" if x is not None else "", bold=get("b"), italic=get("i"), strike=pr is not None and (attr(pr, "strike") or "noStrike") != "noStrike", href=href))
        elif t == "br":
            out.append(Run(kind="break"))
    return out


def body_text(tx: ET.Element | None, rels: dict, bullets: bool, out: list[Block], told: dict[int, bool | None] | None = None) -> None:
    """Paragraphs as lists and text; bullets says what holds where neither the paragraph nor what it goes back to (told, by level) does."""
    entries: list[tuple[int, str, int, list[Block], str | None]] = []
    count: dict[int, int] = {}

    def flush() -> None:
        out.extend(fold_list(entries))
        entries.clear()
        count.clear()

    for p in kids(tx, "p"):
        runs = text_runs(p, rels)
        if not plain(runs).strip():
            continue
        pr = kid(p, "pPr")
        level = int(attr(pr, "lvl") or 0) if pr is not None else 0
        auto = kid(pr, "buAutoNum")
        if auto is not None:
            kind = next((v for k, v in (("alphaLc", "alpha"), ("alphaUc", "Alpha"), ("romanLc", "roman"), ("romanUc", "Roman")) if (attr(auto, "type") or "").startswith(k)), "decimal")
            count[level] = count[level] + 1 if level in count else int(attr(auto, "startAt") or 1)
            entries.append((level, kind, count[level], [Block("paragraph", runs=runs)], None))
        elif kid(pr, "buNone") is None and (kid(pr, "buChar") is not None or (bullets if (by_level := (told or {}).get(level)) is None else by_level)):
            entries.append((level, "", 1, [Block("paragraph", runs=runs)], None))
        else:
            flush()
            out.append(Block("paragraph", runs=runs))
    flush()


def slide_table(tbl: ET.Element, rels: dict) -> Block:
    rows: list[list[Cell | None]] = []
    for tr in kids(tbl, "tr"):
        row: list[Cell | None] = []
        for tc in kids(tr, "tc"):
            if (attr(tc, "hMerge") or "0") in ("1", "true") or (attr(tc, "vMerge") or "0") in ("1", "true"):
                row.append(None)
                continue
            inner: list[Block] = []
            body_text(kid(tc, "txBody"), rels, False, inner)
            row.append(Cell(inner, min(65534, int(attr(tc, "rowSpan") or 1)), min(1000, int(attr(tc, "gridSpan") or 1))))
        rows.append(row)
    pr = kid(tbl, "tblPr")
    first = pr is not None and (attr(pr, "firstRow") or "0") in ("1", "true")
    return Block("table", grid=rows, header_rows=int(first) or header_rows(rows))


__all__ = ["docx", "xlsx", "pptx", "header_rows", "float_text", "serial_text", "hyperlink", "para"]
