"""HTML and EPUB as documents: a tag-soup tree, a small part of CSS, and the block walk."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote

from .model import Block, Cell, ConvertError, Document, GridBuilder, Item, Run, plain
from .office import header_rows
from .package import Package, all_of, attr, kids, local, resolve

VOID = set("area base br col embed hr img input link meta source track wbr".split())
DROPPED = set("script style head template noscript title svg math iframe object".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
BOLD, ITALIC, STRIKE, CODE = set("b strong th".split()), set("i em cite dfn var address".split()), set("s strike del".split()), set("code kbd samp tt".split())
#: Open tags that a tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
COLLAPSE = re.compile(r"[ \t\r\n\f]+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


class Soup(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and len(self.stack) == 1:
            return
        if tag in ENDS:
            cut = None
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in STOPS[tag]:
                    break
                if self.stack[k].tag in ENDS[tag]:
                    cut = k
            if cut is not None:
                del self.stack[cut:]
        elif tag in BLOCKS and self.stack[-1].tag == "p":
            self.stack.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID and len(self.stack) < 256:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                break

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def from_element(e: ET.Element) -> Node:
    n = Node(local(e.tag).lower(), {local(k): v for k, v in e.attrib.items()})
    if e.text:
        n.children.append(e.text)
    for c in e:
        if isinstance(c.tag, str):
            n.children.append(from_element(c))
        if c.tail:
            n.children.append(c.tail)
    return n


class Sheet:
    """CSS subset: tag, .class and tag.class rules for weight, style, decoration and display; !important wins."""

    def __init__(self) -> None:
        self.rules: list[tuple[int, int, str, str, dict[str, tuple[str, bool]]]] = []

    @staticmethod
    def declarations(body: str) -> dict[str, tuple[str, bool]]:
        out = {}
        for d in body.split(";"):
            k, _, v = d.partition(":")
            v = v.strip().lower()
            if v:
                out[k.strip().lower()] = (v.replace("!important", "").strip(), "!important" in v)
        return out

    def add(self, css: str) -> None:
        css = re.sub(r"/\*.*?\*/|@[^{;]*;", "", css, flags=re.S)
        for sel, body in re.findall(r"([^{}]+)\{([^{}]*)\}", css):
            for s in sel.split(","):
                m = re.fullmatch(r"([a-zA-Z][\w-]*)?(?:\.([\w-]+))?", s.strip())
                if m and (m[1] or m[2]):
                    self.rules.append((10 * bool(m[2]) + bool(m[1]), len(self.rules), (m[1] or "").lower(), m[2] or "", self.declarations(body)))

    def of(self, n: Node) -> dict[str, str]:
        classes = set(n.attrs.get("class", "").split())
        hits = sorted((r for r in self.rules if (not r[2] or r[2] == n.tag) and (not r[3] or r[3] in classes)), key=lambda r: r[:2])
        layers = [r[4] for r in hits] + [self.declarations(n.attrs.get("style", ""))]
        out: dict[str, str] = {}
        for important in (False, True):
            for d in layers:
                out.update({k: v for k, (v, i) in d.items() if i == important})
        return out


class Walker:
    def __init__(self, sheet: Sheet, link=lambda h: h, image=lambda s: s, anchor=lambda a: a):
        self.sheet, self.link, self.image, self.anchor = sheet, link, image, anchor

    def style(self, n: Node, s: dict) -> dict | None:
        """Inherited style with the tag's and the sheet's; None if the element isn't shown."""
        css = self.sheet.of(n)
        if css.get("display") == "none" or "hidden" in n.attrs:
            return None
        s = dict(s)
        if n.tag in BOLD:
            s["bold"] = True
        if n.tag in ITALIC:
            s["italic"] = True
        if n.tag in STRIKE:
            s["strike"] = True
        if n.tag in CODE:
            s["code"] = True
        w = css.get("font-weight")
        if w:
            s["bold"] = w in ("bold", "bolder") or (w.isdigit() and int(w) >= 600)
        if "font-style" in css:
            s["italic"] = css["font-style"] in ("italic", "oblique")
        if "line-through" in css.get("text-decoration", "") + css.get("text-decoration-line", ""):
            s["strike"] = True
        return s

    def has_blocks(self, n: Node) -> bool:
        return any(isinstance(c, Node) and c.tag not in DROPPED and (c.tag in BLOCKS or self.has_blocks(c)) for c in n.children)

    def blocks(self, n: Node, s: dict | None = None) -> list[Block]:
        out: list[Block] = []
        self.walk(n, s or {}, out, [])
        return out

    def flush(self, runs: list[Run], out: list[Block]) -> None:
        tidy = squeeze(runs)
        if any(r.kind != "text" or r.text.strip() for r in tidy):
            out.append(Block("paragraph", runs=tidy))
        runs.clear()

    def walk(self, n: Node, s: dict, out: list[Block], runs: list[Run]) -> None:
        for c in n.children:
            if isinstance(c, str):
                runs.append(Run(c, **s))
                continue
            if c.tag in DROPPED:
                continue
            st = self.style(c, s)
            if st is None:
                continue
            if "id" in c.attrs and c.tag not in BLOCKS:
                runs.append(Run(self.anchor(c.attrs["id"]), kind="anchor"))
            if c.tag not in BLOCKS and not self.has_blocks(c):
                self.inline(c, st, runs)
                continue
            self.flush(runs, out)
            at = len(out)
            self.block(c, st, out)
            if "id" in c.attrs and c.tag in BLOCKS and len(out) > at:
                out[at].anchors.append(self.anchor(c.attrs["id"]))
        self.flush(runs, out)

    def block(self, c: Node, st: dict, out: list[Block]) -> None:
        t = c.tag
        if re.fullmatch("h[1-6]", t):
            runs: list[Run] = []
            self.inlines(c, {k: v for k, v in st.items() if k != "bold"}, runs)
            tidy = squeeze(runs)
            if plain(tidy).strip():
                out.append(Block("heading", runs=tidy, level=int(t[1])))
        elif t == "hr":
            out.append(Block("rule"))
        elif t == "pre":
            text = text_of(c).strip("\n")
            if text.strip():
                out.append(Block("code", text=text))
        elif t == "blockquote":
            inner = self.blocks(c, st)
            if inner:
                out.append(Block("quote", blocks=inner))
        elif t in ("ul", "ol", "menu"):
            out.extend(self.list(c, st))
        elif t == "table":
            self.table(c, st, out)
        elif t == "dt":
            out.extend(self.blocks(c, {**st, "bold": True}))
        else:
            self.walk(c, st, out, [])

    def inlines(self, n: Node, s: dict, runs: list[Run]) -> None:
        for c in n.children:
            if isinstance(c, str):
                runs.append(Run(c, **s))
            elif c.tag not in DROPPED and (st := self.style(c, s)) is not None:
                if "id" in c.attrs:
                    runs.append(Run(self.anchor(c.attrs["id"]), kind="anchor"))
                self.inline(c, st, runs)

    def inline(self, c: Node, st: dict, runs: list[Run]) -> None:
        if c.tag == "br":
            runs.append(Run(kind="break"))
        elif c.tag == "img":
            runs.append(Run(c.attrs.get("alt", ""), kind="image", href=self.image(c.attrs.get("src", ""))))
        elif c.tag == "a" and c.attrs.get("href"):
            inner: list[Run] = []
            self.inlines(c, st, inner)
            text = COLLAPSE.sub(" ", plain(inner)).strip()
            to = self.link(c.attrs["href"].strip())
            runs.append(Run(text, href=to, **st) if text or to else Run(""))
        else:
            self.inlines(c, st, runs)

    def list(self, n: Node, st: dict) -> list[Block]:
        ordered = n.tag == "ol"
        kind = {"a": "alpha", "A": "Alpha", "i": "roman", "I": "Roman"}.get(n.attrs.get("type", ""), "decimal") if ordered else ""
        lis = [c for c in n.children if isinstance(c, Node) and c.tag not in DROPPED and (c.tag == "li" or self.has_blocks(c) or text_of(c).strip())]
        number = lambda v, d: int(v) if re.fullmatch(r"\s*-?\d+\s*", v or "") else d
        step = -1 if "reversed" in n.attrs else 1
        k = number(n.attrs.get("start"), len(lis) if step < 0 else 1)
        out: list[Block] = []
        last = None
        for c in lis:
            inner = self.blocks(c, self.style(c, st) or st)
            if ordered:
                k = number(c.attrs.get("value"), k)
            boxes = [x for x in c.children if isinstance(x, Node) and x.tag == "input" and x.attrs.get("type") == "checkbox"]
            item = Item(inner or [Block("paragraph")], "checked" in boxes[0].attrs if boxes else None)
            if out and (not ordered or last is not None and k == last + 1):
                out[-1].items.append(item)
            else:
                out.append(Block("list", ordered=kind, start=k, items=[item]))
            last, k = k, k + step
        for b in out:
            # Markdown can't number from below one, so such a list gets its numbers as text.
            for i, item in enumerate(b.items):
                item.label = f"{b.start + i}." if ordered and b.start < 1 else None
        return out

    def table(self, n: Node, st: dict, out: list[Block]) -> None:
        g = GridBuilder()
        heads, body_seen = 0, False
        groups: list[tuple[str, list[Node]]] = []
        for c in n.children:
            if not isinstance(c, Node):
                continue
            if c.tag == "caption":
                out.extend(self.blocks(c, st))
            elif c.tag in ("thead", "tbody", "tfoot"):
                groups.append((c.tag, [r for r in c.children if isinstance(r, Node) and r.tag == "tr"]))
            elif c.tag == "tr":
                if groups and groups[-1][0] == "":
                    groups[-1][1].append(c)
                else:
                    groups.append(("", [c]))
        span = lambda v, most: max(0, min(most, int(v))) if (v or "").strip().isdigit() else 1
        for tag, rows in groups:
            for i, r in enumerate(rows):
                cells, ths = [], True
                for x in r.children:
                    if isinstance(x, Node) and x.tag in ("td", "th"):
                        down = span(x.attrs.get("rowspan"), 65534)
                        cells.append(Cell(self.blocks(x, {k: v for k, v in (self.style(x, st) or st).items() if x.tag != "th" or k != "bold"}), down or len(rows) - i, max(1, span(x.attrs.get("colspan"), 1000))))
                        ths &= x.tag == "th"
                if cells:
                    g.add_row(cells)
                    if not body_seen and (tag == "thead" or ths):
                        heads += 1
                    else:
                        body_seen = True
        grid = g.finish()
        if grid:
            out.append(Block("table", grid=grid, header_rows=heads or header_rows(grid)))


def squeeze(runs: list[Run]) -> list[Run]:
    """White space collapsed over run borders, none at the ends or around breaks."""
    out: list[Run] = []
    space = True
    for r in runs:
        if r.kind == "text" and r.href is None and not r.code:
            t = COLLAPSE.sub(" ", r.text)
            t = t[1:] if space and t.startswith(" ") else t
            if not t:
                continue
            r = Run(**{**r.__dict__, "text": t})
            space = t.endswith(" ")
        elif r.kind == "break":
            if out and out[-1].kind == "text":
                out[-1].text = out[-1].text.rstrip(" ")
            space = True
        elif r.kind != "anchor":
            space = False
        out.append(r)
    for r in reversed(out):
        if r.kind == "text":
            r.text = r.text.rstrip(" ")
            if r.text:
                break
    return out


def text_of(n: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else text_of(c) for c in n.children)


def find(n: Node, tag: str) -> Node | None:
    for c in n.children:
        if isinstance(c, Node):
            if c.tag == tag:
                return c
            got = find(c, tag)
            if got:
                return got
    return None


def html(text: str) -> Document:
    """Any HTML as blocks, with its style elements; the title is kept apart."""
    soup = Soup()
    soup.feed(text)
    soup.close()
    sheet = Sheet()

    def styles(n: Node) -> None:
        for c in n.children:
            if isinstance(c, Node):
                if c.tag == "style":
                    sheet.add(text_of(c))
                styles(c)

    styles(soup.root)
    t = find(soup.root, "title")
    return Document(Walker(sheet).blocks(soup.root), title=text_of(t).strip() or None if t else None)


def epub(data: bytes) -> Document:
    pkg = Package(data)
    box = pkg.xml("META-INF/container.xml")
    if box is None:
        raise ConvertError("missingPart", "META-INF/container.xml")
    opf = next((attr(r, "full-path") for r in all_of(box, "rootfile")), None)
    root = pkg.xml(opf or "")
    if root is None:
        raise ConvertError("missingPart", opf or "rootfile")
    items = {attr(i, "id"): i for i in all_of(root, "item")}
    doc = Document()
    title = next((t.text for t in all_of(root, "title") if t.text), None)
    if title:
        doc.title = title.strip()
        doc.blocks.append(Block("heading", runs=[Run(doc.title)], level=1))
    for ref in all_of(root, "itemref"):
        item = items.get(attr(ref, "idref"))
        if item is None:
            continue
        path = resolve(opf or "", attr(item, "href") or "")
        raw = pkg.part(path)
        if raw is None:
            doc.warnings.append(f"chapter {path} is missing")
            continue
        tree = pkg.optional(path)
        if tree is not None:
            node = from_element(tree)
        else:
            soup = Soup()
            soup.feed(raw.decode("utf-8", "replace"))
            node = soup.root
        sheet = Sheet()
        head = find(node, "head")
        for c in head.children if head else ():
            if isinstance(c, Node) and c.tag == "style":
                sheet.add(text_of(c))
            elif isinstance(c, Node) and c.tag == "link" and "stylesheet" in c.attrs.get("rel", ""):
                css = pkg.part(resolve(path, c.attrs.get("href", "")))
                sheet.add((css or b"").decode("utf-8", "replace"))

        def link(h: str, path: str = path) -> str:
            if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", h):
                return h
            base, _, frag = h.partition("#")
            file = resolve(path, base) if base else path
            return f"#{posixpath.basename(file)}{'--' + unquote(frag) if frag else ''}"

        got = Walker(sheet, link, lambda s: s if "://" in s else "", lambda a, path=path: f"{posixpath.basename(path)}--{a}").blocks(find(node, "body") or node)
        if got:
            got[0].anchors.append(posixpath.basename(path))
        doc.blocks += got
    return doc


__all__ = ["html", "epub", "kids"]
