"""The document model as GitHub-flavoured Markdown."""

from __future__ import annotations

import re

from .model import Block, Cell, Document, Run, number_label, plain

ACTIVE = "*_~`"
ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def slug(text: str) -> str:
    s = "".join(c for c in text.strip().lower().replace(" ", "-") if c.isalnum() or c in "-_" or re.match(r"\w", c))
    return s or "section"


class Renderer:
    def __init__(self, doc: Document):
        self.doc = doc
        self.note_no: dict[str, int] = {}
        self.anchor: dict[str, str] = {}
        taken: set[str] = set()

        def claim(base: str) -> str:
            n, s = 0, base
            while s in taken:
                n += 1
                s = f"{base}-{n}"
            taken.add(s)
            return s

        targets: set[str] = set()
        every: list[Block] = []

        def walk(blocks: list[Block]) -> None:
            for b in blocks:
                every.append(b)
                for r in b.runs:
                    if r.href and r.href.startswith("#"):
                        targets.add(r.href[1:])
                    if r.kind == "note":
                        self.note_no.setdefault(r.text, len(self.note_no) + 1)
                walk(b.blocks)
                for i in b.items:
                    walk(i.blocks)
                for row in b.grid:
                    for c in row:
                        if c:
                            walk(c.blocks)

        walk(doc.blocks)
        self.note_no = {k: n for n, k in enumerate((k for k in self.note_no if doc.notes.get(k)), 1)}
        for b in every:
            if b.kind == "heading":
                s = claim(slug(plain(b.runs)))
                for a in [*b.anchors, *(r.text for r in b.runs if r.kind == "anchor")]:
                    self.anchor.setdefault(a, s)
        self.tags: dict[str, str] = {}
        for b in every:
            if b.kind != "heading":
                for a in [*b.anchors, *(r.text for r in b.runs if r.kind == "anchor")]:
                    if a in targets and a not in self.anchor:
                        i = re.sub("-+", "-", re.sub(r"[^A-Za-z0-9_.-]", "-", a)).strip("-") or "anchor"
                        self.anchor[a] = self.tags[a] = claim(i)

    # Inline content

    def escape(self, text: str, where: str, start: bool, label: bool = False) -> str:
        """Escapes only what would be read as markup: where is block, heading or cell."""
        out = []
        n = len(text)
        for i, c in enumerate(text):
            rest = text[i + 1 :]
            if c == "\\" or (c == "|" and where == "cell") or (label and c in "[]"):
                out.append("\\" + c)
            elif c == "[" and "]" in rest:
                out.append("\\[")
            elif c == "_" and 0 < i < n - 1 and text[i - 1].isalnum() and text[i + 1].isalnum():
                out.append(c)
            elif c in ACTIVE and (c in rest or c in text[:i]):
                out.append("\\" + c)
            elif c == "<" and rest[:1] and (rest[0].isalpha() or rest[0] in "/!?"):
                out.append("\\<")
            elif c == "&" and ENTITY.match(text, i):
                out.append("&amp;")
            else:
                out.append(c)
        s = "".join(out)
        if start and where == "block":
            lines = s.split("\n")
            for k, x in enumerate(lines):
                x = re.sub(r"^(\s*)(#{1,6}(?=\s|$)|[-+*](?=\s|$)|>|=+\s*$|-+\s*$)", r"\1\\\2", x)
                lines[k] = re.sub(r"^(\s*\d+)([.)])(?=\s|$)", r"\1\\\2", x)
            s = "\n".join(lines)
        return s

    def runs(self, runs: list[Run], where: str, base: tuple[bool, bool] = (False, False)) -> str:
        merged: list[Run] = []
        for r in runs:
            if r.kind == "text" and not r.text:
                continue
            x = Run(**r.__dict__)
            x.bold, x.italic = x.bold and not base[0], x.italic and not base[1]
            if x.kind == "text" and not x.text.strip() and x.href is None:
                x.bold = x.italic = x.strike = x.code = False
            if merged and x.kind == "text" == merged[-1].kind and merged[-1].style() == x.style() and merged[-1].href == x.href:
                merged[-1].text += x.text
            elif len(merged) > 1 and x.kind == "text" and merged[-1].kind == "text" and not merged[-1].text.strip() and merged[-2].kind == "text" and merged[-2].style() == x.style() and any(x.style()) and merged[-2].href == x.href:
                gap = merged.pop()
                merged[-1].text += gap.text + x.text
            else:
                merged.append(x)
        out: list[str] = []
        for r in merged:
            begin = not "".join(out).rsplit("\n", 1)[-1].strip()
            if r.kind == "break":
                out.append({"block": "\\\n", "heading": " ", "cell": "\n"}[where])
            elif r.kind == "anchor":
                if r.text in self.tags:
                    out.append(f'<a id="{self.tags[r.text]}"></a>')
            elif r.kind == "note":
                if r.text in self.note_no:
                    out.append(f"[^{self.note_no[r.text]}]")
            elif r.kind == "image":
                alt = self.escape(r.text, where, False, True)
                out.append(f"![{alt}]({self.target(r.href)})" if r.href else self.escape(r.text, where, begin))
            elif r.href is not None:
                to = r.href
                if to.startswith("#"):
                    to = "#" + self.anchor[to[1:]] if to[1:] in self.anchor else ""
                body = self.styled(r, where, False, True)
                out.append(f"[{body or self.escape(to, where, False, True)}]({self.target(to)})" if to else body)
            else:
                out.append(self.styled(r, where, begin, False))
        return "".join(out)

    def target(self, url: str) -> str:
        s = re.sub(r"[<>|\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url)
        return f"<{s}>" if re.search(r"[\s()]", s) else s

    def styled(self, r: Run, where: str, begin: bool, label: bool) -> str:
        t = r.text
        if r.code and t.strip():
            longest = max(map(len, re.findall("`+", t)), default=0)
            fence = "`" * (longest + 1)
            pad = " " if t.startswith("`") or t.endswith("`") else ""
            return f"{fence}{pad}{t}{pad}{fence}"
        core = t.strip()
        if not core:
            return t
        mark = "~~" * r.strike + "**" * r.bold + "*" * r.italic
        head, tail = t[: len(t) - len(t.lstrip())], t[len(t.rstrip()) :]
        return head + mark + self.escape(core, where, begin and not mark, label) + "*" * r.italic + "**" * r.bold + "~~" * r.strike + tail

    # Blocks

    def block(self, b: Block) -> str | None:
        if b.kind == "rule":
            return "---"
        if b.kind == "code":
            longest = max(map(len, re.findall("`+", b.text)), default=0)
            fence = "`" * max(3, longest + 1)
            return f"{fence}{b.lang}\n{b.text.rstrip(chr(10))}\n{fence}" if b.text.strip() else None
        if b.kind == "heading":
            t = " ".join(self.runs(b.runs, "heading").split())
            return f"{'#' * min(6, max(1, b.level))} {t}" if t else None
        if b.kind == "paragraph":
            t = "\n".join(x.strip() if not x.rstrip().endswith("\\") else x.strip() for x in self.runs(b.runs, "block").split("\n")).strip()
            t = re.sub(r"\\$", "", t).rstrip()
            tags = "".join(f'<a id="{self.tags[a]}"></a>' for a in b.anchors if a in self.tags)
            return tags + t if t or tags else None
        if b.kind == "quote":
            inner = self.blocks(b.blocks)
            return "\n".join(("> " + x).rstrip() for x in inner.split("\n")) if inner else None
        if b.kind == "list":
            return self.list(b)
        if b.kind == "table":
            if len(b.grid) == 1 and len(b.grid[0]) == 1 and b.grid[0][0]:
                return self.blocks(b.grid[0][0].blocks) or None
            return self.table(b)
        return None

    def blocks(self, blocks: list[Block]) -> str:
        return "\n\n".join(x for x in map(self.block, blocks) if x)

    def list(self, b: Block) -> str | None:
        out, loose = [], False
        for k, i in enumerate(b.items):
            label = i.label or (number_label(b.ordered, b.start + k) if b.ordered and b.ordered != "decimal" else None)
            mark = f"- {self.escape(label, 'block', False)} " if label else f"{b.start + k}. " if b.ordered else "- "
            if i.checked is not None:
                mark += "[x] " if i.checked else "[ ] "
            parts = [x for x in map(self.block, i.blocks) if x]
            tight = len(parts) == 1 or all(x.kind == "list" for x in i.blocks[1:])
            body = ("\n" if tight else "\n\n").join(parts)
            loose |= not tight or "\n\n" in body
            lines = body.split("\n")
            out.append("\n".join([mark + lines[0], *((" " * len(mark) if b.ordered == "decimal" else "  ") + x if x else "" for x in lines[1:])]).rstrip())
        return ("\n\n" if loose else "\n").join(out) or None

    def cell(self, c: Cell) -> str:
        parts: list[str] = []
        for b in c.blocks:
            self.cell_block(b, parts)
        return "<br>".join(x for p in parts for x in (y.strip() for y in p.split("\n")) if x)

    def cell_block(self, b: Block, parts: list[str]) -> None:
        if b.kind == "paragraph":
            parts.append(self.runs(b.runs, "cell"))
        elif b.kind == "heading":
            parts.append(f"**{self.runs(b.runs, 'cell', (True, False)).strip()}**")
        elif b.kind == "code":
            parts.append(b.text.replace("|", "\\|"))
        elif b.kind == "list":
            for k, i in enumerate(b.items):
                inner: list[str] = []
                for x in i.blocks:
                    self.cell_block(x, inner)
                mark = i.label or (number_label(b.ordered, b.start + k) if b.ordered else "•")
                parts.append(f"{mark} {' '.join(inner)}")
        elif b.kind == "table":
            for row in b.grid:
                parts.append(" / ".join(self.cell(c) for c in row if c))
        else:
            for x in b.blocks:
                self.cell_block(x, parts)

    def table(self, b: Block) -> str | None:
        width = max(map(len, b.grid), default=0)
        rows = [[self.cell(c) if c else None for c in row] + [""] * (width - len(row)) for row in b.grid]
        while len(rows) > 1 and all(x == "" for x in rows[-1]):
            rows.pop()
        width = max((k + 1 for row in rows for k, x in enumerate(row) if x or x is None), default=0)
        if not width:
            return None
        text = [[x or "" for x in row[:width]] for row in rows]
        head = text.pop(0) if b.header_rows else [""] * width
        line = lambda r: "| " + " | ".join(r) + " |"
        return "\n".join([line(head), line(["---"] * width), *map(line, text)])

    def document(self) -> str:
        out = [x for x in map(self.block, self.doc.blocks) if x]
        for k, n in self.note_no.items():
            body = self.blocks(self.doc.notes[k]).split("\n")
            out.append(f"[^{n}]: " + "\n".join([body[0], *("    " + x if x else "" for x in body[1:])]))
        return "\n\n".join(out) + "\n" if out else ""


def to_markdown(doc: Document) -> str:
    return Renderer(doc).document()
