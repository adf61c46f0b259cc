"""Legacy compound files on the standard library: the container, spreadsheets (BIFF8), texts and presentations.

Text and structure are read, styles only where they are simple: the spreadsheet's cells and merges, the text document's
paragraphs, tables and links by its special characters, its headings, lists and emphasis by its formatting pages, the presentation's slides with titles and bodies.
"""

from __future__ import annotations

import re
import struct

from .drawings import without_base
from .model import Block, Cell, ConvertError, Document, GridBuilder, Run, cell, fold_list
from .office import float_text, header_rows, hyperlink, serial_text
from .pptstyle import StyleRuns, parse_style_text
from .wordbin import Formats

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
STREAM_MAX = 128 << 20
RECORDS_MAX = 16_000_000


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ConvertError("malformed", "no compound file")
        self.data = data
        self.size = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini = 1 << struct.unpack_from("<H", data, 32)[0]
        if not 64 <= self.size <= 65536 or not 2 <= self.mini <= self.size:
            raise ConvertError("malformed", "compound file sector size")
        n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, first_mini = struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0]
        difat = list(struct.unpack_from("<109I", data, 76))
        nxt, seen = struct.unpack_from("<I", data, 68)[0], set()
        while nxt < 0xFFFFFFFA and nxt not in seen:
            seen.add(nxt)
            block = struct.unpack(f"<{self.size // 4}I", self.sector(nxt))
            difat += block[:-1]
            nxt = block[-1]
        self.fat: list[int] = []
        for s in difat[:n_fat]:
            if s < 0xFFFFFFFA:
                self.fat += struct.unpack(f"<{self.size // 4}I", self.sector(s))
        self.entries: list[tuple[str, int, int, int]] = []
        #: Directory place -> (name, kind, left sibling, right sibling, child).
        self.tree: dict[int, tuple[str, int, int, int, int]] = {}
        d = self.chain(first_dir)
        for i in range(0, len(d) - 127, 128):
            e = d[i : i + 128]
            n = struct.unpack_from("<H", e, 64)[0]
            if e[66] in (1, 2, 5):
                self.tree[i // 128] = (e[: max(0, n - 2)].decode("utf-16-le", "replace"), e[66], *struct.unpack_from("<III", e, 68))
                self.entries.append((e[: max(0, n - 2)].decode("utf-16-le", "replace"), e[66], struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<Q", e, 120)[0] & 0xFFFFFFFF))
        root = next((x for x in self.entries if x[1] == 5), None)
        self.ministream = self.chain(root[2]) if root else b""
        raw = self.chain(first_mini) if first_mini < 0xFFFFFFFA else b""
        self.minifat = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def root_streams(self) -> set[str]:
        """Names of the streams that lie directly in the root, not in an embedded document's storage."""
        todo = [child for _, kind, _, _, child in self.tree.values() if kind == 5]
        seen: set[int] = set()
        names = set()
        while todo:
            at = todo.pop()
            if at in seen or at not in self.tree:
                continue
            seen.add(at)
            name, kind, left, right, _ = self.tree[at]
            if kind == 2:
                names.add(name)
            todo += [left, right]
        return names

    def sector(self, n: int) -> bytes:
        s = self.data[(n + 1) * self.size : (n + 2) * self.size]
        return s + b"\0" * (self.size - len(s))

    def chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < 0xFFFFFFFA and n not in seen and n < len(self.fat) and len(seen) * self.size < STREAM_MAX:
            seen.add(n)
            out.append(self.sector(n))
            n = self.fat[n]
        return b"".join(out)

    def stream(self, *names: str) -> bytes | None:
        for name in names:
            for e, kind, start, size in self.entries:
                if kind == 2 and e.lower() == name.lower():
                    if size > STREAM_MAX:
                        raise ConvertError("resourceLimit", f"{name} is too large")
                    if size >= self.cutoff:
                        return self.chain(start)[:size]
                    out, seen, n = [], set(), start
                    while n < 0xFFFFFFFA and n not in seen and n < len(self.minifat):
                        seen.add(n)
                        out.append(self.ministream[n * self.mini : (n + 1) * self.mini])
                        n = self.minifat[n]
                    return b"".join(out)[:size]
        return None


# Spreadsheets


def records(data: bytes):
    """(type, body) of a record stream, continuations joined to the record before."""
    pos, last, n = 0, None, 0
    while pos + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, pos)
        body = data[pos + 4 : pos + 4 + size]
        pos += 4 + size
        n += 1
        if n > RECORDS_MAX:
            raise ConvertError("resourceLimit", "too many records")
        if kind == 0x3C and last:
            last[1].append(body)
            continue
        if last:
            yield last[0], last[1]
        last = (kind, [body])
    if last:
        yield last[0], last[1]


class Parts:
    """Bytes of a record with continuations; a text that runs over a border begins again with an encoding byte."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.i = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0 and self.k < len(self.parts):
            got = self.parts[self.k][self.i : self.i + n]
            out += got
            self.i += len(got)
            n -= len(got)
            if n > 0:
                self.k, self.i = self.k + 1, 0
        return out

    def text(self, chars: int, wide: bool) -> str:
        out = []
        while chars > 0 and self.k < len(self.parts):
            if self.i >= len(self.parts[self.k]):
                self.k, self.i = self.k + 1, 0
                if self.k < len(self.parts):
                    wide = bool(self.take(1)[0] & 1)
                continue
            room = (len(self.parts[self.k]) - self.i) // (2 if wide else 1)
            n = min(chars, room)
            if n == 0:
                self.i = len(self.parts[self.k])
                continue
            out.append(self.take(n * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace"))
            chars -= n
        return "".join(out)

    def string(self) -> str:
        head = self.take(3)
        if len(head) < 3:
            return ""
        n, flags = struct.unpack("<HB", head)
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        ext = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        s = self.text(n, bool(flags & 1))
        self.take(runs * 4 + ext)
        return s


def rk(v: int) -> float:
    x = float((v >> 2) - (1 << 30 if v & 0x80000000 else 0)) if v & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", v & 0xFFFFFFFC))[0]
    return x / 100 if v & 1 else x


def xls(data: bytes) -> Document:
    book = Compound(data).stream("Workbook", "Book")
    if book is None:
        raise ConvertError("missingPart", "Workbook")
    strings: list[str] = []
    formats: dict[int, str] = {}
    xfs: list[int] = []
    names: list[str] = []
    sheets: list[dict] = []
    cur: dict | None = None
    pending = None
    date_ids = {*range(14, 23), *range(45, 48)}

    def shown(v: float, xf: int) -> str:
        f = xfs[xf] if xf < len(xfs) else 0
        code = re.sub(r'"[^"]*"|\\.|\[[^hms\]]*\]', "", formats.get(f, "")).lower()
        if f == 46 or re.search(r"\[[hms]+\]", code):
            return serial_text(v, True)
        return serial_text(v) if f in date_ids or (re.search("[dmyhs]", code) and "0" not in code) else float_text(v)

    for kind, parts in records(book):
        b = parts[0]
        if kind == 0x2F:
            raise ConvertError("encrypted", "an encrypted workbook")
        if kind == 0x809 and len(b) >= 4 and struct.unpack_from("<H", b, 2)[0] == 0x10:
            cur = {"cells": {}, "merges": []}
            sheets.append(cur)
        elif kind == 0x85 and len(b) >= 8:
            wide = b[7] & 1
            names.append(b[8 : 8 + b[6] * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace"))
        elif kind == 0xFC:
            p = Parts([b[8:], *parts[1:]])
            strings = [p.string() for _ in range(min(struct.unpack_from("<I", b, 4)[0], 4_000_000))]
        elif kind == 0x41E and len(b) >= 5:
            p = Parts([b[2:]])
            formats[struct.unpack_from("<H", b)[0]] = p.string()
        elif kind == 0xE0:
            xfs.append(struct.unpack_from("<H", b, 2)[0])
        elif cur is None or len(b) < 6:
            continue
        elif kind == 0xFD:
            r, c, _, i = struct.unpack_from("<HHHI", b)
            cur["cells"][r, c] = strings[i] if i < len(strings) else ""
        elif kind == 0x204:
            r, c = struct.unpack_from("<HH", b)
            cur["cells"][r, c] = Parts([b[6:], *parts[1:]]).string()
        elif kind == 0x203:
            r, c, x, v = struct.unpack_from("<HHHd", b)
            cur["cells"][r, c] = shown(v, x)
        elif kind == 0x27E:
            r, c, x, v = struct.unpack_from("<HHHI", b)
            cur["cells"][r, c] = shown(rk(v), x)
        elif kind == 0xBD:
            r, c = struct.unpack_from("<HH", b)
            for k in range((len(b) - 6) // 6):
                x, v = struct.unpack_from("<HI", b, 4 + 6 * k)
                cur["cells"][r, c + k] = shown(rk(v), x)
        elif kind == 0x205:
            r, c, _, v, err = struct.unpack_from("<HHHBB", b)
            cur["cells"][r, c] = "#Err" if err else "TRUE" if v else "FALSE"
        elif kind == 0x6 and len(b) >= 14:
            r, c, x = struct.unpack_from("<HHH", b)
            if b[12:14] == b"\xff\xff":
                pending = (r, c) if b[6] == 0 else None
                if b[6] == 1:
                    cur["cells"][r, c] = "TRUE" if b[8] else "FALSE"
            else:
                cur["cells"][r, c] = shown(struct.unpack_from("<d", b, 6)[0], x)
        elif kind == 0x207 and pending:
            cur["cells"][pending] = Parts(parts).string()
        elif kind == 0xE5:
            cur["merges"] += [struct.unpack_from("<4H", b, 2 + 8 * k) for k in range((len(b) - 2) // 8)]
    doc = Document()
    for k, s in enumerate(sheets):
        cells = {p: t for p, t in s["cells"].items() if t}
        if not cells:
            continue
        r0, r1, c0, c1 = min(p[0] for p in cells), max(p[0] for p in cells), min(p[1] for p in cells), max(p[1] for p in cells)
        if (r1 - r0 + 1) * (c1 - c0 + 1) > 4_000_000:
            raise ConvertError("resourceLimit", "sheet too large")
        grid: list[list[Cell | None]] = [[cell(cells.get((i, j), "")) for j in range(c0, c1 + 1)] for i in range(r0, r1 + 1)]
        for a, b, x, y in s["merges"]:
            a, b, x, y = max(a, r0), min(b, r1), max(x, c0), min(y, c1)
            if a <= b and x <= y and grid[a - r0][x - c0] is not None:
                grid[a - r0][x - c0].rows, grid[a - r0][x - c0].cols = b - a + 1, y - x + 1
                for i in range(a, b + 1):
                    for j in range(x, y + 1):
                        if (i, j) != (a, x):
                            grid[i - r0][j - c0] = None
        if len(sheets) > 1:
            doc.blocks.append(Block("heading", runs=[Run(names[k] if k < len(names) else f"Sheet{k + 1}")], level=2))
        doc.blocks.append(Block("table", grid=grid, header_rows=header_rows(grid)))
    return doc


# Texts


def doc(data: bytes) -> Document:
    """Paragraphs and tables of a legacy text by its piece table; fields become links or their results."""
    ole = Compound(data)
    word = ole.stream("WordDocument")
    if word is None or len(word) < 0x1AA:
        raise ConvertError("missingPart", "WordDocument")
    flags = struct.unpack_from("<H", word, 10)[0]
    if flags & 0x100:
        raise ConvertError("encrypted", "an encrypted text")
    table = ole.stream("1Table" if flags & 0x200 else "0Table", "0Table", "1Table")
    ccp = struct.unpack_from("<I", word, 0x4C)[0]
    fc, lcb = struct.unpack_from("<II", word, 0x1A2)
    if table is None:
        raise ConvertError("missingPart", "table stream")
    clx, pos, text = table[fc : fc + lcb], 0, []
    pieces: list[tuple[int, int, int, int]] = []
    while pos < len(clx):
        if clx[pos] == 1:
            pos += 3 + struct.unpack_from("<H", clx, pos + 1)[0]
        elif clx[pos] == 2:
            size = struct.unpack_from("<I", clx, pos + 1)[0]
            plc = clx[pos + 5 : pos + 5 + size]
            n = (len(plc) - 4) // 12
            cps = struct.unpack_from(f"<{n + 1}I", plc)
            for k in range(n):
                at = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * k + 2)[0]
                chars = cps[k + 1] - cps[k]
                if at & 0x40000000:
                    start = (at & 0x3FFFFFFF) // 2
                    pieces.append((cps[k], cps[k + 1], start, 1))
                    text.append(word[start : start + chars].decode("cp1252", "replace"))
                else:
                    pieces.append((cps[k], cps[k + 1], at, 2))
                    text.append(word[at : at + 2 * chars].decode("utf-16-le", "replace"))
            break
        else:
            break
    whole = "".join(text)
    # A character outside the basic plane takes two places; positions only hold without any.
    formats = Formats(word, table, pieces) if len(word) >= 0x2F2 and pieces and len(whole) == pieces[-1][1] else None
    return from_marks(whole[:ccp] if ccp else whole, formats)


def from_marks(text: str, formats: Formats | None = None) -> Document:
    """Blocks of a text with the old format's special characters: paragraph, cell, break and field marks; with formats also emphasis, headings and lists."""
    out = Document()
    entries: list = []
    counts: dict[tuple[int, int], int] = {}
    grid: GridBuilder | None = None
    row: list[Cell] = []
    inner: list[Block] = []

    def styled(s: str, at: int, href: str | None = None) -> list[Run]:
        """Text from a place on as runs of one emphasis each, with line breaks."""
        got: list[Run] = []
        for k, c in enumerate(s):
            if c == "\x0b":
                got.append(Run(kind="break"))
                continue
            c = "-" if c == "\x1e" else "" if c < "\t" or "\x0e" <= c <= "\x1f" else c
            look = formats.emphasis(at + k) if formats else (False, False, False)
            if got and got[-1].kind == "text" and (got[-1].bold, got[-1].italic, got[-1].strike) == look:
                got[-1].text += c
            else:
                got.append(Run(c, *look, href=href))
        return got

    def runs(s: str, at: int) -> list[Run]:
        got: list[Run] = []
        end = 0
        for m in re.finditer("\x13([^\x13\x14\x15]*)(?:\x14([^\x13\x15]*))?\x15", s):
            got += styled(s[end : m.start()], at + end)
            if m[2]:
                got += styled(m[2], at + m.start(2), hyperlink(m[1]))
            end = m.end()
        got += styled(s[end:], at + end)
        return [r for r in got if r.text or r.kind == "break"]

    def flush() -> None:
        out.blocks.extend(fold_list(entries))
        entries.clear()

    def close() -> None:
        nonlocal grid
        if grid is not None:
            g = grid.finish()
            if g:
                out.blocks.append(Block("table", grid=g, header_rows=header_rows(g)))
            grid = None

    for m in re.finditer("([^\r\x07\x0c]*)([\r\x07\x0c]|$)", text):
        s, end = m[1], m[2]
        rs = runs(s, m.start(1))
        if end == "\x07":
            if not s and not inner and row:
                if grid is None:
                    flush()
                    grid = GridBuilder()
                grid.add_row(row)
                row = []
            else:
                row.append(Cell([*inner, *([Block("paragraph", runs=rs)] if rs else [])]))
                inner = []
            continue
        if row:
            if rs:
                inner.append(Block("paragraph", runs=rs))
            continue
        if rs:
            close()
            item = formats.entry(m.end(1)) if formats else None
            level = formats.heading(m.end(1)) if formats else None
            if level:
                flush()
                out.blocks.append(Block("heading", runs=without_base(rs, {"bold": all(r.bold for r in rs), "italic": all(r.italic for r in rs)}), level=level))
            elif item:
                depth, kind, start, n = item
                for key in [k for k in counts if k[0] == n and k[1] > depth]:
                    del counts[key]
                counts[n, depth] = counts[n, depth] + 1 if (n, depth) in counts else start or 1
                entries.append((depth, kind, counts[n, depth] if kind else 1, [Block("paragraph", runs=rs)], None))
            else:
                flush()
                out.blocks.append(Block("paragraph", runs=rs))
    flush()
    close()
    return out


# Presentations


def ppt(data: bytes) -> Document:
    """Slides of a legacy presentation: texts of the slide list in order, titles as headings."""
    ole = Compound(data)
    s = ole.stream("PowerPoint Document")
    if s is None:
        raise ConvertError("missingPart", "PowerPoint Document")
    out = Document()
    kind = 4

    waiting: list[tuple[str, int]] = []

    def emit(styles: StyleRuns) -> None:
        """The text that waits for its style runs, as blocks."""
        if not waiting:
            return
        t, k = waiting.pop()
        look = styles.emphasis(len(t))
        lines: list[tuple[str, list[Run], int, bool | None]] = []
        for m in re.finditer("[^\r\x0b]+", t):
            if not m[0].replace("\x00", "").strip() or m[0].strip() == "*":
                continue
            got: list[Run] = []
            for c, (bold, italic) in zip(m[0], look[m.start() : m.end()]):
                if got and (got[-1].bold, got[-1].italic) == (bold, italic):
                    got[-1].text += c.replace("\x00", "")
                else:
                    got.append(Run(c.replace("\x00", ""), bold, italic))
            lines.append((m[0].replace("\x00", ""), got, *styles.paragraph(m.start())))
        if not lines:
            return
        if k in (0, 6):
            out.blocks.append(Block("heading", runs=[Run(" ".join(x[0] for x in lines))], level=2))
        elif k in (1, 5, 7, 8):
            entries: list = []
            for _, rs, level, bullet in lines:
                if bullet is False:
                    out.blocks.extend(fold_list(entries))
                    entries = []
                    out.blocks.append(Block("paragraph", runs=rs))
                else:
                    entries.append((level, "", 1, [Block("paragraph", runs=rs)], None))
            out.blocks.extend(fold_list(entries))
        elif k == 2:
            out.blocks.append(Block("quote", blocks=[Block("paragraph", runs=x[1]) for x in lines]))
        else:
            out.blocks += [Block("paragraph", runs=x[1]) for x in lines]

    def walk(a: int, b: int, depth: int, inside: bool) -> None:
        nonlocal kind
        while a + 8 <= b and depth < 64:
            ver, typ, size = struct.unpack_from("<HHI", s, a)
            end = min(b, a + 8 + size)
            if ver & 15 == 15:
                walk(a + 8, end, depth + 1, inside or typ == 4080)
            elif typ == 3999 and size >= 4:
                emit(StyleRuns())
                kind = struct.unpack_from("<I", s, a + 8)[0]
            elif inside and typ in (4000, 4008):
                emit(StyleRuns())
                waiting.append((s[a + 8 : end].decode("utf-16-le" if typ == 4000 else "latin-1", "replace"), kind))
            elif inside and typ == 4001 and waiting:
                emit(parse_style_text(s[a + 8 : end], len(waiting[0][0])))
            a = end if end > a else b
        emit(StyleRuns())

    walk(0, len(s), 0, False)
    if not out.blocks:
        # Without a slide list every text record is taken, in the order of the stream.
        walk(0, len(s), 0, True)
        out.warnings.append("slides in stream order")
    return out
