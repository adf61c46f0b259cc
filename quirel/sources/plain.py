"""Delimited text and RTF as documents."""

from __future__ import annotations

import re
from collections import Counter

from .model import Block, Document, GridBuilder, Run, cell, fold_list, plain
from .office import header_rows, hyperlink


def decode(data: bytes) -> str:
    """UTF-16 by its mark, UTF-8 with or without one, else Windows-1252."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    if data[:3] == b"\xef\xbb\xbf":
        data = data[3:]
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)


def parse_records(text: str, delimiter: str, most: int | None = None) -> list[list[str]]:
    """Records of delimited text: quotes toggle anywhere in a field, two of them stand for one, line ends in quotes are kept."""
    out: list[list[str]] = []
    row: list[str] = []
    buf: list[str] = []
    quoted, i, n = False, 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                buf.append('"')
                i += 1
            else:
                quoted = not quoted
        elif not quoted and c == delimiter:
            row.append("".join(buf))
            buf = []
        elif not quoted and (c == "\n" or c == "\r" and text[i + 1 : i + 2] == "\n"):
            i += c == "\r"
            row.append("".join(buf))
            out.append(row)
            row, buf = [], []
            if most and len(out) >= most:
                return out
        else:
            buf.append(c)
        i += 1
    if buf or row:
        out.append([*row, "".join(buf)])
    return out


def sniff(text: str) -> str:
    """Delimiter whose first 20 records most often have one number of fields; comma, semicolon, tab, pipe in case of ties."""
    best, score = ",", 0
    for d in ",;\t|":
        sizes = Counter(len(r) for r in parse_records(text, d, 20))
        if not sizes:
            continue
        size, freq = max(sizes.items(), key=lambda x: (x[1], x[0]))
        if size >= 2 and freq * 1000 + min(size, 500) > score:
            best, score = d, freq * 1000 + min(size, 500)
    return best


def clean(s: str) -> str:
    s = re.sub("[\xad\u200b\ufeff]", "", s.replace("\xa0", " "))
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", re.sub(r"\r\n|\r|\n", " ", s))


def delimited(data: bytes) -> Document:
    text = decode(data)
    g = GridBuilder()
    for r in parse_records(text, sniff(text)):
        g.add_row([cell(clean(x)) for x in r])
    grid = g.finish()
    return Document([Block("table", grid=grid, header_rows=header_rows(grid))] if grid else [])


TOKEN = re.compile(rb"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.S)
SKIP = {"colortbl", "info", "pict", "stylesheet", "listtable", "listoverridetable", "rsidtbl", "generator", "header", "footer", "headerl", "headerr", "footerl", "footerr", "object", "themedata", "datastore", "latentstyles", "xmlnstbl", "listtext", "pntext", "nonshppict", "fonttbl", "filetbl", "revtbl"}
CODEPAGES = {0: "cp1252", 77: "mac_roman", 128: "cp932", 129: "cp949", 134: "cp936", 136: "cp950", 161: "cp1253", 162: "cp1254", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 238: "cp1250"}
SYMBOLS = {"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "tab": "\t", "emspace": "\u2003", "enspace": "\u2002"}


def styles_of(data: bytes) -> dict[int, int]:
    """Heading level by paragraph style number."""
    at = data.find(b"{\\stylesheet")
    out: dict[int, int] = {}
    if at < 0:
        return out
    for m in re.finditer(rb"\{\\s(\d+)([^{}]*?)([^{}\;]+);\}", data[at : at + 200_000]):
        name = m[3].decode("latin-1").strip().lower()
        level = re.search(rb"\\outlinelevel(\d+)", m[2])
        head = re.search(r"heading (\d)", name)
        if level and int(level[1]) < 9:
            out[int(m[1])] = int(level[1]) + 1
        elif head:
            out[int(m[1])] = int(head[1])
        elif name == "title":
            out[int(m[1])] = 1
    return out


def rtf(data: bytes) -> Document:
    """A group-stack reader: character styles, code pages and \\u escapes, headings, lists, tables, links and footnotes."""
    doc = Document()
    heads = styles_of(data)
    m = re.search(rb"\\ansicpg(\d+)", data[:4096])
    codepage = f"cp{int(m[1])}" if m else "cp1252"
    fonts = {int(a): CODEPAGES.get(int(b), codepage) for a, b in re.findall(rb"\{\\f(\d+)[^{}]*?\\fcharset(\d+)", data)}
    state = {"bold": False, "italic": False, "strike": False, "skip": False, "uc": 1, "cp": codepage, "dest": "", "href": None}
    stack: list[dict] = []
    runs: list[Run] = []
    par = {"style": None, "list": None, "level": 0, "cell": False, "outline": None}
    entries: list = []
    rows: GridBuilder | None = None
    row: list = []
    cell_blocks: list[Block] = []
    pending, skip_chars, instr, notes = bytearray(), 0, [], 0
    blocks = doc.blocks

    def put(t: str) -> None:
        if state["skip"] or not t:
            return
        if state["dest"] == "instr":
            instr.append(t)
            return
        runs.append(Run(t, bold=state["bold"], italic=state["italic"], strike=state["strike"], href=state["href"]))

    def drain() -> None:
        if pending:
            put(bytes(pending).decode(state["cp"], "replace"))
            pending.clear()

    def flush_list() -> None:
        if entries:
            blocks.extend(fold_list(entries))
            entries.clear()

    def flush_table() -> None:
        nonlocal rows
        if rows is not None:
            grid = rows.finish()
            if grid:
                blocks.append(Block("table", grid=grid, header_rows=header_rows(grid)))
            rows = None

    def end_par() -> None:
        nonlocal runs
        drain()
        done, runs = runs, []
        text = plain(done).strip()
        if state["dest"] == "note":
            if text:
                state["note"].append(Block("paragraph", runs=done))
            return
        if par["cell"]:
            if text:
                cell_blocks.append(Block("paragraph", runs=done))
            return
        flush_table()
        if not text and not any(r.kind == "note" for r in done):
            return
        level = par["outline"] or heads.get(par["style"])
        if level:
            flush_list()
            blocks.append(Block("heading", runs=done, level=level))
        elif par["list"]:
            entries.append((par["level"], "", 1, [Block("paragraph", runs=done)], None))
        else:
            flush_list()
            blocks.append(Block("paragraph", runs=done))

    i, n = 0, len(data)
    while i < n:
        t = TOKEN.match(data, i)
        if not t:
            i += 1
            continue
        i = t.end()
        word, num, hexa, sym, brace, text = t.groups()
        if not hexa:
            drain()
        if brace == b"{":
            if len(stack) > 10_000:
                break
            stack.append(dict(state))
        elif brace == b"}":
            if state["dest"] == "note" and stack and stack[-1]["dest"] != "note":
                end_par()
                key = state["key"]
                doc.notes[key] = state["note"]
                runs = state["outer"]
                runs.append(Run(key, kind="note"))
            if state["dest"] == "instr" and stack and stack[-1]["dest"] != "instr":
                stack[-1]["href"] = hyperlink("".join(instr)) or stack[-1]["href"]
                instr.clear()
            if stack:
                state = stack.pop()
        elif hexa:
            if skip_chars:
                skip_chars -= 1
            elif not state["skip"]:
                pending.append(int(hexa, 16))
        elif sym:
            if sym == b"*":
                state["skip"] = not data[i : i + 9].startswith(b"\\fldinst")
            elif sym == b"~":
                put("\xa0")
            elif sym == b"_":
                put("-")
            elif sym in b"\\{}":
                put(sym.decode())
            elif sym in b"\r\n":
                end_par()
        elif word:
            w = word.decode()
            v = int(num) if num is not None else None
            if w in SKIP:
                state["skip"] = True
            elif w == "bin":
                i += max(0, v or 0)
            elif state["skip"]:
                pass
            elif w in ("b", "i", "strike"):
                state[{"b": "bold", "i": "italic", "strike": "strike"}[w]] = v != 0
            elif w == "plain":
                state.update(bold=False, italic=False, strike=False)
            elif w == "f":
                state["cp"] = fonts.get(v or 0, codepage)
            elif w == "uc":
                state["uc"] = v or 0
            elif w == "u":
                cp = (v or 0) % 65536
                if 0xD800 <= cp < 0xDC00:
                    state["high"] = cp
                elif 0xDC00 <= cp < 0xE000 and state.get("high"):
                    put(chr(0x10000 + ((state.pop("high") - 0xD800) << 10) + cp - 0xDC00))
                elif not 0xD800 <= cp < 0xE000:
                    put(chr(cp))
                skip_chars = state["uc"]
            elif w == "par":
                end_par()
            elif w == "line":
                if state["dest"] != "instr":
                    runs.append(Run(kind="break"))
            elif w in SYMBOLS:
                put(SYMBOLS[w])
            elif w == "pard":
                par.update(style=None, list=None, level=0, cell=False, outline=None)
            elif w == "s":
                par["style"] = v
            elif w == "outlinelevel":
                par["outline"] = (v or 0) + 1 if (v or 0) < 9 else None
            elif w == "ls":
                par["list"] = v
            elif w == "ilvl":
                par["level"] = v or 0
            elif w == "intbl":
                par["cell"] = True
            elif w == "cell":
                par["cell"] = True
                end_par()
                row.append(list(cell_blocks))
                cell_blocks.clear()
            elif w == "row":
                flush_list()
                rows = rows or GridBuilder()
                from .model import Cell

                rows.add_row([Cell(b) for b in row])
                row.clear()
                par["cell"] = False
            elif w == "fldinst":
                state["dest"], state["skip"] = "instr", False
            elif w == "footnote":
                drain()
                notes += 1
                state.update(dest="note", note=[], key=f"fn{notes}", outer=runs)
                runs = []
            elif w in ("sect", "page"):
                end_par()
        elif text:
            s = text
            if skip_chars:
                k = min(skip_chars, len(s))
                s, skip_chars = s[k:], skip_chars - k
            if s and not state["skip"]:
                put(s.decode(state["cp"], "replace"))
    end_par()
    flush_list()
    flush_table()
    return doc
