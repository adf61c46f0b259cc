"""Formatting of legacy texts: character and paragraph runs, the style sheet's headings, list definitions.

Everything is looked up by file position, as the format stores it; what can't be read leaves text plain.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from dataclasses import dataclass, field

#: Bytes of a formatting page.
PAGE = 512
# Property codes for bold, italic, struck through, list level, list, outline level.
BOLD, ITALIC, STRIKE, LEVEL, LIST, OUTLINE = 0x0835, 0x0836, 0x0837, 0x260A, 0x460B, 0x2640
# Property codes whose operand's size isn't told by their bits (its length takes two bytes).
LONG = (0xD608, 0xD606)
# Numbering kinds by the format's number.
KINDS = {0: "decimal", 1: "Roman", 2: "roman", 3: "Alpha", 4: "alpha"}


def properties(data: bytes) -> dict[int, int]:
    """Property code -> operand (its first one to four bytes as a number) of a list of properties."""
    out, i = {}, 0
    while i + 2 <= len(data):
        code = struct.unpack_from("<H", data, i)[0]
        i += 2
        kind = code >> 13
        size = {0: 1, 1: 1, 2: 2, 3: 4, 4: 2, 5: 2, 7: 3}.get(kind)
        if size is None:
            if code in LONG:
                size = 2 + (struct.unpack_from("<H", data, i)[0] - 1 if i + 2 <= len(data) else 0)
            else:
                size = 1 + (data[i] if i < len(data) else 0)
        out[code] = int.from_bytes(data[i : i + min(size, 4)], "little")
        i += size
    return out


def pages(word: bytes, table: bytes, at: int) -> list[bytes]:
    """The formatting pages that the table of pages at an offset of the header names."""
    fc, size = struct.unpack_from("<II", word, at)
    plc = table[fc : fc + size]
    n = (len(plc) - 4) // 8
    return [word[p * PAGE : (p + 1) * PAGE] for p in (struct.unpack_from("<I", plc, 4 * (n + 1) + 4 * k)[0] & 0x3FFFFF for k in range(max(0, n)))]


@dataclass
class Runs:
    """Stretches of file positions and what holds there."""

    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    values: list = field(default_factory=list)

    @staticmethod
    def of(rows: list[tuple[int, int, object]]) -> Runs:
        rows = sorted(rows, key=lambda r: r[:2])
        return Runs([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])

    def get(self, at: int):
        k = bisect_right(self.starts, at) - 1
        return self.values[k] if k >= 0 and at < self.ends[k] else None


def character_runs(word: bytes, table: bytes) -> Runs:
    """(bold, italic, struck) by file position."""
    rows = []
    for page in pages(word, table, 0xFA):
        if len(page) < PAGE:
            continue
        n = page[511]
        fcs = struct.unpack_from(f"<{n + 1}I", page)
        for k in range(n):
            at = 2 * page[4 * (n + 1) + k]
            p = properties(page[at + 1 : at + 1 + page[at]]) if at else {}
            on = tuple(p.get(c, 0) in (1, 0x81) for c in (BOLD, ITALIC, STRIKE))
            if any(on):
                rows.append((fcs[k], fcs[k + 1], on))
    return Runs.of(rows)


def paragraph_runs(word: bytes, table: bytes) -> Runs:
    """(style, properties) by file position."""
    rows = []
    for page in pages(word, table, 0x102):
        if len(page) < PAGE:
            continue
        n = page[511]
        fcs = struct.unpack_from(f"<{n + 1}I", page)
        for k in range(n):
            at = 2 * page[4 * (n + 1) + 13 * k]
            if not at:
                continue
            size, at = (2 * page[at] - 1, at + 1) if page[at] else (2 * page[at + 1], at + 2)
            body = page[at : at + size]
            if len(body) >= 2:
                rows.append((fcs[k], fcs[k + 1], (struct.unpack_from("<H", body)[0], properties(body[2:]))))
    return Runs.of(rows)


def style_sheet(word: bytes, table: bytes) -> list[tuple[int, int] | None]:
    """(built-in number, base style) of each style; None for empty places."""
    fc, size = struct.unpack_from("<II", word, 0xA2)
    data = table[fc : fc + size]
    if len(data) < 6:
        return []
    head = struct.unpack_from("<H", data)[0]
    count = struct.unpack_from("<H", data, 2)[0]
    out: list[tuple[int, int] | None] = []
    i = 2 + head
    while i + 2 <= len(data) and len(out) < count:
        n = struct.unpack_from("<H", data, i)[0]
        std = data[i + 2 : i + 2 + n]
        out.append((struct.unpack_from("<H", std)[0] & 0xFFF, struct.unpack_from("<H", std, 2)[0] >> 4) if len(std) >= 4 else None)
        i += 2 + n + (n & 1)
    return out


def lists(word: bytes, table: bytes) -> list[list[tuple[str, int]]]:
    """For each list of the document (counted from 1 in its texts) kind and first number of its levels; an empty kind is a bullet."""
    fc, size = struct.unpack_from("<II", word, 0x2E2)
    heads = table[fc : fc + size]
    if len(heads) < 2:
        return []
    n = struct.unpack_from("<H", heads)[0]
    by_id: dict[int, list[tuple[str, int]]] = {}
    at = fc + size
    for k in range(n):
        one = heads[2 + 28 * k : 30 + 28 * k]
        if len(one) < 28:
            break
        levels = []
        for _ in range(1 if one[26] & 1 else 9):
            if at + 30 > len(table):
                break
            start, kind = struct.unpack_from("<iB", table, at)
            at += 28 + table[at + 24] + table[at + 25]
            chars = struct.unpack_from("<H", table, at)[0] if at + 2 <= len(table) else 0
            at += 2 + 2 * chars
            levels.append((KINDS.get(kind, "" if kind == 23 else "decimal"), max(0, start)))
        by_id[struct.unpack_from("<i", one)[0]] = levels
    fc, size = struct.unpack_from("<II", word, 0x2EA)
    over = table[fc : fc + size]
    m = struct.unpack_from("<I", over)[0] if len(over) >= 4 else 0
    return [by_id.get(struct.unpack_from("<i", over, 4 + 16 * k)[0], []) for k in range(m) if 4 + 16 * (k + 1) <= len(over)]


class Formats:
    """What a text's positions look like; pieces are (first character, after last, file position, bytes a character)."""

    def __init__(self, word: bytes, table: bytes, pieces: list[tuple[int, int, int, int]]):
        self.pieces = pieces
        self.first = [p[0] for p in pieces]
        parts = {}
        for name, make in (("chars", character_runs), ("paras", paragraph_runs), ("styles", style_sheet), ("lists", lists)):
            try:
                parts[name] = make(word, table)
            except (struct.error, IndexError):
                parts[name] = Runs() if name in ("chars", "paras") else []
        self.chars, self.paras, self.styles, self.lists = parts["chars"], parts["paras"], parts["styles"], parts["lists"]

    def place(self, cp: int) -> int:
        k = bisect_right(self.first, cp) - 1
        if k < 0 or cp >= self.pieces[k][1]:
            return -1
        a, _, fc, width = self.pieces[k]
        return fc + (cp - a) * width

    def emphasis(self, cp: int) -> tuple[bool, bool, bool]:
        return self.chars.get(self.place(cp)) or (False, False, False)

    def heading(self, cp: int) -> int | None:
        """Heading level of the paragraph that ends at a character: by its style, the styles it goes back to, or its outline level."""
        style, p = self.paras.get(self.place(cp)) or (0, {})
        seen = set()
        while style < len(self.styles) and self.styles[style] and style not in seen:
            seen.add(style)
            number, base = self.styles[style]
            if 1 <= number <= 9:
                return number
            style = base
        level = p.get(OUTLINE, 9)
        return level + 1 if level < 9 else None

    def entry(self, cp: int) -> tuple[int, str, int, int] | None:
        """(level, kind, first number, list) of the list entry that the paragraph ending at a character is, or None."""
        _, p = self.paras.get(self.place(cp)) or (0, {})
        n, level = p.get(LIST, 0), p.get(LEVEL, 0)
        if not n or n > len(self.lists):
            return None
        levels = self.lists[n - 1]
        kind, start = levels[level] if level < len(levels) else ("", 1)
        return level, kind, start, n
