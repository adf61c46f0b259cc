"""The document model: blocks, inline runs, lists and tables whose every grid place appears once."""

from __future__ import annotations

from dataclasses import dataclass, field


class ConvertError(Exception):
    """A document that can't be converted, with a stable code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Run:
    """Inline content. kind: text, break, image, anchor or note."""

    text: str = ""
    bold: bool = False
    italic: bool = False
    strike: bool = False
    code: bool = False
    href: str | None = None
    kind: str = "text"

    def style(self) -> tuple[bool, bool, bool, bool]:
        return self.bold, self.italic, self.strike, self.code


@dataclass
class Item:
    blocks: list[Block]
    checked: bool | None = None
    label: str | None = None


@dataclass
class Cell:
    blocks: list[Block] = field(default_factory=list)
    rows: int = 1
    cols: int = 1


@dataclass
class Block:
    """kind: heading, paragraph, list, table, quote, code or rule."""

    kind: str
    runs: list[Run] = field(default_factory=list)
    level: int = 0
    blocks: list[Block] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    ordered: str = ""
    start: int = 1
    text: str = ""
    lang: str = ""
    grid: list[list[Cell | None]] = field(default_factory=list)
    header_rows: int = 0
    anchors: list[str] = field(default_factory=list)


@dataclass
class Document:
    blocks: list[Block] = field(default_factory=list)
    notes: dict[str, list[Block]] = field(default_factory=dict)
    title: str | None = None
    warnings: list[str] = field(default_factory=list)


def plain(runs: list[Run]) -> str:
    return "".join("\n" if r.kind == "break" else r.text if r.kind in ("text", "image") else "" for r in runs)


def para(text: str) -> Block:
    return Block("paragraph", runs=[Run(text)])


def cell(text: str, rows: int = 1, cols: int = 1) -> Cell:
    return Cell([para(text)] if text else [], rows, cols)


#: Most grid places that spans and repeats may make.
MAX_PLACES = 4_000_000


class GridBuilder:
    """Places cells in rows: a cell goes to the next place that no earlier span covers; covered places hold None."""

    def __init__(self) -> None:
        self.rows: list[list[Cell | None]] = []
        self.pending: dict[int, int] = {}
        self.spent = 0

    def add_row(self, cells: list[Cell]) -> None:
        row: list[Cell | None] = []
        nxt: dict[int, int] = {}

        def skip() -> None:
            while self.pending.get(len(row), 0) > 0:
                left = self.pending[len(row)]
                if left > 1:
                    nxt[len(row)] = left - 1
                row.append(None)

        for c in cells:
            skip()
            at = len(row)
            cols = max(1, c.cols)
            cols = next((k for k in range(1, cols) if self.pending.get(at + k, 0) > 0), cols)
            rows = max(1, c.rows)
            self.spent += rows * cols - 1
            if self.spent > MAX_PLACES:
                raise ConvertError("resourceLimit", "table spans are too large")
            c.cols, c.rows = cols, rows
            row.append(c)
            row += [None] * (cols - 1)
            if rows > 1:
                for k in range(cols):
                    nxt[at + k] = rows - 1
        while any(k >= len(row) and v > 0 for k, v in self.pending.items()):
            if self.pending.get(len(row), 0) > 0:
                skip()
            else:
                row.append(Cell())
        self.pending = nxt
        self.rows.append(row)

    def finish(self) -> list[list[Cell | None]]:
        """Rows of one width; trailing rows without any text go; spans end with the grid."""
        rows = self.rows
        while rows and all(c is None or not c.blocks for c in rows[-1]):
            rows.pop()
        width = max(map(len, rows), default=0)
        for i, row in enumerate(rows):
            row += [Cell() for _ in range(width - len(row))]
            for c in row:
                if c is not None:
                    c.rows = min(c.rows, len(rows) - i)
        return rows


def fold_list(entries: list[tuple[int, str, int, list[Block], str | None]]) -> list[Block]:
    """Flat entries (depth, marker kind, number, blocks, label) as nested lists; a jump in numbers starts a new list."""
    out: list[Block] = []
    stack: list[tuple[int, Block, int]] = []
    for depth, kind, number, blocks, label in entries:
        while stack and stack[-1][0] > depth:
            stack.pop()
        if stack and stack[-1][0] == depth:
            d, lst, last = stack.pop()
            if lst.ordered == kind and (not kind or number == last + 1):
                lst.items.append(Item(blocks, label=label))
                stack.append((d, lst, number))
                continue
        new = Block("list", ordered=kind, start=number, items=[Item(blocks, label=label)])
        (stack[-1][1].items[-1].blocks if stack else out).append(new)
        stack.append((depth, new, number))
    return out


def number_label(kind: str, n: int) -> str:
    """Ordinal label of a list entry: decimal, alpha (a, b, ... aa) or roman."""
    if kind.lower() == "alpha" and n > 0:
        s = ""
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(97 + r) + s
        return (s.upper() if kind[0] == "A" else s) + "."
    if kind.lower() == "roman" and 0 < n < 4000:
        s = ""
        for v, t in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "M CM D CD C XC L XL X IX V IV I".split()):
            s += t * (n // v)
            n %= v
        return (s if kind[0] == "R" else s.lower()) + "."
    return f"{n}."
