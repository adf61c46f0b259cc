"""Reading order of a scanned page: columns from the boxes of its lines, lines stored across columns taken apart.

Defined results: a page without text has no lines; without boxes, or with another number of boxes than lines, the stored
order is the reading order.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

#: Lines whose left edges differ by more than this (in boxes' units) stand in different columns; beyond INDENT they are set in.
COLUMN_GAP, INDENT = 50, 9
# A market-list line is a short label, a leader and figures (letters stand for misread figures).
MARKET = re.compile(r"^[^\W\d_][^,;:!?]{1,30}?(?:\s*\.{3,}|…|(?:\s\.){2,}|\s+[—–]|\s{2,})[\s.,]*[\dOIlSBZoi]{1,5}(?:\s+[\dOIlSBZoi]{1,5})*[\s.,]*$")
FIGURES = frozenset("0123456789OIlSBZoi")
SPLIT = re.compile(r"\s{2,}")


def take_apart(line: str, columns: int, longest: int) -> list[str]:
    """The parts of a line that runs over several columns: at wide gaps, then where a part is longer than a column's lines."""
    parts = [p for p in SPLIT.split(line.strip()) if p]
    while len(parts) < columns:
        k = max(range(len(parts)), key=lambda i: len(parts[i]))
        p = parts[k]
        if len(p) <= longest:
            break
        at = p.rfind(" ", 0, longest + 1)
        if at <= 0:
            break
        parts[k : k + 1] = [p[:at], p[at + 1 :]]
    return parts


def usual(xs: list[int]) -> int:
    """The left edge from which the most lines start within INDENT, the least of several."""
    xs = sorted(xs)
    return max(xs, key=lambda x: (bisect_right(xs, x + INDENT) - bisect_left(xs, x), -x))


def page_lines(text: str | None, xs, ys, ws, margins: bool = False) -> list[tuple[str, bool]]:
    """(line, set in) in reading order: columns from left to right, in each from top to bottom.

    Lines are set in from the least left edge of their column, or, with margins, from its usual one.
    """
    if not text:
        return []
    lines = text.split("\n")
    n = len(lines)
    if xs is None or ys is None or ws is None or len(xs) != n or len(ys) != n or len(ws) != n or any(v is None for v in xs):
        return [(x, False) for x in lines]
    xs, ys, ws = list(xs), list(ys), list(ws)
    edges: list[int] = []
    last = None
    for v in sorted(xs):
        if last is None or v - last > COLUMN_GAP:
            edges.append(v)
        last = v
    if len(edges) == 1:
        base = usual(xs) if margins else edges[0]
        return [(lines[i], xs[i] - base > INDENT) for i in sorted(range(n), key=ys.__getitem__)]
    own = [bisect_right(edges, x) - 1 for x in xs]
    base = [usual([x for x, o in zip(xs, own) if o == k]) for k in range(len(edges))] if margins else edges
    placed = []
    longest = 0
    for i, x in enumerate(xs):
        k = bisect_right(edges, x) - 1
        spans = k + 1
        while spans < len(edges) and x + ws[i] > edges[spans] + 15:
            spans += 1
        if spans == k + 1:
            placed.append((k, ys[i], i, lines[i], x - base[k] > INDENT))
            longest = max(longest, len(lines[i]))
    for i, x in enumerate(xs):
        k = bisect_right(edges, x) - 1
        if k + 1 < len(edges) and x + ws[i] > edges[k + 1] + 15:
            columns = sum(x + ws[i] > e + 15 for e in edges[k:])
            for j, part in enumerate(take_apart(lines[i], columns, longest or 40)):
                placed.append((min(k + j, len(edges) - 1), ys[i], i, part, False))
    placed.sort(key=lambda p: p[:3])
    return [(p[3], p[4]) for p in placed]


def is_market(x: str) -> bool:
    """Whether a line belongs to a market list; most lines are told by a look at their ends."""
    return x.rstrip(" .,")[-1:] in FIGURES and (".." in x or "  " in x or " ." in x or "—" in x or "–" in x or "…" in x) and MARKET.match(x) is not None


def streams(text: str | None, xs, ys, ws) -> list[tuple[list[str], list[int], list[int]]]:
    """The page's running words with all its lines, and, where that differs, without inserts by either margin.

    Each with the places of words that end a line unbroken and, without inserts, the places before which lines are left out.
    """
    lines = page_lines(text, xs, ys, ws)
    out = [(*running_words(lines, False), [])]
    way = [(x, inset or is_market(x)) for x, inset in lines]
    if any(skip for _, skip in way):
        kept = [way]
        if any(inset for _, inset in lines):
            other = [(x, inset or is_market(x)) for x, inset in page_lines(text, xs, ys, ws, True)]
            if other != way:
                kept.append(other)
        out += [_without(k) for k in kept]
    return out


def _without(lines: list[tuple[str, bool]]) -> tuple[list[str], list[int], list[int]]:
    """running_words() of the lines that aren't to be skipped, and the places before which lines are left out."""
    joints, parts, gap = [], [], False
    for x, skip in lines:
        gap |= skip and x.strip() != ""
        if not skip:
            if gap and parts:
                joints.append(len(parts))
            gap = False
            parts.append((x, False))
    words, ends, starts = _running(parts)
    at = sorted({starts[j] for j in joints})
    return words, ends, at


def running_words(lines: list[tuple[str, bool]], drop_inserts: bool) -> tuple[list[str], list[int]]:
    """White-space words of the page, words broken at line ends joined, and the places of words that end a line unbroken.

    Adverts (lines set in) and market lists are left out if wanted.
    """
    if drop_inserts:
        lines = [(x, inset) for x, inset in lines if not inset and not is_market(x)]
    words, ends, _ = _running(lines)
    return words, ends


def _running(lines: list[tuple[str, bool]]) -> tuple[list[str], list[int], list[int]]:
    """Running words, the places of words that end a line unbroken, and how many words stand before each line."""
    out: list[str] = []
    ends: list[int] = []
    starts: list[int] = []
    carry = ""
    for x, _ in lines:
        starts.append(len(out))
        words = x.split()
        if not words:
            continue
        if carry:
            words[0] = carry + words[0]
            carry = ""
        if len(words[-1]) > 1 and words[-1][-1] in "-=¬\xad‐":
            carry = words.pop()[:-1]
            out += words
        else:
            out += words
            ends.append(len(out) - 1)
    if carry:
        out.append(carry)
    return out, ends, starts
