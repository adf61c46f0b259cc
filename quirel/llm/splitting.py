"""Problem 4: oversized texts in pieces, cut at natural boundaries, neighbours sharing an overlap.

Method: agglomerative merging. A text starts as atomic segments (sentences and lines; words where those are too long;
runs of characters where words are). Adjacent pairs stand in a heap by the strength of the boundary between them; the
weakest is merged first, while the combined size plus the overlap stays within the limit.

Defined results: texts within the limit, empty and null texts give no pieces; a limit not above the overlap raises;
repeated rows give their pieces once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Boundaries, strongest first, as (strength, pattern whose end is the boundary).
BOUNDARIES = [
    (6, re.compile(r"\n(?=#{1,6} )")),
    (5, re.compile(r"\n[ \t]*\n\s*")),
    (4, re.compile(r"\n(?=[ \t]{0,20}(?:[-*+•]|\d{1,3}[.)])\s)|(?<=[.!?:;”»])\n")),
    (3, re.compile(r"(?<=[.!?…])[”’»\")\]]*\s+(?=[^a-zà-ÿ\s])|\n(?=\|)")),
    (2, re.compile(r"\n|(?<=[,;:–—])\s+")),
]
WORDS = re.compile(r"\s+")


def cuts(text: str, room: int) -> list[tuple[int, int]]:
    """(position, strength) of the places between atomic segments, each segment no longer than room."""
    at: dict[int, int] = {}
    for strength, rx in reversed(BOUNDARIES[:-1]):
        for m in rx.finditer(text):
            at[m.end()] = max(strength, at.get(m.end(), 0))
    for strength, rx in (BOUNDARIES[-1], (1, WORDS)):
        edges = [0, *sorted(p for p in at if 0 < p < len(text)), len(text)]
        for a, b in zip(edges, edges[1:]):
            if b - a > room:
                for m in rx.finditer(text, a, b):
                    if a < m.end() < b:
                        at.setdefault(m.end(), strength)
    edges = [0, *sorted(p for p in at if 0 < p < len(text)), len(text)]
    for a, b in zip(edges, edges[1:]):
        for p in range(a + room, b, room):
            at[p] = 0
    return sorted((p, s) for p, s in at.items() if 0 < p < len(text))


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; from the second on, start lies overlap characters before the piece's own first one."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    room = limit - overlap
    at = cuts(text, room)
    ends = [p for p, _ in at] + [len(text)]
    starts = [0] + [p for p, _ in at]
    n = len(starts)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(s, ends[i + 1] - starts[i], i, i + 1) for i, (_, s) in enumerate(at)]
    heapq.heapify(heap)
    strength = {i + 1: s for i, (_, s) in enumerate(at)}
    while heap:
        s, size, a, b = heapq.heappop(heap)
        if not alive[a] or not alive[b] or right[a] != b or ends[b] - starts[a] != size:
            continue
        # The first piece has no overlap before it, so it may use the whole limit.
        if size > (limit if starts[a] == 0 else room):
            continue
        ends[a], right[a], alive[b] = ends[b], right[b], False
        if right[b] >= 0:
            left[right[b]] = a
            heapq.heappush(heap, (strength[right[b]], ends[right[b]] - starts[a], a, right[b]))
        if left[a] >= 0:
            heapq.heappush(heap, (strength[a], ends[a] - starts[left[a]], left[a], a))
    return [(max(0, starts[i] - (overlap if starts[i] else 0)), ends[i]) for i in range(n) if alive[i]]


def split_oversized(df: DataFrame, keys: list[str], text: str, limits: DataFrame, tbl: str = "tbl") -> DataFrame:
    """(keys..., piece_no, start_at, piece) of the texts longer than their table's limit.

    limits has a row for each table (tbl, max_chars, overlap_chars), a fixed dimension. keys must hold the tbl column.
    Only oversized texts leave the JVM.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    lim = limits.select(F.col("tbl").alias("__tbl"), F.col("max_chars").cast("int").alias("__max"), F.col("overlap_chars").cast("int").alias("__over"))
    recs = df.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], F.col(text).alias("__t"))
    big = recs.join(F.broadcast(lim), recs[names[keys.index(tbl)]] == F.col("__tbl")).where(F.char_length("__t") > F.col("__max")).select(*names, "__t", "__max", "__over").distinct()
    schema = ", ".join(f"{a} {recs.schema[a].dataType.simpleString()}" for a in names) + ", piece_no int, start_at int, piece string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                key, t = r[: len(names)], r[len(names)]
                rows += [(*key, i, a, t[a:b]) for i, (a, b) in enumerate(split_text(t, r[-2], r[-1]), 1)]
            yield pd.DataFrame(rows, columns=[*names, "piece_no", "start_at", "piece"])

    return big.mapInPandas(run, schema).select(*[F.col(a).alias(k) for k, a in zip(keys, names)], "piece_no", "start_at", "piece")
