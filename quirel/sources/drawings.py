"""Charts, diagrams and pictures inside office files: their cached values and texts as blocks, their bytes as assets."""

from __future__ import annotations

import hashlib
import struct
import xml.etree.ElementTree as ET
import zlib
from dataclasses import dataclass, field

from .model import Block, Cell, ConvertError, GridBuilder, Item, Run, cell, para
from .package import Package, all_of, attr, kid, local

#: Bytes of all assets of one document, and of one inflated metafile.
ASSETS_MAX, METAFILE_MAX = 256 << 20, 64 << 20
# Record types of stored pictures and what they hold; metafiles are deflated.
BLIPS = {0xF01A: "image/x-emf", 0xF01B: "image/x-wmf", 0xF01C: "image/x-pict", 0xF01D: "image/jpeg", 0xF01E: "image/png", 0xF01F: "image/bmp", 0xF029: "image/tiff", 0xF02A: "image/jpeg"}


def cached(e: ET.Element | None) -> dict[int, str]:
    """Index -> value of a series' cached points."""
    out = {}
    for p in all_of(e, "pt") if e is not None else ():
        v = kid(p, "v")
        if v is not None and v.text is not None:
            out[int(attr(p, "idx") or 0)] = v.text
    return out


def chart_blocks(root: ET.Element) -> list[Block]:
    """A chart's title in bold and a table of its categories and series, from the values the file keeps."""
    out: list[Block] = []
    title = next(iter(all_of(root, "title")), None)
    text = "".join(t.text or "" for t in all_of(title, "t")) if title is not None else ""
    if text.strip():
        out.append(Block("paragraph", runs=[Run(text.strip(), bold=True)]))
    series = [s for s in all_of(root, "ser")]
    names, values, categories = [], [], {}
    for i, s in enumerate(series):
        tx = cached(kid(s, "tx"))
        names.append(" ".join(tx[k] for k in sorted(tx)) or f"Series {i + 1}")
        categories |= {k: v for k, v in cached(kid(s, "cat") if kid(s, "cat") is not None else kid(s, "xVal")).items() if k not in categories}
        values.append(cached(kid(s, "val") if kid(s, "val") is not None else kid(s, "yVal")))
    places = sorted(set(categories).union(*values)) if values else []
    if places:
        grid = GridBuilder()
        grid.add_row([cell(""), *(cell(n) for n in names)])
        for k in places:
            grid.add_row([cell(categories.get(k, str(k + 1))), *(cell(v.get(k, "")) for v in values)])
        out.append(Block("table", grid=grid.finish(), header_rows=1))
    return out


def diagram_blocks(root: ET.Element) -> list[Block]:
    """A diagram's points that hold text, as a list in document order."""
    items = []
    for p in all_of(root, "pt"):
        text = " ".join("".join(t.text or "" for t in all_of(par, "t")).strip() for par in all_of(p, "p")).strip()
        if text and attr(p, "type") not in ("pres", "parTrans", "sibTrans"):
            items.append(Item([para(text)]))
    return [Block("list", items=items)] if items else []


def graphic_blocks(e: ET.Element, rels: dict, pkg: Package) -> list[Block]:
    """Blocks of the charts and diagrams that a drawing or a frame refers to."""
    out: list[Block] = []
    for x in e.iter():
        name = local(x.tag)
        if name == "chart" and (target := rels.get(attr(x, "id") or "")):
            root = pkg.optional(target[1])
            out += chart_blocks(root) if root is not None else []
        elif name == "relIds" and (target := rels.get(attr(x, "dm") or "")):
            root = pkg.optional(target[1])
            out += diagram_blocks(root) if root is not None else []
    return out


@dataclass
class Asset:
    asset_id: str
    media_type: str
    part: str
    data: bytes


@dataclass
class Assets:
    """A document's pictures: each part once, all together not over a limit."""

    limit: int = ASSETS_MAX
    spent: int = 0
    by_part: dict[str, Asset] = field(default_factory=dict)

    def add(self, media_type: str, part: str, data: bytes) -> str:
        if part not in self.by_part:
            self.spent += len(data)
            if self.spent > self.limit:
                raise ConvertError("resourceLimit", "the document's pictures are too large")
            self.by_part[part] = Asset(f"asset-{len(self.by_part) + 1}-{hashlib.sha256(data).hexdigest()[:12]}", media_type, part, data)
        return self.by_part[part].asset_id


def package_assets(pkg: Package, limit: int = ASSETS_MAX) -> Assets:
    """The pictures of an office package, by the media type of their content type or extension."""
    from quirel.functions.labels import IMAGE_TYPES

    out = Assets(limit)
    for name in sorted(pkg.names):
        ext = name.rsplit(".", 1)[-1].lower()
        if "/media/" in f"/{name}" or name.startswith("Pictures/"):
            out.add(pkg.content_type(name) or IMAGE_TYPES.get(ext, "application/octet-stream"), name, pkg.part(name) or b"")
    return out


def decode_blip(instance: int, kind: int, body: bytes, limit: int = METAFILE_MAX) -> tuple[str, bytes] | None:
    """(media type, bytes) of a stored picture's record: behind one or two marks of 16 bytes, metafiles behind their header and deflated.

    None if the record holds no picture, is cut short or inflates to more than the limit.
    """
    media = BLIPS.get(kind)
    if media is None:
        return None
    marks = 32 if instance & 1 else 16
    if kind in (0xF01A, 0xF01B, 0xF01C):
        head = body[marks : marks + 34]
        if len(head) < 34:
            return None
        size, = struct.unpack_from("<I", head, 28)
        raw = body[marks + 34 : marks + 34 + size]
        if head[32] != 0:
            return media, raw
        d = zlib.decompressobj()
        try:
            data = d.decompress(raw, limit + 1)
        except zlib.error:
            return None
        return (media, data) if len(data) <= limit else None
    data = body[marks + 1 :]
    return (media, data) if data else None


def stored_pictures(stream: bytes, limit: int = ASSETS_MAX) -> list[tuple[str, bytes]]:
    """Pictures of a stream of records, containers gone into; a broken record ends its container."""
    out: list[tuple[str, bytes]] = []
    todo = [(0, len(stream))]
    spent = 0
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            head, kind, size = struct.unpack_from("<HHI", stream, at)
            stop = min(end, at + 8 + size)
            if head & 15 == 15:
                todo.append((stop, end))
                end, at = stop, at + 8
                continue
            if kind == 0xF007:
                # A store entry holds its picture's record behind 36 bytes and a name.
                at += 8 + 36 + (stream[at + 8 + 33] if at + 8 + 33 < stop else 0)
                continue
            got = decode_blip(head >> 4, kind, stream[at + 8 : stop])
            if got:
                spent += len(got[1])
                if spent > limit:
                    raise ConvertError("resourceLimit", "the document's pictures are too large")
                out.append(got)
            at = stop
    return out


def merged_style(parent: dict, child: dict) -> dict:
    """Style properties of a chain: what the child says wins, null says nothing."""
    return parent | {k: v for k, v in child.items() if v is not None}


def without_base(runs: list[Run], base: dict[str, bool]) -> list[Run]:
    """Runs without the emphasis that their heading's style has anyway."""
    return [Run(r.text, r.bold and not base.get("bold"), r.italic and not base.get("italic"), r.strike and not base.get("strike"), r.code, r.href, r.kind) for r in runs]


def runs_are_empty(runs: list[Run]) -> bool:
    """Whether inline content shows nothing: white space, breaks, anchors, links around nothing."""
    return all(r.kind in ("break", "anchor") or r.kind == "text" and not r.text.strip() for r in runs)


def cell_is_empty(c: Cell) -> bool:
    """Whether all of a cell's blocks are empty paragraphs."""
    return all(b.kind == "paragraph" and runs_are_empty(b.runs) for b in c.blocks)

