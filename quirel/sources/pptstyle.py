"""Style runs of a legacy presentation's text: bullets and levels of paragraphs, emphasis of characters."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Which fields a mask announces, in the order they are stored: (bits of the mask, bytes of the field).
PARAGRAPH = [(0xF, 2), (1 << 7, 2), (1 << 4, 2), (1 << 6, 2), (1 << 5, 4), (1 << 11, 2), (1 << 12, 2), (1 << 13, 2), (1 << 14, 2), (1 << 8, 2), (1 << 10, 2), (1 << 15, 2), (1 << 20, -1), (1 << 16, 2), (7 << 17, 2), (1 << 21, 2)]
CHARACTER = [(0x3EB7, 2), (1 << 16, 2), (1 << 21, 2), (1 << 22, 2), (1 << 23, 2), (1 << 17, 2), (1 << 18, 4), (1 << 19, 2)]


@dataclass
class StyleRuns:
    #: (characters, level, whether it has a bullet or None if that isn't said) of each stretch of paragraphs.
    paragraphs: list[tuple[int, int, bool | None]] = field(default_factory=list)
    #: (characters, bold, italic) of each stretch of characters.
    characters: list[tuple[int, bool, bool]] = field(default_factory=list)

    def emphasis(self, n: int) -> list[tuple[bool, bool]]:
        """Bold and italic of each of n characters."""
        out = [(b, i) for k, b, i in self.characters for _ in range(min(k, n))]
        return (out + [(False, False)] * n)[:n]

    def paragraph(self, at: int) -> tuple[int, bool | None]:
        """(level, bullet) of the paragraph that a character lies in."""
        for k, level, bullet in self.paragraphs:
            if at < k:
                return level, bullet
            at -= k
        return 0, None


def fields(body: bytes, at: int, layout: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(mask, first field's value or 0, place after the fields)."""
    mask = struct.unpack_from("<I", body, at)[0]
    at += 4
    first = 0
    for k, (bits, size) in enumerate(layout):
        if mask & bits:
            if size < 0:
                size = 2 + 4 * struct.unpack_from("<H", body, at)[0]
            elif k == 0:
                first = struct.unpack_from("<H", body, at)[0]
            at += size
    return mask, first, at


def parse_style_text(body: bytes, text_len: int) -> StyleRuns:
    """The runs of a style record beside a text of so many characters (its end counts as one more); what is cut short ends them."""
    out = StyleRuns()
    at = 0
    try:
        left = text_len + 1
        while left > 0:
            count, level = struct.unpack_from("<IH", body, at)
            mask, flags, at = fields(body, at + 6, PARAGRAPH)
            out.paragraphs.append((count, level, bool(flags & 1) if mask & 1 else None))
            left -= max(1, count)
        left = text_len + 1
        while left > 0:
            count = struct.unpack_from("<I", body, at)[0]
            mask, style, at = fields(body, at + 4, CHARACTER)
            out.characters.append((count, bool(mask & 1 and style & 1), bool(mask & 2 and style & 2)))
            left -= max(1, count)
    except struct.error:
        pass
    return out
