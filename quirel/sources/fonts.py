"""What a PDF's fonts leave out: widths of the standard fonts, predefined encodings of composite fonts, Unicode of embedded glyphs."""

from __future__ import annotations

import struct

# Widths of the characters from the space to the tilde in thousandths of the size.
SANS = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
SERIF = [250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, *[500] * 10, 278, 278, 564, 564, 564, 444, 921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500, 333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541]
MONO = 600
# Beginnings of the standard fonts' names (and of those that stand in for them), without their subset tag.
FAMILIES = [("courier", MONO), ("helvetica", SANS), ("arial", SANS), ("times", SERIF)]
# Parts of the names of predefined encodings, and the codec that gives their Unicode.
ENCODINGS = [("UCS2", "utf-16-be"), ("UTF16", "utf-16-be"), ("UTF32", "utf-32-be"), ("UTF8", "utf-8"), ("90ms-RKSJ", "cp932"), ("90msp-RKSJ", "cp932"), ("83pv-RKSJ", "cp932"), ("90pv-RKSJ", "cp932"), ("RKSJ", "shift_jis"), ("GBK", "gb18030"), ("GBKp", "gb18030"), ("GB-EUC", "gb2312"), ("GBpc-EUC", "gb2312"), ("KSCms-UHC", "cp949"), ("KSC-EUC", "euc_kr"), ("KSCpc-EUC", "euc_kr"), ("ETen-B5", "cp950"), ("ETenms-B5", "cp950"), ("B5pc", "cp950"), ("HKscs-B5", "big5hkscs"), ("EUC-H", "euc_jp"), ("EUC-V", "euc_jp")]


def standard_widths(name: str) -> dict[int, float]:
    """Widths by character code of a standard font, whatever its weight and slant; accented letters are as wide as their base. Empty for other fonts."""
    import unicodedata

    plain = name.split("+", 1)[-1].lower()
    table = next((w for k, w in FAMILIES if plain.startswith(k)), None)
    if table is None:
        return {}
    out = {}
    for code in range(32, 256):
        try:
            base = unicodedata.normalize("NFD", bytes([code]).decode("cp1252"))[0]
        except UnicodeDecodeError:
            continue
        if isinstance(table, int):
            out[code] = float(table)
        elif 32 <= ord(base) < 127:
            out[code] = float(table[ord(base) - 32])
    return out


def predefined_codec(encoding: str) -> str | None:
    """The codec of a predefined encoding of a composite font, by its name; None for identity and unknown ones."""
    return next((codec for part, codec in ENCODINGS if part in encoding), None)


def decode_codes(data: bytes, codec: str) -> list[tuple[str, int]]:
    """(character, code) one after another; bytes that mean nothing give the replacement character."""
    out = []
    i = 0
    while i < len(data):
        for n in ((4, 2, 1) if codec == "utf-16-be" and data[i] & 0xFC == 0xD8 else (2, 1) if codec == "utf-16-be" else (1, 2, 3, 4)):
            try:
                text = data[i : i + n].decode(codec)
            except UnicodeDecodeError:
                continue
            if text:
                break
        else:
            n, text = 1, "�"
        out.append((text, int.from_bytes(data[i : i + n], "big")))
        i += n
    return out


def glyph_unicode(font: bytes) -> dict[int, str]:
    """Glyph number -> character of an embedded TrueType or OpenType font by its own character table; empty if it has none that can be read."""
    try:
        n = struct.unpack_from(">H", font, 4)[0]
        at = next(struct.unpack_from(">I", font, 12 + 16 * i + 8)[0] for i in range(n) if font[12 + 16 * i : 16 + 16 * i] == b"cmap")
        tables = [struct.unpack_from(">HHI", font, at + 4 + 8 * i) for i in range(struct.unpack_from(">H", font, at + 2)[0])]
        # Full Unicode first, then the basic plane; symbol fonts don't tell.
        rank = {(3, 10): 0, (0, 4): 1, (3, 1): 2, (0, 3): 3}
        out: dict[int, str] = {}
        for platform, kind, offset in sorted(tables, key=lambda t: rank.get(t[:2], 9)):
            if (platform, kind) not in rank:
                continue
            p = at + offset
            form = struct.unpack_from(">H", font, p)[0]
            if form == 4:
                half = struct.unpack_from(">H", font, p + 6)[0] // 2
                read = lambda o, f=">H", p=p, half=half: [struct.unpack_from(f, font, p + 14 + o + 2 * i)[0] for i in range(half)]
                ends, starts, deltas, ranges = read(0), read(2 + 2 * half), read(2 + 4 * half), read(2 + 6 * half)
                for i, (a, b, d, r) in enumerate(zip(starts, ends, deltas, ranges)):
                    for c in range(a, min(b, 0xFFFE) + 1):
                        if r:
                            q = p + 16 + 6 * half + 2 * i + r + 2 * (c - a)
                            g = struct.unpack_from(">H", font, q)[0] if q + 2 <= len(font) else 0
                            g = (g + d) & 0xFFFF if g else 0
                        else:
                            g = (c + d) & 0xFFFF
                        if g:
                            out.setdefault(g, chr(c))
            elif form == 12:
                for i in range(min(struct.unpack_from(">I", font, p + 12)[0], 100_000)):
                    a, b, g = struct.unpack_from(">III", font, p + 16 + 12 * i)
                    for k in range(min(b - a + 1, 0x10FFFF)):
                        if a + k <= 0x10FFFF:
                            out.setdefault(g + k, chr(a + k))
            if out:
                return out
    except (struct.error, StopIteration, IndexError):
        pass
    return {}
