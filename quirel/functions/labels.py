"""More scalar functions: labels of rows and headings, scripts, structure roles, field texts, identifiers, geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws

# Code point ranges as regex class bodies.
CJK = r"\x{1100}-\x{11ff}\x{3000}-\x{303f}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{3130}-\x{318f}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}"
RTL = r"\x{0590}-\x{05ff}\x{0600}-\x{06ff}\x{0700}-\x{074f}\x{0750}-\x{077f}\x{0780}-\x{07bf}\x{07c0}-\x{07ff}\x{0800}-\x{083f}\x{0840}-\x{085f}\x{08a0}-\x{08ff}\x{fb1d}-\x{fb4f}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}"
# Standard structure roles, and those that are never headings.
ROLES = "Document Part Art Sect Div BlockQuote Caption TOC TOCI Index NonStruct Private H H1 H2 H3 H4 H5 H6 P L LI Lbl LBody Table TR TH TD THead TBody TFoot Span Quote Note Reference BibEntry Code Link Annot Figure Formula Form Ruby RB RT RP Warichu WT WP".split()
NOT_HEADING = "L LI Lbl LBody BlockQuote Quote Caption TOC TOCI Index Note Reference BibEntry Code Formula Form Table TR TH TD THead TBody TFoot".split()
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
ROMAN = r"^(?i:m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))$"
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "svg": "image/svg+xml", "emf": "image/x-emf", "wmf": "image/x-wmf"}


def expand_ligatures(c: Column) -> Column:
    """Ligatures to letters, hidden characters and C0 controls dropped, typographic spaces to spaces."""
    c = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), c)
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\xad\x{200b}-\x{200d}\x{2060}\x{feff}]", "")
    return F.regexp_replace(c, r"[\x{2000}-\x{200a}]", " ")


def is_rtl_text(c: Column) -> Column:
    """Letters written from right to left outnumber the others (CJK aside)."""
    rtl = F.char_length(F.regexp_replace(c, f"[^{RTL}]", ""))
    other = F.char_length(F.regexp_replace(F.regexp_replace(c, f"[{RTL}{CJK}]", ""), r"[^\p{L}]", ""))
    return rtl > other


def roman_value(c: Column) -> Column:
    """Value of a canonical Roman numeral of at most eight characters; null otherwise."""
    u = F.upper(trim_ws(c))
    value = lambda ch: F.when(ch == "M", 1000).when(ch == "D", 500).when(ch == "C", 100).when(ch == "L", 50).when(ch == "X", 10).when(ch == "V", 5).otherwise(1)
    vals = F.transform(F.filter(F.split(u, ""), lambda x: x != ""), value)
    # From the right, a digit below the largest so far is taken off.
    total = F.aggregate(F.reverse(vals), F.struct(F.lit(0).alias("s"), F.lit(0).alias("m")), lambda a, v: F.struct((a["s"] + F.when(v < a["m"], -v).otherwise(v)).alias("s"), F.greatest(a["m"], v).alias("m")), lambda a: a["s"])
    return F.when((F.char_length(u) >= 1) & (F.char_length(u) <= 8) & u.rlike(ROMAN), total)


def page_number_value(c: Column) -> Column:
    t = trim_ws(c)
    return F.when(t.rlike("^[0-9]{1,4}$"), t.try_cast("int")).otherwise(roman_value(c))


def looks_like_data(c: Column) -> Column:
    """Numbers, short dates and codes, digits with a unit or in parentheses."""
    t = trim_ws(c)
    digit = t.rlike("[0-9]")
    number = F.regexp_replace(t, r"[,$€£%\s]", "").rlike(r"^[(+\-]?[0-9]*\.?[0-9]+\)?$")
    date = (F.octet_length(t) <= 10) & t.rlike("^[0-9/\\-]+$") & t.rlike("[/\\-]") & (F.char_length(F.regexp_replace(t, "[^0-9]", "")) >= 4)
    code = (F.octet_length(t) <= 10) & t.rlike(r"^[\p{L}\p{N}]+$") & digit
    unit = digit & t.rlike("[°VAµ]|Hz|pin")
    bracket = digit & t.contains("(") & t.contains(")")
    degrees = t.rlike("°[CF]") & t.contains("to")
    return F.when(t == "", False).otherwise(number | date | code | unit | bracket | degrees)


def alpha_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"\p{L}")))


def is_entry_label(c: Column) -> Column:
    t = trim_ws(c)
    start = t.rlike(r"^\p{Lu}") | t.rlike(r"^[0-9]+(?:\.[0-9]+)*[.)]?\s+\S")
    return F.octet_length(t).between(3, 80) & start & ~t.rlike("[.,;:]$") & alpha_words(t).between(1, 6)


def is_section_label(c: Column) -> Column:
    t = trim_ws(c)
    small = (F.octet_length(t) <= 4) & ~t.rlike(r"\p{Ll}")
    return F.octet_length(t).between(4, 40) & t.rlike(r"^\p{Lu}[\p{L}\s&/\-]*$") & ~small & alpha_words(t).between(1, 4)


def is_incomplete(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+$", "")).rlike(r" and$| or$|[,\-/]$")


def is_page_number_cell(c: Column) -> Column:
    toks = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    one = lambda w: (F.octet_length(w) <= 8) & F.when(w.rlike("^[0-9]+$"), F.char_length(w) <= 4).otherwise((w.rlike(ROMAN) & (w != "")) | (w.rlike("^[0-9A-Z\\-]+$") & w.rlike("[0-9]")))
    return F.when(F.size(toks) == 0, False).otherwise(F.forall(toks, one))


def is_toc_marker(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim_ws(c)), ":$", "").isin("contents", "table of contents")


def has_numbering_prefix(c: Column) -> Column:
    """A leading section number: 1. / 1.2 / IV. / A."""
    return trim_ws(c).rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3})*[.)]?\s+\S|[IVXLC]{1,6}[.)]\s+\S|[A-Z][.)]\s+\S)")


def numbering(c: Column) -> Column:
    """(kind, depth) of a leading section number; null without one."""
    t = trim_ws(c)
    d = F.regexp_extract(t, r"^([0-9]{1,3}(?:\.[0-9]{1,3})*)[.)]?\s+\S", 1)
    return F.when(d != "", F.struct(F.lit("decimal").alias("kind"), F.size(F.split(d, r"\.")).alias("depth"))).when(t.rlike(r"^[IVXLC]{1,6}[.)]\s"), F.struct(F.lit("roman").alias("kind"), F.lit(1).alias("depth"))).when(t.rlike(r"^[A-Z][.)]\s"), F.struct(F.lit("alpha").alias("kind"), F.lit(1).alias("depth")))


def looks_title_case(c: Column) -> Column:
    """Most words of four letters and more begin with a capital."""
    words = F.filter(F.split(trim_ws(c), r"\s+"), lambda w: w.rlike(r"^\p{L}{4,}"))
    caps = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return (F.size(words) > 0) & (caps * 5 >= F.size(words) * 4)


def role(c: Column) -> Column:
    return F.when(c.isin(ROLES), c).when(c.isNotNull(), F.lit("Other"))


def never_heading(c: Column) -> Column:
    return c.isin(NOT_HEADING)


def media_type(part: Column) -> Column:
    ext = F.lower(F.regexp_extract(part, r"\.([^./]*)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in IMAGE_TYPES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def name_from_disposition(h: Column) -> Column:
    n = F.regexp_extract(h, r"(?i)filename=\"?([^\";]+)\"?", 1)
    return F.when(n != "", F.trim(n))


def hash31(c: Column) -> Column:
    """31-polynomial hash of a text's bytes into [3, 2^32)."""
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(F.hex(F.encode(c, "UTF-8"))) / 2, F.lit(1)).cast("int")), lambda i: F.conv(F.substring(F.hex(F.encode(c, "UTF-8")), (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("bigint"))
    folded = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, b: (a * 31 + F.coalesce(b, F.lit(0))) % 4294967296)
    return 3 + folded % 4294967292


def box_of(coords: Column) -> Column:
    """Box [x1, y1, x2, y2] of 4 numbers, or of a polygon's 8; null otherwise."""
    xs, ys = F.filter(coords, lambda _, i: i % 2 == 0), F.filter(coords, lambda _, i: i % 2 == 1)
    return F.when(F.size(coords).isin(4, 8), F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def pixels_to_points(box: Column, dpi: Column, ox: Column, oy: Column) -> Column:
    """A pixel box as points: by 72 over the resolution, from the crop's origin."""
    k = F.lit(72.0) / dpi
    return F.array(box[0] * k + ox, box[1] * k + oy, box[2] * k + ox, box[3] * k + oy)


def list_marker(c: Column) -> Column:
    """A bullet glyph at the start, also inside emphasis marks, as '- '."""
    return F.regexp_replace(c, r"^(\s*)(\*\*|\*|<u>)?[•○●◦▪]\s*", "$1- $2")


def percent_levels(pattern: Column) -> Column:
    """Level numbers a list pattern refers to."""
    return F.transform(F.regexp_extract_all(pattern, F.lit("%([1-9])")), lambda x: x.cast("int"))


def format_urls(c: Column) -> Column:
    """Bare web addresses as links, unless they stand in brackets, parentheses or angle brackets already."""
    return F.regexp_replace(c, r"(?<![\[(<\"'=\w/])(https?://[^\s<>\[\]()\"']*[^\s<>\[\]()\"'.,;:!?])", "[$1]($1)")
