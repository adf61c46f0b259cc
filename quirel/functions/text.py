"""Scalar text functions as Column expressions: they stay in the JVM and in code generation.

All give null for null. Patterns are written so that the same text works in other engines' regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as a regex class body.
WS = r"\s\x0b\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# File extensions by category, and media types by extension.
CATEGORIES = {
    "text": "txt md mdx log json yaml yml toml xml rs ts tsx js jsx py go java c cpp sh sql",
    "html": "html htm",
    "pdf": "pdf",
    "image": "png jpg jpeg webp gif bmp tif tiff",
    "audio": "mp3 wav m4a aac flac ogg opus",
    "video": "mp4 webm mov mkv",
    "document": "doc docx docm ppt pptx pptm pps ppsx xls xlsx xlsm xlsb odt ods odp rtf epub csv",
}
MIME = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "html": "text/html", "htm": "text/html", "md": "text/markdown", "mdx": "text/markdown", "txt": "text/plain", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4"}
SUPPORTED = {
    "text": ("txt md mdx json yaml yml toml xml rs ts js py", False),
    "document": ("doc docx docm ppt pptx pptm xls xlsx xlsm xlsb odt ods odp rtf epub csv", False),
    "pdf": ("pdf", False),
    "image": ("png jpg jpeg webp gif bmp tif tiff", True),
    "audio": ("mp3 wav m4a aac flac ogg opus", True),
    "video": ("mp4 webm mov mkv", True),
}
CAPTION = r"^(?:Figura |Fig\. |Fig |Tabela |Source:|Fonte:|Source |Fonte |Note:|Nota:|Chart |Gráfico |Graph |Diagram |Image |Imagem |Photo |Foto |(?i:figure|table) [ \t]*[0-9(#]|(?i:source:))"
LIST_ITEM = r"^(?:[•\-*○●◦] |[0-9]{1,4}[.)]|[.)]|[A-Za-z][.)]|\(.\))"
CODE_START = r"^(?:import |export |from |const |let |var |function |class |def |pub fn |fn |async fn |impl |=> |-> |:: |:= )"
HYPHEN_LETTERS = "a-zA-ZáàâãéèêíïóôõöúçñÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ"
PAGE_NUMBER = r"^(?:[0-9]{1,4}|[-–—] ?[0-9]{1,4} ?[-–—]|(?i:page) [0-9]{1,4}(?: (?i:of) [0-9]{1,4})?|[0-9]{1,4} (?i:of) [0-9]{1,4})$"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
TEMPORAL = r"^(?:[0-9]{1,4}([-/.])[0-9]{1,2}[-/.][0-9]{1,4}(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?)?|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)$"


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^[{WS}]+", ""), f"[{WS}]+$", "")


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WS}]+", " ")


def clean_text(c: Column) -> Column:
    """No-break space to space, hidden characters dropped, line ends to one space, other controls but tab dropped."""
    c = F.regexp_replace(F.regexp_replace(c, r"\xa0", " "), r"[\xad\x{200b}\x{feff}]", "")
    return F.regexp_replace(F.regexp_replace(c, r"\r\n|\r|\n", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


def strip_tags(c: Column) -> Column:
    """Markup to text: what stands between angle brackets goes, each closing bracket is a space, white space collapses."""
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]*>|>", " "), "<[^>]*$", "")
    return trim_ws(collapse_ws(c))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*\.([^./]*)$", 1))


def file_stem(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    stem = F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)).otherwise(base)
    return F.when(stem == "", "document").otherwise(stem)


def category(ext: Column) -> Column:
    out = F.lit("unsupported")
    for k, v in CATEGORIES.items():
        out = F.when(ext.isin(v.split()), k).otherwise(out)
    return out


def mime(ext: Column) -> Column:
    out = F.lit("application/octet-stream")
    for k, v in MIME.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def has_scheme(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def is_drive_path(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z]:[\\/]")


def link_kind(c: Column) -> Column:
    return F.when(c.startswith("#"), "anchor").when(has_scheme(c) & ~is_drive_path(c), "external").otherwise("relative")


def blocked_ipv4(ip: Column) -> Column:
    """Private, loopback, link-local, unspecified, broadcast and documentation addresses; null if it is no address."""
    p = F.split(ip, r"\.")
    a, b, c, d = (p[i].cast("int") for i in range(4))
    bad = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 127) | ((a == 169) & (b == 254)) | ((a == 0) & (b == 0) & (c == 0) & (d == 0)) | ((a == 255) & (b == 255) & (c == 255) & (d == 255)) | ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    return F.when(ip.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), bad)


def garbage_counts(c: Column) -> tuple[Column, Column]:
    """(letters and digits, other counted characters): leaders, white space and Markdown marks don't count."""
    t = F.regexp_replace(c, r"\.{3,}|_{3,}|·{3,}", "")
    alnum = F.char_length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    other = F.char_length(F.regexp_replace(t, rf"[\p{{L}}\p{{N}}{WS}#*|\-]", ""))
    return alnum, other


def is_garbage(c: Column) -> Column:
    a, o = garbage_counts(c)
    return (a + o >= 50) & (a * 2 < a + o)


def is_cid_garbage(c: Column) -> Column:
    total = F.char_length(F.regexp_replace(c, f"[{WS}]", ""))
    c1 = F.regexp_count(c, F.lit(r"[\x80-\x84\x86-\x9f]"))
    high = F.regexp_count(c, F.lit(r"[\xa1-\xb6\xb8-\xff]"))
    ascii_letters = F.regexp_count(c, F.lit("[A-Za-z]"))
    return is_garbage(c) | ((total >= 5) & (((c1 >= 2) & (c1 * 20 >= total)) | ((total >= 20) & (high * 5 >= total * 2) & (ascii_letters * 3 < total))))


def dollar_as_space(c: Column) -> Column:
    dollars = F.regexp_count(c, F.lit(r"\$"))
    # Neighbouring hits share a letter, so hits are counted after each such dollar's letters are doubled.
    hits = F.regexp_count(F.regexp_replace(c, "([A-Za-z])", "$1$1"), F.lit(r"[A-Za-z]\$[A-Za-z]"))
    return (dollars > 10) & ((hits > 20) | (hits * 2 > dollars))


def replacement_stats(c: Column) -> tuple[Column, Column]:
    n = F.char_length(F.regexp_replace(c, r"[^\x{fffd}]", ""))
    runs = F.transform(F.regexp_extract_all(c, F.lit(r"(\x{fffd}+)")), F.char_length)
    return n, F.coalesce(F.array_max(runs), F.lit(0))


def private_use_run(c: Column) -> Column:
    pua = r"[\x{e000}-\x{f8ff}\x{f0000}-\x{ffffd}\x{100000}-\x{10fffd}]"
    n = F.regexp_count(c, F.lit(pua))
    total = F.char_length(F.regexp_replace(c, f"[{WS}]", ""))
    return c.rlike(pua + "{3}") | (c.rlike(pua + "{2}") & (total >= 5) & (n * 2 >= total))


def is_caption(c: Column) -> Column:
    return trim_ws(c).rlike(CAPTION)


def is_list_item(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+", "").rlike(LIST_ITEM)


def is_code_like(c: Column) -> Column:
    t = trim_ws(c)
    marks = F.char_length(F.regexp_replace(t, r"[^{}()\[\];=<>]", ""))
    return t.rlike(CODE_START) | ((marks >= 3) & (F.octet_length(t) < 200)) | t.rlike("[;{}]$")


def is_structural(c: Column) -> Column:
    t = trim_ws(c)
    return t.rlike(r"^(?:#|- |\* |• )") | t.rlike(r"^[0-9].*(?:\. |\) )")


def is_footnote(c: Column) -> Column:
    t = F.lower(trim_ws(c))
    return t.rlike(r"^(?:\([0-9]{1,2}\)|[0-9]{1,2}\)|notes?:)")


def is_page_number(c: Column) -> Column:
    return trim_ws(c).rlike(PAGE_NUMBER)


def has_dot_leaders(c: Column) -> Column:
    return c.rlike(r"\.{4}") | (F.regexp_count(c, F.lit(r"\.{3,}")) >= 2)


def is_toc_entry(c: Column) -> Column:
    return trim_ws(c).rlike(rf"\.[{WS}]*[0-9]{{1,4}}$")


def value_kind(c: Column) -> Column:
    t = trim_ws(c)
    bare = F.regexp_replace(F.regexp_replace(t, "%$", ""), r"[, _\xa0]", "")
    return (
        F.when(t == "", None)
        .when(bare.rlike(NUMBER) & bare.rlike("[0-9]"), "number")
        .when(F.lower(t).isin("true", "false", "yes", "no"), "bool")
        .when(t.rlike(TEMPORAL), "date")
        .when(t.isNotNull(), "text")
    )


def gfm_slug(c: Column) -> Column:
    s = F.regexp_replace(F.replace(F.lower(trim_ws(c)), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}\p{M}\p{Pc}\-]", "")
    return F.when(s == "", "section").otherwise(s)


def sanitize_id(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.\-]", "-"), "-+", "-"), "^-|-$", "")
    return F.when(s == "", "anchor").otherwise(s)


def fence(c: Column, least: int) -> Column:
    """A run of backticks longer than any in the text, least at the least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(\\x60+)")), F.char_length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(least)))


def format_url(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<", "%3C"), ">", "%3E"), r"\|", "%7C")
    return F.when(s.rlike(r"[\s()]"), F.concat(F.lit("<"), s, F.lit(">"))).otherwise(s)


def roman(n: Column) -> Column:
    digits = [(1000, ["", "M", "MM", "MMM"]), (100, ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]), (10, ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]), (1, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])]
    parts = [F.element_at(F.array(*map(F.lit, d)), (F.floor(n / v) % 10 + 1).cast("int")) for v, d in digits]
    return F.when(n.between(1, 3999), F.concat(*parts)).otherwise(n.cast("string"))


def alpha(n: Column) -> Column:
    """Bijective base 26, a to zz (702); 0 is "0"."""
    letter = lambda x: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (x + 1).cast("int"), F.lit(1))
    return F.when(n == 0, "0").when(n <= 26, letter(n - 1)).when(n <= 702, F.concat(letter(F.floor((n - 27) / 26)), letter((n - 1) % 26)))


def clock(days: Column) -> Column:
    """Day fraction as HH:MM:SS, rounded to seconds, modulo a day."""
    s = F.round(days * 86400).cast("bigint") % 86400
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(two(s / 3600), F.lit(":"), two(s % 3600 / 60), F.lit(":"), two(s % 60))


def duration(days: Column) -> Column:
    """Days as [h]:mm:ss with a sign."""
    s = F.round(F.abs(days) * 86400).cast("bigint")
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(F.when(days < 0, "-").otherwise(""), F.floor(s / 3600).cast("string"), F.lit(":"), two(s % 3600 / 60), F.lit(":"), two(s % 60))


def fix_hyphenation(c: Column) -> Column:
    return F.regexp_replace(c, f"([{HYPHEN_LETTERS}]) - ([{HYPHEN_LETTERS}])", "$1-$2")


def collapse_leaders(c: Column) -> Column:
    return F.regexp_replace(c, r"\.{4,}", " ... ")


def collapse_spaces(c: Column) -> Column:
    """Runs of spaces inside lines to one space; indents stay."""
    return F.regexp_replace(c, r"([^ \n]) {2,}", "$1 ")


def tidy_punctuation(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit(" ]"), F.lit("]")), r" ([.,;])(\s|\||$)", "$1$2")


def clean_markdown(c: Column, compact: bool = False) -> Column:
    """The cleanup that needs no look at neighbouring lines; remove page-number lines first where wanted."""
    c = fix_hyphenation(collapse_leaders(c) if compact else c)
    c = F.regexp_replace(tidy_punctuation(collapse_spaces(c)), r"\n{3,}", "\n\n")
    return F.concat(trim_ws(c), F.lit("\n"))


def is_bold_font(c: Column) -> Column:
    return F.lower(c).rlike(r"bold|-bd|_bd|black|heavy|demibold|semibold|demi-bold|semi-bold|extrabold|ultrabold") | (F.lower(c).rlike("medium|-medi") & ~F.lower(c).rlike("mediumital"))


def is_italic_font(c: Column) -> Column:
    return F.lower(c).rlike(r"italic|oblique|-it|_it|slant|inclined|kursiv")


def is_monospace_font(c: Column) -> Column:
    return F.lower(c).rlike(r"courier|consolas|monaco|menlo|mono|fixed|terminal|typewriter|source code|fira code|jetbrains|inconsolata")


def heading_level(role: Column) -> Column:
    return F.when(role.isin("H", "H1"), 1).when(role.rlike("^H[2-6]$"), F.substring(role, 2, 1).cast("int"))


def count_table_columns(c: Column) -> Column:
    """Columns of the first pipe row."""
    row = F.regexp_extract(c, r"(?m)^\|(.*)\|[ \t]*$", 1)
    return F.when(row == "", 0).otherwise(F.size(F.split(row, r"\|")))
