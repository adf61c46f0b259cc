"""Checks and small readings of names, paths, URIs, JSON, figures and separators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that a guest may read, and those it may write to; beginnings of names of composite fonts.
READABLE, WRITABLE = ("/workspace", "/knowledge", "/tmp"), ("/workspace", "/tmp")
CID_FONTS = ("C2_", "C0_")
# Where the URIs of the strict form of office packages begin, and those of the usual form.
STRICT_ROOT, USUAL_ROOT = "http://purl.oclc.org/ooxml/", "http://schemas.openxmlformats.org/"
FIGURE = r"[0-9,.()\-+%]*[0-9][0-9,.()\-+%]*"
DASH = "[—–‒-]"


def safe_file_name(name: Column) -> Column:
    """The last part of a path; null if there is none, or if the path holds a null character."""
    last = F.regexp_extract(name, r"([^/]+)/*$", 1)
    return F.when(~F.contains(name, F.lit("\x00")) & ~last.isin("", ".", ".."), last)


def guest_path_ok(path: Column, writable: bool) -> Column:
    """Absolute, without a null character or a step up, inside the folders for reading or writing."""
    roots = WRITABLE if writable else READABLE
    inside = path.isin(*roots)
    for r in roots:
        inside |= path.startswith(f"{r}/")
    return path.startswith("/") & ~F.contains(path, F.lit("\x00")) & ~path.rlike(r"(?:^|/)\.\.(?:/|$)") & inside


def is_separator(s: Column) -> Column:
    """One character over and over."""
    return (F.char_length(s) > 0) & (F.replace(s, F.left(s, F.lit(1)), F.lit("")) == "")


def is_cid_font(font: Column) -> Column:
    out = F.lit(False)
    for p in CID_FONTS:
        out |= font.startswith(p)
    return out


def bold_heading_level(n_tiers: Column) -> Column:
    """The level of bold headings of body size: below all tiers, from 2 to 6."""
    return F.least(F.greatest(n_tiers + 1, F.lit(2)), F.lit(6))


def usual_uri(uri: Column) -> Column:
    """A strict URI in its usual form; null if it isn't one."""
    rest = F.regexp_extract(uri, f"^{STRICT_ROOT}([^/]*)/(.*)$", 1), F.regexp_extract(uri, f"^{STRICT_ROOT}([^/]*)/(.*)$", 2)
    return F.when(uri.rlike(f"^{STRICT_ROOT}[^/]*/"), F.concat(F.lit(USUAL_ROOT), rest[0], F.lit("/2006/"), rest[1]))


def declared_encoding(head: Column) -> Column:
    """The encoding that an XML declaration names, or null."""
    both = F.concat(F.regexp_extract(head, r"encoding\s*=\s*\"([^\"]*)\"", 1), F.regexp_extract(head, r"encoding\s*=\s*'([^']*)'", 1))
    return F.when(head.rlike(r"encoding\s*=\s*(?:\"[^\"]*\"|'[^']*')"), both)


def json_depth(j: Column) -> Column:
    """How deep objects and arrays are nested; 0 for a plain value. Strings don't count, whatever they hold."""
    marks = F.regexp_replace(F.regexp_replace(j, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.when(j.isNotNull(), F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), start, step, lambda a: a["most"]))


def financial_values(s: Column) -> Column:
    """The figures of a text of nothing else (a currency sign goes with its number, dashes stand for none); null otherwise."""
    one = rf"(?:\$\s+{FIGURE}|{FIGURE}|{DASH})"
    values = F.transform(F.regexp_extract_all(s, F.lit(rf"(?:^|\s)({one})(?=\s|$)"), F.lit(1)), lambda v: F.regexp_replace(v, r"\s+", " "))
    return F.when(s.rlike(rf"^\s*{one}(?:\s+{one})*\s*$"), values)


def blocked_ipv6(ip: Column) -> Column:
    """Loopback, unspecified, unique local and link-local addresses, and private ones of the older kind written in the newer; null if it is no address."""
    from .text import blocked_ipv4

    low = F.lower(ip)
    mapped = F.regexp_extract(low, r"^::ffff:([0-9.]+)$", 1)
    own = low.rlike(r"^(?:::1?|0*(?::0*){6,7}:?0*1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$")
    return F.when(low.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$"), own | F.coalesce(blocked_ipv4(mapped), F.lit(False)))


def new_id(prefix: str) -> Column:
    """A new identifier with a prefix; another one each time it is computed."""
    return F.concat(F.lit(f"{prefix}_"), F.uuid())
