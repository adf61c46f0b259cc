"""Queries of the scalar functions over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirel.functions import text as T
from quirel.session import spread, table

W = T.WS


def sql_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{W}]+', ''), '[{W}]+$', '')"


def _cat_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN ({', '.join(repr(e) for e in v.split())}) THEN '{k}'" for k, v in T.CATEGORIES.items()) + " ELSE 'unsupported' END"


def _mime_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in T.MIME.items()) + " ELSE 'application/octet-stream' END"


EXT = r"lower(regexp_extract({0}, '[^/.][^/]*\.([^./]*)$', 1))"
STEM = r"CASE WHEN {0} IS NULL THEN NULL WHEN regexp_matches(regexp_extract({0}, '([^/]*)$', 1), '^.+\.[^.]*$') THEN regexp_extract(regexp_extract({0}, '([^/]*)$', 1), '^(.+)\.[^.]*$', 1) WHEN regexp_extract({0}, '([^/]*)$', 1) = '' THEN 'document' ELSE regexp_extract({0}, '([^/]*)$', 1) END"


def file_category(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "doc_source").select("file_id", "file_name").distinct()
    ext = T.extension(F.coalesce("file_name", F.lit("")))
    return s.select("file_id", "file_name", ext.alias("ext"), T.category(ext).alias("category"), T.mime(ext).alias("mime"), T.file_stem(F.col("file_name")).alias("stem"))


FILE_CATEGORY = f"SELECT file_id, file_name, ext, {_cat_sql('ext')} AS category, {_mime_sql('ext')} AS mime, {STEM.format('file_name')} AS stem FROM (SELECT DISTINCT file_id, file_name, {EXT.format(chr(99) + 'oalesce(file_name, ' + chr(39) * 2 + ')')} AS ext FROM doc_source)"


def inspect_source(spark: SparkSession, d: str) -> DataFrame:
    """One row for each received file (the latest landing): what conversion would do with it, before any byte is read."""
    s = table(spark, d, "doc_source").groupBy("file_id").agg(F.max_by(F.struct("file_name", "size_bytes", "source_type", "source_url"), F.struct("landed_at", "received_at", F.coalesce("size_bytes", F.lit(-1)), F.coalesce("file_name", F.lit("")))).alias("r")).select("file_id", "r.*")
    ext = T.extension(F.coalesce("file_name", F.lit("")))
    cat = T.category(ext)
    return s.select("file_id", cat.alias("category"), (cat != "unsupported").alias("supported"), cat.isin("image", "audio", "video").alias("requires_provider"), F.when(F.col("size_bytes") > 500 * 1024 * 1024, "resourceLimit").when(F.col("size_bytes") == 0, "malformed").when(cat == "unsupported", "unsupported").alias("error_code"))


INSPECT = f"""SELECT file_id, {_cat_sql('ext')} AS category, ({_cat_sql('ext')}) <> 'unsupported' AS supported, ({_cat_sql('ext')}) IN ('image', 'audio', 'video') AS requires_provider,
 CASE WHEN size_bytes > 524288000 THEN 'resourceLimit' WHEN size_bytes = 0 THEN 'malformed' WHEN ({_cat_sql('ext')}) = 'unsupported' THEN 'unsupported' END AS error_code
 FROM (SELECT *, {EXT.format("coalesce(file_name, '')")} AS ext FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY landed_at DESC, received_at DESC, coalesce(size_bytes, -1) DESC, coalesce(file_name, '') DESC) AS rn FROM doc_source) WHERE rn = 1)"""


def supported_formats(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, e, p) for k, (v, p) in T.SUPPORTED.items() for e in v.split()]
    return spark.createDataFrame(rows, "category string, extension string, requires_provider boolean")


SUPPORTED_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{e}', {str(p).lower()})" for k, (v, p) in T.SUPPORTED.items() for e in v.split()) + ") t(category, extension, requires_provider)"
LINKS = ["#top", "C:\\docs\\a.txt", "c:/docs/a.txt", "mailto:x@y.invalid", "http://10.1.2.3/a", "https://8.8.8.8/b", "ftp://192.168.0.9/c", "chapter2.xhtml#s", "a b(c).html", "x|y<z>", "", "172.31.0.1", "127.0.0.1", "203.0.113.9", "169.254.1.1", "1.2.3"]


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "doc_source").where("source_url IS NOT NULL").select(F.col("source_url").alias("url"))
    u = u.unionByName(spark.createDataFrame([(x,) for x in LINKS], "url string")).distinct()
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]*)", 1)
    ip = F.when(F.col("url").rlike(r"^[0-9.]+$"), F.col("url")).otherwise(host)
    c = F.col("url")
    return u.select("url", F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("scheme"), host.alias("host"), T.has_scheme(c).alias("has_scheme"), T.is_drive_path(c).alias("is_drive_path"), T.link_kind(c).alias("link_kind"), T.blocked_ipv4(ip).alias("blocked_ip"), T.format_url(c).alias("as_target"), T.sanitize_id(c).alias("as_id"))


_IP = "(CASE WHEN regexp_matches(url, '^[0-9.]+$') THEN url ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/:?#]*)', 1) END)"
_O = [f"try_cast(split_part(ip, '.', {i}) AS INT)" for i in (1, 2, 3, 4)]
URL_PARTS = rf"""WITH u AS (SELECT source_url AS url FROM doc_source WHERE source_url IS NOT NULL UNION SELECT * FROM (VALUES {', '.join("('" + x + "')" for x in LINKS)}) t(url)), v AS (SELECT url, {_IP} AS ip FROM u)
SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]*)', 1) AS host,
 regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*:') AS has_scheme, regexp_matches(url, '^[A-Za-z]:[\\/]') AS is_drive_path,
 CASE WHEN starts_with(url, '#') THEN 'anchor' WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*:') AND NOT regexp_matches(url, '^[A-Za-z]:[\\/]') THEN 'external' ELSE 'relative' END AS link_kind,
 CASE WHEN regexp_matches(ip, '^[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}$') THEN ({_O[0]} = 10 OR ({_O[0]} = 172 AND {_O[1]} BETWEEN 16 AND 31) OR ({_O[0]} = 192 AND {_O[1]} = 168) OR {_O[0]} = 127 OR ({_O[0]} = 169 AND {_O[1]} = 254) OR ip = '0.0.0.0' OR ip = '255.255.255.255' OR ip LIKE '192.0.2.%' OR ip LIKE '198.51.100.%' OR ip LIKE '203.0.113.%') END AS blocked_ip,
 CASE WHEN regexp_matches(url, '[\s()]') THEN '<' || replace(replace(replace(url, '<', '%3C'), '>', '%3E'), '|', '%7C') || '>' ELSE replace(replace(replace(url, '<', '%3C'), '>', '%3E'), '|', '%7C') END AS as_target,
 CASE WHEN s = '' THEN 'anchor' ELSE s END AS as_id FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.\-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS s FROM v)"""


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    r = spread(table(spark, d, "pdf_result").select("result_id", "markdown"))
    c = F.col("markdown")
    return r.select("result_id", T.clean_text(c).alias("cleaned"), T.collapse_ws(c).alias("collapsed"), T.strip_tags(c).alias("stripped"))


CLEAN_TEXT = rf"""SELECT result_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(markdown, '\xa0', ' ', 'g'), '[\xad\x{{200b}}\x{{feff}}]', '', 'g'), '\r\n|\r|\n', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g') AS cleaned,
 regexp_replace(markdown, '[{W}]+', ' ', 'g') AS collapsed,
 {sql_trim(f"regexp_replace(regexp_replace(regexp_replace(markdown, '<[^>]*>|>', ' ', 'g'), '<[^>]*$', ''), '[{W}]+', ' ', 'g')")} AS stripped FROM pdf_result"""

GARBAGE_EXTRA = {-1: "~" * 60 + "ab", -2: "\x80\x81" * 6 + "abcdefgh", -3: "a$b$c$d$e$f$g$h$i$j$k$l$m", -4: "\ufffd\ufffd caf\ufffd", -5: "\ue000\ue001\ue002 ok", -6: "...... ______ \xb7\xb7\xb7\xb7", -7: ""}


def _rows_sql(rows: dict[int, str]) -> str:
    ctl = lambda s: "'" + "' || chr(".join("") + s.replace("'", "''") + "'"
    return ", ".join(f"({k}, {ctl(v)})" for k, v in rows.items())


def _quality_base(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame(list(GARBAGE_EXTRA.items()), "result_id long, markdown string")
    return spread(table(spark, d, "pdf_result").select("result_id", "markdown")).unionByName(extra)


def text_quality(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("markdown")
    a, o = T.garbage_counts(c)
    n, run = T.replacement_stats(c)
    return _quality_base(spark, d).select("result_id", a.alias("alnum"), o.alias("other"), T.is_garbage(c).alias("garbage"), T.is_cid_garbage(c).alias("cid_garbage"), T.dollar_as_space(c).alias("dollar"), n.alias("replaced"), run.alias("longest_run"), T.private_use_run(c).alias("private_use"))


_G = r"regexp_replace(markdown, '\.{3,}|_{3,}|·{3,}', '', 'g')"


def _drop(x: str, p: str) -> str:
    return f"length(regexp_replace({x}, '{p}', '', 'g'))"


_PUA = r"[\x{e000}-\x{f8ff}\x{f0000}-\x{ffffd}\x{100000}-\x{10fffd}]"
_C = {
    "alnum": _drop(_G, r"[^\p{L}\p{N}]"),
    "other": _drop(_G, r"[\p{L}\p{N}" + W + r"#*|\-]"),
    "total": _drop("markdown", "[" + W + "]"),
    "c1": _drop("markdown", r"[^\x80-\x84\x86-\x9f]"),
    "high": _drop("markdown", r"[^\xa1-\xb6\xb8-\xff]"),
    "letters": _drop("markdown", "[^A-Za-z]"),
    "dollars": _drop("markdown", "[^$]"),
    "replaced": _drop("markdown", r"[^\x{fffd}]"),
    "pua": _drop("markdown", "[^" + _PUA[1:]),
}
TEXT_QUALITY = rf"""WITH b AS (SELECT result_id, markdown FROM pdf_result UNION ALL SELECT * FROM (VALUES {_rows_sql(GARBAGE_EXTRA)}) t(result_id, markdown)),
 c AS (SELECT result_id, markdown, {', '.join(f'{v} AS {k}' for k, v in _C.items())},
 len(regexp_extract_all(regexp_replace(markdown, '([A-Za-z])', '\1\1', 'g'), '[A-Za-z]\$[A-Za-z]')) AS hits,
 coalesce(list_max(list_transform(regexp_extract_all(markdown, '\x{{fffd}}+'), lambda x: length(x))), 0) AS longest_run FROM b)
 SELECT result_id, alnum, other, alnum + other >= 50 AND alnum * 2 < alnum + other AS garbage,
 (alnum + other >= 50 AND alnum * 2 < alnum + other) OR (total >= 5 AND ((c1 >= 2 AND c1 * 20 >= total) OR (total >= 20 AND high * 5 >= total * 2 AND letters * 3 < total))) AS cid_garbage,
 dollars > 10 AND (hits > 20 OR hits * 2 > dollars) AS dollar, replaced, CASE WHEN markdown IS NULL THEN 0 ELSE longest_run END AS longest_run,
 regexp_matches(markdown, '{_PUA}{{3}}') OR (regexp_matches(markdown, '{_PUA}{{2}}') AND total >= 5 AND pua * 2 >= total) AS private_use FROM c"""


def line_kind(spark: SparkSession, d: str) -> DataFrame:
    """Each line of each page and what kind of line it is."""
    x = spread(table(spark, d, "documents").where("text <> ''").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    c = F.col("line")
    return x.select("doc_id", "line_no", T.is_caption(c).alias("caption"), T.is_list_item(c).alias("list_item"), T.is_code_like(c).alias("code"), T.is_structural(c).alias("structural"), T.is_footnote(c).alias("footnote"), T.is_page_number(c).alias("page_number"), T.has_dot_leaders(c).alias("leaders"), T.is_toc_entry(c).alias("toc_entry"), T.value_kind(c).alias("value_kind"))


def _value_kind_sql(x: str) -> str:
    t = sql_trim(x)
    bare = rf"regexp_replace(regexp_replace({t}, '%$', ''), '[, _\xa0]', '', 'g')"
    return f"CASE WHEN {t} = '' THEN NULL WHEN regexp_matches({bare}, '{T.NUMBER}') AND regexp_matches({bare}, '[0-9]') THEN 'number' WHEN lower({t}) IN ('true', 'false', 'yes', 'no') THEN 'bool' WHEN regexp_matches({t}, '{T.TEMPORAL}') THEN 'date' WHEN {t} IS NOT NULL THEN 'text' END"


_LT = "t"
LINE_KIND = rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text <> ''), m AS (SELECT *, {sql_trim('line')} AS t FROM l)
 SELECT doc_id, CAST(line_no AS INT) AS line_no, regexp_matches(t, '{T.CAPTION}') AS caption, regexp_matches(regexp_replace(line, '^[{W}]+', ''), '{T.LIST_ITEM}') AS list_item,
 regexp_matches(t, '{T.CODE_START}') OR (length(regexp_replace(t, '[^{{}}()\[\];=<>]', '', 'g')) >= 3 AND strlen(t) < 200) OR regexp_matches(t, '[;{{}}]$') AS code,
 regexp_matches(t, '^(?:#|- |\* |• )') OR regexp_matches(t, '^[0-9].*(?:\. |\) )') AS structural, regexp_matches(lower(t), '^(?:\([0-9]{{1,2}}\)|[0-9]{{1,2}}\)|notes?:)') AS footnote,
 regexp_matches(t, '{T.PAGE_NUMBER}') AS page_number, regexp_matches(line, '\.{{4}}') OR len(regexp_extract_all(line, '\.{{3,}}')) >= 2 AS leaders, regexp_matches(t, '\.[{W}]*[0-9]{{1,4}}$') AS toc_entry, {_value_kind_sql('line')} AS value_kind FROM m"""


def slugs(spark: SparkSession, d: str) -> DataFrame:
    """Heading slugs of each file's blocks; the second and later ones of a file get -1, -2 (no look at other bases)."""
    from pyspark.sql import Window

    b = table(spark, d, "doc_block").where("block_kind = 'heading' AND text IS NOT NULL").select("file_id", "block_no", "text").distinct()
    b = b.withColumn("slug", T.gfm_slug(F.col("text")))
    n = F.row_number().over(Window.partitionBy("file_id", "slug").orderBy("block_no", "text")) - 1
    return b.select("file_id", "block_no", "slug", F.when(n == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), n)).alias("anchor"), T.fence(F.col("text"), 3).alias("fence"), F.length(T.sanitize_id(F.col("text"))).alias("id_len"))


SLUGS = rf"""WITH b AS (SELECT DISTINCT file_id, block_no, text, regexp_replace(replace(lower({sql_trim('text')}), ' ', '-'), '[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}\-]', '', 'g') AS s0 FROM doc_block WHERE block_kind = 'heading' AND text IS NOT NULL),
 c AS (SELECT *, CASE WHEN s0 = '' THEN 'section' ELSE s0 END AS slug FROM b), e AS (SELECT *, row_number() OVER (PARTITION BY file_id, slug ORDER BY block_no, text) - 1 AS n, regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.\-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS sid FROM c)
 SELECT file_id, block_no, slug, CASE WHEN n = 0 THEN slug ELSE slug || '-' || n END AS anchor, repeat(chr(96), greatest(coalesce(list_max(list_transform(regexp_extract_all(text, '\x60+'), lambda x: length(x))), 0) + 1, 3)) AS fence, CASE WHEN sid = '' THEN 6 ELSE length(sid) END AS id_len FROM e"""


def ordinals(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    return spark.range(0, 4001).select(n.alias("n"), T.roman(n).alias("roman"), T.alpha(n).alias("alpha"), F.concat(n, F.lit(".")).alias("decimal"))


_R = {v: d for v, d in [(1000, ["", "M", "MM", "MMM"]), (100, ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]), (10, ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]), (1, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])]}
ORDINALS = "SELECT n, CASE WHEN n BETWEEN 1 AND 3999 THEN " + " || ".join(f"({d!r})[n // {v} % 10 + 1]" for v, d in _R.items()) + " ELSE CAST(n AS VARCHAR) END AS roman, CASE WHEN n = 0 THEN '0' WHEN n <= 26 THEN chr(CAST(96 + n AS INT)) WHEN n <= 702 THEN chr(CAST(97 + (n - 27) // 26 AS INT)) || chr(CAST(97 + (n - 1) % 26 AS INT)) END AS alpha, n || '.' AS decimal FROM range(0, 4001) t(n)"


def clocks(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", (F.col("value") / 24).alias("v"))
    return x.select("event_id", T.clock(F.col("v")).alias("time_of_day"), T.duration(F.col("v") - 0.5).alias("duration"))


CLOCKS = """WITH e AS (SELECT event_id, value / 24 AS v FROM events), s AS (SELECT event_id, v, CAST(round(v * 86400) AS BIGINT) % 86400 AS a, CAST(round(abs(v - 0.5) * 86400) AS BIGINT) AS b FROM e)
 SELECT event_id, lpad(CAST(a // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a % 60 AS VARCHAR), 2, '0') AS time_of_day,
 CASE WHEN v - 0.5 < 0 THEN '-' ELSE '' END || CAST(b // 3600 AS VARCHAR) || ':' || lpad(CAST(b % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b % 60 AS VARCHAR), 2, '0') AS duration FROM s"""


def md_clean(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pdf_result").select("result_id", "markdown")).select("result_id", T.clean_markdown(F.col("markdown"), True).alias("cleaned"), T.count_table_columns(F.col("markdown")).alias("table_columns"))


_H = T.HYPHEN_LETTERS
_MC = rf"regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(markdown, '\.{{4,}}', ' ... ', 'g'), '([{_H}]) - ([{_H}])', '\1-\2', 'g'), '([^ \n]) {{2,}}', '\1 ', 'g'), ' ]', ']'), ' ([.,;])(\s|\||$)', '\1\2', 'g')"
MD_CLEAN = rf"""SELECT result_id, {sql_trim(f"regexp_replace({_MC}, chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")} || chr(10) AS cleaned,
 CASE WHEN markdown IS NULL THEN NULL WHEN regexp_extract(markdown, '(?m)^\|(.*)\|[ \t]*$', 1) = '' THEN 0 ELSE len(string_split(regexp_extract(markdown, '(?m)^\|(.*)\|[ \t]*$', 1), '|')) END AS table_columns FROM pdf_result"""


def font_kind(spark: SparkSession, d: str) -> DataFrame:
    extra = ["ABCDEF+Courier-Bold", "Arial-BlackItalic", "Helvetica-Oblique", "Foo-Medium", "Foo-MediumItalic", "JetBrainsMono", "TimesNewRoman,BoldItalic", "Kursivschrift"]
    f = table(spark, d, "pdf_item").select("font").unionByName(spark.createDataFrame([(x,) for x in extra], "font string")).where("font IS NOT NULL").distinct()
    c = F.col("font")
    return f.select("font", T.is_bold_font(c).alias("bold"), T.is_italic_font(c).alias("italic"), T.is_monospace_font(c).alias("mono"), F.regexp_replace(c, r"^[A-Z]{6}\+", "").alias("family"))


FONT_KIND = r"""WITH f AS (SELECT font FROM pdf_item WHERE font IS NOT NULL UNION SELECT * FROM (VALUES ('ABCDEF+Courier-Bold'), ('Arial-BlackItalic'), ('Helvetica-Oblique'), ('Foo-Medium'), ('Foo-MediumItalic'), ('JetBrainsMono'), ('TimesNewRoman,BoldItalic'), ('Kursivschrift')) t(font))
 SELECT font, regexp_matches(lower(font), 'bold|-bd|_bd|black|heavy') OR (regexp_matches(lower(font), 'medium|-medi') AND NOT regexp_matches(lower(font), 'mediumital')) AS bold,
 regexp_matches(lower(font), 'italic|oblique|-it|_it|slant|inclined|kursiv') AS italic, regexp_matches(lower(font), 'courier|consolas|monaco|menlo|mono|fixed|terminal|typewriter|source code|fira code|jetbrains|inconsolata') AS mono, regexp_replace(font, '^[A-Z]{6}\+', '') AS family FROM f"""

QUERIES = {
    "file_category": (file_category, FILE_CATEGORY),
    "inspect_source": (inspect_source, INSPECT),
    "supported_formats": (supported_formats, SUPPORTED_SQL),
    "url_parts": (url_parts, URL_PARTS),
    "clean_text": (clean_text, CLEAN_TEXT),
    "text_quality": (text_quality, TEXT_QUALITY),
    "line_kind": (line_kind, LINE_KIND),
    "slugs": (slugs, SLUGS),
    "ordinals": (ordinals, ORDINALS),
    "clocks": (clocks, CLOCKS),
    "md_clean": (md_clean, MD_CLEAN),
    "font_kind": (font_kind, FONT_KIND),
}
