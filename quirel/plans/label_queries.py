"""Queries of labels, scripts, roles, letter statistics and neighbouring-line steps, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirel.functions import labels as L
from quirel.functions import text as T
from quirel.operators import tidy
from quirel.session import spread, table

from .text_queries import W, sql_trim

SAMPLES = ["12.5%", "(3.2)", "12/03/1999", "AB12", "5 kHz", "10 mA", "20°C to 30°C", "Total (2)", "xiv", "IV", "MCMXC", "iiii", "", " ", "Summary and", "Item,", "Board of Trustees", "Research & Development", "R&D", "1.2 Scope", "A. Intro", "IV. Results", "Table of Contents:", "contents", "12 iv A-3", "page", "Notes.", "ﬁnal oﬃce​", "שלום abc", "مرحبا", "日本語 text", "• bullet", "**• bold**", "see http://x.invalid/a, or [b](http://y.invalid)", "%1.%2)", "attachment; filename=\"a b.pdf\"", "img/pic.JPEG", "x.emf", "2024", "99999"]


def _cells(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "doc_block").where("text IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("s"))
    i = table(spark, d, "pdf_item").where("text IS NOT NULL").select(F.col("text").alias("s"))
    return b.unionByName(i).unionByName(spark.createDataFrame([(x,) for x in SAMPLES], "s string")).distinct()


_V = ", ".join("('" + x.replace("'", "''") + "')" for x in SAMPLES)
BASE = f"c AS (SELECT unnest(string_split(text, chr(10))) AS s FROM doc_block WHERE text IS NOT NULL UNION SELECT text FROM pdf_item WHERE text IS NOT NULL UNION SELECT * FROM (VALUES {_V}) t(s)), t AS (SELECT s, {sql_trim('s')} AS t FROM c)"
_AW = r"len(list_filter(string_split_regex(t, '\s+'), lambda w: regexp_matches(w, '\p{L}')))"


def cell_labels(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    return _cells(spark, d).select("s", L.looks_like_data(s).alias("data"), L.is_entry_label(s).alias("entry"), L.is_section_label(s).alias("section"), L.is_incomplete(s).alias("incomplete"), L.is_page_number_cell(s).alias("page_cell"), L.is_toc_marker(s).alias("toc_marker"), L.has_numbering_prefix(s).alias("numbered"), L.looks_title_case(s).alias("title_case"))


CELL_LABELS = rf"""WITH {BASE} SELECT s, CASE WHEN t = '' THEN false ELSE regexp_matches(regexp_replace(t, '[,$€£%\s]', '', 'g'), '^[(+\-]?[0-9]*\.?[0-9]+\)?$') OR (strlen(t) <= 10 AND regexp_matches(t, '^[0-9/\-]+$') AND regexp_matches(t, '[/\-]') AND length(regexp_replace(t, '[^0-9]', '', 'g')) >= 4) OR (strlen(t) <= 10 AND regexp_matches(t, '^[\p{{L}}\p{{N}}]+$') AND regexp_matches(t, '[0-9]'))
 OR (regexp_matches(t, '[0-9]') AND regexp_matches(t, '[°VAµ]|Hz|pin')) OR (regexp_matches(t, '[0-9]') AND contains(t, '(') AND contains(t, ')')) OR (regexp_matches(t, '°[CF]') AND contains(t, 'to')) END AS data,
 strlen(t) BETWEEN 3 AND 80 AND (regexp_matches(t, '^\p{{Lu}}') OR regexp_matches(t, '^[0-9]+(?:\.[0-9]+)*[.)]?\s+\S')) AND NOT regexp_matches(t, '[.,;:]$') AND {_AW} BETWEEN 1 AND 6 AS entry,
 strlen(t) BETWEEN 4 AND 40 AND regexp_matches(t, '^\p{{Lu}}[\p{{L}}\s&/\-]*$') AND NOT (strlen(t) <= 4 AND NOT regexp_matches(t, '\p{{Ll}}')) AND {_AW} BETWEEN 1 AND 4 AS section,
 regexp_matches(lower(regexp_replace(s, '\s+$', '')), ' and$| or$|[,\-/]$') AS incomplete,
 CASE WHEN len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')) = 0 THEN false ELSE len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '' AND NOT (strlen(w) <= 8 AND CASE WHEN regexp_matches(w, '^[0-9]+$') THEN length(w) <= 4 ELSE regexp_matches(w, '{L.ROMAN}') OR (regexp_matches(w, '^[0-9A-Z\-]+$') AND regexp_matches(w, '[0-9]')) END))) = 0 END AS page_cell,
 regexp_replace(lower(t), ':$', '') IN ('contents', 'table of contents') AS toc_marker, regexp_matches(t, '^(?:[0-9]{{1,3}}(?:\.[0-9]{{1,3}})*[.)]?\s+\S|[IVXLC]{{1,6}}[.)]\s+\S|[A-Z][.)]\s+\S)') AS numbered,
 len(list_filter(string_split_regex(t, '\s+'), lambda w: regexp_matches(w, '^\p{{L}}{{4,}}'))) > 0 AND len(list_filter(string_split_regex(t, '\s+'), lambda w: regexp_matches(w, '^\p{{L}}{{4,}}') AND regexp_matches(w, '^\p{{Lu}}'))) * 5 >= len(list_filter(string_split_regex(t, '\s+'), lambda w: regexp_matches(w, '^\p{{L}}{{4,}}'))) * 4 AS title_case FROM t"""


def scripts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    return _cells(spark, d).select("s", L.is_rtl_text(s).alias("rtl"), s.rlike(f"[{L.CJK}]").alias("cjk"), L.expand_ligatures(s).alias("expanded"), L.list_marker(s).alias("marker"), L.media_type(s).alias("media_type"), L.name_from_disposition(s).alias("file_name"), L.hash31(s).alias("h"))


_LIG = "s"
for _k, _v in L.LIGATURES.items():
    _LIG = f"replace({_LIG}, '{_k}', '{_v}')"
_MEDIA = "CASE " + " ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in L.IMAGE_TYPES.items()) + " ELSE 'application/octet-stream' END"
SCRIPTS = rf"""WITH {BASE}, e AS (SELECT s, lower(regexp_extract(s, '\.([^./]*)$', 1)) AS e FROM t) SELECT s, length(regexp_replace(s, '[^{L.RTL}]', '', 'g')) > length(regexp_replace(regexp_replace(s, '[{L.RTL}{L.CJK}]', '', 'g'), '[^\p{{L}}]', '', 'g')) AS rtl, regexp_matches(s, '[{L.CJK}]') AS cjk,
 regexp_replace(regexp_replace({_LIG}, '[\x00-\x08\x0b\x0c\x0e-\x1f\xad\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g'), '[\x{{2000}}-\x{{200a}}]', ' ', 'g') AS expanded, regexp_replace(s, '^(\s*)(\*\*|\*|<u>)?[•○●◦▪]\s*', '\1- \2') AS marker, {_MEDIA} AS media_type,
 CASE WHEN regexp_extract(s, '(?i)filename="?([^";]+)"?', 1) <> '' THEN trim(regexp_extract(s, '(?i)filename="?([^";]+)"?', 1), ' ') END AS file_name,
 CAST(3 + list_reduce(list_transform(range(1, CAST(greatest(strlen(s), 1) + 1 AS BIGINT)), lambda i: CAST(coalesce(try_cast('0x' || nullif(substr(hex(encode(s)), 2 * i - 1, 2), '') AS BIGINT), 0) AS BIGINT)), lambda a, b: (a * 31 + b) % 4294967296, CAST(0 AS BIGINT)) % 4294967292 AS BIGINT) AS h FROM e"""


def numerals(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    x = spark.range(0, 400).select(T.roman(F.col("id")).alias("s")).unionByName(spark.createDataFrame([(v,) for v in SAMPLES], "s string")).distinct()
    return x.select("s", L.roman_value(s).alias("value"), L.page_number_value(s).alias("page_value"), L.numbering(s)["kind"].alias("kind"), L.numbering(s)["depth"].alias("depth"), F.array_join(F.transform(L.percent_levels(s), lambda v: v.cast("string")), ",").alias("levels"), L.format_urls(s).alias("linked"))


def roles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "struct_element").groupBy("struct_role").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("struct_role")
    return e.select("struct_role", "n", L.role(c).alias("role"), L.never_heading(c).alias("never_heading"), T.heading_level(c).alias("level"))


ROLES = f"SELECT struct_role, count(*) AS n, CASE WHEN struct_role IN ({', '.join(map(repr, L.ROLES))}) THEN struct_role WHEN struct_role IS NOT NULL THEN 'Other' END AS role, struct_role IN ({', '.join(map(repr, L.NOT_HEADING))}) AS never_heading, CASE WHEN struct_role IN ('H', 'H1') THEN 1 WHEN regexp_matches(struct_role, '^H[2-6]$') THEN CAST(substr(struct_role, 2, 1) AS INT) END AS level FROM struct_element GROUP BY struct_role"


def letter_stats(spark: SparkSession, d: str) -> DataFrame:
    return tidy.letter_stats(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


_OBS = "[" + ", ".join(f"CAST(length(regexp_replace(lower(text), '[^{ch}]', '', 'g')) AS DOUBLE)" for ch in "abcdefghijklmnopqrstuvwxyz") + "]"
_NORM = sum(x * x for x in tidy.ENGLISH) ** 0.5
LETTER_STATS = rf"""WITH a AS (SELECT doc_id, {_OBS} AS obs, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(lower(text), '[^aeiou]', '', 'g')) AS v, coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) - 1)), 0) AS bi, len(regexp_extract_all(text, '[a-z][A-Z]')) AS sh, length(regexp_replace(text, '[^\p{{L}}]|[A-Za-zÀ-ɏḀ-ỿ]', '', 'g')) AS o, length(regexp_replace(text, '[^À-ÖØ-öø-ɏḀ-ỿ]', '', 'g')) AS lx FROM documents WHERE text IS NOT NULL),
 b AS (SELECT *, CASE WHEN letters > 0 THEN list_dot_product(obs, {tidy.ENGLISH}) / (sqrt(list_dot_product(obs, obs)) * {_NORM!r}) ELSE 1.0 END AS cosine, CASE WHEN letters > 0 THEN list_dot_product(list_reverse_sort(obs), {sorted(tidy.ENGLISH, reverse=True)}) / (sqrt(list_dot_product(obs, obs)) * {_NORM!r}) ELSE 1.0 END AS shape FROM a)
 SELECT doc_id, letters, round(v / greatest(letters, 1), 6) AS vowel_ratio, round(sh / greatest(bi, 1), 6) AS case_shift_ratio, round(cosine, 6) AS cosine, round(shape, 6) AS shape_cosine,
 letters >= 200 AND o <= letters + lx AND v / greatest(letters, 1) <= 0.30 AND ((bi >= 100 AND sh / greatest(bi, 1) >= 0.10) OR (cosine < 0.60 AND shape >= 0.90)) AS garbled FROM b"""

PAGED = [(-1, "text\n\n12\n\nmore"), (-2, "text\n12\nmore"), (-3, "a\nPage 3\n---\nb"), (-4, "7"), (-5, "x\n- 4 -\n\n---"), (-6, None), (-7, ""), (-8, "page 2 of 9\n\nz")]


def page_numbers_dropped(spark: SparkSession, d: str) -> DataFrame:
    x = spread(table(spark, d, "pdf_result").select("result_id", "markdown")).unionByName(spark.createDataFrame(PAGED, "result_id long, markdown string"))
    return tidy.drop_page_numbers(x, "result_id", "markdown")


_P = ", ".join(f"({k}, {'NULL' if v is None else repr(v).replace(chr(92) + 'n', chr(39) + ' || chr(10) || ' + chr(39))})" for k, v in PAGED)
PAGE_NUMBERS = rf"""WITH r AS (SELECT result_id, markdown FROM pdf_result UNION ALL SELECT * FROM (VALUES {_P}) t(result_id, markdown)), l AS (SELECT result_id, unnest(range(len(string_split(markdown, chr(10))))) AS pos, unnest(string_split(markdown, chr(10))) AS line FROM r WHERE markdown IS NOT NULL),
 w AS (SELECT *, {sql_trim('line')} AS t FROM l), n AS (SELECT *, lag(t) OVER x AS b, lead(t) OVER x AS a, lead(t, 2) OVER x AS a2 FROM w WINDOW x AS (PARTITION BY result_id ORDER BY pos)),
 k AS (SELECT result_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM n WHERE NOT ((regexp_matches(t, '{T.PAGE_NUMBER}') OR regexp_matches(t, '^(?i:page) [0-9]{{1,4}}\b')) AND (((b IS NULL OR b IN ('', '---')) AND (a IS NULL OR a IN ('', '---'))) OR coalesce(a = '---' OR (a = '' AND a2 = '---'), false))) GROUP BY result_id)
 SELECT r.result_id, CASE WHEN r.markdown IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM r LEFT JOIN k ON r.result_id = k.result_id"""

QUERIES = {
    "cell_labels": (cell_labels, CELL_LABELS),
    "scripts": (scripts, SCRIPTS),
    "numerals": (numerals, None),
    "roles": (roles, ROLES),
    "letter_stats": (letter_stats, LETTER_STATS),
    "page_numbers_dropped": (page_numbers_dropped, PAGE_NUMBERS),
}
