"""Queries of the line and stroke steps, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirel.functions import text as T
from quirel.operators import layout, lines
from quirel.session import table

from .convert_queries import _csv_files, _pdf_files
from .layout_queries import ITEMS, LINES, PAGES, _items
from .text_queries import W, sql_trim

__all__ = ["QUERIES", "PAGES"]


def isolated_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.isolated_lines(layout.lines(_items(spark, d)))


ISOLATED = rf"""WITH {LINES}, z AS (SELECT *, {sql_trim('text')} AS t, lag(line_y) OVER w - line_y AS before, line_y - lead(line_y) OVER w AS after FROM l WINDOW w AS (PARTITION BY result_id, page_no ORDER BY line_y DESC)),
 o AS (SELECT *, (before IS NULL OR before > 18.0) AND (after IS NULL OR after > 18.0) AND len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) BETWEEN 1 AND 6 AND strlen(t) > 3 AND font_size >= CAST(0.95 * 12.0 AS DOUBLE) AND NOT regexp_matches(regexp_replace(t, '^[{W}]+', ''), '{T.LIST_ITEM}') AND NOT regexp_matches(t, '{T.CAPTION}') AND NOT regexp_matches(t, '[,;:\-]$') AS iso FROM z),
 k AS (SELECT *, count(*) OVER (PARTITION BY result_id, page_no) AS n, count_if(iso) OVER (PARTITION BY result_id, page_no) AS k FROM o) SELECT result_id, page_no, line_y FROM k WHERE iso AND NOT (n >= 10 AND k > 0.25 * n)"""


def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    ln = layout.lines(_items(spark, d))
    tiers = layout.heading_tiers(ln)
    base = ln.where("font_size >= 9").groupBy("result_id", F.floor(F.col("font_size") * 10).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("result_id").agg((F.max_by("k", F.struct("n", -F.col("k"))) / 10).alias("base"))
    j = ln.join(base, "result_id").join(tiers, "result_id", "left")
    size = F.round(F.col("font_size").cast("double"), 2)
    lv = lines.header_level(size, F.col("base"), F.coalesce("tiers", F.array().cast("array<double>")), F.col("bold_chars") * 2 >= F.col("chars"))
    return j.select("result_id", "page_no", "line_y", lv.alias("level")).where("level IS NOT NULL")


HEADING_LEVELS = rf"""WITH RECURSIVE {LINES}, z AS (SELECT DISTINCT l.result_id, round(CAST(font_size AS DOUBLE), 2) AS size FROM l JOIN s USING (result_id) WHERE font_size >= 1.2 * base AND regexp_matches(text, '\p{{L}}')),
 f AS (SELECT result_id, max(size) AS size, 0 AS tier FROM z GROUP BY result_id UNION ALL SELECT f.result_id, (SELECT max(z.size) FROM z WHERE z.result_id = f.result_id AND f.size - z.size > 0.5) AS size, tier + 1 FROM f WHERE tier < 3 AND size IS NOT NULL),
 t AS (SELECT result_id, list(size ORDER BY tier) AS tiers FROM f WHERE size IS NOT NULL GROUP BY result_id),
 x AS (SELECT l.result_id, page_no, line_y, round(CAST(font_size AS DOUBLE), 2) AS size, base, bold_chars * 2 >= chars AS bold, coalesce(tiers, []) AS tiers FROM l JOIN s ON l.result_id = s.result_id LEFT JOIN t ON l.result_id = t.result_id),
 y AS (SELECT *, size / base AS ratio, coalesce(list_position(list_transform(tiers, lambda q: abs(q - size) <= 0.5), true), 0) AS p FROM x)
 SELECT result_id, page_no, line_y, CAST(level AS INT) AS level FROM (SELECT *, CASE WHEN ratio >= 1.2 THEN CASE WHEN len(tiers) > 0 THEN CASE WHEN p > 0 THEN p WHEN ratio >= 1.5 THEN least(len(tiers) + 1, 4) END ELSE CASE WHEN ratio >= 2.0 THEN 1 WHEN ratio >= 1.5 THEN 2 WHEN ratio >= 1.25 THEN 3 ELSE 4 END END WHEN ratio >= 1.05 AND bold AND p > 0 THEN p END AS level FROM y) WHERE level IS NOT NULL"""


def overused_levels(spark: SparkSession, d: str) -> DataFrame:
    """Trees of forms printed twelve times over, whose writer has tagged every paragraph as a heading."""
    e = table(spark, d, "struct_element").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("struct_role", F.when(F.col("struct_role") == "P", "H2").otherwise(F.col("struct_role")))
    return lines.overused_levels(e)


OVERUSED = "WITH h AS (SELECT result_id, mcid, CASE WHEN struct_role = 'P' THEN 'H2' ELSE struct_role END AS struct_role FROM struct_element, range(12)), g AS (SELECT result_id, struct_role, count(*) AS n FROM h WHERE struct_role IS NOT NULL AND mcid IS NOT NULL GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY result_id) AS t FROM g) SELECT result_id, struct_role, n, round(n / t, 6) AS share FROM a WHERE regexp_matches(struct_role, '^H[1-6]?$') AND t >= 20 AND n > 0.15 * t"


def _strokes(spark: SparkSession, d: str) -> DataFrame:
    """A stroke below each item, at heights of ten points."""
    return _items(spark, d).where("width > 0").select("result_id", "page_no", F.floor(F.col("y").cast("double") / 10).cast("int").alias("y10"), F.col("x").cast("double").alias("x1"), (F.col("x").cast("double") + F.col("width").cast("double")).alias("x2"))


def merged_strokes(spark: SparkSession, d: str) -> DataFrame:
    m = lines.merge_strokes(_strokes(spark, d))
    return m.select("result_id", "page_no", "y10", F.round("x1", 3).alias("x1"), F.round("x2", 3).alias("x2"), "n")


STROKES = f"""WITH {ITEMS}, s AS (SELECT result_id, page_no, CAST(floor(CAST(y AS DOUBLE) / 10) AS INT) AS y10, CAST(x AS DOUBLE) AS x1, CAST(x AS DOUBLE) + CAST(width AS DOUBLE) AS x2 FROM i WHERE width > 0),
 r AS (SELECT *, max(x2) OVER (PARTITION BY result_id, page_no, y10 ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), k AS (SELECT *, sum(CASE WHEN x1 <= reach + 2.0 THEN 0 ELSE 1 END) OVER (PARTITION BY result_id, page_no, y10 ORDER BY x1, x2 ROWS UNBOUNDED PRECEDING) AS isle FROM r)
 SELECT result_id, page_no, y10, round(min(x1), 3) AS x1, round(max(x2), 3) AS x2, count(*) AS n FROM k GROUP BY result_id, page_no, y10, isle"""


def underlined_items(spark: SparkSession, d: str) -> DataFrame:
    """Items marked as underlined give a rule two points below; what items do these rules underline?"""
    it = _items(spark, d)
    rules = it.where("is_underline AND width > 0").select("result_id", "page_no", (F.col("y").cast("double") - 2).alias("ry"), F.col("x").cast("double").alias("x1"), (F.col("x").cast("double") + F.col("width").cast("double")).alias("x2"))
    return lines.underlined(it, rules)


UNDERLINED = f"""WITH {ITEMS}, r AS (SELECT result_id, page_no, CAST(y AS DOUBLE) - 2 AS ry, CAST(x AS DOUBLE) AS x1, CAST(x AS DOUBLE) + CAST(width AS DOUBLE) AS x2 FROM i WHERE is_underline AND width > 0)
 SELECT DISTINCT i.result_id, i.page_no, item_no FROM i JOIN r ON i.result_id = r.result_id AND i.page_no = r.page_no WHERE width > 0 AND ry <= CAST(y AS DOUBLE) AND ry >= CAST(y AS DOUBLE) - 0.35 * CAST(font_size AS DOUBLE) AND least(CAST(x AS DOUBLE) + CAST(width AS DOUBLE), x2) - greatest(CAST(x AS DOUBLE), x1) >= 0.6 * CAST(width AS DOUBLE)"""


def file_signatures(spark: SparkSession, d: str) -> DataFrame:
    f = _pdf_files(spark, d).select("doc_id", "data").unionByName(_csv_files(spark, d).select(F.col("doc_id").cast("long"), "data"))
    s = lines.signature(F.col("data"))
    return f.select("doc_id", F.coalesce(s, F.lit("none")).alias("kind"), lines.pdf_page_estimate(F.col("data")).cast("bigint").alias("pages"))


SIGNATURES = "SELECT result_id AS doc_id, 'pdf' AS kind, count(DISTINCT page_no) AS pages FROM pdf_item WHERE text IS NOT NULL GROUP BY result_id UNION ALL SELECT DISTINCT c_nationkey, 'none', 0 FROM customer"


def text_markdown(spark: SparkSession, d: str) -> DataFrame:
    return lines.text_to_markdown(table(spark, d, "doc_block").groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("block_no", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), "\n\n").alias("t")), "file_id", "t")


_T = "t"
TEXT_MARKDOWN = rf"""WITH f AS (SELECT file_id, string_agg(t, chr(10) || chr(10) ORDER BY block_no, t) AS text FROM (SELECT DISTINCT file_id, block_no, coalesce(text, '') AS t FROM doc_block) GROUP BY file_id),
 l AS (SELECT file_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM f), m AS (SELECT *, {sql_trim('line')} AS t FROM l),
 k AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(regexp_replace(t, '^[{W}]+', ''), '{T.LIST_ITEM}') THEN 'list' WHEN regexp_matches(t, '{T.CODE_START}') OR (length(regexp_replace(t, '[^{{}}()\[\];=<>]', '', 'g')) >= 3 AND strlen(t) < 200) OR regexp_matches(t, '[;{{}}]$') THEN 'code' ELSE 'para' END AS kind FROM m),
 g AS (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS s FROM k WINDOW w AS (PARTITION BY file_id ORDER BY pos)), i AS (SELECT *, sum(s) OVER (PARTITION BY file_id ORDER BY pos) AS isle FROM g),
 b AS (SELECT file_id, isle, CASE kind WHEN 'list' THEN string_agg(regexp_replace(t, '^[•○●◦*] ', '- '), chr(10) ORDER BY pos) WHEN 'code' THEN repeat(chr(96), 3) || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) || repeat(chr(96), 3) ELSE string_agg(t, ' ' ORDER BY pos) END AS md FROM i WHERE kind <> 'blank' GROUP BY file_id, isle, kind)
 SELECT file_id, string_agg(md, chr(10) || chr(10) ORDER BY isle) || chr(10) AS markdown FROM b GROUP BY file_id"""

QUERIES = {
    "isolated_lines": (isolated_lines, ISOLATED),
    "heading_levels": (heading_levels, HEADING_LEVELS),
    "overused_levels": (overused_levels, OVERUSED),
    "merged_strokes": (merged_strokes, STROKES),
    "underlined_items": (underlined_items, UNDERLINED),
    "file_signatures": (file_signatures, SIGNATURES),
    "text_markdown": (text_markdown, TEXT_MARKDOWN),
}
