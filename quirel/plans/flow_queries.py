"""Queries of reading order, tables without rules, content types and small checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirel.functions import checks as K
from quirel.functions import text as T
from quirel.operators import flow, geometry, layout, lines, tidy
from quirel.session import spread, table

from .label_queries import BASE, LETTER_STATS, _cells
from .pdf_queries import DRAWN_TABLES, _order_pages
from .text_queries import TEXT_QUALITY


def _customer_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each customer with orders: a title over the whole width, the orders below in two columns."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("result_id"), "o_orderkey")
    g = o.groupBy("result_id").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    g = g.withColumn("half", F.ceil(F.size("ks") / 2).cast("int"))
    it = g.select("result_id", "half", F.posexplode("ks").alias("k", "o"))
    right = F.col("k") >= F.col("half")
    it = it.select("result_id", (F.col("k") + 1).alias("item_no"), F.concat(F.lit("an order with number "), "o").alias("text"), F.when(right, 330.0).otherwise(50.0).alias("x"), (700.0 - 14 * (F.col("k") - F.when(right, F.col("half")).otherwise(0))).alias("y"), F.lit(200.0).alias("width"))
    title = g.select("result_id", F.lit(0).alias("item_no"), F.lit("What was ordered").alias("text"), F.lit(50.0).alias("x"), F.lit(740.0).alias("y"), F.lit(480.0).alias("width"))
    return title.unionByName(it).select("result_id", F.lit(1).alias("page_no"), "item_no", "text", "x", "y", "width", F.lit(10.0).alias("font_size"))


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return flow.reading_order(_customer_pages(spark, d))


READING_ORDER = """WITH o AS (SELECT o_custkey AS result_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS item_no, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
 h AS (SELECT *, CAST(ceil(n / 2) AS BIGINT) AS half FROM o), c AS (SELECT *, item_no > half AS r, item_no - CASE WHEN item_no > half THEN half ELSE 0 END AS row_no FROM h)
 SELECT result_id, 1 AS page_no, CAST(0 AS INT) AS item_no, 1 AS region_no, 1 AS order_no FROM (SELECT DISTINCT result_id FROM c)
 UNION ALL SELECT result_id, 1, CAST(item_no AS INT), CASE WHEN n - half >= 3 AND r THEN 3 WHEN n > 1 THEN 2 ELSE 2 END, CAST(1 + CASE WHEN n - half >= 3 THEN item_no ELSE row_number() OVER (PARTITION BY result_id ORDER BY row_no, r) END AS INT) FROM c"""


def page_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the customers' pages: with twenty orders and more there are two."""
    return geometry.columns(_customer_pages(spark, d))


PAGE_COLUMNS = """WITH c AS (SELECT o_custkey AS result_id, count(*) AS n, CAST(ceil(count(*) / 2) AS BIGINT) AS half FROM orders GROUP BY o_custkey)
 SELECT result_id, 1 AS page_no, k AS col_no, CAST(CASE k WHEN 1 THEN 50 ELSE 291 END AS DOUBLE) AS x1, CAST(CASE WHEN n >= 20 AND k = 1 THEN 291 WHEN n = 1 THEN 530 ELSE 530 END AS DOUBLE) AS x2, CAST(CASE WHEN n < 20 THEN n + 1 WHEN k = 1 THEN half + 1 ELSE n - half END AS INT) AS n_items FROM c, (VALUES (1), (2)) t(k) WHERE k = 1 OR n >= 20"""


def merged_items(spark: SparkSession, d: str) -> DataFrame:
    """The customers' pages with an item a word, merged again."""
    it = _customer_pages(spark, d)
    words = it.where("item_no > 0").withColumn("ws", F.split("text", " "))
    words = words.select("*", F.posexplode("ws").alias("k", "word"))
    before = F.when(F.col("k") == 0, 0).otherwise(F.char_length(F.array_join(F.slice("ws", F.lit(1), F.col("k")), "")) * 5 + F.col("k") * 2)
    words = words.select("result_id", "page_no", (F.col("item_no") * 10 + F.col("k")).alias("item_no"), F.col("word").alias("text"), (F.col("x") + before).alias("x"), "y", (F.char_length("word") * 5.0).alias("width"), "font_size")
    return geometry.merged(words.unionByName(it.where("item_no = 0")))


MERGED_ITEMS = """WITH o AS (SELECT o_custkey AS result_id, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
 c AS (SELECT *, i > CAST(ceil(n / 2) AS BIGINT) AS r, i - CASE WHEN i > CAST(ceil(n / 2) AS BIGINT) THEN CAST(ceil(n / 2) AS BIGINT) ELSE 0 END AS row_no FROM o)
 SELECT result_id, 1 AS page_no, 1 AS item_no, 'What was ordered' AS text, CAST(50 AS FLOAT) AS x, CAST(740 AS FLOAT) AS y, CAST(480 AS FLOAT) AS width FROM (SELECT DISTINCT result_id FROM c)
 UNION ALL SELECT result_id, 1, CAST(1 + row_number() OVER (PARTITION BY result_id ORDER BY row_no, r) AS INT), 'an order with number ' || o, CAST(CASE WHEN r THEN 330 ELSE 50 END AS FLOAT), CAST(714 - 14 * row_no AS FLOAT), CAST(93 + 5 * length(CAST(o AS VARCHAR)) AS FLOAT) FROM c"""


def borderless_tables(spark: SparkSession, d: str) -> DataFrame:
    """The orders' pages without what is drawn on them."""
    return geometry.tables(_order_pages(spark, d)[0])


BORDERLESS = DRAWN_TABLES[: DRAWN_TABLES.index(" SELECT result_id, 1 AS page_no")] + " SELECT result_id, 1 AS page_no, CAST(n + 1 AS INT) AS n_rows, 3 AS n_cols, '|line|part|flags|' || chr(10) || '|---|---|---|' || chr(10) || body AS markdown FROM g"


def layout_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Pages of orders with a table; with six lines and more its columns count as the page's."""
    it = _order_pages(spark, d)[0]
    return lines.layout_complexity(geometry.tables(it), geometry.columns(it))


COMPLEXITY = "SELECT l_orderkey AS result_id, [1] AS table_pages, CASE WHEN count(*) >= 6 THEN [1] ELSE [] END AS column_pages, true AS is_complex FROM lineitem GROUP BY l_orderkey"


def content_types(spark: SparkSession, d: str) -> DataFrame:
    """The type of each file: its own where one is recorded for its name, else the usual one of its extension."""
    s = table(spark, d, "doc_source").where("file_name IS NOT NULL").select("file_name", "mime_type", T.extension(F.col("file_name")).alias("ext"))
    own = s.where("mime_type IS NOT NULL AND mime_type <> 'application/octet-stream'")
    return layout.content_types(s.select("file_name", "ext").distinct(), own.groupBy(F.lower("file_name").alias("part")).agg(F.max("mime_type").alias("own_type")), own.groupBy("ext").agg(F.min("mime_type").alias("default_type")))


CONTENT_TYPES = r"""WITH s AS (SELECT DISTINCT file_name, mime_type, lower(regexp_extract(file_name, '[^.].*\.([^.]*)$', 1)) AS ext FROM doc_source WHERE file_name IS NOT NULL), o AS (SELECT * FROM s WHERE mime_type IS NOT NULL AND mime_type <> 'application/octet-stream')
 SELECT DISTINCT s.file_name, coalesce((SELECT max(mime_type) FROM o WHERE lower(o.file_name) = lower(s.file_name)), (SELECT min(mime_type) FROM o WHERE o.ext = s.ext)) AS content_type FROM s"""

PATHS = ["/workspace/", "/knowledge/", "/tmp/../", "/etc/", ""]


def file_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths made of file names: their last part, and whether a guest may read or write there."""
    f = table(spark, d, "doc_source").select("file_name").distinct()
    p = f.select(F.explode(F.array(*map(F.lit, PATHS))).alias("root"), "file_name").select(F.concat("root", F.coalesce("file_name", F.lit(".."))).alias("path")).distinct()
    c = F.col("path")
    return p.select("path", K.safe_file_name(c).alias("name"), K.guest_path_ok(c, False).alias("readable"), K.guest_path_ok(c, True).alias("writable"))


FILE_PATHS = rf"""WITH p AS (SELECT DISTINCT root || coalesce(file_name, '..') AS path FROM doc_source, (VALUES {', '.join(f"('{x}')" for x in PATHS)}) t(root)), l AS (SELECT path, regexp_extract(path, '([^/]+)/*$', 1) AS last FROM p)
 SELECT path, CASE WHEN last NOT IN ('', '.', '..') THEN last END AS name, path LIKE '/%' AND NOT list_contains(string_split(path, '/'), '..') AND (path IN ('/workspace', '/knowledge', '/tmp') OR path LIKE '/workspace/%' OR path LIKE '/knowledge/%' OR path LIKE '/tmp/%') AS readable,
 path LIKE '/%' AND NOT list_contains(string_split(path, '/'), '..') AND (path IN ('/workspace', '/tmp') OR path LIKE '/workspace/%' OR path LIKE '/tmp/%') AS writable FROM l"""


def json_depths(spark: SparkSession, d: str) -> DataFrame:
    """Events' properties, plain and put into arrays of one to three levels."""
    e = table(spark, d, "events").select("event_id", F.col("props").cast("string").alias("j"), (F.col("event_id") % 3 + 1).cast("int").alias("k"))
    return e.select("event_id", K.json_depth(F.col("j")).alias("depth"), K.json_depth(F.concat(F.repeat(F.lit("["), F.col("k")), F.lit('"]["'), F.repeat(F.lit("]"), F.col("k")))).alias("nested"))


JSON_DEPTHS = r"""WITH m AS (SELECT event_id, string_split(regexp_replace(regexp_replace(CAST(props AS VARCHAR), '"(?:[^"\\]|\\.)*"', '', 'g'), '[^\[\]{}]', '', 'g'), '') AS cs, props FROM events)
 SELECT event_id, CASE WHEN props IS NOT NULL THEN CAST(coalesce(list_max(list_transform(range(1, len(cs) + 1), lambda i: list_sum(list_transform(cs[1:i], lambda c: CASE WHEN c IN ('[', '{') THEN 1 WHEN c IN (']', '}') THEN -1 ELSE 0 END)))), 0) AS INT) END AS depth, CAST(event_id % 3 + 1 AS INT) AS nested FROM m"""
EXTRA = ["$ 5,147,649 114,167 —", "(3.2) - 12%", "$ x", "-----", "====", "—", "C2_0", "C0_Font", "<?xml version='1.0' encoding='latin-1'?>", '<?xml encoding = "UTF-16"?>', "http://purl.oclc.org/ooxml/officeDocument/relationships/styles", "http://purl.oclc.org/ooxml/none", "  7  8 ", "1 2 a"]


def cell_checks(spark: SparkSession, d: str) -> DataFrame:
    """Cells and some samples: figures, separators, composite fonts, encodings and URIs."""
    c = _cells(spark, d).unionByName(spark.createDataFrame([(x,) for x in EXTRA], "s string")).distinct()
    s = F.col("s")
    return c.select("s", F.array_join(K.financial_values(s), "|").alias("figures"), K.is_separator(s).alias("separator"), K.is_cid_font(s).alias("cid_font"), K.declared_encoding(s).alias("encoding"), K.usual_uri(s).alias("uri"), K.bold_heading_level(F.char_length(s) % 8).alias("bold_level"))


_X = ", ".join("('" + x.replace("'", "''") + "')" for x in EXTRA)
_FIG = r"[0-9,.()\-+%]*[0-9][0-9,.()\-+%]*"
CELL_CHECKS = rf"""WITH {BASE}, x AS (SELECT s FROM t UNION SELECT * FROM (VALUES {_X}) y(s)), v AS (SELECT s, list_filter(string_split_regex(s, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS ws FROM x)
 SELECT s, CASE WHEN len(ws) > 0 AND len(list_filter(range(1, len(ws) + 1), lambda i: NOT (regexp_matches(ws[i], '^{_FIG}$') OR ws[i] IN ('—', '–', '‒', '-') OR (ws[i] = '$' AND i < len(ws) AND regexp_matches(ws[i + 1], '^{_FIG}$'))))) = 0 THEN replace(array_to_string(ws, '|'), '$|', '$ ') END AS figures,
 length(s) > 0 AND replace(s, left(s, 1), '') = '' AS separator, s LIKE 'C2\_%' ESCAPE '\' OR s LIKE 'C0\_%' ESCAPE '\' AS cid_font, CASE s WHEN '<?xml version=''1.0'' encoding=''latin-1''?>' THEN 'latin-1' WHEN '<?xml encoding = "UTF-16"?>' THEN 'UTF-16' END AS encoding,
 CASE s WHEN 'http://purl.oclc.org/ooxml/officeDocument/relationships/styles' THEN 'http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles' END AS uri, CAST(least(greatest(length(s) % 8 + 1, 2), 6) AS INT) AS bold_level FROM v"""


def encoding_issues(spark: SparkSession, d: str) -> DataFrame:
    """Texts with lost characters, dollars for spaces, or letters that are shifted or substituted."""
    r = spread(table(spark, d, "pdf_result").where("markdown IS NOT NULL").select("result_id", "markdown"))
    m = F.col("markdown")
    g = tidy.letter_stats(r, "result_id", "markdown").select("result_id", "garbled")
    return r.select("result_id", (F.contains(m, F.lit("�")) | T.dollar_as_space(m)).alias("a")).join(g, "result_id").select("result_id", (F.col("a") | F.col("garbled")).alias("issue"))


ENCODING_ISSUES = "WITH q AS (" + TEXT_QUALITY + "), l AS (" + LETTER_STATS.replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT result_id AS doc_id, markdown AS text FROM pdf_result) WHERE text IS NOT NULL") + ") SELECT result_id, replaced > 0 OR dollar OR garbled AS issue FROM q JOIN l ON q.result_id = l.doc_id"


def tables_and_texts(spark: SparkSession, d: str) -> DataFrame:
    """Results whose pages are all tables, and those with texts beside them, by their pipe rows: (result_id, only_tables)."""
    x = table(spark, d, "pdf_result").where("markdown <> ''").select("result_id", F.explode(F.split("markdown", "\n")).alias("line")).where(F.trim("line") != "")
    row = F.col("line").rlike(r"^\|.*\|[ \t]*$")
    return x.where(row).select("result_id").distinct().join(x.where(~row).select("result_id", F.lit(True).alias("t")).distinct(), "result_id", "left").select("result_id", F.col("t").isNull().alias("only_tables"))


TABLES_AND_TEXTS = r"""WITH x AS (SELECT result_id, unnest(string_split(markdown, chr(10))) AS line FROM pdf_result WHERE markdown <> ''), y AS (SELECT result_id, regexp_matches(line, '^\|.*\|[ \t]*$') AS r FROM x WHERE trim(line, ' ') <> '')
 SELECT result_id, bool_and(r) AS only_tables FROM y GROUP BY result_id HAVING bool_or(r)"""

QUERIES = {
    "reading_order": (reading_order, READING_ORDER),
    "page_columns": (page_columns, PAGE_COLUMNS),
    "merged_items": (merged_items, MERGED_ITEMS),
    "borderless_tables": (borderless_tables, BORDERLESS),
    "layout_complexity": (layout_complexity, COMPLEXITY),
    "content_types": (content_types, CONTENT_TYPES),
    "file_paths": (file_paths, FILE_PATHS),
    "json_depths": (json_depths, JSON_DEPTHS),
    "cell_checks": (cell_checks, CELL_CHECKS),
    "encoding_issues": (encoding_issues, ENCODING_ISSUES),
    "tables_and_texts": (tables_and_texts, TABLES_AND_TEXTS),
}
