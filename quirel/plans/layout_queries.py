"""Queries of the relational steps over items, pages, structure trees, grids and blocks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirel.functions import text as T
from quirel.operators import blocks, geometry, grids, layout
from quirel.session import spread, table

from .text_queries import W, _value_kind_sql, sql_trim

ITEMS = "i AS (SELECT DISTINCT ON (result_id, page_no, item_no) * FROM pdf_item)"
LINES = ITEMS + f""", l AS (SELECT result_id, page_no, CAST(round(CAST(y AS DOUBLE)) AS INT) AS line_y, string_agg(coalesce(text, ''), ' ' ORDER BY x, item_no) AS text, arg_min(font_size, struct_pack(x := x, n := item_no)) AS font_size,
 sum(CASE WHEN is_bold THEN length({sql_trim("coalesce(text, '')")}) ELSE 0 END) AS bold_chars, sum(length({sql_trim("coalesce(text, '')")})) AS chars, count(*) AS n_items FROM i GROUP BY ALL),
 s AS (SELECT result_id, k / 10 AS base FROM (SELECT result_id, k, row_number() OVER (PARTITION BY result_id ORDER BY n DESC, k) AS r FROM (SELECT result_id, CAST(floor(font_size * 10) AS INT) AS k, count(*) AS n FROM l WHERE font_size >= 9 GROUP BY ALL)) WHERE r = 1)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return layout.items(table(spark, d, "pdf_item"))


def font_mode(spark: SparkSession, d: str) -> DataFrame:
    return layout.font_mode(_items(spark, d))


FONT_MODE = f"""WITH {ITEMS}, g AS (SELECT result_id, CAST(floor(font_size * 10) AS INT) AS k, count(*) AS n FROM i WHERE font_size >= 9 GROUP BY ALL), m AS (SELECT result_id, k, count(*) OVER (PARTITION BY result_id) AS c, row_number() OVER (PARTITION BY result_id ORDER BY n DESC, k) AS r FROM g)
 SELECT a.result_id, coalesce(k / 10, 12.0) AS base_size, coalesce(c, 0) AS n_sizes FROM (SELECT DISTINCT result_id FROM i) a LEFT JOIN m ON a.result_id = m.result_id AND r = 1"""


def size_rarity(spark: SparkSession, d: str) -> DataFrame:
    return layout.size_rarity(_items(spark, d))


SIZE_RARITY = f"WITH {ITEMS} SELECT result_id, CAST(floor(font_size * 10) AS INT) AS size_tenths, count(*) AS n, round(1 - count(*) / sum(count(*)) OVER (PARTITION BY result_id), 6) AS rarity FROM i GROUP BY result_id, CAST(floor(font_size * 10) AS INT)"


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.lines(_items(spark, d)).withColumn("mostly_bold", F.col("bold_chars") * 2 >= F.col("chars"))


TEXT_LINES = f"WITH {LINES} SELECT *, bold_chars * 2 >= chars AS mostly_bold FROM l"


def paragraph_gap(spark: SparkSession, d: str) -> DataFrame:
    return layout.paragraph_gap(layout.lines(_items(spark, d)))


PARAGRAPH_GAP = f"""WITH {LINES}, b AS (SELECT a.result_id, coalesce(base, 12.0) AS base FROM (SELECT DISTINCT result_id FROM l) a LEFT JOIN s USING (result_id)),
 g AS (SELECT l.result_id, base, lag(line_y) OVER (PARTITION BY l.result_id, page_no ORDER BY line_y DESC) - line_y AS gap FROM l JOIN b USING (result_id)),
 r AS (SELECT result_id, first(base) AS base, count(*) FILTER (gap > 0 AND gap < 10 * base) AS n_gaps, list_sort(list(gap) FILTER (gap > 0 AND gap < 10 * base)) AS gaps FROM g GROUP BY result_id)
 SELECT result_id, n_gaps, round(CASE WHEN n_gaps < 5 THEN 1.8 * base ELSE greatest(1.3 * gaps[n_gaps // 2 + 1], 1.5 * base) END, 6) AS threshold FROM r"""


def heading_tiers(spark: SparkSession, d: str) -> DataFrame:
    return layout.heading_tiers(layout.lines(_items(spark, d))).select("result_id", F.posexplode("tiers").alias("tier", "size"))


HEADING_TIERS = rf"""WITH RECURSIVE {LINES}, z AS (SELECT DISTINCT l.result_id, round(CAST(font_size AS DOUBLE), 2) AS size FROM l JOIN s USING (result_id) WHERE font_size >= 1.2 * base AND regexp_matches(text, '\p{{L}}')),
 f AS (SELECT result_id, max(size) AS size, 0 AS tier FROM z GROUP BY result_id UNION ALL SELECT f.result_id, (SELECT max(z.size) FROM z WHERE z.result_id = f.result_id AND f.size - z.size > 0.5) AS size, tier + 1 FROM f WHERE tier < 3 AND size IS NOT NULL)
 SELECT result_id, tier, size FROM f WHERE size IS NOT NULL"""


def running_heads(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each paper with a head that names the paper and the page printed above their text."""
    head = F.concat(F.lit("THE PAPER "), F.coalesce("paper_code", F.lit("")), F.lit(" OF THE TOWN "), "page_no", F.lit("\n"))
    x = table(spark, d, "documents").where("text <> ''").select(F.coalesce("paper_code", F.lit("")).alias("paper"), "doc_id", F.posexplode(F.split(F.concat(head, "text"), "\n")).alias("line_no", "line"))
    return layout.repeated_lines(x, "paper", "doc_id", "line_no", "line")


RUNNING_HEADS = rf"""WITH h AS (SELECT paper_code, doc_id, 'THE PAPER ' || coalesce(paper_code, '') || ' OF THE TOWN ' || page_no || chr(10) || text AS text FROM documents WHERE text <> ''), x AS (SELECT coalesce(paper_code, '') AS paper, doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM h),
 n AS (SELECT paper, doc_id, line_no, {sql_trim(f"regexp_replace({sql_trim('regexp_replace(line, ' + chr(39) + '[' + W + ']+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '^[0-9]+|[0-9]+$', '', 'g')")} AS norm FROM x),
 r AS (SELECT *, dense_rank() OVER (PARTITION BY paper, doc_id ORDER BY line_no) AS up, dense_rank() OVER (PARTITION BY paper, doc_id ORDER BY line_no DESC) AS down FROM n),
 p AS (SELECT paper, count(*) AS n_all, avg(span) AS span FROM (SELECT paper, doc_id, max(line_no) - min(line_no) AS span FROM x GROUP BY ALL) GROUP BY paper),
 g AS (SELECT paper, norm, count(DISTINCT doc_id) AS n_pages, stddev_pop(line_no) AS sd, min(doc_id) AS first_page FROM r WHERE (up <= 5 OR down <= 5) AND strlen(norm) >= 10 AND NOT regexp_matches(norm, '^(?:#|- |\* |• )|^[0-9].*(?:\. |\) )') GROUP BY ALL)
 SELECT paper, norm, n_pages, first_page FROM g JOIN p USING (paper) WHERE n_all >= 3 AND n_pages >= greatest(3, floor(n_all * 30 / 100)) AND sd < 0.05 * greatest(span, 1.0)"""
def _regions(it: DataFrame) -> DataFrame:
    """Three regions of each page, by the extent of its items: two upper ones that overlap, and the lower part."""
    at = [F.min(F.col("x").cast("double")), F.max(F.col("x").cast("double")), F.min(F.col("y").cast("double")), F.max(F.col("y").cast("double"))]
    p = it.groupBy("result_id", "page_no").agg(*[a.alias(n) for a, n in zip(at, ("x1", "x2", "y1", "y2"))])
    third = lambda k: F.expr(f"x1 + (x2 - x1) * {k} / 3")
    mid = F.expr("(y1 + y2) / 2")
    box = lambda n, a, b, c, e: F.struct(F.lit(n).alias("region_no"), a.alias("rx1"), b.alias("ry1"), c.alias("rx2"), e.alias("ry2"))
    far, top = F.col("x2") + 600, F.col("y2") + 40
    return p.select("result_id", "page_no", F.explode(F.array(box(0, F.col("x1"), mid, third(2), top), box(1, third(1), mid, far, top), box(2, F.col("x1"), F.col("y1"), far, mid))).alias("r")).select("result_id", "page_no", "r.*")


def region_assign(spark: SparkSession, d: str) -> DataFrame:
    it = _items(spark, d)
    return layout.assign_regions(it, _regions(it))


REGION_ASSIGN = f"""WITH {ITEMS}, p AS (SELECT result_id, page_no, min(CAST(x AS DOUBLE)) AS x1, max(CAST(x AS DOUBLE)) AS x2, min(CAST(y AS DOUBLE)) AS y1, max(CAST(y AS DOUBLE)) AS y2 FROM i GROUP BY ALL),
 r AS (SELECT result_id, page_no, 0 AS region_no, x1 AS rx1, (y1 + y2) / 2 AS ry1, x1 + (x2 - x1) * 2 / 3 AS rx2, y2 + 40 AS ry2 FROM p UNION ALL SELECT result_id, page_no, 1, x1 + (x2 - x1) * 1 / 3, (y1 + y2) / 2, x2 + 600, y2 + 40 FROM p UNION ALL SELECT result_id, page_no, 2, x1, y1, x2 + 600, (y1 + y2) / 2 FROM p),
 c AS (SELECT i.result_id, i.page_no, item_no, region_no, greatest(least(CAST(x AS DOUBLE) + CAST(width AS DOUBLE), rx2) - greatest(CAST(x AS DOUBLE), rx1), 0) * greatest(least(CAST(y AS DOUBLE) + CAST(height AS DOUBLE), ry2) - greatest(CAST(y AS DOUBLE), ry1), 0) AS area FROM i JOIN r ON i.result_id = r.result_id AND i.page_no = r.page_no)
 SELECT result_id, page_no, item_no, CAST(region_no AS INT) AS region_no, round(area, 2) AS area FROM (SELECT *, row_number() OVER (PARTITION BY result_id, page_no, item_no ORDER BY area DESC, region_no) AS n FROM c WHERE area > 0) WHERE n = 1"""


def unclaimed_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that neither a figure region nor a tagged table claims."""
    it = _items(spark, d)
    tagged = table(spark, d, "struct_element").where("struct_role IN ('TD', 'TH', 'TR', 'Table') AND mcid IS NOT NULL").select("result_id", "page_no", "mcid").distinct()
    claimed = it.join(tagged, ["result_id", "page_no", "mcid"], "left_semi").select("result_id", "page_no", "item_no")
    boxed = it.where("x BETWEEN 0 AND 300 AND y BETWEEN 600 AND 900").select("result_id", "page_no", "item_no")
    return layout.unclaimed(it, claimed.unionByName(boxed)).select("result_id", "page_no", "item_no")


UNCLAIMED = f"WITH {ITEMS} SELECT result_id, page_no, item_no FROM i WHERE NOT (x BETWEEN 0 AND 300 AND y BETWEEN 600 AND 900) AND NOT EXISTS (SELECT 1 FROM struct_element s WHERE s.struct_role IN ('TD', 'TH', 'TR', 'Table') AND s.result_id = i.result_id AND s.page_no = i.page_no AND s.mcid = i.mcid)"


def item_roles(spark: SparkSession, d: str) -> DataFrame:
    return layout.item_roles(_items(spark, d), table(spark, d, "struct_element"))


ITEM_ROLES = f"""WITH {ITEMS}, e AS (SELECT result_id, page_no, mcid, arg_min(struct_role, elem_id) AS role FROM struct_element WHERE mcid IS NOT NULL GROUP BY ALL)
 SELECT i.result_id, i.page_no, item_no, i.mcid, role, CASE WHEN role IN ('H', 'H1') THEN 1 WHEN regexp_matches(role, '^H[2-6]$') THEN CAST(substr(role, 2, 1) AS INT) END AS level FROM i LEFT JOIN e ON i.result_id = e.result_id AND i.page_no = e.page_no AND i.mcid = e.mcid"""


def item_joins(spark: SparkSession, d: str) -> DataFrame:
    return layout.item_joins(_items(spark, d)).select("result_id", "page_no", "item_no", "next_text", "joined")


ITEM_JOINS = rf"""WITH {ITEMS}, n AS (SELECT result_id, page_no, item_no, text, lead(text) OVER w AS next_text, abs(CAST(lead(y) OVER w AS DOUBLE) - CAST(y AS DOUBLE)) > 0.5 * greatest(CAST(font_size AS DOUBLE), 1.0) AS below, (CAST(lead(x) OVER w AS DOUBLE) - CAST(x AS DOUBLE) - CASE WHEN width > 0 THEN CAST(width AS DOUBLE) ELSE length(text) * 0.5 * greatest(CAST(font_size AS DOUBLE), 1.0) END) / greatest(CAST(font_size AS DOUBLE), 1.0) AS gap
 FROM i WINDOW w AS (PARTITION BY result_id, page_no ORDER BY item_no))
 SELECT result_id, page_no, item_no, next_text, CASE WHEN below OR regexp_matches(text, '\s$') OR regexp_matches(next_text, '^\s') THEN false WHEN regexp_matches(next_text, '^[.,;!?)\]}}'']') THEN true WHEN gap > 3 OR gap < -1 THEN false
 ELSE gap < CASE WHEN regexp_matches(text, '[0-9]$') AND regexp_matches(next_text, '^[0-9]') THEN 0.30 WHEN length(text) = 1 OR length(next_text) = 1 THEN 0.20 WHEN regexp_matches(text, '\p{{Ll}}$') AND regexp_matches(next_text, '^\p{{Ll}}') THEN 0.18 ELSE 0.15 END END AS joined FROM n WHERE next_text IS NOT NULL"""


def structure_paths(spark: SparkSession, d: str) -> DataFrame:
    return layout.structure_paths(table(spark, d, "struct_element"))


STRUCTURE_PATHS = "WITH RECURSIVE e AS (SELECT DISTINCT elem_id, parent_id, struct_role FROM struct_element), t AS (SELECT elem_id, 0 AS depth, struct_role AS path FROM e WHERE parent_id IS NULL UNION ALL SELECT e.elem_id, depth + 1, path || '/' || struct_role FROM e JOIN t ON e.parent_id = t.elem_id) SELECT elem_id, depth, path FROM t"
_TEXT = "(text_operator_count >= CASE WHEN has_images THEN 10 ELSE 3 END AND NOT (image_count > 10 AND image_count > 3 * text_operator_count) AND unique_text_chars >= 5 AND NOT has_vector_text AND NOT has_only_type3_fonts)"
PAGES = f"p AS (SELECT *, {_TEXT} AS is_text FROM (SELECT DISTINCT ON (result_id, page_no) * FROM pdf_page))"


def detect_class(spark: SparkSession, d: str) -> DataFrame:
    return layout.detect_class(table(spark, d, "pdf_page"))


DETECT_CLASS = f"""WITH {PAGES}, g AS (SELECT result_id, count(*) AS pages, count_if(is_text) AS text_pages, count_if(has_template_image) AS template, count_if(has_images AND NOT is_text) AS image, count_if(has_vector_text) AS vector, sum(text_operator_count) AS ops FROM p GROUP BY result_id)
 SELECT result_id, CASE WHEN template > 0 AND text_pages > 0 THEN 'Mixed' WHEN text_pages / pages >= 0.6 THEN 'TextBased' WHEN text_pages = 0 AND image + vector > 0 THEN CASE WHEN ops = 0 AND vector = 0 THEN 'Scanned' ELSE 'ImageBased' END WHEN text_pages > 0 AND image + vector > 0 THEN 'Mixed' WHEN ops = 0 THEN 'Scanned' ELSE 'TextBased' END AS pdf_class,
 round(CASE WHEN template > 0 AND text_pages > 0 THEN 0.5 + 0.3 * (1 - template / pages) WHEN text_pages / pages >= 0.6 THEN text_pages / pages WHEN text_pages = 0 AND image + vector > 0 THEN CASE WHEN ops = 0 AND vector = 0 THEN 0.95 ELSE 0.8 END WHEN text_pages > 0 AND image + vector > 0 THEN 0.7 WHEN ops = 0 THEN 0.9 ELSE greatest(text_pages / pages, 0.5) END, 6) AS confidence, text_pages, pages FROM g"""


def ocr_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that need recognition by their signals, by the record, or both; reasons in order, without repeats."""
    a = layout.ocr_reasons(table(spark, d, "pdf_page"))
    b = table(spark, d, "pdf_result").select("result_id", F.explode("pages_needing_ocr").alias("page_no")).distinct().withColumn("r", F.lit("recorded"))
    j = a.join(b, ["result_id", "page_no"], "full")
    r = F.array_sort(F.array_distinct(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.when(F.col("r").isNotNull(), F.array("r")).otherwise(F.array().cast("array<string>")))))
    return j.select("result_id", "page_no", F.array_join(r, ",").alias("reasons"))


OCR_PAGES = f"""WITH {PAGES}, q AS (SELECT *, (has_identity_h_no_tounicode AND NOT has_decodable_text_fonts) OR has_only_type3_fonts AS font FROM p), a AS (SELECT result_id, page_no, 'suspected_garbled_text' AS r FROM q WHERE font UNION SELECT result_id, page_no, 'vector_text' FROM q WHERE has_vector_text
 UNION SELECT result_id, page_no, 'no_text' FROM q WHERE NOT font AND NOT has_vector_text AND NOT (text_operator_count > 0 AND unique_text_chars >= 5) AND NOT has_images UNION SELECT result_id, page_no, 'scanned' FROM q WHERE NOT font AND NOT has_vector_text AND NOT is_text AND has_images
 UNION SELECT result_id, unnest(pages_needing_ocr), 'recorded' FROM pdf_result) SELECT result_id, page_no, string_agg(r, ',' ORDER BY r) AS reasons FROM a GROUP BY result_id, page_no"""


def sample_pages(spark: SparkSession, d: str) -> DataFrame:
    return layout.sample_pages(table(spark, d, "pdf_result"))


SAMPLE_PAGES = "SELECT DISTINCT result_id, CAST(CASE WHEN page_count <= 8 THEN i + 1 ELSE floor(i * (page_count - 1) / 7) + 1 END AS INT) AS page_no FROM pdf_result, range(0, 8) t(i) WHERE page_count >= 1 AND (page_count > 8 OR i < page_count)"


def continued_tables(spark: SparkSession, d: str) -> DataFrame:
    """Runs of tables over pages: a customer's orders are the pages, their numbers of lines the columns."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_cols"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pages = table(spark, d, "orders").select("o_custkey", "o_orderkey").join(n, "o_orderkey").withColumn("page_no", F.row_number().over(w))
    return layout.continued_tables(pages.select(F.col("o_custkey").alias("result_id"), "page_no", F.lit(1).alias("n_tables"), "n_cols"))


CONTINUED = """WITH p AS (SELECT o_custkey AS result_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no, n_cols FROM orders JOIN (SELECT l_orderkey, count(*) AS n_cols FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
 r AS (SELECT *, CASE WHEN lag(n_cols) OVER w = n_cols THEN 0 ELSE 1 END AS s FROM p WINDOW w AS (PARTITION BY result_id ORDER BY page_no)), q AS (SELECT *, sum(s) OVER (PARTITION BY result_id ORDER BY page_no) AS run_no FROM r)
 SELECT result_id, CAST(run_no AS BIGINT) AS run_no, CAST(min(page_no) AS INT) AS first_page, CAST(max(page_no) AS INT) AS last_page, first(n_cols) AS n_cols FROM q GROUP BY result_id, run_no"""


def adjacent_folios(spark: SparkSession, d: str) -> DataFrame:
    """Items that are a number one more than a number item of the page before; each page has its own number, counted from the result's, below its text."""
    n = F.when(F.col("text").rlike(r"^\s*[0-9]{1,4}\s*$"), F.trim("text").cast("int"))
    it = _items(spark, d).select("result_id", "page_no", "item_no", "text")
    folio = it.select("result_id", "page_no").distinct().select("result_id", "page_no", F.lit(0).alias("item_no"), (F.col("page_no") + F.col("result_id") % 500).cast("string").alias("text"))
    x = it.unionByName(folio).select("result_id", "page_no", "item_no", n.alias("n")).where("n IS NOT NULL")
    y = x.select("result_id", (F.col("page_no") + 1).alias("page_no"), (F.col("n") + 1).alias("n")).distinct()
    return x.join(y, ["result_id", "page_no", "n"], "left_semi").select("result_id", "page_no", "item_no", "n")


FOLIOS = rf"WITH {ITEMS}, f AS (SELECT result_id, page_no, item_no, text FROM i UNION ALL SELECT DISTINCT result_id, page_no, 0, CAST(page_no + result_id % 500 AS VARCHAR) FROM i), x AS (SELECT result_id, page_no, item_no, CAST(trim(text) AS INT) AS n FROM f WHERE regexp_matches(text, '^\s*[0-9]{{1,4}}\s*$')) SELECT * FROM x WHERE EXISTS (SELECT 1 FROM x y WHERE y.result_id = x.result_id AND y.page_no = x.page_no - 1 AND y.n = x.n - 1)"


def header_vote(spark: SparkSession, d: str) -> DataFrame:
    return grids.header_rows(grids.pipe_cells(spread(table(spark, d, "pdf_result").select("result_id", "markdown")), "result_id", "markdown"))


CELLS = r"""ln AS (SELECT DISTINCT result_id AS doc, unnest(range(len(string_split(markdown, chr(10))))) AS pos, unnest(string_split(markdown, chr(10))) AS line FROM pdf_result WHERE regexp_matches(markdown, '(?m)^\|.*\|')),
 pl AS (SELECT *, pos - row_number() OVER (PARTITION BY doc ORDER BY pos) AS isle FROM ln WHERE regexp_matches(line, '^\|.*\|[ \t]*$')), fl AS (SELECT *, doc || ':' || dense_rank() OVER (PARTITION BY doc ORDER BY isle) AS grid FROM pl),
 rw AS (SELECT grid, row_number() OVER (PARTITION BY grid ORDER BY pos) - 1 AS row_no, string_split(rtrim(line, ' '), '|') AS parts FROM fl WHERE NOT regexp_matches(line, '^[|: -]*-{3,}[|: -]*$')),
 cl AS (SELECT grid, row_no, unnest(range(greatest(len(parts) - 2, 0))) AS col_no, trim(unnest(parts[2:len(parts) - 1]), ' ') AS text FROM rw)"""
KINDS = f"""kv AS (SELECT grid, col_no, k FROM (SELECT *, {_value_kind_sql('text')} AS k FROM cl WHERE row_no > 0 AND row_no <= 50) WHERE k IS NOT NULL),
 ck AS (SELECT grid, col_no, CASE WHEN count_if(k = 'number') * 10 >= count(*) * 9 THEN 'number' WHEN count_if(k = 'bool') * 10 >= count(*) * 9 THEN 'bool' WHEN count_if(k = 'date') * 10 >= count(*) * 9 THEN 'date' WHEN count_if(k = 'text') * 10 >= count(*) * 9 THEN 'text' END AS kind FROM kv GROUP BY grid, col_no)"""
HEADER_VOTE = f"""WITH {CELLS}, {KINDS}, lb AS (SELECT grid, col_no, text AS label FROM cl WHERE row_no = 0), sm AS (SELECT c.grid, c.col_no, max(CAST(lower(trim(c.text)) = lower(trim(label)) AS INT)) AS same FROM cl c JOIN lb USING (grid, col_no) WHERE row_no > 0 AND row_no <= 50 GROUP BY ALL),
 v AS (SELECT lb.grid, lb.col_no, label, kind, same, {_value_kind_sql('label')} AS lk FROM lb LEFT JOIN ck USING (grid, col_no) LEFT JOIN sm USING (grid, col_no)),
 g AS (SELECT grid, sum(CASE WHEN kind IN ('number', 'bool', 'date') AND lk = 'text' THEN 1 ELSE 0 END) AS header_votes, sum(CASE WHEN kind IN ('number', 'bool', 'date') AND lk <> 'text' THEN 1 WHEN NOT coalesce(kind IN ('number', 'bool', 'date'), false) AND same = 1 THEN 1 ELSE 0 END) AS data_votes,
 max(length(label)) AS longest, max(CAST(label = '' AND col_no > 0 AS INT)) AS blank, count(*) AS width0, count(DISTINCT lower(label)) AS distinct0 FROM v GROUP BY grid),
 md AS (SELECT grid, arg_max(width, struct_pack(n := n, w := width)) AS width FROM (SELECT grid, width, count(*) AS n FROM (SELECT grid, row_no, max(col_no) + 1 AS width FROM cl WHERE row_no <= 50 GROUP BY ALL) GROUP BY ALL) GROUP BY grid), lr AS (SELECT grid, max(row_no) AS last_row FROM cl GROUP BY grid)
 SELECT grid, CAST(header_votes AS BIGINT) AS header_votes, CAST(data_votes AS BIGINT) AS data_votes, CAST(CASE WHEN last_row < 1 OR width0 <> width OR blank = 1 OR distinct0 < width0 THEN 0 WHEN header_votes + data_votes = 0 THEN CAST(longest <= 64 AS INT) ELSE CAST(header_votes > data_votes AS INT) END AS INT) AS header_rows FROM g JOIN md USING (grid) JOIN lr USING (grid)"""


def column_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = grids.pipe_cells(spread(table(spark, d, "pdf_result").select("result_id", "markdown")), "result_id", "markdown")
    return grids.column_kinds(c.where("row_no > 0 AND row_no <= 50"))


COLUMN_KINDS = f"WITH {CELLS}, {KINDS} SELECT grid, CAST(col_no AS INT) AS col_no, kind FROM ck"


def grid_checks(spark: SparkSession, d: str) -> DataFrame:
    return grids.grid_checks(grids.pipe_cells(spread(table(spark, d, "pdf_result").select("result_id", "markdown")), "result_id", "markdown"))


GRID_CHECKS = rf"""WITH {CELLS}, r AS (SELECT grid, row_no, count_if(text <> '') AS filled, max(CASE WHEN col_no = 0 THEN text END) AS first, max(col_no) AS m FROM cl GROUP BY ALL),
 k AS (SELECT grid, avg(CAST(filled <= 2 AS INT)) AS few, avg(CAST(coalesce(first LIKE '%:' OR (regexp_matches(first, '\p{{Lu}}') AND NOT regexp_matches(first, '\p{{Ll}}')), false) AS INT)) AS labels, max(m) AS m FROM r WHERE filled > 0 GROUP BY grid),
 mo AS (SELECT grid, arg_max(filled, struct_pack(n := n, f := filled)) AS mode FROM (SELECT grid, filled, count(*) AS n FROM r GROUP BY ALL) GROUP BY grid), ne AS (SELECT grid, avg(CAST(abs(filled - mode) <= 2 AS INT)) AS near, count(*) AS n_rows FROM r JOIN mo USING (grid) GROUP BY grid),
 pa AS (SELECT grid, count_if(text <> '') AS n, avg(strlen(text)) FILTER (text <> '') AS mean, avg(CAST(strlen(text) > 60 AS INT)) FILTER (text <> '') AS long FROM cl GROUP BY grid)
 SELECT grid, few > 0.7 AND labels > 0.5 AND m < 6 AS key_value, n >= 4 AND ((mean > 40 AND long > 0.2) OR long > 0.3) AS paragraph, n_rows < 3 OR near > 0.4 AS consistent FROM k JOIN ne USING (grid) JOIN pa USING (grid)"""
ONE = "o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, block_no ORDER BY coalesce(text, ''), coalesce(block_kind, ''), coalesce(heading_level, 0), coalesce(marker, ''), coalesce(code_lang, '')) AS rn FROM doc_block) WHERE rn = 1)"


def block_folds(spark: SparkSession, d: str) -> DataFrame:
    return blocks.folds(table(spark, d, "doc_block"))


BLOCK_FOLDS = f"WITH {ONE}, x AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY block_no) - row_number() OVER (PARTITION BY file_id, block_kind ORDER BY block_no) AS isle FROM o) SELECT file_id, block_kind AS kind, min(block_no) AS first_block, max(block_no) AS last_block, count(*) AS n FROM x WHERE block_kind IN ('quote', 'code', 'list') GROUP BY file_id, block_kind, isle"


def list_runs(spark: SparkSession, d: str) -> DataFrame:
    return blocks.list_runs(table(spark, d, "doc_block"))


LIST_RUNS = rf"""WITH {ONE}, e AS (SELECT file_id, block_no, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM o WHERE block_kind = 'list' AND text IS NOT NULL), n AS (SELECT file_id, block_no, pos, try_cast(regexp_extract(line, '^\s*([0-9]{{1,6}})[.)]\s', 1) AS INT) AS num FROM e),
 r AS (SELECT *, CASE WHEN num = lag(num) OVER w + 1 THEN 0 ELSE 1 END AS s FROM n WHERE num IS NOT NULL WINDOW w AS (PARTITION BY file_id, block_no ORDER BY pos)), q AS (SELECT *, sum(s) OVER (PARTITION BY file_id, block_no ORDER BY pos) AS run_no FROM r)
 SELECT file_id, block_no, CAST(run_no AS BIGINT) AS run_no, min(num) AS start, count(*) AS n FROM q GROUP BY file_id, block_no, run_no"""


def file_markdown(spark: SparkSession, d: str) -> DataFrame:
    return blocks.file_markdown(table(spark, d, "doc_block"))


_T = sql_trim("text")
FILE_MARKDOWN = rf"""WITH {ONE}, m AS (SELECT file_id, block_no, CASE WHEN block_kind = 'rule' THEN '---' WHEN coalesce({_T}, '') = '' THEN NULL WHEN block_kind = 'heading' THEN repeat('#', CAST(least(greatest(coalesce(heading_level, 1), 1), 6) AS BIGINT)) || ' ' || regexp_replace({_T}, '[{W}]+', ' ', 'g')
 WHEN block_kind = 'quote' THEN '> ' || replace({_T}, chr(10), chr(10) || '> ') WHEN block_kind = 'code' THEN repeat(chr(96), greatest(coalesce(list_max(list_transform(regexp_extract_all({_T}, '\x60+'), lambda x: length(x))), 0) + 1, 3)) || coalesce(code_lang, '') || chr(10) || {_T} || chr(10) || repeat(chr(96), greatest(coalesce(list_max(list_transform(regexp_extract_all({_T}, '\x60+'), lambda x: length(x))), 0) + 1, 3)) ELSE {_T} END AS md FROM o)
 SELECT file_id, string_agg(md, chr(10) || chr(10) ORDER BY block_no) || chr(10) AS markdown, count(*) AS n_blocks FROM m WHERE md IS NOT NULL GROUP BY file_id"""


def table_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Of the detectors that found a table in a result (pipe rows, tagged tables, separated rows), the first."""
    r = table(spark, d, "pdf_result")
    a = r.where(F.col("markdown").rlike(r"(?m)^\|.*\|[ \t]*$")).select("result_id", F.lit(2).alias("priority"), F.lit("pipes").alias("detector"))
    b = table(spark, d, "struct_element").where("struct_role IN ('Table', 'TR')").select("result_id", F.lit(1).alias("priority"), F.lit("tagged").alias("detector")).distinct()
    c = r.where(F.col("markdown").rlike(r"(?m)^[^;\n]*;[^;\n]*;.*$")).select("result_id", F.lit(3).alias("priority"), F.lit("separated").alias("detector"))
    return blocks.pick_by_priority(a.unionByName(b).unionByName(c), ["result_id"], "priority")


TABLE_CASCADE = r"""WITH c AS (SELECT result_id, 2 AS priority, 'pipes' AS detector FROM pdf_result WHERE regexp_matches(markdown, '(?m)^\|.*\|[ \t]*$') UNION SELECT result_id, 1, 'tagged' FROM struct_element WHERE struct_role IN ('Table', 'TR') UNION SELECT result_id, 3, 'separated' FROM pdf_result WHERE regexp_matches(markdown, '(?m)^[^;\n]*;[^;\n]*;.*$'))
 SELECT result_id, CAST(min(priority) AS INT) AS priority, arg_min(detector, priority) AS detector FROM c GROUP BY result_id"""
OCR_JSON = ['{"pages":[{"text":"one","rec_scores":[0.9,0.7]},{"text":"two","rec_scores":[0.8]}]}', '{"pages":[]}', "not json", '{"pages":[{"text":"x","rec_scores":[]}]}']


def ocr_response(spark: SparkSession, d: str) -> DataFrame:
    """Recognition responses: pages under '## Page n', confidence the mean of all scores; broken JSON gives nulls."""
    x = spark.createDataFrame(list(enumerate(OCR_JSON)), "id int, j string")
    p = F.from_json("j", "pages array<struct<text:string,rec_scores:array<double>>>")["pages"]
    scores = F.flatten(F.transform(p, lambda q: q["rec_scores"]))
    md = F.array_join(F.transform(p, lambda q, i: F.concat(F.lit("## Page "), i + 1, F.lit("\n\n"), q["text"])), "\n\n")
    return x.select("id", md.alias("markdown"), F.round(F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, b: a + b) / F.size(scores)), 6).alias("confidence"))


OCR_RESPONSE = "SELECT * FROM (VALUES (0, '## Page 1' || chr(10) || chr(10) || 'one' || chr(10) || chr(10) || '## Page 2' || chr(10) || chr(10) || 'two', CAST(0.8 AS DOUBLE)), (1, '', NULL), (2, NULL, NULL), (3, '## Page 1' || chr(10) || chr(10) || 'x', NULL)) t(id, markdown, confidence)"


def md_table(spark: SparkSession, d: str) -> DataFrame:
    """Nations of each region as a pipe table."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    row = F.concat(F.lit("| "), "n_nationkey", F.lit(" | "), "n_name", F.lit(" |"))
    g = j.groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda s: s["row"]), "\n").alias("body"))
    return g.select(F.col("r_name").alias("region"), F.concat(F.lit("| key | name |\n| --- | --- |\n"), "body").alias("md"))


MD_TABLE = "SELECT r_name AS region, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"



def region_text(spark: SparkSession, d: str) -> DataFrame:
    it = _items(spark, d)
    return geometry.region_text(it, layout.assign_regions(it, _regions(it)))


REGION_TEXT = REGION_ASSIGN.replace("WITH ", "WITH q AS (WITH ", 1) + ") SELECT q.result_id, q.page_no, region_no, string_agg(coalesce(text, ''), ' ' ORDER BY -round(y), x, q.item_no) AS text FROM q JOIN (SELECT DISTINCT ON (result_id, page_no, item_no) * FROM pdf_item) i ON q.result_id = i.result_id AND q.page_no = i.page_no AND q.item_no = i.item_no GROUP BY ALL"


QUERIES = {
    "region_text": (region_text, REGION_TEXT),
    "font_mode": (font_mode, FONT_MODE),
    "size_rarity": (size_rarity, SIZE_RARITY),
    "text_lines": (text_lines, TEXT_LINES),
    "paragraph_gap": (paragraph_gap, PARAGRAPH_GAP),
    "heading_tiers": (heading_tiers, HEADING_TIERS),
    "running_heads": (running_heads, RUNNING_HEADS),
    "region_assign": (region_assign, REGION_ASSIGN),
    "unclaimed_items": (unclaimed_items, UNCLAIMED),
    "item_roles": (item_roles, ITEM_ROLES),
    "item_joins": (item_joins, ITEM_JOINS),
    "structure_paths": (structure_paths, STRUCTURE_PATHS),
    "detect_class": (detect_class, DETECT_CLASS),
    "ocr_pages": (ocr_pages, OCR_PAGES),
    "sample_pages": (sample_pages, SAMPLE_PAGES),
    "continued_tables": (continued_tables, CONTINUED),
    "adjacent_folios": (adjacent_folios, FOLIOS),
    "header_vote": (header_vote, HEADER_VOTE),
    "column_kinds": (column_kinds, COLUMN_KINDS),
    "grid_checks": (grid_checks, GRID_CHECKS),
    "block_folds": (block_folds, BLOCK_FOLDS),
    "list_runs": (list_runs, LIST_RUNS),
    "file_markdown": (file_markdown, FILE_MARKDOWN),
    "table_cascade": (table_cascade, TABLE_CASCADE),
    "ocr_response": (ocr_response, OCR_RESPONSE),
    "md_table": (md_table, MD_TABLE),
}
