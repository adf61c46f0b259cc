"""Steps over text lines and strokes: isolated lines, heading levels, layout complexity, underlines, merged strokes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirel.functions import text as T


def header_level(size: Column, base: Column, tiers: Column, bold: Column) -> Column:
    """Heading level by size: a tier within half a point gives its number; a large size without one the next; bold body none."""
    ratio = size / base
    n = F.size(tiers)
    at = F.array_position(F.transform(tiers, lambda t: F.abs(t - size) <= 0.5), F.lit(True)).cast("int")
    plain = F.when(ratio >= 2.0, 1).when(ratio >= 1.5, 2).when(ratio >= 1.25, 3).otherwise(4)
    tiered = F.when(at > 0, at).when(ratio >= 1.5, F.least(n + 1, F.lit(4)))
    return F.when(ratio >= 1.2, F.when(n > 0, tiered).otherwise(plain)).when((ratio >= 1.05) & bold & (at > 0), at)


def isolated_lines(ln: DataFrame, base: float = 12.0) -> DataFrame:
    """(result_id, page_no, line_y): short lines with a paragraph break on both sides.

    One to six words, more than three bytes, at least 0.95 of the base size, no list item or caption, not ending as if it
    went on. A page of ten lines and more of which over a quarter are isolated has none.
    """
    w = Window.partitionBy("result_id", "page_no").orderBy(F.desc("line_y"))
    t = T.trim_ws(F.col("text"))
    gap = 1.5 * base
    before, after = F.lag("line_y").over(w) - F.col("line_y"), F.col("line_y") - F.lead("line_y").over(w)
    apart = (before.isNull() | (before > gap)) & (after.isNull() | (after > gap))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    ok = words.between(1, 6) & (F.octet_length(t) > 3) & (F.col("font_size") >= 0.95 * base) & ~T.is_list_item(t) & ~T.is_caption(t) & ~t.rlike(r"[,;:\-]$")
    x = ln.withColumn("iso", apart & ok)
    p = Window.partitionBy("result_id", "page_no")
    x = x.withColumn("n", F.count(F.lit(1)).over(p)).withColumn("k", F.sum(F.col("iso").cast("int")).over(p))
    return x.where("iso AND NOT (n >= 10 AND k > 0.25 * n)").select("result_id", "page_no", "line_y")


def overused_levels(elems: DataFrame) -> DataFrame:
    """(result_id, struct_role, n, share): heading roles on over 15 % of at least 20 role-tagged elements; not to be trusted."""
    e = elems.where("struct_role IS NOT NULL AND mcid IS NOT NULL")
    g = e.groupBy("result_id", "struct_role").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("result_id")))
    return g.where("struct_role RLIKE '^H[1-6]?$' AND all >= 20 AND n > 0.15 * all").select("result_id", "struct_role", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def merge_strokes(strokes: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Horizontal strokes (result_id, page_no, y10, x1, x2) that touch, as rules: gaps and islands over the running right end."""
    w = Window.partitionBy("result_id", "page_no", "y10").orderBy("x1", "x2")
    reach = F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = strokes.withColumn("isle", F.sum(F.when(F.col("x1") <= reach + tolerance, 0).otherwise(1)).over(w))
    g = x.groupBy("result_id", "page_no", "y10", "isle").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.count(F.lit(1)).alias("n"))
    return g.drop("isle")


def underlined(items: DataFrame, rules: DataFrame, share: float = 0.6) -> DataFrame:
    """Items with a rule just below them over at least that share of their width: (result_id, page_no, item_no).

    Rules join by page and by height in steps of ten points (each item looks in two steps), not by every pair of a page.
    """
    step = lambda c: F.floor(c / 10)
    i = items.where("width > 0").select("result_id", "page_no", "item_no", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("width").cast("double").alias("w"), F.col("font_size").cast("double").alias("s"))
    i = i.withColumn("h", F.explode(F.array_distinct(F.array(step(F.col("y")), step(F.col("y") - 0.35 * F.col("s"))))))
    r = rules.select("result_id", "page_no", F.col("ry"), "x1", "x2", step(F.col("ry")).alias("h"))
    j = i.join(r, ["result_id", "page_no", "h"]).where("ry <= y AND ry >= y - 0.35 * s")
    cover = F.least(F.col("x") + F.col("w"), F.col("x2")) - F.greatest("x", "x1")
    return j.where(cover >= share * F.col("w")).select("result_id", "page_no", "item_no").distinct()


def layout_complexity(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(result_id, table_pages, column_pages, is_complex): pages with a table, pages of two columns and more."""
    t = cells.groupBy("result_id").agg(F.array_sort(F.collect_set("page_no")).alias("table_pages"))
    c = columns.where("col_no = 2").groupBy("result_id").agg(F.array_sort(F.collect_set("page_no")).alias("column_pages"))
    e = F.array().cast("array<int>")
    return t.join(c, "result_id", "full").select("result_id", F.coalesce("table_pages", e).alias("table_pages"), F.coalesce("column_pages", e).alias("column_pages"), F.lit(True).alias("is_complex"))


def signature(data: Column) -> Column:
    """Format of bytes by their first ones; null if they don't tell."""
    h = F.hex(F.substring(data, 1, 8))
    head = F.decode(F.substring(data, 1, 1024), "ISO-8859-1")
    return F.when(h.startswith("7B5C727466"), "rtf").when(h == "D0CF11E0A1B11AE1", "ole").when(h.startswith("504B0304"), "zip").when(head.contains("%PDF-"), "pdf").when(h.startswith("89504E47"), "png").when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("47494638"), "gif")


def pdf_page_estimate(data: Column) -> Column:
    """Pages of a PDF by its page objects, without reading it."""
    return F.regexp_count(F.decode(data, "ISO-8859-1"), F.lit(r"/Type\s*/Page(?![A-Za-z])"))


def text_to_markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """Plain text as Markdown blocks: lists keep their lines, code-like lines are fenced, the rest joins to paragraphs.

    A block is a run of lines of one kind; a blank line ends a paragraph. Null and blank texts give no row.
    """
    x = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    t = T.trim_ws(F.col("line"))
    kind = F.when(t == "", "blank").when(T.is_list_item(t), "list").when(T.is_code_like(t), "code").otherwise("para")
    x = x.withColumn("kind", kind).withColumn("t", t)
    w = Window.partitionBy("k").orderBy("pos")
    x = x.withColumn("isle", F.sum(F.when(F.col("kind") == F.lag("kind").over(w), 0).otherwise(1)).over(w)).where("kind <> 'blank'")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line", "t"))), lambda s: F.struct(s["line"].alias("line"), s["t"].alias("t")))
    g = x.groupBy("k", "isle", "kind").agg(lines.alias("ls"))
    marks = F.array_join(F.transform("ls", lambda s: F.regexp_replace(s["t"], "^[•○●◦*] ", "- ")), "\n")
    body = F.when(F.col("kind") == "list", marks).when(F.col("kind") == "code", F.concat(F.lit("```\n"), F.array_join(F.transform("ls", lambda s: s["line"]), "\n"), F.lit("\n```"))).otherwise(F.array_join(F.transform("ls", lambda s: s["t"]), " "))
    g = g.select("k", "isle", body.alias("md"))
    return g.groupBy("k").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("isle", "md"))), lambda s: s["md"]), "\n\n"), F.lit("\n")).alias("markdown")).withColumnRenamed("k", key)
