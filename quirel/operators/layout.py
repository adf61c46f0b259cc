"""Relational steps over positioned text items: fonts, lines, headings, running headers, regions, claims.

Items are rows of (doc, page, item) with coordinates from the lower left; repeated item rows are taken once. Grouping is
always by document and page, so a large document spreads over tasks by its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirel.functions import text as T


def items(df: DataFrame) -> DataFrame:
    """The items, repeated rows dropped."""
    return df.dropDuplicates(["result_id", "page_no", "item_no"])


def font_mode(df: DataFrame) -> DataFrame:
    """(result_id, base_size, n_sizes): most frequent font size of 9 and more, by tenths; ties to the smaller; 12 if none."""
    k = F.floor(F.col("font_size") * 10).cast("int")
    g = df.where("font_size >= 9").groupBy("result_id", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    mode = g.groupBy("result_id").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("k"), F.count(F.lit(1)).alias("n_sizes"))
    return df.select("result_id").distinct().join(mode, "result_id", "left").select("result_id", F.coalesce(F.col("k") / 10, F.lit(12.0)).alias("base_size"), F.coalesce("n_sizes", F.lit(0)).alias("n_sizes"))


def size_rarity(df: DataFrame) -> DataFrame:
    """(result_id, size_tenths, n, rarity): one less the size's share of the document's items."""
    k = F.floor(F.col("font_size") * 10).cast("int")
    g = df.groupBy("result_id", k.alias("size_tenths")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rarity", F.round(1 - F.col("n") / F.sum("n").over(Window.partitionBy("result_id")), 6))


def lines(df: DataFrame) -> DataFrame:
    """Items of one page at one height (to a point) as a line: (result_id, page_no, y10, text, font_size, bold_share, n_items)."""
    y10 = F.round(F.col("y").cast("double")).cast("int")
    t = F.coalesce(F.col("text"), F.lit(""))
    n = F.char_length(T.trim_ws(t))
    return df.groupBy("result_id", "page_no", y10.alias("line_y")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "item_no", t.alias("t")))), lambda s: s["t"]), " ").alias("text"),
        F.min_by("font_size", F.struct("x", "item_no")).alias("font_size"),
        F.sum(F.when(F.col("is_bold"), n).otherwise(0)).alias("bold_chars"),
        F.sum(n).alias("chars"),
        F.count(F.lit(1)).alias("n_items"),
    )


def paragraph_gap(ln: DataFrame) -> DataFrame:
    """(result_id, n_gaps, threshold): gap above which a new paragraph starts.

    Gaps of consecutive lines of a page within ten times the base size; fewer than five give 1.8 times the base size, else
    the larger of 1.3 times the upper median and 1.5 times the base size.
    """
    base = ln.groupBy("result_id").agg(F.coalesce(F.max_by(F.lit(1), F.lit(1)), F.lit(1)).alias("one"))
    size = ln.where("font_size >= 9").groupBy("result_id", F.floor(F.col("font_size") * 10).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("result_id").agg((F.max_by("k", F.struct("n", -F.col("k"))) / 10).alias("b"))
    base = base.join(size, "result_id", "left").select("result_id", F.coalesce("b", F.lit(12.0)).alias("base"))
    w = Window.partitionBy("result_id", "page_no").orderBy(F.desc("line_y"))
    g = ln.withColumn("gap", F.lag("line_y").over(w) - F.col("line_y")).join(base, "result_id")
    good = F.when((F.col("gap") > 0) & (F.col("gap") < 10 * F.col("base")), F.col("gap"))
    r = g.groupBy("result_id").agg(F.count(good).alias("n_gaps"), F.array_sort(F.collect_list(good)).alias("gaps"), F.first("base").alias("base"))
    mid = F.element_at("gaps", (F.floor(F.col("n_gaps") / 2) + 1).cast("int"))
    return r.select("result_id", "n_gaps", F.round(F.when(F.col("n_gaps") < 5, 1.8 * F.col("base")).otherwise(F.greatest(1.3 * mid, 1.5 * F.col("base"))), 6).alias("threshold"))


def heading_tiers(ln: DataFrame) -> DataFrame:
    """(result_id, tiers): at most four heading sizes, descending; sizes of 1.2 times the base size and more, merged within half a point."""
    base = ln.where("font_size >= 9").groupBy("result_id", F.floor(F.col("font_size") * 10).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("result_id").agg((F.max_by("k", F.struct("n", -F.col("k"))) / 10).alias("base"))
    big = ln.join(base, "result_id").where((F.col("font_size") >= 1.2 * F.col("base")) & F.col("text").rlike(r"\p{L}"))
    sizes = big.groupBy("result_id").agg(F.sort_array(F.collect_set(F.round(F.col("font_size").cast("double"), 2)), asc=False).alias("s"))
    merged = F.aggregate("s", F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1) - x > 0.5), F.concat(acc, F.array(x))).otherwise(acc))
    return sizes.select("result_id", F.slice(merged, 1, 4).alias("tiers"))


def repeated_lines(ln: DataFrame, key: str, page: str, pos: str, text: str) -> DataFrame:
    """Running headers and footers: (key, norm, n_pages, first_page) of lines repeated at the edges of pages.

    A line's text without surrounding digits, ten bytes long at least, on at least max(3, 30 %) of the pages, among the
    first or last five places of a page, at places whose spread is under 5 % of the mean page span. Documents of fewer
    than three pages have none.
    """
    norm = F.regexp_replace(T.trim_ws(T.collapse_ws(F.col(text))), r"^[0-9]+|[0-9]+$", "")
    x = ln.select(key, page, pos, T.trim_ws(norm).alias("norm"))
    w = Window.partitionBy(key, page)
    x = x.withColumn("up", F.dense_rank().over(w.orderBy(pos))).withColumn("down", F.dense_rank().over(w.orderBy(F.desc(pos))))
    pages = ln.groupBy(key, page).agg((F.max(pos) - F.min(pos)).alias("span")).groupBy(key).agg(F.count(F.lit(1)).alias("n_all"), F.avg("span").alias("span"))
    edge = x.where("(up <= 5 OR down <= 5) AND octet_length(norm) >= 10").where(~T.is_structural(F.col("norm")))
    g = edge.groupBy(key, "norm").agg(F.countDistinct(page).alias("n_pages"), F.stddev_pop(pos).alias("sd"), F.min(page).alias("first_page"))
    ok = g.join(pages, key).where((F.col("n_all") >= 3) & (F.col("n_pages") >= F.greatest(F.lit(3), F.floor(F.col("n_all") * 30 / 100))) & (F.col("sd") < 0.05 * F.greatest("span", F.lit(1.0))))
    return ok.select(key, "norm", "n_pages", "first_page")


def overlap_area(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), zero) * F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), zero)


#: Side of the squares by which items meet regions that hold for every page.
SQUARE = 100.0


def assign_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Each item to the one region of its page that it overlaps most; ties to the first region, no overlap no region.

    regions(region_no, rx1, ry1, rx2, ry2) with the columns that say which pages they are of (result_id, page_no or both): joined by
    these. Without any they hold for every page; then items and regions meet in the squares of a grid that both cover.
    """
    on = [c for c in ("result_id", "page_no") if c in regions.columns]
    x1, y1 = F.col("x").cast("double"), F.col("y").cast("double")
    x2, y2 = x1 + F.col("width").cast("double"), y1 + F.col("height").cast("double")
    if not on:

        def squares(a: Column, b: Column) -> Column:
            lo = F.floor(a / SQUARE)
            return F.sequence(lo, F.greatest(lo, F.floor(b / SQUARE)))

        df = df.where(x2.isNotNull() & y2.isNotNull()).withColumn("__sx", F.explode(squares(x1, x2))).withColumn("__sy", F.explode(squares(y1, y2)))
        regions = regions.withColumn("__sx", F.explode(squares(F.col("rx1"), F.col("rx2")))).withColumn("__sy", F.explode(squares(F.col("ry1"), F.col("ry2"))))
        on = ["__sx", "__sy"]
    area = overlap_area(x1, y1, x2, y2, F.col("rx1"), F.col("ry1"), F.col("rx2"), F.col("ry2"))
    j = df.join(regions.select(*on, "region_no", "rx1", "ry1", "rx2", "ry2"), on).withColumn("area", area).where("area > 0")
    return j.groupBy("result_id", "page_no", "item_no").agg(F.max_by("region_no", F.struct("area", -F.col("region_no"))).alias("region_no"), F.round(F.max("area"), 2).alias("area"))


def content_types(parts: DataFrame, own: DataFrame, defaults: DataFrame) -> DataFrame:
    """(file_name, content_type) of parts(file_name, ext): the own type of the name, whatever its case, else the extension's default, else null.

    own(part in lower case, own_type) and defaults(ext, default_type) have one row a key; null names and extensions match none.
    """
    j = parts.join(own.withColumnRenamed("part", "__p"), F.lower("file_name") == F.col("__p"), "left").join(defaults, "ext", "left")
    return j.select("file_name", F.coalesce("own_type", "default_type").alias("content_type"))


def unclaimed(df: DataFrame, claimed: DataFrame) -> DataFrame:
    return df.join(claimed, ["result_id", "page_no", "item_no"], "left_anti")


def item_roles(df: DataFrame, elems: DataFrame) -> DataFrame:
    """Items with the structure role of their marked content: by document, page and content id; null if there is none."""
    e = elems.where("mcid IS NOT NULL").groupBy("result_id", "page_no", "mcid").agg(F.min_by("struct_role", "elem_id").alias("role"))
    return df.join(e, ["result_id", "page_no", "mcid"], "left").select("result_id", "page_no", "item_no", "mcid", "role", T.heading_level(F.col("role")).alias("level"))


def item_joins(df: DataFrame) -> DataFrame:
    """Whether an item and the next of its page are joined without a space: never across lines, else by the gap in ems."""
    w = Window.partitionBy("result_id", "page_no").orderBy("item_no")
    size = F.greatest(F.col("font_size").cast("double"), F.lit(1.0))
    width = F.when(F.col("width") > 0, F.col("width").cast("double")).otherwise(F.char_length("text") * 0.5 * size)
    nxt, gap = F.lead("text").over(w), (F.lead("x").over(w).cast("double") - F.col("x").cast("double") - width) / size
    t = F.col("text")
    low = t.rlike(r"\p{Ll}$") & nxt.rlike(r"^\p{Ll}")
    digits = t.rlike("[0-9]$") & nxt.rlike("^[0-9]")
    single = (F.char_length(t) == 1) | (F.char_length(nxt) == 1)
    limit = F.when(digits, 0.30).when(single, 0.20).when(low, 0.18).otherwise(0.15)
    below = F.abs(F.lead("y").over(w).cast("double") - F.col("y").cast("double")) > 0.5 * size
    joined = F.when(below | t.rlike(r"\s$") | nxt.rlike(r"^\s"), False).when(nxt.rlike(r"^[.,;!?)\]}']"), True).when((gap > 3) | (gap < -1), False).otherwise(gap < limit)
    return df.select("result_id", "page_no", "item_no", nxt.alias("next_text"), F.round(gap, 3).alias("gap"), joined.alias("joined")).where("next_text IS NOT NULL")


def structure_paths(elems: DataFrame, root: str = "Document") -> DataFrame:
    """(elem_id, depth, path) of each structure element below a root, however deep; elements of cycles or of missing parents have none.

    Pointer jumping: each round every element takes over its ancestor's ancestor, so the rounds grow with the logarithm of the depth; a
    round's rows are written out and the round before deleted. Ids alone are followed first, so that only rows that reach a root carry paths.
    """
    from quirel.session import cut, discard

    e = cut(elems.select("elem_id", "parent_id", "struct_role").where("elem_id IS NOT NULL").dropDuplicates(["elem_id"]), "elements")
    rounds = max(1, e.count()).bit_length() + 1

    def jump(rows: DataFrame, paths: bool) -> DataFrame:
        for _ in range(rounds):
            todo = rows.where("up IS NOT NULL")
            if not todo.limit(1).count():
                break
            above = rows.select(F.col("elem_id").alias("up"), F.col("up").alias("up2"), *([F.col("depth").alias("d2"), F.col("path").alias("p2")] if paths else []))
            moved = todo.join(above, "up").select("elem_id", F.col("up2").alias("up"), *([(F.col("depth") + F.col("d2") + 1).alias("depth"), F.concat_ws("/", "p2", "path").alias("path")] if paths else []))
            new = cut(rows.where("up IS NULL").unionByName(moved), "paths")
            discard(rows)
            rows = new
        return rows

    free = jump(cut(e.select("elem_id", F.col("parent_id").alias("up")), "paths"), False).where("up IS NULL").select("elem_id")
    start = e.join(free, "elem_id").select("elem_id", F.col("parent_id").alias("up"), F.lit(0).alias("depth"), F.coalesce("struct_role", F.lit("")).alias("path"))
    return jump(cut(start, "paths"), True).select("elem_id", "depth", "path")


def page_text(pages: DataFrame) -> Column:
    """Whether a page counts as text."""
    return (
        (F.col("text_operator_count") >= F.when(F.col("has_images"), 10).otherwise(3))
        & ~((F.col("image_count") > 10) & (F.col("image_count") > 3 * F.col("text_operator_count")))
        & (F.col("unique_text_chars") >= 5)
        & ~F.col("has_vector_text")
        & ~F.col("has_only_type3_fonts")
    )


def detect_class(pages: DataFrame) -> DataFrame:
    """(result_id, pdf_class, confidence, text_pages, pages): document class from its pages' signals."""
    p = pages.dropDuplicates(["result_id", "page_no"]).withColumn("is_text", page_text(pages))
    c = lambda x: F.sum(F.when(x, 1).otherwise(0))
    g = p.groupBy("result_id").agg(F.count(F.lit(1)).alias("pages"), c(F.col("is_text")).alias("text_pages"), c(F.col("has_template_image")).alias("template"), c(F.col("has_images") & ~F.col("is_text")).alias("image"), c(F.col("has_vector_text")).alias("vector"), F.sum("text_operator_count").alias("ops"))
    ratio, other = F.col("text_pages") / F.col("pages"), (F.col("image") + F.col("vector")) > 0
    kind = (
        F.when((F.col("template") > 0) & (F.col("text_pages") > 0), "Mixed")
        .when(ratio >= 0.6, "TextBased")
        .when((F.col("text_pages") == 0) & other, F.when((F.col("ops") == 0) & (F.col("vector") == 0), "Scanned").otherwise("ImageBased"))
        .when((F.col("text_pages") > 0) & other, "Mixed")
        .when(F.col("ops") == 0, "Scanned")
        .otherwise("TextBased")
    )
    conf = (
        F.when((F.col("template") > 0) & (F.col("text_pages") > 0), 0.5 + 0.3 * (1 - F.col("template") / F.col("pages")))
        .when(ratio >= 0.6, ratio)
        .when((F.col("text_pages") == 0) & other, F.when((F.col("ops") == 0) & (F.col("vector") == 0), 0.95).otherwise(0.8))
        .when((F.col("text_pages") > 0) & other, 0.7)
        .when(F.col("ops") == 0, 0.9)
        .otherwise(F.greatest(ratio, F.lit(0.5)))
    )
    return g.select("result_id", kind.alias("pdf_class"), F.round(conf, 6).alias("confidence"), "text_pages", "pages")


def ocr_reasons(pages: DataFrame) -> DataFrame:
    """(result_id, page_no, reasons): why a page needs recognition; pages without a reason are left out."""
    p = pages.dropDuplicates(["result_id", "page_no"])
    font = (F.col("has_identity_h_no_tounicode") & ~F.col("has_decodable_text_fonts")) | F.col("has_only_type3_fonts")
    usable = (F.col("text_operator_count") > 0) & (F.col("unique_text_chars") >= 5)
    none = ~font & ~F.col("has_vector_text")
    r = F.array_compact(F.array(F.when(font, F.lit("suspected_garbled_text")), F.when(F.col("has_vector_text"), F.lit("vector_text")), F.when(none & ~usable & ~F.col("has_images"), F.lit("no_text")), F.when(none & ~page_text(pages) & F.col("has_images"), F.lit("scanned"))))
    return p.select("result_id", "page_no", r.alias("reasons")).where(F.size("reasons") > 0)


def sample_pages(docs: DataFrame, n: int = 8) -> DataFrame:
    """(result_id, page_no): first, last and evenly spaced pages, n at most; all pages of shorter documents."""
    p = F.col("page_count")
    every = F.sequence(F.lit(1), p)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.floor(i * (p - 1) / (n - 1)) + 1).cast("int")))
    return docs.where("page_count >= 1").select("result_id", F.explode(F.when(p <= n, every).otherwise(spread)).alias("page_no"))


def continued_tables(rows: DataFrame) -> DataFrame:
    """Runs of tables on consecutive pages with equal column counts: (result_id, run_no, first_page, last_page, n_cols).

    rows(result_id, page_no, n_tables, n_cols): a page joins the run of the page before it if both hold exactly one table
    of as many columns.
    """
    w = Window.partitionBy("result_id").orderBy("page_no")
    prev = (F.lag("page_no").over(w) == F.col("page_no") - 1) & (F.lag("n_cols").over(w) == F.col("n_cols")) & (F.lag("n_tables").over(w) == 1) & (F.col("n_tables") == 1)
    x = rows.withColumn("run_no", F.sum(F.when(F.coalesce(prev, F.lit(False)), 0).otherwise(1)).over(w))
    return x.groupBy("result_id", "run_no").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.first("n_cols").alias("n_cols"))
