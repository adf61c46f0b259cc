"""Queries of the readers: files are made from the test tables, read again, and compared by SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirel.operators import blocks as B
from quirel.operators import layout
from quirel.sources import convert as C
from quirel.session import table


def _csv_files(spark: SparkSession, d: str) -> DataFrame:
    """One delimited file for each nation's customers; the delimiter and the encoding change with the nation."""
    c = table(spark, d, "customer")
    sep = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t"), F.lit("|")), F.col("c_nationkey") % 4 + 1)
    q = F.concat(F.lit('"'), F.col("c_name"), sep, F.lit('""x"""'))
    row = F.concat_ws("\u0001", F.col("c_custkey").cast("string"), q, F.col("c_mktsegment"))
    g = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))), lambda s: s["row"]), "\n").alias("body"))
    text = F.replace(F.concat(F.lit("key\u0001name\u0001segment\n"), "body", F.lit("\n")), F.lit("\u0001"), sep)
    return g.select(F.col("c_nationkey").alias("doc_id"), F.concat(F.lit("n"), "c_nationkey", F.lit(".csv")).alias("file_name"), F.when(F.col("c_nationkey") % 3 == 0, F.encode(text, "UTF-16")).otherwise(F.encode(text, "UTF-8")).alias("data"))


def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    x = C.cells(_csv_files(spark, d))
    return x.groupBy("doc_id").agg((F.max("row_no") + 1).alias("n_rows"), (F.max("col_no") + 1).alias("n_cols"), F.max(F.col("is_header").cast("int")).alias("header"), F.max(F.when((F.col("col_no") == 1) & (F.col("row_no") > 0), F.col("text"))).alias("last_name"))


CSV_CELLS = """SELECT c_nationkey AS doc_id, CAST(count(*) + 1 AS INT) AS n_rows, 3 AS n_cols, 1 AS header, max(c_name || ([',', ';', chr(9), '|'])[c_nationkey % 4 + 1] || '"x"') AS last_name FROM customer GROUP BY c_nationkey"""


def _html(kind: str, level: F.Column, text: F.Column) -> F.Column:
    t = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    k = F.col(kind)
    tag = lambda n: F.concat(F.lit(f"<{n}>"), t, F.lit(f"</{n}>"))
    lv = F.least(F.greatest(F.coalesce(level, F.lit(1)), F.lit(1)), F.lit(6)).cast("string")
    li = F.concat(F.lit("<ul><li>"), F.replace(t, F.lit("\n"), F.lit("<li>")), F.lit("</ul>"))
    return F.when(k == "rule", F.lit("<hr>")).when(k == "heading", F.concat(F.lit("<h"), lv, F.lit(">"), t, F.lit("</h"), lv, F.lit(">"))).when(k == "quote", tag("blockquote")).when(k == "code", tag("pre")).when(k == "list", li).otherwise(tag("p"))


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each file's blocks written as HTML and read again: how many blocks of each kind come back."""
    b = B.one_each(table(spark, d, "doc_block")).where("block_kind = 'rule' OR trim(translate(text, '\n\t', '  ')) <> ''")
    x = b.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", _html("block_kind", F.col("heading_level"), F.coalesce("text", F.lit(""))).alias("h")))), lambda s: s["h"]), "\n").alias("h"))
    files = x.select(F.col("file_id").alias("doc_id"), F.lit("a.html").alias("file_name"), F.encode("h", "UTF-8").alias("data"))
    return C.blocks(files).where("parent_no IS NULL").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


HTML_BLOCKS = r"""WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, block_no ORDER BY coalesce(text, ''), coalesce(block_kind, ''), coalesce(heading_level, 0), coalesce(marker, ''), coalesce(code_lang, '')) AS rn FROM doc_block) WHERE rn = 1)
 SELECT file_id AS doc_id, CASE WHEN block_kind IN ('rule', 'heading', 'quote', 'code', 'list') THEN block_kind ELSE 'paragraph' END AS kind, count(*) AS n FROM o WHERE block_kind = 'rule' OR trim(translate(text, chr(10) || chr(9), '  '), ' ') <> '' GROUP BY ALL"""


def html_convert(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "doc_block").where("text <> ''").select("file_id", "block_no", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("h")).distinct()
    x = b.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "h"))), lambda s: s["h"]), "\n").alias("h"))
    return C.convert(x.select(F.col("file_id").alias("doc_id"), F.lit("a.html").alias("file_name"), F.encode("h", "UTF-8").alias("data"))).select("doc_id", "category", "n_blocks", "markdown", "error_code")


def make_pdf(pages: list[list[tuple[str, float, float, float]]]) -> bytes:
    """A plain PDF with positioned text (text, x, y, size) on each page, in one WinAnsi font."""
    objs = ["<</Type/Catalog/Pages 2 0 R>>", "<</Type/Pages/Kids[" + " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages))) + f"]/Count {len(pages)}>>", "<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    out = [b"%PDF-1.4\n"]
    for i, items in enumerate(pages):
        body = b"BT\n" + b"".join(f"/F1 {s:.2f} Tf 1 0 0 1 {x:.2f} {y:.2f} Tm (".encode() + t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b") Tj\n" for t, x, y, s in items) + b"ET"
        objs.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Contents {5 + 2 * i} 0 R/Resources<</Font<</F1 3 0 R>>>>>>")
        objs.append((body, len(body)))
    for n, o in enumerate(objs, 1):
        out.append(f"{n} 0 obj\n".encode() + (f"<</Length {o[1]}>>stream\n".encode() + o[0] + b"\nendstream" if isinstance(o, tuple) else o.encode()) + b"\nendobj\n")
    return b"".join(out) + b"trailer<</Root 1 0 R>>\n%%EOF"


def _pdf_files(spark: SparkSession, d: str) -> DataFrame:
    it = layout.items(table(spark, d, "pdf_item")).where("text IS NOT NULL")
    g = it.groupBy("result_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("item_no", "text", "x", "y", "font_size"))).alias("items")).groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "items"))).alias("pages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [make_pdf([[(i["text"], i["x"], i["y"], i["font_size"]) for i in p["items"]] for p in ps]) for ps in pdf["pages"]]
            yield pd.DataFrame({"doc_id": pdf["result_id"], "file_name": "a.pdf", "data": data})

    return g.mapInPandas(run, "doc_id long, file_name string, data binary")


def pdf_read_items(spark: SparkSession, d: str) -> DataFrame:
    """Text items written as PDF files and read again: items and characters of each page."""
    x = C.pdf_items(_pdf_files(spark, d))
    return x.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


PDF_READ_ITEMS = """WITH i AS (SELECT DISTINCT ON (result_id, page_no, item_no) * FROM pdf_item), p AS (SELECT result_id AS doc_id, dense_rank() OVER (PARTITION BY result_id ORDER BY page_no) AS page_no, text FROM i WHERE text IS NOT NULL)
 SELECT doc_id, CAST(page_no AS INT) AS page_no, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM p WHERE trim(text, ' ') <> '' GROUP BY ALL"""


def pdf_convert(spark: SparkSession, d: str) -> DataFrame:
    return C.convert(_pdf_files(spark, d)).select("doc_id", "category", "n_blocks", "markdown", "error_code")


QUERIES = {
    "csv_cells": (csv_cells, CSV_CELLS),
    "html_blocks": (html_blocks, HTML_BLOCKS),
    "html_convert": (html_convert, None),
    "pdf_read_items": (pdf_read_items, PDF_READ_ITEMS),
    "pdf_convert": (pdf_convert, None),
}
