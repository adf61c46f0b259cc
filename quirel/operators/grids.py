"""Grids of text cells: kinds of columns, the vote for a header row, and the checks that tell tables from other layouts.

A grid is rows of (grid, row_no, col_no, text), row_no and col_no from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirel.functions import text as T

#: Body rows that vote.
SAMPLE_ROWS = 50


def modal_width(cells: DataFrame) -> DataFrame:
    """(grid, width): most frequent row width, ties to the wider."""
    w = cells.groupBy("grid", "row_no").agg(F.max("col_no").alias("m")).groupBy("grid", (F.col("m") + 1).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("grid").agg(F.max_by("width", F.struct("n", "width")).alias("width"))


def column_kinds(cells: DataFrame) -> DataFrame:
    """(grid, col_no, kind): first of number, bool, date, text that nine tenths of the values are; null if none is."""
    v = cells.withColumn("k", T.value_kind(F.col("text"))).where("k IS NOT NULL")
    g = v.groupBy("grid", "col_no").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("k") == k, 1)).alias(k) for k in ("number", "bool", "date", "text")])
    kind = F.coalesce(*[F.when(F.col(k) * 10 >= F.col("n") * 9, F.lit(k)) for k in ("number", "bool", "date", "text")])
    return g.select("grid", "col_no", kind.alias("kind"))


def header_rows(cells: DataFrame) -> DataFrame:
    """(grid, header_votes, data_votes, header_rows): whether the first row is a header.

    Vetoes: fewer than two rows, a first row of another width than the usual one, a blank label past column 0, a label with
    a line break, labels equal without case. Then each column votes: a kind other than text in the body speaks for a header
    if the label is text, else against; a text column speaks against if it repeats the label. Without votes it is a header
    if no label is over 64 characters.
    """
    body = cells.where((F.col("row_no") > 0) & (F.col("row_no") <= SAMPLE_ROWS))
    label = cells.where("row_no = 0").select("grid", "col_no", F.col("text").alias("label"))
    fold = lambda c: F.lower(T.trim_ws(c))
    kinds = column_kinds(body)
    same = body.join(label, ["grid", "col_no"]).groupBy("grid", "col_no").agg(F.max((fold(F.col("text")) == fold(F.col("label"))).cast("int")).alias("same"))
    v = label.join(kinds, ["grid", "col_no"], "left").join(same, ["grid", "col_no"], "left")
    lk = T.value_kind(F.col("label"))
    other = F.col("kind").isin("number", "bool", "date")
    pro = F.when(other & (lk == "text"), 1).otherwise(0)
    con = F.when(other & (lk != "text"), 1).when(~F.coalesce(other, F.lit(False)) & (F.col("same") == 1), 1).otherwise(0)
    g = v.groupBy("grid").agg(
        F.sum(pro).alias("header_votes"),
        F.sum(con).alias("data_votes"),
        F.max(F.char_length(F.coalesce("label", F.lit("")))).alias("longest"),
        F.max(((fold(F.coalesce(F.col("label"), F.lit(""))) == "") & (F.col("col_no") > 0)).cast("int")).alias("blank"),
        F.max(F.coalesce(F.col("label").contains("\n"), F.lit(False)).cast("int")).alias("broken"),
        F.count(F.lit(1)).alias("width0"),
        F.countDistinct(fold(F.coalesce(F.col("label"), F.lit("")))).alias("distinct0"),
    )
    rows = cells.groupBy("grid").agg(F.max("row_no").alias("last_row"))
    g = g.join(modal_width(cells.where(F.col("row_no") <= SAMPLE_ROWS)), "grid").join(rows, "grid")
    veto = (F.col("last_row") < 1) | (F.col("width0") != F.col("width")) | (F.col("blank") == 1) | (F.col("broken") == 1) | (F.col("distinct0") < F.col("width0"))
    head = F.when(veto, 0).when(F.col("header_votes") + F.col("data_votes") == 0, (F.col("longest") <= 64).cast("int")).otherwise((F.col("header_votes") > F.col("data_votes")).cast("int"))
    return g.select("grid", "header_votes", "data_votes", head.alias("header_rows"))


def grid_checks(cells: DataFrame) -> DataFrame:
    """(grid, key_value, paragraph, consistent): a layout of keys and values, of paragraphs, of even columns."""
    t = F.coalesce(T.trim_ws(F.col("text")), F.lit(""))
    c = cells.select("grid", "row_no", "col_no", t.alias("t"))
    rows = c.groupBy("grid", "row_no").agg(F.sum((F.col("t") != "").cast("int")).alias("filled"), F.max(F.when(F.col("col_no") == 0, F.col("t"))).alias("first"), F.max("col_no").alias("m"))
    label = F.col("first").endswith(":") | (F.col("first").rlike(r"\p{Lu}") & ~F.col("first").rlike(r"\p{Ll}"))
    kv = rows.where("filled > 0").groupBy("grid").agg(F.avg((F.col("filled") <= 2).cast("int")).alias("few"), F.avg(F.coalesce(label, F.lit(False)).cast("int")).alias("labels"), F.max("m").alias("m"))
    mode = rows.groupBy("grid", "filled").agg(F.count(F.lit(1)).alias("n")).groupBy("grid").agg(F.max_by("filled", F.struct("n", "filled")).alias("mode"))
    near = rows.join(mode, "grid").groupBy("grid").agg(F.avg((F.abs(F.col("filled") - F.col("mode")) <= 2).cast("int")).alias("near"), F.count(F.lit(1)).alias("n_rows"))
    para = c.groupBy("grid").agg(F.sum((F.col("t") != "").cast("int")).alias("n"), F.avg(F.when(F.col("t") != "", F.octet_length("t"))).alias("mean"), F.avg(F.when(F.col("t") != "", (F.octet_length("t") > 60).cast("int"))).alias("long"))
    j = kv.join(near, "grid").join(para, "grid")
    return j.select("grid", ((F.col("few") > 0.7) & (F.col("labels") > 0.5) & (F.col("m") < 6)).alias("key_value"), ((F.col("n") >= 4) & (((F.col("mean") > 40) & (F.col("long") > 0.2)) | (F.col("long") > 0.3))).alias("paragraph"), ((F.col("n_rows") < 3) | (F.col("near") > 0.4)).alias("consistent"))


def pipe_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """Cells of every pipe table of each text; a grid is named by the text's key and the table's number in it."""
    lines = df.where(F.col(text).rlike(r"(?m)^\|.*\|")).select(F.col(key).alias("doc"), F.posexplode(F.split(text, "\n")).alias("at", "line")).where(F.col("line").rlike(r"^\|.*\|[ \t]*$"))
    w = Window.partitionBy("doc").orderBy("at")
    run = lines.withColumn("isle", F.col("at") - F.row_number().over(w))
    run = run.withColumn("grid", F.concat_ws(":", "doc", F.dense_rank().over(Window.partitionBy("doc").orderBy("isle"))))
    rows = run.where(r"NOT line RLIKE '^[|: -]*-{3,}[|: -]*$'").withColumn("row_no", F.row_number().over(Window.partitionBy("grid").orderBy("at")) - 1)
    cells = F.slice(F.split(F.rtrim("line"), r"\|"), 2, F.greatest(F.size(F.split(F.rtrim("line"), r"\|")) - 2, F.lit(0)))
    return rows.select("grid", "row_no", F.posexplode(cells).alias("col_no", "c")).select("grid", "row_no", "col_no", F.trim("c").alias("text"))
