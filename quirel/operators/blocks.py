"""Blocks of office files: runs of lists and quotes, and whole files as Markdown.

Repeated block rows are taken once; where one block number has several texts the first in order is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirel.functions import text as T


def one_each(df: DataFrame) -> DataFrame:
    key = F.struct(F.coalesce("text", F.lit("")), F.coalesce("block_kind", F.lit("")), F.coalesce("heading_level", F.lit(0)), F.coalesce("marker", F.lit("")), F.coalesce("code_lang", F.lit("")))
    return df.groupBy("file_id", "block_no").agg(F.min_by(F.struct("block_kind", "heading_level", "code_lang", "marker", "text"), key).alias("b")).select("file_id", "block_no", "b.*")


def folds(df: DataFrame, kinds: tuple[str, ...] = ("quote", "code", "list")) -> DataFrame:
    """(file_id, kind, first_block, last_block, n): runs of consecutive blocks of one kind, as they are folded into one."""
    w = Window.partitionBy("file_id").orderBy("block_no")
    x = one_each(df).withColumn("isle", F.row_number().over(w) - F.row_number().over(Window.partitionBy("file_id", "block_kind").orderBy("block_no")))
    g = x.where(F.col("block_kind").isin(*kinds)).groupBy("file_id", "block_kind", "isle").agg(F.min("block_no").alias("first_block"), F.max("block_no").alias("last_block"), F.count(F.lit(1)).alias("n"))
    return g.select("file_id", F.col("block_kind").alias("kind"), "first_block", "last_block", "n")


def list_runs(df: DataFrame) -> DataFrame:
    """(file_id, block_no, run_no, start, n): numbered entries of list blocks, split where a number isn't the last plus one."""
    e = one_each(df).where("block_kind = 'list' AND text IS NOT NULL").select("file_id", "block_no", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    e = e.withColumn("num", F.regexp_extract("line", r"^\s*([0-9]{1,6})[.)]\s", 1).try_cast("int")).where("num IS NOT NULL")
    w = Window.partitionBy("file_id", "block_no").orderBy("at")
    e = e.withColumn("run_no", F.sum(F.when(F.col("num") == F.lag("num").over(w) + 1, 0).otherwise(1)).over(w))
    return e.groupBy("file_id", "block_no", "run_no").agg(F.min("num").alias("start"), F.count(F.lit(1)).alias("n"))


def block_markdown() -> Column:
    """A block as Markdown; blank blocks are null."""
    t = T.trim_ws(F.col("text"))
    level = F.least(F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1)), F.lit(6))
    return (
        F.when(F.col("block_kind") == "rule", "---")
        .when(F.coalesce(t, F.lit("")) == "", None)
        .when(F.col("block_kind") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), T.collapse_ws(t)))
        .when(F.col("block_kind") == "quote", F.concat(F.lit("> "), F.replace(t, F.lit("\n"), F.lit("\n> "))))
        .when(F.col("block_kind") == "code", F.concat(T.fence(t, 3), F.coalesce("code_lang", F.lit("")), F.lit("\n"), t, F.lit("\n"), T.fence(t, 3)))
        .otherwise(t)
    )


def file_markdown(df: DataFrame) -> DataFrame:
    """(file_id, markdown, n_blocks): the blocks of each file joined by blank lines, with a line end at the end."""
    x = one_each(df).withColumn("md", block_markdown()).where("md IS NOT NULL")
    return x.groupBy("file_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "md"))), lambda s: s["md"]), "\n\n"), F.lit("\n")).alias("markdown"), F.count(F.lit(1)).alias("n_blocks"))


def pick_by_priority(candidates: DataFrame, key: list[str], priority: str) -> DataFrame:
    """The candidate of least priority number for each key, ties by the rest of the row: a cascade of detectors."""
    rest = [c for c in candidates.columns if c not in key and c != priority]
    return candidates.groupBy(*key).agg(F.min_by(F.struct(priority, *rest), F.struct(priority, *rest)).alias("r")).select(*key, "r.*")
