"""Queries of the problems 1 to 8 and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirel.session import cut, table

from . import garbled, language, leakage, mixing, neardup, quality, splitting, unicode_form

Query = Callable[[SparkSession, str], DataFrame]
#: Most ids that are broadcast to fetch their texts; beyond it they are joined by shuffling.
NARROW = 1_000_000


def _garbled_results(spark: SparkSession, d: str, among: DataFrame | None = None) -> DataFrame:
    """Repairs of all results, or of some of them (result_id, markdown); pairs are counted over all either way."""
    res = table(spark, d, "pdf_result").select("result_id", "markdown")
    return garbled.repair(res if among is None else among, ["result_id"], "markdown", garbled.pair_scores(res, "markdown"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    res, cmaps = table(spark, d, "pdf_result").select("result_id", "markdown"), table(spark, d, "font_cmap")
    pairs = garbled.pair_scores(res, "markdown")
    a = garbled.repair(res, ["result_id"], "markdown", pairs).select(F.lit("pdf_result").alias("tbl"), F.col("result_id").alias("rec_id"), F.lit(-1).alias("cid"))
    b = garbled.garbled_entries(cmaps, pairs).select(F.lit("font_cmap").alias("tbl"), F.col("cmap_id").alias("rec_id"), F.col("code").alias("cid"))
    return a.unionByName(b).distinct()


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _garbled_results(spark, d)


def p2_entries(spark: SparkSession, d: str) -> DataFrame:
    res = table(spark, d, "pdf_result").select("result_id", "markdown")
    return garbled.garbled_entries(table(spark, d, "font_cmap"), garbled.pair_scores(res, "markdown"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    res = table(spark, d, "pdf_result").select("result_id", "markdown")
    dirty = cut(res.where(unicode_form.is_dirty(F.col("markdown"))), "p3-dirty")
    bad = _garbled_results(spark, d, dirty).select("result_id").distinct()
    ok = dirty.join(bad, "result_id", "left_anti")
    texts = ok.select(F.lit("pdf_result").alias("tbl"), F.col("result_id").alias("rec_id"), F.col("markdown").alias("t"))
    elems = table(spark, d, "struct_element").select(F.lit("struct_element").alias("tbl"), F.col("elem_id").alias("rec_id"), F.col("actual_text").alias("t"))
    return unicode_form.form_cases(texts.unionByName(elems), ["tbl", "rec_id"], "t")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "pdf_result").select(F.lit("pdf_result").alias("tbl"), F.col("result_id").alias("rec_id"), F.col("markdown").alias("t"))
    elems = table(spark, d, "struct_element").select(F.lit("struct_element").alias("tbl"), F.col("elem_id").alias("rec_id"), F.col("actual_text").alias("t"))
    return unicode_form.normalize_forms(texts.unionByName(elems).where("t IS NOT NULL"), ["tbl", "rec_id"], "t")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    res = table(spark, d, "pdf_result").select("result_id", "markdown")
    kinds = cut(quality.text_kinds(res, "result_id", "markdown").where("kind <> 'prose'"), "p1-kinds")
    # Only what isn't prose by its statistics can be a case, so only that is looked at for wrong charsets.
    ids = kinds.select(F.col("id").alias("result_id")).distinct()
    some = res.join(F.broadcast(ids) if ids.count() <= NARROW else ids, "result_id", "left_semi")
    bad = _garbled_results(spark, d, some).select(F.col("result_id").alias("id"))
    return kinds.join(bad, "id", "left_anti").select(F.col("id").alias("result_id"), "kind").distinct()


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_kinds(table(spark, d, "pdf_result"), "result_id", "markdown").withColumnRenamed("id", "result_id")


def p1_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_result").select("result_id", *[c.alias(k) for k, c in quality.basic_stats(F.col("markdown")).items()])


def _p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    res = table(spark, d, "pdf_result").select(F.lit("pdf_result").alias("tbl"), F.col("result_id").alias("rec_id"), F.lit(-1).alias("block_no"), F.col("markdown").alias("t"))
    blocks = table(spark, d, "doc_block").select(F.lit("doc_block").alias("tbl"), F.col("file_id").alias("rec_id"), "block_no", F.col("text").alias("t"))
    return splitting.split_oversized(res.unionByName(blocks), ["tbl", "rec_id", "block_no"], "t", table(spark, d, "split_limit"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4_pieces(spark, d).select("tbl", "rec_id", "block_no").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _p4_pieces(spark, d)


def p4_cover(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each oversized text put together again, and whether each keeps to the limit and shares its beginning with the one before."""
    w = Window.partitionBy("tbl", "rec_id", "block_no").orderBy("piece_no")
    lim = table(spark, d, "split_limit").select("tbl", "max_chars", "overlap_chars")
    p = _p4_pieces(spark, d).join(F.broadcast(lim), "tbl").withColumn("end", F.col("start_at") + F.char_length("piece"))
    shared = F.coalesce(F.lag("end").over(w) - F.col("start_at"), F.lit(0))
    p = p.withColumn("own", F.substring("piece", shared + 1, F.char_length("piece"))).withColumn("ok", (F.char_length("piece") <= F.col("max_chars")) & ((F.col("piece_no") == 1) | (shared == F.col("overlap_chars"))))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda s: s["own"]), "")
    return p.groupBy("tbl", "rec_id", "block_no").agg(F.md5(whole).alias("md5"), F.min("ok").alias("ok")).distinct()


def _p5(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.similar(table(spark, d, "pdf_result"), "result_id", "title", "markdown", size=3, threshold=0.6, min_words=30)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.record_pairs(*_p5(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.components(*_p5(spark, d)).select(F.col("id").alias("result_id"), F.col("rep").alias("class_id"), "class_size", "group_id", "n_links")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select(F.col("id").alias("doc_id"), "item_id").distinct()


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).withColumnRenamed("id", "doc_id")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_caps(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the mixture: its documents with a text, whether all that it gives are its own, whether the copies of no two of them differ by
    more than one, and whether none is taken more often than allowed."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_target").where("source IS NOT NULL").dropDuplicates(["source"])
    mixed = mixing.mixture(docs, table(spark, d, "mix_target")).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    own = docs.where("text <> ''").select("source", "doc_id").distinct().join(mixed.withColumnRenamed("source", "s"), "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    g = own.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most"), F.min("copies").alias("least"), F.max(F.coalesce(F.col("s") != F.col("source"), F.lit(False))).alias("other"))
    return g.join(F.broadcast(targets), "source").select("source", "n_docs", (~F.col("other")).alias("own"), (F.col("most") - F.col("least") <= 1).alias("even"), (F.col("most") <= F.col("max_repeat")).alias("within"))


def _p8_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return language.stretches(docs, language.train(docs, table(spark, d, "lang_alias")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = language.page_languages(_p8_segments(spark, d)).where("share >= 0.15").select(F.col("id").alias("doc_id"), "lang")
    alias = table(spark, d, "lang_alias").select(F.col("alias").alias("label"), F.col("lang").alias("named")).dropDuplicates(["label"])
    labels = table(spark, d, "documents").select("doc_id", F.col("lang").alias("label")).join(F.broadcast(alias), "label").select("doc_id", F.col("named").alias("lang"))
    return found.join(labels, ["doc_id", "lang"], "left_anti").distinct()


def p8_pages(spark: SparkSession, d: str) -> DataFrame:
    return language.page_languages(_p8_segments(spark, d)).withColumnRenamed("id", "doc_id")


def p8_stretches(spark: SparkSession, d: str) -> DataFrame:
    return _p8_segments(spark, d).withColumnRenamed("id", "doc_id").withColumn("confidence", F.round("confidence", 6))


def p8_cover(spark: SparkSession, d: str) -> DataFrame:
    """Per page with letters: whether its stretches follow one another from its first word on and hold all of its letters."""
    g = _p8_segments(spark, d).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.max("seg_no").alias("last"), F.min("first_word").alias("first"), F.sum("n_words").alias("words"), F.max(F.col("first_word") + F.col("n_words")).alias("end"), F.sum("n_chars").alias("chars"), F.max("page_chars").alias("all"))
    return g.select("doc_id", ((F.col("n") == F.col("last")) & (F.col("first") == 0) & (F.col("words") == F.col("end")) & (F.col("chars") == F.col("all"))).alias("whole"))


def p3_plain(spark: SparkSession, d: str) -> DataFrame:
    """The forms of texts of ASCII alone: they stay as they are and are no case."""
    forms = p3_forms(spark, d).where(~F.col("text_form").rlike(r"[^\x00-\x7E]"))
    t = table(spark, d, "pdf_result").select(F.lit("pdf_result").alias("tbl"), F.col("result_id").alias("rec_id"), F.col("markdown").alias("t"))
    t = t.unionByName(table(spark, d, "struct_element").select(F.lit("struct_element").alias("tbl"), F.col("elem_id").alias("rec_id"), F.col("actual_text").alias("t"))).where(~F.col("t").rlike(r"[^\x00-\x7E]"))
    return forms.join(t.select("tbl", "rec_id"), ["tbl", "rec_id"], "left_semi").select("tbl", "rec_id", F.md5("text_form").alias("md5"), "is_case").distinct()


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p8_found, p8_pages, p8_stretches, p8_cover, p7_mixture, p7_shares, p7_caps, p6_found, p6_passages, p5_found, p5_groups, p1_found, p1_kinds, p1_stats, p4_found, p4_pieces, p4_cover, p2_found, p2_repaired, p2_entries, p3_found, p3_forms, p3_plain)}


P1_STATS = rf"""WITH t AS (SELECT result_id, CASE WHEN trim(translate(markdown, chr(10) || chr(9) || chr(13), '   '), ' ') <> '' THEN markdown END AS t FROM pdf_result),
 s AS (SELECT result_id, t, len(regexp_extract_all(t, '[A-Za-z0-9À-ÖØ-öø-ÿ]+')) AS words, length(regexp_replace(t, '[ \t\r\n]', '', 'g')) AS solid, length(regexp_replace(t, '[^A-Za-z0-9À-ÖØ-öø-ÿ]', '', 'g')) AS plain, list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS lines,
 len(list_filter(string_split_regex(lower(t), '[^a-z0-9à-öø-ÿ]+'), lambda w: w IN ({', '.join("'" + w + "'" for w in sorted(quality.COMMON_SET))}))) AS common FROM t)
 SELECT result_id, CASE WHEN t IS NOT NULL THEN words END AS word_count, CASE WHEN words > 0 THEN round(plain / words, 6) END AS mean_word_len, CASE WHEN solid > 0 THEN round(1 - plain / solid, 6) END AS symbol_ratio, CASE WHEN t IS NOT NULL THEN len(lines) END AS line_count,
 CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:][”’»"'')]*[ \t\r]*$'))) / len(lines), 6) END AS ended_line_share, CASE WHEN words > 0 THEN round(common / words, 6) END AS common_word_share FROM s"""
P4_FOUND = """SELECT DISTINCT 'pdf_result' AS tbl, result_id AS rec_id, -1 AS block_no FROM pdf_result WHERE length(markdown) > (SELECT max_chars FROM split_limit WHERE tbl = 'pdf_result')
 UNION SELECT DISTINCT 'doc_block', file_id, block_no FROM doc_block WHERE length(text) > (SELECT max_chars FROM split_limit WHERE tbl = 'doc_block')"""
P5_FOUND = r"""WITH w AS (SELECT result_id, regexp_extract_all(lower(coalesce(title, '') || chr(10) || markdown), '[\p{L}\p{N}]+') AS w FROM pdf_result WHERE markdown <> ''),
 s AS (SELECT result_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 30), u AS (SELECT result_id, len(s) AS n, unnest(s) AS g FROM s),
 p AS (SELECT a.result_id AS a_id, b.result_id AS b_id, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.result_id < b.result_id GROUP BY ALL) SELECT a_id, b_id FROM p WHERE c / (na + nb - c) >= 0.6"""


P4_COVER = """SELECT DISTINCT 'pdf_result' AS tbl, result_id AS rec_id, -1 AS block_no, md5(markdown) AS md5, true AS ok FROM pdf_result WHERE length(markdown) > (SELECT max_chars FROM split_limit WHERE tbl = 'pdf_result')
 UNION SELECT DISTINCT 'doc_block', file_id, block_no, md5(text), true FROM doc_block WHERE length(text) > (SELECT max_chars FROM split_limit WHERE tbl = 'doc_block')"""
P8_COVER = r"SELECT doc_id, true AS whole FROM documents WHERE regexp_matches(text, '\p{L}')"
P3_PLAIN = r"""SELECT DISTINCT 'pdf_result' AS tbl, result_id AS rec_id, md5(markdown) AS md5, false AS is_case FROM pdf_result WHERE NOT regexp_matches(markdown, '[^\x00-\x7E]')
 UNION SELECT DISTINCT 'struct_element', elem_id, md5(actual_text), false FROM struct_element WHERE NOT regexp_matches(actual_text, '[^\x00-\x7E]')"""
P7_CAPS = "SELECT d.source, count(DISTINCT doc_id) AS n_docs, true AS own, true AS even, true AS within FROM documents d JOIN (SELECT DISTINCT source FROM mix_target) m ON d.source = m.source WHERE text <> '' GROUP BY d.source"
P5_GROUPS = r"""WITH RECURSIVE w AS (SELECT result_id, regexp_extract_all(lower(coalesce(title, '') || chr(10) || markdown), '[\p{L}\p{N}]+') AS w FROM pdf_result WHERE markdown <> ''),
 s AS (SELECT result_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 30), k AS (SELECT result_id, s, md5(array_to_string(list_sort(s), '|')) AS k FROM s),
 m AS (SELECT result_id, s, min(result_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS class_size FROM k), u AS (SELECT result_id, len(s) AS n, unnest(s) AS g FROM m WHERE result_id = class_id),
 p AS (SELECT a.result_id AS a, b.result_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.result_id <> b.result_id GROUP BY ALL), e AS (SELECT a, b FROM p WHERE c / (na + nb - c) >= 0.6),
 r AS (SELECT DISTINCT class_id AS x, class_id AS y FROM m UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), q AS (SELECT x, min(y) AS group_id FROM r GROUP BY x), d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
 SELECT result_id, class_id, class_size, group_id, coalesce(d.n, 0) AS n_links FROM m JOIN q ON class_id = x LEFT JOIN d ON class_id = a"""


def oracle_sql() -> dict[str, str]:
    return {"p1_stats": P1_STATS, "p4_found": P4_FOUND, "p4_cover": P4_COVER, "p5_found": P5_FOUND, "p5_groups": P5_GROUPS, "p7_caps": P7_CAPS, "p8_cover": P8_COVER, "p3_plain": P3_PLAIN}
