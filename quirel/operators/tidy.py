"""Steps over the lines of Markdown texts that look at neighbouring lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirel.functions import text as T


def drop_page_numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): lines that are a page number and stand alone, or before a '---', are dropped.

    Alone means: a blank line, a '---' or the text's end on both sides. Null texts stay null; texts without a candidate
    pass as they are, so only texts with one are taken apart.
    """
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    some = F.coalesce(F.col("t").rlike(rf"(?m)^[{T.WS}]*[-–—]?\s?(?:(?i:page) )?[0-9]{{1,4}}"), F.lit(False))
    x = src.where(some).select("k", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    w = Window.partitionBy("k").orderBy("pos")
    t = T.trim_ws(F.col("line"))
    stop = lambda c: c.isNull() | (c == "") | (c == "---")
    x = x.withColumn("b", F.lag(t).over(w)).withColumn("a", F.lead(t).over(w)).withColumn("a2", F.lead(t, 2).over(w))
    number = t.rlike(T.PAGE_NUMBER) | t.rlike(r"^(?i:page) [0-9]{1,4}\b")
    drop = number & ((stop(F.col("b")) & stop(F.col("a"))) | F.coalesce((F.col("a") == "---") | ((F.col("a") == "") & (F.col("a2") == "---")), F.lit(False)))
    kept = x.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~drop, F.struct("pos", "line")))), lambda s: s["line"]), "\n").alias("t"))
    return src.where(~some).unionByName(kept).select(F.col("k").alias(key), F.col("t").alias("text"))


def letter_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, letters, vowel_ratio, case_shift_ratio, cosine, shape_cosine, garbled): is it shifted or substituted text?

    Letters are compared with their usual frequencies, as they stand and sorted by size; a text of at least 200 letters and
    few vowels is garbled if small letters often turn capital within words, or if only the sorted frequencies fit.
    """
    c = F.col(text)
    low = F.lower(c)
    counts = F.array(*[(F.char_length(low) - F.char_length(F.replace(low, F.lit(ch), F.lit("")))).cast("double") for ch in "abcdefghijklmnopqrstuvwxyz"])
    n = F.char_length(F.regexp_replace(c, "[^A-Za-z]", ""))
    vowels = F.char_length(F.regexp_replace(low, "[^aeiou]", ""))
    bigrams = F.coalesce(F.aggregate(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+)")), lambda x: F.char_length(x) - 1), F.lit(0), lambda a, b: a + b), F.lit(0))
    shifts = F.regexp_count(c, F.lit("[a-z][A-Z]"))
    other = F.char_length(F.regexp_replace(c, r"[^\p{L}]|[A-Za-zÀ-ɏḀ-ỿ]", ""))
    latin = F.char_length(F.regexp_replace(c, r"[^À-ÖØ-öø-ɏḀ-ỿ]", ""))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    ref = F.array(*map(F.lit, ENGLISH))
    ref_sorted = F.array(*map(F.lit, sorted(ENGLISH, reverse=True)))
    norm = sum(x * x for x in ENGLISH) ** 0.5
    cos = lambda o, r: dot(o, r) / (F.sqrt(dot(o, o)) * norm)
    # The counts are bound to a lambda's variable, else the optimizer would put all of them into each place that uses them.
    both = F.transform(F.array(counts), lambda o: F.array(cos(o, ref), F.transform(F.array(F.sort_array(o, asc=False)), lambda q: cos(q, ref_sorted))[0]))[0]
    both = F.when(n > 0, both).otherwise(F.array(F.lit(1.0), F.lit(1.0)))
    d = df.where(c.isNotNull()).select(F.col(key).alias("k"), n.alias("letters"), vowels.alias("v"), bigrams.alias("bi"), shifts.alias("sh"), other.alias("o"), latin.alias("lx"), F.transform(F.array(both), lambda x: F.struct(x[0].alias("a"), x[1].alias("b")))[0].alias("c"))
    d = d.withColumn("cosine", F.col("c.a")).withColumn("shape", F.col("c.b"))
    vr, sr = F.col("v") / F.greatest("letters", F.lit(1)), F.col("sh") / F.greatest("bi", F.lit(1))
    bad = (F.col("letters") >= 200) & (F.col("o") <= F.col("letters") + F.col("lx")) & (vr <= 0.30) & (((F.col("bi") >= 100) & (sr >= 0.10)) | ((F.col("cosine") < 0.60) & (F.col("shape") >= 0.90)))
    return d.select(F.col("k").alias(key), "letters", F.round(vr, 6).alias("vowel_ratio"), F.round(sr, 6).alias("case_shift_ratio"), F.round("cosine", 6).alias("cosine"), F.round("shape", 6).alias("shape_cosine"), bad.alias("garbled"))


# Frequencies of the letters a to z in English, in percent.
ENGLISH = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.15, 2.0, 0.07]
