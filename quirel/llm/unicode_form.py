"""Problem 3: one form for text that looks the same but differs in its characters.

Method: dirty tokens (those with a character outside a safe set) are taken once each, exploded to positioned code
points, broadcast-joined with a decomposition table and a look-alike table, combining marks are ordered by class, the
characters are recomposed and the tokens, then the texts, are rebuilt. Clean texts pass through untouched.

A token is what stands between white space, in stretches of at most STRETCH characters (with the marks after them) where it is longer, so no group grows
with a text; letters of one word beyond that are judged by stretch.

Defined results: null text gives null, empty text gives empty text; repeated rows stay repeated; a token wholly in another script stays as it is.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirel.session import cut

# Letters of other scripts that look like a Latin letter, each followed by that letter.
LOOKALIKE_CYRILLIC = "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS УY ԌG ԚQ ԜW Ѵv ѵv ӏl"
LOOKALIKE_GREEK = "οo αa ρp νv υu ιi κk τt χx γy ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϜF"
# Characters that show nothing.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
# A token with none but these characters needs no work (ASCII, composed Latin letters, common punctuation, currency, shapes).
SAFE_BEYOND = r"¡-¬®-´¶-ıĴ-ňŊ-ž‐-‧‰-⁞₠-⃏←-⋿─-➿�"
SAFE_CLASS = r"\x00-\x7E" + SAFE_BEYOND
# Only characters beyond ASCII are looked up in the whole class.
DIRTY = rf"[\x7F-\x{{10FFFF}}&&[^{SAFE_BEYOND}]]"
LATIN, OTHER = "L", "O"
#: Characters of the longest stretch without white space that is taken as one token.
STRETCH = 200
TOKENS = rf"[ \t\r\n]+|[^ \t\r\n]{{1,{STRETCH}}}\p{{M}}{{0,{STRETCH}}}"
# Letters of the Latin script that Unicode names otherwise (ordinal indicators, unit signs, forms for other widths).
NOT_LATIN = "\u00AA\u00BA\u212A\u212B\uFF21-\uFF3A\uFF41-\uFF5A"


@functools.cache
def mapping_rows() -> list[tuple[int, str, str, int, str | None]]:
    """(code point, replacement, kind, combining class, Latin look-alike) of every character that the form changes or orders.

    Built by rule from the Unicode database: kind is "form" (a letter, digit or space in another form; counts as a case),
    "mark" (combining), "hidden" (dropped; counts), "soft" (punctuation in another form; changed, but no case) or "twin"
    (a letter of another script with a Latin look-alike).
    """
    rows: dict[int, tuple[int, str, str, int, str | None]] = {}
    hidden = set(INVISIBLE)
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0x20000 <= cp < 0x30000 or cp >= 0xF0000:
            continue
        ch = chr(cp)
        if cp in hidden:
            rows[cp] = (cp, "", "hidden", 0, None)
            continue
        cat, dec = unicodedata.category(ch), unicodedata.decomposition(ch)
        ccc = unicodedata.combining(ch)
        if cat == "Zs":
            rows[cp] = (cp, " ", "form", 0, None)
        elif ccc:
            rows[cp] = (cp, unicodedata.normalize("NFD", ch), "mark", ccc, None)
        elif cat == "Nd" and not dec and cp < 0x20000:
            rows[cp] = (cp, str(unicodedata.decimal(ch)), "digit", 0, None)
        elif dec.startswith("<") and dec.split(">")[0][1:] in ("wide", "narrow", "font", "compat", "initial", "medial", "final", "isolated", "noBreak"):
            to = unicodedata.normalize("NFKC", ch)
            if cat[0] in "LN" and cat != "No" and all(unicodedata.category(c)[0] in "LNM" for c in to) and cat != "Nl":
                rows[cp] = (cp, to, "form", 0, None)
            elif dec.startswith(("<wide", "<narrow")) and len(to) == 1:
                rows[cp] = (cp, to, "soft", 0, None)
    for table in (LOOKALIKE_CYRILLIC, LOOKALIKE_GREEK):
        for pair in table.split():
            rows[ord(pair[0])] = (ord(pair[0]), pair[0], "twin", 0, pair[1])
    return list(rows.values())


def mapping_table(spark: SparkSession) -> DataFrame:
    """Fixed-size dimension (a few thousand rows of the Unicode database), always small enough to broadcast."""
    return spark.createDataFrame(pd.DataFrame(mapping_rows(), columns=["cp", "to", "kind", "ccc", "twin"]), "cp int, to string, kind string, ccc int, twin string")


@F.pandas_udf(StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def _letter_script(cp: Column, c: Column) -> Column:
    """Script of a letter, empty for other characters; ASCII, which most are, is told by number."""
    plain = F.when(cp.between(97, 122) | cp.between(65, 90), LATIN).otherwise("")
    return F.when(cp < 128, plain).when(~c.rlike(r"^\p{L}"), "").when(c.rlike(rf"^[\p{{IsLatin}}&&[^{NOT_LATIN}]]"), LATIN).otherwise(OTHER)


def fix_tokens(tokens: DataFrame) -> DataFrame:
    """tokens(token) distinct -> (token, fixed, is_case). One row for each token; groups are single tokens, so bounded.

    A look-alike letter is replaced if its run of letters has a Latin letter that stands for itself, or if every letter
    of the run has a Latin twin; otherwise the run is in its own script and stays. In a run that holds both Latin and
    unmistakable letters of another script, nothing is replaced either way.
    """
    spark = tokens.sparkSession
    chars = tokens.select("token", F.posexplode(F.split("token", "")).alias("pos", "ch")).where("ch <> ''")
    chars = chars.withColumn("cp", F.expr("ascii(ch)"))  # Spark's ascii() gives the whole code point
    m = F.broadcast(mapping_table(spark))
    x = chars.join(m, "cp", "left").withColumn("script", _letter_script(F.col("cp"), F.col("ch")))
    w = Window.partitionBy("token").orderBy("pos")
    inner = (F.col("script") != "") | F.col("kind").isin("hidden", "mark")
    x = x.withColumn("run", F.sum(F.when(inner, 0).otherwise(1)).over(w))
    r = Window.partitionBy("token", "run")
    plain_latin = F.coalesce((F.col("script") == LATIN) | (F.col("kind") == "form") & F.col("to").rlike("^[A-Za-z0-9]+$"), F.lit(False))
    x = (
        x.withColumn("n_latin", F.sum(F.when(plain_latin, 1).otherwise(0)).over(r))
        .withColumn("n_twin", F.sum(F.when(F.col("kind") == "twin", 1).otherwise(0)).over(r))
        .withColumn("n_other", F.sum(F.when((F.col("script") == OTHER) & F.coalesce(F.col("kind") != "twin", F.lit(True)) & ~plain_latin, 1).otherwise(0)).over(r))
    )
    spoof = (F.col("kind") == "twin") & (F.col("n_other") == 0)
    alien_digit = (F.col("kind") == "digit") & (F.col("n_other") == 0)
    x = x.withColumn("out", F.when(spoof, F.col("twin")).when(alien_digit, F.col("to")).when(F.col("kind").isin("form", "hidden", "soft", "mark"), F.col("to")).otherwise(F.col("ch")))
    hit = spoof | alien_digit | F.col("kind").isin("form", "hidden")
    # A mark belongs to the last base before it; within that cluster marks stand in order of class, then of place.
    x = x.withColumn("base", F.max(F.when(F.coalesce("ccc", F.lit(0)) == 0, F.col("pos"))).over(w))
    y = x.groupBy("token").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("base", F.lit(-1)).alias("b"), F.coalesce("ccc", F.lit(0)).alias("c"), "pos", "out"))), lambda s: s["out"]), "").alias("joined"),
        F.max(F.when(hit, 1).otherwise(0)).alias("hit"),
    )
    y = y.withColumn("fixed", _compose("joined"))
    composed = F.regexp_replace("joined", r"\p{M}", "") != F.regexp_replace("fixed", r"\p{M}", "")
    return y.select("token", "fixed", ((F.col("hit") == 1) | composed).alias("is_case"))


def normalize_forms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., text_form, is_case): each text in the one form, and whether a letter, digit, space or hidden character differed."""
    names = [f"__k{i}" for i in range(len(keys))]
    recs = df.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], F.col(text).alias("__t"))
    bad = F.col("token").rlike(DIRTY)
    dirty = F.coalesce(F.col("__t").rlike(DIRTY), F.lit(False))
    clean = recs.where(~dirty).select(*names, F.col("__t").alias("text_form"), F.lit(False).alias("is_case"))
    # Each row to be rebuilt gets a number of its own, so repeated rows stay apart; the numbers are written, as several branches read them.
    work = cut(recs.where(dirty).withColumn("__row", F.monotonically_increasing_id()), "p3-rows")
    ks = ["__row", *names]
    toks = work.select(*ks, F.posexplode(F.regexp_extract_all("__t", F.lit(TOKENS), F.lit(0))).alias("pos", "token"))
    fixed = fix_tokens(toks.where(bad).select("token").distinct())
    done = toks.where(~bad).select(*ks, "pos", F.col("token").alias("fixed"), F.lit(False).alias("is_case")).unionByName(toks.where(bad).join(fixed, "token").select(*ks, "pos", "fixed", "is_case"))
    built = done.groupBy(*ks).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fixed"))), lambda s: s["fixed"]), "").alias("text_form"),
        F.max("is_case").alias("is_case"),
    )
    out = clean.unionByName(built.select(*names, "text_form", "is_case"))
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, names)], "text_form", "is_case")


def form_cases(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Keys of the texts with a case: the same token stage, without rebuilding whole texts."""
    ks = [f"__k{i}" for i in range(len(keys))]
    recs = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(text).alias("__t")).where(is_dirty(F.col("__t")))
    toks = recs.select(*ks, F.explode(F.split("__t", r"[ \t\r\n]+")).alias("token")).where(is_dirty(F.col("token")))
    stretches = F.when(F.char_length("token") <= STRETCH, F.array("token")).otherwise(F.regexp_extract_all("token", F.lit(TOKENS), F.lit(0)))
    toks = toks.select(*ks, F.explode(stretches).alias("token")).where(is_dirty(F.col("token"))).distinct()
    fixed = fix_tokens(toks.select("token").distinct()).where("is_case").select("token")
    hits = toks.join(fixed, "token", "left_semi").select(*ks).distinct()
    return hits.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)])


def is_dirty(c: Column) -> Column:
    """Whether a text has a character outside the safe set; ASCII texts are told by their length in bytes."""
    return ((F.octet_length(c) > F.char_length(c)) | F.contains(c, F.lit("\x7f"))) & c.rlike(DIRTY)
