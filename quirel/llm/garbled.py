"""Problem 2: text decoded with the wrong charset.

Method: adjacent character pairs of the whole corpus are counted, each pair gets its contribution to the mutual
information, improbable runs are isolated inside tokens as maximal-scoring segments, and only inside those runs inverse
mappings are tested: multi-byte sequences read through a one-byte charset (up to three times over), one-byte text read
through another one-byte charset, and places where characters were lost.

Pairs are counted over a fixed alphabet: ASCII and all characters that the one-byte charsets here can give; every other
character counts as one and the same. So the table of pairs is bounded by that alphabet's square, whatever the corpus, and no pair is left out.

Defined results: null or empty texts are no case; repeated rows give repeated results, callers make keys distinct.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirel.session import spread

#: A pair whose contribution to the mutual information is below this is improbable.
IMPROBABLE = 2e-5
#: Gain in log2 pair probability, a pair, that a one-byte mapping must bring.
GAIN = 3.0
# Characters other than letters that a repaired sequence may give.
PUNCT = "‘’‚“”„–—…«»‹›°§£¿¡€™•·©®ªº´¨½¼¾²³¹×†‡ ­﻿"
#: Charsets through which multi-byte text may have been read.
WRONG_FOR_UTF8 = ("cp1252", "cp437", "mac_roman", "cp1250", "cp850", "iso8859_15", "cp1254", "cp1257", "mac_latin2")
#: (read as, really) for one-byte text.
ONE_BYTE = (("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp437", "cp1252"))
# What a lead byte's letter stands for once its second character was dropped, and general punctuation.
AFTER_LEAD = {"Ã": list("àíÁÍÏÐÝ"), "Â": list(" ­")}
QUOTES = list("‘’“”–—…•")
DANGLING = re.compile(r"[a-zß-öø-ÿ][ÃÂ](?![A-ZÀ-Þ])|^Ã(?=\W*$)")
NON_ASCII = re.compile(r"[^\x00-\x7F]")
# Spaces and hidden characters, which problem 3 treats.
KEEP = "\xa0\xad\u200b\u200c\u200d\u2060\ufeff"
# Tokens without spaces are taken a stretch at a time; none ends inside a run of characters outside ASCII.
TOKEN = re.compile(r"[^ \t\r\n]{1,400}[^\x00-\x7F]*")
#: Charsets whose characters make the alphabet of pairs, besides those above; letters of other scripts that a repair may give.
ALPHABET_CODECS = ("cp1251", "koi8_r", "iso8859_5", "cp1253", "iso8859_2")
#: Letters of another script than Latin that a token's repair must give at least: fewer may as well be meant as they stand.
FOREIGN_LEAST = 3


@functools.cache
def to_byte(codec: str) -> dict[str, int]:
    """Character to byte (0x80 and up); bytes without a character stand for the control character of that number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
        if codec in ("cp1252", "iso8859_15", "cp1250", "cp1254", "cp1257") and b < 0xA0:
            out.setdefault(chr(b), b)
    return out


@functools.cache
def alphabet() -> frozenset[str]:
    """The characters that are counted as themselves."""
    coded = {c for codec in (*WRONG_FOR_UTF8, *ALPHABET_CODECS) for c in to_byte(codec)}
    return frozenset(coded | {chr(i) for i in range(0x180)} | set(PUNCT) | {"\ufffd"})


#: What every character outside the alphabet counts as.
OTHER = 0x10FFFF


@functools.cache
def code_table() -> np.ndarray:
    """Code point -> itself in the alphabet, else OTHER."""
    out = np.full(0x110000, OTHER, np.int32)
    at = np.array(sorted(map(ord, alphabet())))
    out[at] = at
    return out


def code(c: str) -> int:
    return ord(c) if c in alphabet() else OTHER


def foreign(c: str) -> bool:
    """A letter of the alphabet that isn't Latin (Cyrillic, Greek)."""
    return ord(c) >= 0x370 and c.isalpha() and c in alphabet()


def good_char(c: str) -> bool:
    return c in PUNCT or (unicodedata.category(c)[0] == "L" and ord(c) < 0x180) or foreign(c)


def shows_nothing(c: str) -> bool:
    """Marks, spaces and invisible characters: differing forms, not symbols."""
    return unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf", "Zs")


def join_sequences(s: str, least: int = FOREIGN_LEAST) -> tuple[str, int, str | None, int]:
    """Put multi-byte sequences that were read one byte at a time together again: (text, joined, codec, cut short)."""
    best = (s, 0, None, 0)
    for codec in WRONG_FOR_UTF8:
        table, out, i, joined, lost = to_byte(codec), [], 0, 0, 0
        while i < len(s):
            b = table.get(s[i])
            n = 0 if b is None else 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
            if n:
                tail = [table.get(c) for c in s[i + 1 : i + n]]
                k = next((j for j, t in enumerate(tail) if t is None or not 0x80 <= t <= 0xBF), len(tail))
                if k == n - 1:
                    try:
                        c = bytes([b, *tail]).decode()
                    except UnicodeDecodeError:
                        c = ""
                    follows = s[i + n : i + n + 1]
                    if c and (good_char(c) or to_byte("cp1252").get(c)) and not (c in "¿¡" and not follows.isalpha() and follows):
                        out.append(c)
                        joined += 1
                        i += n
                        continue
                elif n == 3 and k == 1 and b == 0xE2 and tail[0] == 0x80:
                    out.append("�")
                    joined, lost = joined + 1, lost + 1
                    i += 2
                    continue
            out.append(s[i])
            i += 1
        if 0 < sum(map(foreign, out)) - sum(map(foreign, s)) < least:
            continue
        if joined > best[1] or (joined == best[1] and joined and lost < best[3]):
            best = ("".join(out), joined, codec, lost)
    return best


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal-scoring segments (start, end) of positive total, left to right (Ruzzo and Tompa's linear scan)."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, nearest one before with a lesser left sum
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, left = i, before
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((start, i + 1, left, total, j))
                break
            start, _, left, _, before_j = found[j]
            del found[j:]
            j = before_j
    return [(a, b) for a, b, _, _, _ in found]


class PairScores:
    """Log probabilities and mutual-information scores of character pairs, from counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.n = dict(zip(keys.tolist(), counts.tolist()))
        self.total = float(max(1, counts.sum()))
        self.one: dict[int, int] = {}
        for k, n in self.n.items():
            self.one[k >> 21] = self.one.get(k >> 21, 0) + n

    def logp(self, a: str, b: str) -> float:
        return float(np.log2((self.n.get(code(a) << 21 | code(b), 0) + 0.02) / self.total))

    def seen(self, a: str, b: str) -> bool:
        return code(a) << 21 | code(b) in self.n

    def fill(self, before: str, options: list[str], after: str) -> str:
        """The option that goes best between two characters."""
        return max(options, key=lambda c: self.logp(before, c) + self.logp(c, after))

    def improbable(self, a: str, b: str) -> float:
        """Positive for a pair that contributes little to the corpus' mutual information.

        Two characters outside ASCII that keep to one another are what a wrong decoding makes, so there association
        counts as improbable too.
        """
        if a > "\x7f" and b > "\x7f":
            return 4.0
        a, b = code(a), code(b)
        n = self.n.get(a << 21 | b, 0)
        if not n:
            return 6.0
        pa, pb, pab = self.one.get(a, 1) / self.total, self.one.get(b, 1) / self.total, n / self.total
        mi = pab * np.log2(pab / (pa * pb))
        return float(np.clip(np.log2(IMPROBABLE / max(mi, 1e-12)), -6, 6))


def count_pairs(df: DataFrame, text: str) -> DataFrame:
    """(pair, n) over all texts: a table of ASCII pairs by number, the rest by sorting, summed a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = code_table()
        grid, rest = np.zeros(1 << 14, np.int64), {}
        for pdf in batches:
            for s in pdf["__t"]:
                if not s:
                    continue
                a = np.frombuffer((" " + s + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                x, y = a[:-1], a[1:]
                if s.isascii():
                    grid += np.bincount(x << 7 | y, minlength=1 << 14)
                    continue
                a = codes[a].astype(np.int64)
                x, y = a[:-1], a[1:]
                low = (x < 128) & (y < 128)
                grid += np.bincount(x[low] << 7 | y[low], minlength=1 << 14)
                for k, n in zip(*(v.tolist() for v in np.unique(x[~low] << 21 | y[~low], return_counts=True))):
                    rest[k] = rest.get(k, 0) + n
            if len(rest) > 200_000:
                yield pd.DataFrame({"pair": np.fromiter(rest, np.int64), "n": np.fromiter(rest.values(), np.int64)})
                rest = {}
        at = np.flatnonzero(grid)
        yield pd.DataFrame({"pair": (at >> 7) << 21 | (at & 127), "n": grid[at]})
        if rest:
            yield pd.DataFrame({"pair": np.fromiter(rest, np.int64), "n": np.fromiter(rest.values(), np.int64)})

    parts = spread(df.select(F.col(text).alias("__t")).where("__t <> ''")).mapInPandas(run, "pair long, n long")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def pair_scores(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """All pairs and their counts: at most the square of the alphabet (some 400 000), so they may be collected and broadcast."""
    top = count_pairs(df, text).orderBy("pair").toPandas()
    return top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def firm(tok: str, new: str) -> bool:
    """Whether each changed letter stands as only a wrong decoding puts it: no capital made small without a small letter beside it."""
    for i, (a, b) in enumerate(zip(tok, new)):
        if a != b and a.isupper() and b.islower() and not any(x.isascii() and x.islower() for x in tok[max(0, i - 1) : i + 2]):
            return False
    return sum(c.isalnum() for c in new) > 1


def one_byte_fixes(tok: str, ps: PairScores, inside: set[int]) -> dict[str, tuple[float, str, int, bool]]:
    """Charset pair -> (gain, repaired token, places, firm): one-byte mappings of the characters inside the improbable runs
    (their places) that make the token's pairs far more probable."""
    padded, found = f" {tok} ", {}
    for wrong, right in ONE_BYTE:
        table = to_byte(wrong)
        new, n = [], 0
        for i, c in enumerate(tok):
            b = table.get(c) if c > "\x7f" and c not in KEEP and i in inside else None
            if b is None:
                new.append(c)
                continue
            try:
                r = bytes([b]).decode(right)
            except UnicodeDecodeError:
                r = ""
            if not r or not good_char(r) or r in KEEP or r in "ÃÂ":
                n = 0
                break
            new.append(r)
            n += 1
        if not n:
            continue
        s = f" {''.join(new)} "
        pairs = [i for i in range(len(padded) - 1) if padded[i] != s[i] or padded[i + 1] != s[i + 1]]
        if not pairs:
            continue
        gain = (sum(ps.logp(s[i], s[i + 1]) for i in pairs) - sum(ps.logp(padded[i], padded[i + 1]) for i in pairs)) / len(pairs)
        if gain > GAIN and all(ps.seen(s[i], s[i + 1]) for i in pairs):
            found[f"{right} as {wrong}"] = (gain, s[1:-1], n, firm(tok, s[1:-1]))
    return found


def repair_token(tok: str, ps: PairScores, least: int = FOREIGN_LEAST) -> tuple[str, str | None, int, bool, dict[str, tuple[float, str, int, bool]]]:
    """(repaired token, charset, repaired places, whether characters were lost, one-byte mappings to choose from)."""
    padded = f" {tok} "
    runs = [(a, b) for a, b in segments([ps.improbable(x, y) for x, y in zip(padded, padded[1:])]) if NON_ASCII.search(padded[a : b + 1])]
    if not runs:
        return tok, None, 0, False, {}
    # Neighbouring runs and the characters outside ASCII between them are one place to test.
    spans: list[list[int]] = []
    for a, b in runs:
        a, b = max(a, 1), min(b + 1, len(padded) - 1)
        while a > 1 and padded[a - 1] > "\x7f":
            a -= 1
        while b < len(padded) - 1 and padded[b] > "\x7f":
            b += 1
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    out, at, codec, places, lost = [], 0, None, 0, False
    for a, b in spans:
        fixed, n, c, cut = join_sequences(padded[a:b], least)
        for _ in range(2):
            if not n or not NON_ASCII.search(fixed):
                break
            again, n2, _, cut2 = join_sequences(fixed, least)
            if not n2:
                break
            fixed, cut = again, cut + cut2
        if n:
            codec, places, lost = codec or f"utf_8 as {c}", places + n, lost or cut > 0
        out.append(padded[at:a] + fixed)
        at = b
    if places:
        whole = "".join(out) + padded[at:]
        if lost:
            for k, c in enumerate(whole):
                if c == "\ufffd" and 0 < k < len(whole) - 1:
                    whole = whole[:k] + ps.fill(whole[k - 1], QUOTES, whole[k + 1]) + whole[k + 1 :]
        return whole[1:-1], codec, places, lost or "\ufffd" in whole, {}
    inside = {i - 1 for a, b in spans for i in range(a, b)}
    gone = sum(tok[i] == "\ufffd" for i in inside)
    if gone:
        return tok, "lost", gone, True, {}
    if fixes := one_byte_fixes(tok, ps, inside):
        return tok, None, 0, False, fixes
    m = next((m for m in DANGLING.finditer(tok) if m.end() - 1 in inside), None)
    if m:
        # The second byte's character was dropped: the letter that goes best with its neighbours.
        at = m.end() - 1
        return tok[:at] + ps.fill(padded[at], AFTER_LEAD[tok[at]], padded[at + 2]) + tok[at + 1 :], "lost", 1, True, {}
    if any("\x80" <= tok[i] <= "\x9f" for i in inside):
        return tok, "lost", 1, True, {}
    return tok, None, 0, False, {}


def sure_place(tok: str, fixed: str, plain: set[str]) -> bool:
    """Whether a repair is sure beside symbols: characters were lost, or letters change with a character that the text nowhere else holds unexplained."""
    gone, come = Counter(tok) - Counter(fixed), Counter(fixed) - Counter(tok)
    return tok == fixed or any(c > "\x7f" and c not in plain for c in gone) and any(c > "\x7f" and c.isalpha() for c in (*gone, *come))


def repair_text(text: str, ps: PairScores, memo: dict[str, tuple]) -> tuple[str, str | None, int, bool]:
    """(repaired text, charset, places, lost). One-byte mappings are chosen by their gain over the whole text;
    what could as well be meant (a capital among capitals, a character alone) counts only beside places that are sure.

    Of a text most of whose odd symbols no mapping explains only the sure places are kept: the others are symbols, not garbled text.
    """
    got, odd, gains, plain = [], 0, {}, set()
    for m in TOKEN.finditer(text):
        tok = m[0]
        if tok.isascii():
            continue
        if tok not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[tok] = repair_token(tok, ps)
        r = memo[tok]
        got.append((m, r))
        for c, (gain, _, _, sure) in r[4].items():
            if sure:
                gains[c] = gains.get(c, 0.0) + gain
        if not r[2] and not r[4]:
            symbols = [ch for ch in tok if ch > "\x7f" and not ch.isalnum() and not shows_nothing(ch)]
            odd += sum(ch not in PUNCT for ch in symbols)
            plain.update(symbols)
    if any(r[2] and any(map(foreign, r[0])) for _, r in got):
        # Beside words that are sure to be of another script, short ones are taken as such too.
        got = [(m, r if r[2] else repair_token(m[0], ps, 1)) for m, r in got]
    main = max(gains, key=lambda c: (gains[c], c)) if gains else None
    repairs = []
    for m, (fixed, c, n, gone, fixes) in got:
        if fixes and main in fixes:
            c = main
            _, fixed, n, _ = fixes[main]
        elif fixes and (sure := [x for x in fixes if fixes[x][3]]):
            c = max(sure, key=lambda x: (fixes[x][0], x))
            _, fixed, n, _ = fixes[c]
        if n:
            repairs.append((m, fixed, c, n, gone))
    if odd > 4 * sum(r[3] for r in repairs):
        repairs = [r for r in repairs if sure_place(r[0][0], r[1], plain)]
    out, at, codec, places, lost = [], 0, None, 0, False
    for m, fixed, c, n, gone in repairs:
        out.append(text[at : m.start()] + fixed)
        at = m.end()
        codec, places, lost = codec or c, places + n, lost or gone
    if not places:
        return text, None, 0, False
    return "".join(out) + text[at:], codec, places, lost


def repair(df: DataFrame, keys: list[str], text: str, pairs: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(keys..., codec, places, lost, repaired) of the texts with a part decoded with the wrong charset."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(pairs)
    names = [f"__k{i}" for i in range(len(keys))]
    recs = spread(df.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], F.col(text).alias("__t")).where(F.col("__t").rlike(r"[^\x00-\x7F]")))
    schema = ", ".join(f"{a} {recs.schema[a].dataType.simpleString()}" for a in names) + ", codec string, places int, lost boolean, repaired string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ps, memo = PairScores(*shared.value), {}
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False, name=None):
                fixed, codec, places, lost = repair_text(r[-1], ps, memo)
                if places:
                    rows.append((*r[:-1], codec, places, bool(lost), fixed))
            yield pd.DataFrame(rows, columns=[*names, "codec", "places", "lost", "repaired"])

    return recs.mapInPandas(run, schema).select(*[F.col(a).alias(k) for k, a in zip(keys, names)], "codec", "places", "lost", "repaired")


def garbled_entries(cmaps: DataFrame, pairs: tuple[np.ndarray, np.ndarray], key: str = "cmap_id", mapping: str = "char_map") -> DataFrame:
    """(key, code, value, original, codec, lost) of map entries whose one character has turned into several."""
    entries = cmaps.select(F.col(key), F.explode(mapping).alias("code", "value")).where((F.char_length("value") > 1) & F.col("value").rlike(r"[^\x00-\x7F]"))
    values = repair(entries.select("value").distinct().withColumn("t", F.col("value")), ["value"], "t", pairs)
    one = values.where(F.char_length("repaired") == 1).select("value", F.col("repaired").alias("original"), "codec", "lost")
    return entries.join(one, "value").select(key, "code", "value", "original", "codec", "lost")
