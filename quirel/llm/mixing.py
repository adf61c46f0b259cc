"""Problem 7: one mixture of several sources by target shares, small sources repeated a capped number of times.

Method: hash-threshold histograms. Every document has a hash of its id; tokens are summed by source and by the hash's
leading bits, budgets become thresholds on the hash, only the bucket at a threshold is summed again by the next bits, and
documents are then picked by comparing hashes with thresholds, without a sort. Thresholds are nested: a larger budget
keeps all that a smaller one had.

The mixture is as large as the sources allow: the total is the largest at which no source needs more than max_repeat
times its tokens. A source that needs m whole passes and a part takes every document m times and those below the
threshold once more.

Defined results: documents of null or unlisted sources, and without a text or token, take no part; listed sources
without documents have share 0 and their target is left out of the total (the other shares are scaled to it); an empty
table gives an empty mixture; ids are unique, rows repeated with one id are taken once per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirel.session import cut, spread

#: Bits of the hash summed a level, and levels; 2 ** (BITS * LEVELS) buckets tell documents apart at last.
BITS, LEVELS = 10, 6


def hash_of(key: str) -> F.Column:
    """60 hash bits of an id, as a number that isn't negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(key)), 64 - BITS * LEVELS)


def count_tokens(docs: DataFrame, key: str, text: str, source: str, path: str) -> DataFrame:
    """(id, source, h, n): tokens of each document by the byte-level BPE of path (ranks file)."""
    recs = spread(docs.where(F.col(source).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("id"), F.col(source).alias("source"), hash_of(key).alias("h"), F.col(text).alias("t")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) for t in pdf["t"]]
            yield pdf[["id", "source", "h"]].astype(object).assign(n=n)

    return recs.mapInPandas(run, f"id {recs.schema['id'].dataType.simpleString()}, source string, h long, n long").where("n > 0")


def _histogram(tokens: DataFrame, level: int, at: dict[str, int] | None) -> dict[str, dict[int, int]]:
    """Tokens by source and bucket of a level; below the first level only inside each source's boundary bucket."""
    rest = BITS * (LEVELS - 1 - level)
    t = tokens.withColumn("b", F.shiftright("h", rest))
    if at is not None:
        inside = t.sparkSession.createDataFrame([(s, b) for s, b in at.items()], "source string, p long")
        t = t.join(F.broadcast(inside), "source").where(F.shiftright("b", BITS) == F.col("p"))
    # At most listed sources times 2 ** BITS rows.
    got: dict[str, dict[int, int]] = {}
    for s, b, n in t.groupBy("source", "b").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False, name=None):
        got.setdefault(s, {})[int(b)] = int(n)
    return got


def plan(tokens: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None) -> list[dict]:
    """Per listed source: whole passes, the hash below which one more copy is taken, and the tokens that gives.

    With a total, sources that can't give their share of it give all that max_repeat allows.
    """
    hist = _histogram(tokens, 0, None)
    have = {s: sum(h.values()) for s, h in hist.items()}
    live = [(s, w, m) for s, w, m in targets if have.get(s) and w > 0 and m > 0]
    if not live:
        return []
    weight = sum(w for _, w, _ in live)
    most = min(m * have[s] * weight / w for s, w, m in live)
    out = []
    left: dict[str, float] = {}
    for s, w, m in live:
        want = (most if total is None else total) * w / weight
        want = min(want, m * have[s])
        passes = int((want + 1e-6 * have[s]) // have[s])
        out.append({"source": s, "have": have[s], "want": want, "passes": passes, "threshold": 0, "part": 0})
        left[s] = want - passes * have[s]
    at: dict[str, int] = {}
    for level in range(LEVELS):
        if level:
            if not at:
                break
            hist = _histogram(tokens, level, at)
        nxt: dict[str, int] = {}
        for o in out:
            s = o["source"]
            if level and s not in at:
                continue
            rest = BITS * (LEVELS - 1 - level)
            low = at.get(s, 0) << BITS
            for b in range(low, low + (1 << BITS)):
                n = hist.get(s, {}).get(b, 0)
                if n > left[s]:
                    nxt[s] = b
                    break
                left[s] -= n
                o["part"] += n
                o["threshold"] = (b + 1) << rest
        at = nxt
    for o in out:
        o["taken"] = o["passes"] * o["have"] + o["part"]
    return out


def token_table(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = "") -> tuple[DataFrame, list[tuple[str, float, int]]]:
    listed = [(r["source"], float(r["target_share"]), int(r["max_repeat"])) for r in targets.where("source IS NOT NULL").dropDuplicates(["source"]).collect()]
    mine = docs.where(F.col(source).isin([s for s, _, _ in listed]))
    return cut(count_tokens(mine, key, text, source, path), "p7-tokens"), listed


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = "") -> DataFrame:
    """(key, source, copy_no, text): the mixed documents, one row a copy. targets is a small fixed table of sources."""
    tokens, listed = token_table(docs, targets, key, text, source, path)
    made = plan(tokens, listed)
    spark = docs.sparkSession
    p = spark.createDataFrame([(o["source"], o["passes"], o["threshold"]) for o in made], "source string, passes int, threshold long")
    d = docs.where(F.col(text) != "").select(F.col(key), F.col(source).alias("source"), F.col(text).alias("text"), hash_of(key).alias("h"))
    d = d.join(F.broadcast(p), "source").withColumn("copies", F.col("passes") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0))
    return d.where("copies > 0").select(key, "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "text")


def shares(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = "") -> DataFrame:
    """Per listed source: target share, tokens there, tokens taken, most and actual repeats, actual share."""
    tokens, listed = token_table(docs, targets, key, text, source, path)
    made = {o["source"]: o for o in plan(tokens, listed)}
    total = sum(o["taken"] for o in made.values()) or 1
    rows = [(s, w, m, made[s]["have"] if s in made else 0, made[s]["taken"] if s in made else 0, made[s]["taken"] / made[s]["have"] if s in made else 0.0, made[s]["taken"] / total if s in made else 0.0) for s, w, m in listed]
    return docs.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeat int, tokens long, tokens_taken long, repeats double, actual_share double")
