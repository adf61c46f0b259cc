"""Problem 5: near-duplicate records, as pairs, and as groups.

Method: a MinHash LSH forest. Each record's set of word shingles gets, in each of TREES trees, a sequence of DEEPEST labels,
packed into one number so that sorting the numbers sorts the tree's leaves and a prefix of labels is a shift. Nodes are
prefixes; what shares a node is a candidate pair. The prefix a record is matched by is chosen for each record and tree from
the sizes of the nodes: the record's longest prefixes are kept where nodes are crowded, and shortened where they are not, for as
long as the recall expected of a pair just at the threshold stays at the target. (The nodes are computed from the short
prefixes on, so quiet branches are never walked to their leaves.) Candidates are weighed on their labels, which have a fixed
size, and what may reach the threshold is verified exactly on the shingle sets.

Exact copies (equal shingle sets) are one class from the start, so a class may hold a third of all rows without a single
pair being made for it; pairs of copies only come out where a result asks for pairs of records. A crowded node that the
recall doesn't let go deeper is joined in blocks of at most BLOCK by BLOCK rows, so that no task holds a whole node.

Defined results: records with empty or null text, or fewer words than min_words, take no part; null titles are empty;
repeated rows of an id count once (with different texts, the one whose class comes first); an empty table gives no pairs and
no groups.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirel.session import cut, discard, spread

#: Trees, labels of a tree's longest prefix, bits of a label (all labels of a tree make one number of 63 bits).
TREES, DEEPEST, BITS = 56, 7, 9
#: Recall wanted of a pair that is just at the threshold.
TARGET_RECALL = 0.999
#: Nodes of more records than this are crowded; blocks in which crowded nodes are joined.
CROWDED, BLOCK = 16, 512
#: Standard deviations by which the labels may fall short of the threshold before a candidate is dropped.
MARGIN = 6.0
#: Most nodes, or ids, (some 20 bytes each) that are broadcast to their leaves or texts; beyond it they are joined by shuffling.
NARROW = 1_000_000
SEED = 20240229
WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def gain(threshold: float, depth: int) -> float:
    """What a tree matched at this depth adds to -log(1 - recall) of a pair at the threshold."""
    return -math.log1p(-min(threshold, 1 - 1e-9) ** depth)


def needed(target: float = TARGET_RECALL) -> float:
    return -math.log1p(-target)


def first_depth(threshold: float) -> int:
    """The depth from which nodes are looked at: one label less than all trees together can afford."""
    depth = max((d for d in range(1, DEEPEST + 1) if TREES * gain(threshold, d) >= needed()), default=1)
    return depth if depth == DEEPEST else max(1, depth - 1)


def shingles(words: list[str], size: int, memo: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of size words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    hs = []
    for w in words:
        h = memo.get(w)
        if h is None:
            if len(memo) > 500_000:
                memo.clear()
            h = memo[w] = xxhash.xxh3_64_intdigest(w)
        hs.append(h)
    a = np.array(hs, np.uint64)
    out = np.zeros(len(a) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ a[i : len(a) - size + 1 + i]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _records(df: DataFrame, key: str, title: str | None, text: str) -> DataFrame:
    return spread(df.select(F.col(key).alias("id"), (F.coalesce(F.col(title), F.lit("")) if title else F.lit("")).alias("h"), F.col(text).alias("t")).where("t <> ''"))


def _sets(recs: DataFrame, size: int, min_words: int, labels: bool) -> DataFrame:
    """(id, cls, n, keys array<long>) or (id, cls, n, sh array<long>) of the records: class and size of the shingle set, and
    a leaf for each tree or the set itself."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 1 << 32, TREES * DEEPEST, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, TREES * DEEPEST, dtype=np.uint32)
    shifts = np.arange(DEEPEST - 1, -1, -1, dtype=np.int64) * BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for i, h, t in zip(pdf["id"], pdf["h"], pdf["t"]):
                words = WORD.findall(f"{h}\n{t}".lower())
                if len(words) < min_words:
                    continue
                s = shingles(words, size, memo)
                if not len(s):
                    continue
                if labels:
                    # Labels: bits of the least of a multiplicative hash, in blocks that stay in the cache.
                    x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
                    low = np.full(TREES * DEEPEST, 0xFFFFFFFF, np.uint32)
                    for k in range(0, len(x), 128):
                        np.minimum(low, (x[k : k + 128] * a + b).min(0), out=low)
                    lab = ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64).reshape(TREES, DEEPEST)
                    out = (lab << shifts).sum(1)
                else:
                    out = s.view(np.int64)
                rows.append((i, xxhash.xxh3_128_hexdigest(s.tobytes()), len(s), out))
            yield pd.DataFrame(rows, columns=["id", "cls", "n", "out"])

    return recs.mapInPandas(run, f"id {recs.schema['id'].dataType.simpleString()}, cls string, n int, out array<long>").withColumnRenamed("out", "keys" if labels else "sh")


def _prefix(depth: int) -> Column:
    return F.shiftright("key", BITS * (DEEPEST - depth))


def _level(rows: DataFrame, depth: int, threshold: float, slack: Column) -> DataFrame:
    """rows (id, n, tree, key) -> those that share their node of this depth, with its prefix p and size c, whether the
    row goes deeper, and the slack its record has left then.

    A record goes deeper in its most crowded trees, in as many as the slack of its expected recall pays for.
    """
    rows = rows.withColumn("p", _prefix(depth)).withColumn("slack", slack)
    sizes = cut(rows.groupBy("tree", "p").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "p5-nodes")
    shared = rows.join(F.broadcast(sizes) if sizes.count() <= NARROW else sizes, ["tree", "p"])
    if depth == DEEPEST:
        return shared.withColumn("deeper", F.lit(False))
    price = gain(threshold, depth) - gain(threshold, depth + 1)
    shared = shared.withColumn("crowded", F.col("c") > CROWDED)
    # At most TREES rows a record, and only those of crowded nodes count.
    own = Window.partitionBy("id", "crowded").orderBy(F.desc("c"), "tree")
    paid = F.floor(F.col("slack") / price + 1e-9)
    ranked = shared.where("crowded").withColumn("deeper", F.row_number().over(own) <= paid)
    ranked = ranked.withColumn("slack", F.col("slack") - price * F.sum(F.col("deeper").cast("int")).over(Window.partitionBy("id", "crowded")))
    return shared.where("NOT crowded").withColumn("deeper", F.lit(False)).unionByName(ranked).drop("crowded")


def _node_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of a level: each record that stays at the level with all of its node, crowded nodes in blocks."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit("block")), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    x = rows.where("NOT deeper").select("id", "n", "tree", "p", mine.alias("u"), every.alias("v")).alias("x")
    y = rows.select("id", "n", "tree", "p", "deeper", every.alias("u"), mine.alias("v")).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("tree", "p", "u", "v")]
    once = (F.col("x.id") < F.col("y.id")) | (F.col("y.deeper") & (F.col("x.id") != F.col("y.id")))
    fits = F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9
    return x.join(y, [*same, once, fits]).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, distinct: pairs of records (id, n, keys) that share a node of the forest by either one's prefix."""
    depth = first_depth(threshold)
    rows = reps.select("id", "n", F.posexplode("keys").alias("tree", "key"))
    slack: Column = F.lit(TREES * gain(threshold, depth) - needed())
    found = []
    while True:
        level = cut(_level(rows, depth, threshold, slack), "p5-level")
        found.append(_node_pairs(level, threshold))
        if depth == DEEPEST or not level.where("deeper").limit(1).count():
            break
        rows, slack, depth = level.where("deeper").select("id", "n", "tree", "key", "slack"), F.col("slack"), depth + 1
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    return pairs.distinct()


def label_similarity(x: str, y: str) -> Column:
    """Share of equal labels of two leaf arrays; a tree's labels are compared side by side inside the number."""
    ones = sum(1 << (BITS * i) for i in range(DEEPEST))
    low, high = ones * ((1 << (BITS - 1)) - 1), ones << (BITS - 1)
    # A field of the xor is zero if neither its high bit nor any lower one is set; adding carries the lower ones into the high one.
    differing = F.aggregate(F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q)), F.lit(0), lambda acc, z: acc + F.bit_count((z.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(z).bitwiseAND(F.lit(high))))
    return 1 - differing / (TREES * DEEPEST)


def similar(df: DataFrame, key: str, title: str | None, text: str, *, size: int = 5, threshold: float = 0.8, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(links, members): links(a, b, sim) between class representatives, a < b; members(id, rep) of every record that takes part."""
    recs = _records(df, key, title, text)
    sk = cut(_sets(recs, size, min_words, True), "p5-sketch")
    # One class an id, one representative a class: both from two narrow columns, so that texts and sets are never shuffled for it.
    chosen = sk.groupBy("id").agg(F.min("cls").alias("cls"))
    classes = chosen.groupBy("cls").agg(F.min("id").alias("rep"))
    members = chosen.join(classes, "cls").select("id", "rep")
    reps = cut(sk.join(classes.select("cls", F.col("rep").alias("id")), ["cls", "id"], "left_semi").dropDuplicates(["id"]), "p5-reps")
    pairs = candidates(reps, threshold)
    for s in "ab":
        pairs = pairs.join(reps.select(F.col("id").alias(s), F.col("keys").alias(f"k{s}")), s)
    # The labels' share of equals has this deviation at the threshold.
    spread = math.sqrt(threshold * (1 - threshold) / (TREES * DEEPEST))
    likely = cut(pairs.where(label_similarity("ka", "kb") >= threshold - MARGIN * spread).select("a", "b"), "p5-pairs")
    # The sets themselves are made again, of the records in likely pairs only.
    ends = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    near = F.broadcast(ends) if ends.count() <= NARROW else ends
    sets = _sets(recs.join(near, "id", "left_semi"), size, min_words, False).join(reps.select("id", "cls"), ["id", "cls"], "left_semi").select("id", "n", "sh")
    v = likely
    for s in "ab":
        v = v.join(sets.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sh").alias(f"s{s}")), s)
    both = F.size(F.array_intersect("sa", "sb"))
    v = v.select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("sim"))
    return v.where(F.col("sim") >= threshold - 1e-12).distinct(), members


def record_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a_id, b_id) with a_id < b_id of all similar records, copies included: only for results that are defined as pairs."""
    ma = members.select(F.col("rep").alias("a"), F.col("id").alias("p"))
    mb = members.select(F.col("rep").alias("b"), F.col("id").alias("q"))
    across = links.select("a", "b").join(ma, "a").join(mb, "b").select("p", "q")
    within = ma.join(mb, (F.col("a") == F.col("b")) & (F.col("p") < F.col("q"))).select("p", "q")
    return across.unionByName(within).select(F.least("p", "q").alias("a_id"), F.greatest("p", "q").alias("b_id"))


def components(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, rep, class_size, group_id, n_links): each record with its class, the least id of its connected component and
    the number of other texts its class is similar to.

    Labels go to the least neighbour's label and then to that label's own label (pointer jumping), so the number of
    rounds grows with the logarithm of a component's diameter; each round's labels are written to the shared folder and
    deleted after the next.
    """
    pairs = cut(links.select("a", "b"), "p5-links")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l"), F.count(F.lit(1)).alias("n")), "p5-label")
    while True:
        near = both.join(label.select(F.col("a").alias("b"), F.col("l").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("m"))
        nxt = label.join(near, "a").select("a", "n", F.col("l").alias("old"), F.least("l", "m").alias("m"))
        jump = label.select(F.col("a").alias("m"), F.col("l").alias("j"))
        nxt = cut(nxt.join(jump, "m", "left").select("a", "n", "old", F.least("m", F.coalesce("j", "m")).alias("l")), "p5-label")
        changed = nxt.where("l <> old").limit(1).count()
        discard(label)
        label = nxt
        if not changed:
            break
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("class_size"))
    ends = sizes.join(label.select(F.col("a").alias("rep"), "l", "n"), "rep", "left")
    return members.join(ends, "rep").select("id", "rep", "class_size", F.coalesce("l", "rep").alias("group_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"))


def expected_recall(similarity: float, threshold: float) -> float:
    """Chance, at least, that a pair of this similarity becomes a candidate when every tree is as deep as the target allows."""
    depth = max((d for d in range(1, DEEPEST + 1) if TREES * gain(threshold, d) >= needed()), default=1)
    return 1 - (1 - similarity**depth) ** TREES
