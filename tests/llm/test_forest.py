"""The forest of problem 5: crowded nodes, depths by recall, labels side by side."""

import numpy as np
import pytest
from test_llm import brute

from quirel.llm import neardup


def test_depths_reach_the_target():
    for threshold in (0.3, 0.5, 0.6, 0.8, 0.95):
        assert neardup.expected_recall(threshold, threshold) >= neardup.TARGET_RECALL
        assert neardup.TREES * neardup.gain(threshold, neardup.first_depth(threshold)) >= neardup.needed()


def test_labels_side_by_side(spark):
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 4, (6, 2, neardup.TREES, neardup.DEEPEST))
    labels[0, 1] = labels[0, 0]
    labels[1] = [[[511]], [[255]]]
    packed = (labels << (np.arange(neardup.DEEPEST - 1, -1, -1) * neardup.BITS)).sum(3)
    df = spark.createDataFrame([(i, packed[i, 0].tolist(), packed[i, 1].tolist()) for i in range(6)], "i int, x array<long>, y array<long>")
    for r in df.select("i", neardup.label_similarity("x", "y").alias("s")).collect():
        assert r["s"] == pytest.approx((labels[r["i"], 0] == labels[r["i"], 1]).mean())


def test_template_shared_by_all_rows(spark, monkeypatch):
    """Every record holds the same template; only some are near duplicates. Crowded nodes go deeper or are joined in blocks."""
    monkeypatch.setattr(neardup, "CROWDED", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(3000)]
    template = list(rng.choice(vocab, 60))
    rows = []
    for g in range(60):
        own = list(rng.choice(vocab, 60))
        for k in range(3):
            w = list(own)
            for _ in range(int(rng.integers(0, 6)) * (k > 0)):
                w[int(rng.integers(0, 60))] = str(rng.choice(vocab))
            rows.append((len(rows), None, " ".join(template + w)))
    df = spark.createDataFrame(rows, "rid int, ti string, md string")
    links, members = neardup.similar(df, "rid", "ti", "md", size=3, threshold=0.6, min_words=30)
    assert {(r["a_id"], r["b_id"]) for r in neardup.record_pairs(links, members).collect()} == brute(rows, 3, 0.6, 30)
    groups = neardup.components(links, members).collect()
    assert len(groups) == len(rows) and sum(r["class_size"] for r in groups if r["id"] == r["rep"]) == len(rows)


def test_record_in_many_crowded_nodes_keeps_its_recall(spark):
    """However crowded a record's nodes are, the trees it stays in by depth keep its expected recall at the target."""
    threshold, start = 0.6, neardup.first_depth(0.6)
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 3, (200, neardup.TREES, neardup.DEEPEST))
    rows = [(i, 100, ((keys[i] << (np.arange(neardup.DEEPEST - 1, -1, -1) * neardup.BITS)).sum(1)).tolist()) for i in range(200)]
    rows = spark.createDataFrame(rows, "id int, n int, keys array<long>")
    at, slack, depth = rows.select("id", "n", neardup.F.posexplode("keys").alias("tree", "key")), neardup.F.lit(neardup.TREES * neardup.gain(threshold, start) - neardup.needed()), start
    gained = dict.fromkeys(range(200), neardup.TREES * neardup.gain(threshold, start))
    moved = 0
    while depth < neardup.DEEPEST:
        level = neardup._level(at, depth, threshold, slack).where("deeper").toPandas()
        moved += len(level)
        for i, n in level.groupby("id").size().items():
            gained[i] -= n * (neardup.gain(threshold, depth) - neardup.gain(threshold, depth + 1))
        if level.empty:
            break
        at, slack, depth = spark.createDataFrame(level[["id", "n", "tree", "key", "slack"]]), neardup.F.col("slack"), depth + 1
    assert moved and min(gained.values()) >= neardup.needed() - 1e-6
