"""Problem 8: a language for each page and for each stretch of it.

Method: unigram models over the pieces of a fixed public vocabulary, one for each language. A word's score is the sum
over all its segmentations into pieces, by the forward algorithm; the probabilities are fitted by expectation-
maximization on a bounded sample of labelled pages (SAMPLE a language, picked by hash), whose labels are then replaced
by the model's own decoding before a second fit, as some are wrong. Pages are decoded word by word, in reading order, by
the best path with a price on changing language.

Defined results: null, empty and letterless pages have no language; labels that the alias table doesn't know name none;
without any labelled page there is no model and no result; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirel.session import spread

from .reading import page_lines, running_words

#: Labelled pages a language that the models are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 150, 3
#: Price of a change of language, most that one word can count against a language, and letters of a unit: longer words (scripts
#: without spaces) are taken as several units, so that each part has its own score.
SWITCH, CLIP, UNIT = 7.0, 6.0, 32
#: Probability of a character outside the vocabulary, and weight of the pooled model in each language's.
UNKNOWN, POOLED = 1e-7, 400.0
NOT_LETTER = re.compile(r"[\W\d_]+")


def pieces(path: str = "") -> dict[str, int]:
    """Piece -> number of the vocabulary's lower-case pieces; a leading low line marks the start of a word."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    out: dict[str, int] = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if p == "▁" or sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        p = p.replace("▁", "_")
        body = p[1:] if p[0] == "_" else p
        if body.isalpha() and body == body.lower():
            out.setdefault(p, len(out))
    return out


def clean(word: str) -> str:
    """Lower-case letters of a word."""
    w = word.lower()
    return w if w.isalpha() else NOT_LETTER.sub("", w)


def units(words: list[str]) -> list[str]:
    """The words, those of more than UNIT characters in consecutive parts of that length."""
    if not words or max(map(len, words)) <= UNIT:
        return words
    return [w[k : k + UNIT] for w in words for k in range(0, len(w), UNIT)]


class PieceTable:
    """Pieces by the hash of their letters, one sorted table for each length, so that words are looked up side by side."""

    PRIME = np.uint64(0x100000001B3)

    def __init__(self, vocab: dict[str, int]):
        self.size = len(vocab)
        self.longest = max(map(len, vocab), default=1)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[tuple[int, int]]] = {}
        for p, i in vocab.items():
            h = 0
            for c in p:
                h = (h * int(self.PRIME) + ord(c) + 1) % (1 << 64)
            by.setdefault(len(p), []).append((h, i))
        for k, rows in by.items():
            rows.sort()
            self.tables[k] = np.array([h for h, _ in rows], np.uint64), np.array([i for _, i in rows], np.int32)

    def find(self, k: int, h: np.ndarray, none: int) -> np.ndarray:
        if k not in self.tables:
            return np.full(h.shape, none, np.int32)
        keys, ids = self.tables[k]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, ids[at], none).astype(np.int32)


def lattice(words: list[str], table: PieceTable) -> np.ndarray:
    """Piece numbers by word, end and length (words of one length); table.size is no piece, one more an unknown character."""
    n, none = len(words[0]) + 1, table.size
    longest = min(table.longest, n)
    codes = np.frombuffer("".join("_" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(words), n) + np.uint64(1)
    out = np.full((len(words), n, longest), none, np.int32)
    h = codes
    out[:, :, 0] = table.find(1, h, none + 1)
    for k in range(2, longest + 1):
        h = h[:, :-1] * PieceTable.PRIME + codes[:, k - 1 :]
        out[:, k - 1 :, k - 1] = table.find(k, h, none)
    return out


def forward(lat: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha (word, place, language) of the lattice; prob is (piece, language)."""
    w, n, longest = lat.shape
    alpha = np.zeros((w, n + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, n + 1):
        for k in range(1, min(longest, j) + 1):
            alpha[:, j] += alpha[:, j - k] * prob[lat[:, j - 1, k - 1]]
    return alpha


def expected(lat: np.ndarray, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected piece counts (piece, language) over all segmentations; count is (word, language)."""
    w, n, longest = lat.shape
    alpha = forward(lat, prob)
    beta = np.zeros_like(alpha)
    beta[:, n] = 1
    out = np.zeros_like(prob)
    every, parts = [], []
    scale = count / np.maximum(alpha[:, n], 1e-300)
    for j in range(n, 0, -1):
        for k in range(1, min(longest, j) + 1):
            ids = lat[:, j - 1, k - 1]
            p = prob[ids]
            beta[:, j - k] += beta[:, j] * p
    for j in range(1, n + 1):
        for k in range(1, min(longest, j) + 1):
            ids = lat[:, j - 1, k - 1]
            every.append(ids)
            parts.append(alpha[:, j - k] * prob[ids] * beta[:, j] * scale)
    ids, part = np.concatenate(every), np.concatenate(parts)
    for x in range(out.shape[1]):
        out[:, x] = np.bincount(ids, part[:, x], out.shape[0])
    return out


def normalize(c: np.ndarray, n: int) -> np.ndarray:
    """Counts to probabilities: each language's counts with POOLED of the pooled distribution; last two rows: none, unknown."""
    c = c[:n]
    pool = c.sum(1) + 0.1
    pool /= pool.sum()
    p = (c + POOLED * pool[:, None]) / (c.sum(0) + POOLED)
    return np.vstack([p, np.zeros(p.shape[1]), np.full(p.shape[1], UNKNOWN)])


@dataclass
class Model:
    langs: list[str]
    table: PieceTable
    prob: np.ndarray
    #: Scored words: place in scores, which grows.
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))

    def score(self, words: list[str]) -> np.ndarray:
        """log p(word | language), less the best, not below -CLIP; rows follow words."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, at in by.items():
            if not n:
                continue
            for a in range(0, len(at), 2000):
                part = at[a : a + 2000]
                lat = lattice([words[i] for i in part], self.table)
                s = np.log(np.maximum(forward(lat, self.prob)[:, -1], 1e-300))
                out[part] = np.maximum(s - s.max(1, keepdims=True), -CLIP)
        return out

    def places(self, raw: list[str]) -> list[int]:
        """Place of each word's scores; 0 stands for a word without letters. Call before reading scores."""
        known = self.known
        new = {w for w in raw if w not in known}
        if new:
            if len(known) > 300_000:
                known.clear()
                self.scores = np.zeros((1, len(self.langs)), np.float32)
                new = set(raw)
            if not self.scores.shape[1]:
                self.scores = np.zeros((1, len(self.langs)), np.float32)
            letters = {w: clean(w) for w in new}
            todo = sorted({c for c in letters.values() if c})
            first = len(self.scores)
            number = {c: first + i for i, c in enumerate(todo)}
            if todo:
                self.scores = np.vstack([self.scores, self.score(todo)])
            for w, c in letters.items():
                known[w] = number[c] if c else 0
        return [known[w] for w in raw]


def best_paths(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Language of each word of each page: the best path with SWITCH as the price of a change. Pages are taken side by side."""
    langs = scores.shape[1]
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(lengths)
    order = np.argsort(lengths, kind="stable")
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * lengths[order[b]] <= 400_000:
            b += 1
        part = order[a:b]
        a = b
        t = int(lengths[part].max())
        if not t:
            continue
        where = starts[part][:, None] + np.arange(t)
        inside = np.arange(t) < lengths[part][:, None]
        e = np.where(inside[:, :, None], scores[np.where(inside, where, 0)], 0).astype(np.float32)
        back = np.zeros((t, len(part), langs), np.int8)
        v = e[:, 0]
        stay = np.arange(langs, dtype=np.int8)
        for i in range(1, t):
            top = v.argmax(1).astype(np.int8)
            jump = v.max(1) - SWITCH
            go = jump[:, None] > v
            back[i] = np.where(go, top[:, None], stay)
            v = np.where(go, jump[:, None], v) + e[:, i]
        path = np.zeros((len(part), t), np.int8)
        s = v.argmax(1).astype(np.int8)
        rows = np.arange(len(part))
        for i in range(t - 1, -1, -1):
            path[:, i] = s
            s = back[i, rows, s]
        for r, p in enumerate(part):
            out[p] = path[r, : lengths[p]]
    return out


def decode(model: Model, pages: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(languages by word, scores of all words, start of each page, words' letters) for pages given as word lists."""
    lengths = np.array([len(p) for p in pages], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(pages) else np.zeros(0, np.int64)
    flat = [w for p in pages for w in p]
    at = np.array(model.places(flat), np.int64) if flat else np.zeros(0, np.int64)
    scores = model.scores[at] if len(at) else np.zeros((0, len(model.langs)), np.float32)
    sizes = np.where(at > 0, np.fromiter(map(len, flat), np.int64, len(flat)), 0)
    return best_paths(scores, starts, lengths), scores, starts, sizes


def fit(sample: pd.DataFrame, langs: list[str], vocab: dict[str, int]) -> Model:
    """Models from labelled pages (columns lang, words): labels first, then the models' own decoding in place of labels."""
    table = PieceTable(vocab)
    n, k = len(vocab), len(langs)
    number = {a: i for i, a in enumerate(langs)}
    memo: dict[str, str] = {}
    pages = [[memo[w] if w in memo else memo.setdefault(w, clean(w)) for w in p] for p in sample["words"]]
    every = sorted({c for p in pages for c in p if c}, key=lambda c: (len(c), c))
    place = {c: i for i, c in enumerate(every, 1)} | {"": 0}
    lengths = np.array([len(p) for p in pages], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.array([place[c] for p in pages for c in p], np.int64)
    tags = np.repeat(np.array([number[a] for a in sample["lang"]], np.int64), lengths)
    lats: list[tuple[int, int, np.ndarray]] = []
    a = 0
    while a < len(every):
        b = a
        while b < len(every) and len(every[b]) == len(every[a]) and b - a < 4000:
            b += 1
        lats.append((a, b, lattice(every[a:b], table)))
        a = b
    prob = normalize(np.ones((n, k)), n)
    for round_ in range(ROUNDS):
        count = np.zeros((len(every) + 1, k))
        np.add.at(count, (flat, tags), 1)
        for _ in range(3 if round_ == 0 else 2):
            c = np.zeros_like(prob)
            for a, b, lat in lats:
                c += expected(lat, prob, count[a + 1 : b + 1])
            prob = normalize(c, n)
        scores = np.zeros((len(every) + 1, k), np.float32)
        for a, b, lat in lats:
            s = np.log(np.maximum(forward(lat, prob)[:, -1], 1e-300))
            scores[a + 1 : b + 1] = np.maximum(s - s.max(1, keepdims=True), -CLIP)
        if len(flat):
            tags = np.concatenate(best_paths(scores[flat], starts, lengths)).astype(np.int64)
    return Model(langs, table, prob)


def train(docs: DataFrame, alias: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", boxes: str = "line_boxes", path: str = "") -> Model | None:
    """The model from at most about SAMPLE labelled pages a language, picked by the hash of their key."""
    named = F.broadcast(alias.select(F.col("alias").alias("__a"), F.col("lang").alias("__l")).dropDuplicates(["__a"]))
    labelled = docs.select(F.col(key).alias("id"), F.col(lang).alias("__lab"), F.col(text).alias("t"), *[F.col(f"{boxes}.{c}").alias(c) for c in "xyw"]).where("t <> ''")
    counts = dict(labelled.join(named, F.col("__lab") == F.col("__a")).groupBy("__l").count().orderBy("__l").collect())
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for a, c in counts.items() for v in (a, min(1.0, SAMPLE / c))])
    pick = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1_000_003)) < share[F.col("__l")] * 1_000_003
    pdf = labelled.join(named, F.col("__lab") == F.col("__a")).where(pick).toPandas().sort_values("id")
    words = [units(running_words(page_lines(*r), False)[0]) for r in pdf[["t", "x", "y", "w"]].itertuples(index=False, name=None)]
    return fit(pd.DataFrame({"lang": pdf["__l"].to_numpy(), "words": words}), sorted(counts), pieces(path))


def stretches(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", boxes: str = "line_boxes") -> DataFrame:
    """(id, seg_no, lang, confidence, first_word, n_words, n_chars, page_chars): each page's stretches in one language.

    Words are the page's white-space words, each part of a word of more than UNIT characters counting as one.
    """
    schema = f"id {docs.schema[key].dataType.simpleString()}, seg_no int, lang string, confidence double, first_word int, n_words int, n_chars int, page_chars int"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.prob))
    recs = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("t"), *[F.col(f"{boxes}.{c}").alias(c) for c in "xyw"]).where("t <> ''"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for pdf in batches:
            for a in range(0, len(pdf), 1000):
                part = pdf.iloc[a : a + 1000]
                pages = [units(running_words(page_lines(*r), False)[0]) for r in part[["t", "x", "y", "w"]].itertuples(index=False, name=None)]
                paths, scores, starts, sizes = decode(m, pages)
                rows = []
                for i, path, s in zip(part["id"], paths, starts):
                    size = sizes[s : s + len(path)]
                    total = int(size.sum())
                    if not total:
                        continue
                    edges = np.flatnonzero(np.diff(path)) + 1
                    bounds = [0, *edges.tolist(), len(path)]
                    for no, (x, y) in enumerate(zip(bounds, bounds[1:]), 1):
                        sums = scores[s + x : s + y].sum(0)
                        gap = np.delete(sums, path[x]) - sums[path[x]]
                        rows.append((i, no, m.langs[path[x]], float(1 / (1 + np.exp(np.clip(gap / 4, -50, 50)).sum())), x, y - x, int(size[x:y].sum()), total))
                yield pd.DataFrame(rows, columns=["id", "seg_no", "lang", "confidence", "first_word", "n_words", "n_chars", "page_chars"])

    return recs.mapInPandas(run, schema)


def page_languages(segs: DataFrame) -> DataFrame:
    """(id, lang, share, confidence): each language of each page, with its share of the page's letters."""
    g = segs.groupBy("id", "lang").agg((F.sum("n_chars") / F.first("page_chars")).alias("share"), (F.sum(F.col("confidence") * F.col("n_chars")) / F.greatest(F.sum("n_chars"), F.lit(1))).alias("confidence"))
    return g.select("id", "lang", F.round("share", 6).alias("share"), F.round("confidence", 6).alias("confidence"))
