"""Quality rules: fixed limits first, then an isolation forest on rule statistics.

Each text's words, lines, symbols, repeated 8-word windows and words that stand
twice in a row are counted in one pass over the whole text. Documents of fewer
than 20 words, or with more than 30 % of their words in repeated windows, fail
at once. For the others, ratios of the counts, as far as they are beyond a band
of usual values, go through an isolation forest: random splits part odd
documents from the rest after few steps, so a short mean path marks them.

Band and trees come from a bounded sample of labelled documents, SAMPLE of them
by smallest hash of their id. The band is the range of the sample's good rows
with a margin, as good documents may repeat lines that would look odder than a
few symbols do. The trees see no labels: they are grown on random rows of the
sample. A split's feature and value are drawn from the sample's whole range, or
the band's width if that is more, and not from a node's own rows, so that splits
also reach values that few rows or none have; a row that falls where no row of the
tree did is odd.
The threshold comes from all labelled rows that the sample leaves out, among
those that the fixed limits pass: the score that rejects the most rows of quality
0 while it rejects at most `loss` of those of quality 1, put midway to the next
score above. Scores are counted in steps of 0.0001, so what meets on the driver
is bounded. Half of the labelled ids, by hash, are never in the sample. With no labels in
either half, or none of quality 1, only the fixed limits hold.

Defined results: a null text has no words and fails. Repeated rows are judged
each on its own. An empty table gives an empty result. Rows of labels with a
null id or quality are passed over; of several labels for one id, the lowest
counts. Other columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, filter_rows, map_rows, texts

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Labelled documents that band and trees come from.
SAMPLE = 4096
#: Trees, documents of a tree, and the part of good labelled rows that may be lost.
TREES, PER_TREE, LOSS = 200, 256, 0.002
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_next")
STATS = ", ".join(f"{c} long" for c in COUNTS)
#: How far beyond the good documents' range the band of usual values goes, as a part of that range.
MARGIN = 0.25
#: Steps of a score when scores are counted.
STEPS = 10_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows found twice or more, the first finding included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) > len(words) - 2:  # a repeated window repeats its words
        return 0
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key = (key ^ ids[i : i + n].astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    suspect = np.zeros(n, bool)
    suspect[order[1:][same]] = True
    suspect[order[:-1][same]] = True
    first: dict[bytes, int] = {}
    again = np.zeros(n, bool)
    for i in np.flatnonzero(suspect).tolist():  # the windows themselves decide
        w = ids[i : i + window].tobytes()
        if (j := first.setdefault(w, i)) != i:
            again[i] = again[j] = True
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += again
    cover[window : window + n] -= again
    return int((np.cumsum(cover) > 0).sum())


def stats(text: str) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word), n_same_next (words that the next one repeats)."""
    words = text.encode().split()
    if not words:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), sum(map(eq, words, words[1:]))


def base_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def features(s: np.ndarray) -> np.ndarray:
    """Ratios from rows of stats: symbols by word and by character, characters by word, and the parts of repeated lines, words in repeated windows and words that the next one repeats.

    None depends on a document's length.
    """
    words, chars, symbols, dup, repeat, lines, same = s.astype(float).T
    words, lines = np.maximum(words, 1), np.maximum(lines, 1)
    return np.stack([symbols / words, symbols / np.maximum(chars, 1), chars / words, dup / lines, repeat / words, same / words], axis=1)


class Band:
    """The range of the good documents' features, and a margin. What is within doesn't count, so that usual variation costs no splits."""

    def __init__(self, good: np.ndarray):
        low, high = good.min(0), good.max(0)
        self.low, self.high = low - MARGIN * (high - low), high + MARGIN * (high - low)

    def outside(self, x: np.ndarray) -> np.ndarray:
        """How far each feature is below or above."""
        return np.maximum(np.maximum(self.low - x, x - self.high), 0.0)


class Forest:
    """Isolation trees in arrays: feature, split value and children by node; a leaf leads to itself."""

    def __init__(self, x: np.ndarray, reach: np.ndarray, seed: int = 7, trees: int = TREES, per_tree: int = PER_TREE):
        rng = np.random.default_rng(seed)
        self.size = min(per_tree, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        built = [self._tree(x[rng.choice(len(x), self.size, replace=False)], np.zeros(x.shape[1]), np.maximum(reach, x.max(0)), rng) for _ in range(trees)]
        nodes = max(len(t) for t in built)
        pad = [t + [(0, 0.0, 0, 0, 0.0)] * (nodes - len(t)) for t in built]
        self.feature = np.array([[n[0] for n in t] for t in pad])
        self.value = np.array([[n[1] for n in t] for t in pad])
        self.left = np.array([[n[2] for n in t] for t in pad])
        self.right = np.array([[n[3] for n in t] for t in pad])
        self.path = np.array([[n[4] for n in t] for t in pad])

    @staticmethod
    def mean_path(n: int) -> float:
        """Mean path of a search that fails among n rows: what stands for the part of a tree not built."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _tree(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, rng) -> list[tuple]:
        nodes: list = []

        def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append(None)
            wide = np.flatnonzero(high > low)
            if depth >= self.depth or len(rows) < 2 or not len(wide):
                nodes[at] = (0, 0.0, at, at, depth + self.mean_path(len(rows)))
                return at
            f = int(rng.choice(wide))
            v = float(rng.uniform(low[f], high[f]))
            under = rows[:, f] <= v
            below, above = high.copy(), low.copy()
            below[f] = above[f] = v
            nodes[at] = (f, v, grow(rows[under], low, below, depth + 1), grow(rows[~under], above, high, depth + 1), 0.0)
            return at

        grow(x, low, high, 0)
        return nodes

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the higher, the sooner random splits part a row from the others."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left, right, path in zip(self.feature, self.value, self.left, self.right, self.path, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= value[at], left[at], right[at])
            total += path[at]
        return 2.0 ** (-total / len(self.path) / max(self.mean_path(self.size), 1e-9))


def calibrate(steps: np.ndarray, good: np.ndarray, poor: np.ndarray, loss: float = LOSS) -> float:
    """The threshold, from the numbers of good and poor rows at each step of the score; rows above it are rejected."""
    order = np.argsort(steps)
    steps, good, poor = steps[order], good[order], poor[order]
    lost = good.sum() - np.cumsum(good)  # good rows above each step
    top = int(np.flatnonzero(lost <= int(loss * good.sum()))[0])
    above = np.flatnonzero(poor[top + 1 :] > 0)
    return float((steps[top] + steps[top + 1 + above[0]]) / 2 / STEPS) if len(above) else float("inf")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and counts of every row."""

    def start():
        return lambda ids, batch: {"doc_id": ids} | dict(zip(COUNTS, zip(*map(stats, batch)), strict=True))

    return map_rows(texts(docs), f"doc_id long, {STATS}", start)


def fit(rows: DataFrame, labels: DataFrame | None, sample: int = SAMPLE, loss: float = LOSS) -> tuple[Band, Forest, float] | None:
    """Band, forest and threshold; rows as from counted()."""
    if labels is None:
        return None
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("quality"))
    judged = rows.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(known, F.col("doc_id") == F.col("l_id"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    chosen = judged.where(half == 0).orderBy(F.xxhash64("doc_id"), *COUNTS).limit(sample).select("quality", *COUNTS).collect()  # bounded by sample
    if not any(r[0] for r in chosen):
        return None
    x = features(np.array([tuple(r)[1:] for r in chosen]))
    band = Band(x[[r[0] != 0 for r in chosen]])
    forest = Forest(band.outside(x), band.high - band.low)

    def start():
        return lambda quality, *s: {"quality": quality, "step": np.round(STEPS * forest.score(band.outside(features(np.array(s).T)))).astype(int)}

    held = map_rows(judged.where(half == 1).select("quality", *COUNTS), "quality int, step int", start)
    found = held.groupBy("step").agg(F.count_if(F.col("quality") != 0), F.count_if(F.col("quality") == 0)).collect()  # STEPS rows at most
    steps, good, poor = np.array([tuple(r) for r in found]).reshape(-1, 3).T
    return (band, forest, calibrate(steps, good, poor, loss)) if good.sum() else None


def _verdict(model, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept and score from rows of stats."""
    failed = base_failed(s[:, 0], s[:, 4])
    score = model[1].score(model[0].outside(features(s))) if model else np.zeros(len(s))
    return failed, ~failed & (score <= model[2]) if model else ~failed, score


def judge(docs: DataFrame, labels: DataFrame | None, sample: int = SAMPLE, loss: float = LOSS) -> DataFrame:
    """Every row's counts and verdict: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.cut(counted(docs))
    model = fit(rows, labels, sample, loss)

    def start():
        def batch(ids, *s):
            failed, kept, score = _verdict(model, np.array(s).T)
            return {"doc_id": ids, **dict(zip(COUNTS[:5], s[:5], strict=True)), "base_failed": failed, "kept": kept, "score": score}

        return batch

    return scratch.result(map_rows(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double", start))


def passing(docs: DataFrame, labels: DataFrame | None, sample: int = SAMPLE, loss: float = LOSS) -> DataFrame:
    """The rows of docs that are kept, with all their columns, each judged on its own text where it is; no row moves."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(scratch.cut(counted(docs)), labels, sample, loss) if labels is not None else None
    return scratch.result(filter_rows(docs, "text", lambda: lambda batch: _verdict(model, np.array([stats(t or "") for t in batch]))[1].tolist()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
