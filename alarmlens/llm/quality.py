"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are taken from the whole text: sizes, shares of kinds of characters, repetition of words, word pairs and
lines.  Trees are grown level by level on binned statistics (gradient and Hessian histograms, logistic loss) and kept
as flat arrays of one shape, children of node i at 2i + 1 and 2i + 2, so that scoring walks all trees of all rows of a
batch together.

Defined results: null and empty texts have statistics like any other (all zero) and so a score; repeated rows get equal
scores; without labelled rows of both kinds every score is 0.5.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, boxed, fitted_in_a_task
from .toxicity import labelled_sample

#: Labelled rows of each class that the trees are fitted on, at most.
PER_CLASS = 3000
DEPTH, TREES, RATE, BINS = 5, 120, 0.12, 64

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "same_again", "distinct_pairs", "upper", "digits", "closing",
    "symbols", "foreign", "bars", "exclamations", "log_lines", "mean_line", "distinct_lines", "symbol_words", "upper_words", "entropy", "wide_space", "markup", "closed_lines",
)

_KIND = np.zeros((256, 8), np.int64)  # upper, digits, closing marks, symbols, foreign bytes, bars, exclamation marks, markup
for _column, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"#$%&*@^~_=+\\", bytes(range(128, 256)), b"|", b"!", b"<>{}[]/")):
    _KIND[list(_chars), _column] = 1


def statistics(text: object) -> list[float]:
    """Statistics of one whole text, in the order of ``STATISTICS``."""
    data = as_bytes(text)
    n = len(data)
    words = data.split()
    if not words:
        return [math.log1p(n), *[0.0] * (len(STATISTICS) - 1)]
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = (counts @ _KIND) / n
    used = counts[counts > 0] / n
    m, pairs = len(words), max(1, len(words) - 1)
    by_word = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(n), math.log1p(m), sum(map(len, words)) / m, math.log1p(max(map(len, by_word))), len(by_word) / m, max(by_word.values()) / m,
        sum(map(eq, words, words[1:])) / pairs, len(set(zip(words, words[1:], strict=False))) / pairs, *kinds[:7].tolist(), math.log1p(len(lines)),
        math.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(c for w, c in by_word.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?") / m,
        sum(c for w, c in by_word.items() if w.isupper()) / m, float(-(used * np.log2(used)).sum()), data.count(b"  ") / n, float(kinds[7]),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
    ]


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # trees by inner nodes
    limit: np.ndarray  # trees by inner nodes: right if above
    value: np.ndarray  # trees by leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + math.exp(-self.base)))
        inner = self.feature.shape[1]
        tree = np.arange(len(self.feature))[None, :]
        out = np.empty(len(x))
        for lo in range(0, len(x), 2000):
            part = x[lo : lo + 2000]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            while node.size and node[0, 0] < inner:
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.limit[tree, node])
            out[lo : lo + 2000] = self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-(out + self.base)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boost trees of ``depth`` levels on rows ``x`` with labels 0 and 1."""
    y = np.asarray(y, np.float64)
    inner = 2**depth - 1
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max():
        return none
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    prior = y.mean()
    out = Trees(float(np.log(prior / (1 - prior))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    margin = np.full(n, out.base)
    flat = binned + np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * bins) + flat).ravel()
            size = count * width * bins
            gs = np.bincount(cell, np.repeat(g, width), size).reshape(count, width, bins).cumsum(axis=2)
            hs = np.bincount(cell, np.repeat(h, width), size).reshape(count, width, bins).cumsum(axis=2)
            g_all, h_all = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
            gain[(hs < least) | (h_all - hs < least)] = 0
            gain = gain.reshape(count, -1)
            best = gain.argmax(axis=1)
            feature, cut = best // bins, best % bins
            worth = gain[np.arange(count), best] > 1e-9
            for k in np.flatnonzero(worth):
                if cut[k] < len(edges[feature[k]]):
                    out.feature[t, first + k], out.limit[t, first + k] = feature[k], edges[feature[k]][cut[k]]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.limit[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        out.value[t] = -rate * gs / (hs + ridge)
        margin += out.value[t, leaf]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Trees:
    """Fit on at most ``per_class`` labelled training rows of each class, those of the least hashes."""
    def run(rows: pd.DataFrame) -> Trees:
        rows = rows.sort_values(["id", "label"], kind="stable")
        return train(np.array([statistics(t) for t in rows["text"]], np.float64).reshape(-1, len(STATISTICS)), rows["label"].to_numpy())

    return fitted_in_a_task(labelled_sample(docs, labels, "quality", id_col, text_col, 4, 2, per_class), run)


def scored(docs: DataFrame, trees: Trees, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 (in the place of a column of that name, if there)."""

    @F.pandas_udf(T.DoubleType())
    def udf(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(STATISTICS))
        return pd.Series(trees.predict(x))

    rows = boxed(docs).withColumn("_score", udf(F.col(f"_doc.`{text_col}`")))
    return rows.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c != out], F.col("_score").alias(out))
