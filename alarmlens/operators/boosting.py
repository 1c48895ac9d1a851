"""Boosted trees grown leaf by leaf, from histograms that Spark adds up.

Features are cut into bins once; a missing value has a bin of its own and goes to the better side of each split.  Rows stay
in a stored table of bins, labels and margins.  A leaf's histogram is one grouped sum of gradients over (feature, bin), of
whole numbers, so that it does not depend on the order of the rows; of two new leaves the smaller one is counted and the other
is the difference.  The driver holds histograms, which are features times bins, and always splits the leaf of the largest
gain.  Each tree is added to the margins by storing the table again."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import stored

#: Gradients are counted in this many parts of one.
UNIT = 1 << 28


@dataclass
class Tree:
    """``splits``: (leaf, feature, last bin to the left, whether missing goes left); the right side of the k-th split is leaf
    k + 1, the left side keeps its number."""

    splits: list[tuple[int, int, int, bool]] = field(default_factory=list)
    values: list[float] = field(default_factory=list)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for k, (leaf, feature, last, missing_left) in enumerate(self.splits):
            b = bins[:, feature]
            left = np.where(b == 0, missing_left, b <= last)
            at[(at == leaf) & ~left] = k + 1
        return at


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]  # of each feature the upper ends of its bins but the last, rising
    base: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, columns: list[pd.Series]) -> np.ndarray:
        """0 for missing, else 1 and the number of edges below the value."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for k, (c, e) in enumerate(zip(columns, self.edges, strict=True)):
            x = pd.to_numeric(c).to_numpy(np.float64, na_value=np.nan)
            out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, side="left"))
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for tree in self.trees:
            total += np.array(tree.values)[tree.leaves(bins)]
        return total

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """``df`` with the probability of label 1."""

        @F.pandas_udf("double")
        def udf(*columns: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-self.margins(self.bins(list(columns))))))

        return df.withColumn(out, udf(*[F.col(c).cast("double") for c in self.features]))


def best_split(hist: np.ndarray, least: int, l2: float) -> tuple[float, int, int, bool] | None:
    """(gain, feature, last bin to the left, missing left) of ``hist`` (feature, bin, [gradient, hessian, rows]) in whole
    numbers; the first of equal ones; None if there is no gain."""
    value = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + l2, 1e-12)
    whole = hist[0].sum(axis=0)
    scale = np.array([1 / UNIT, 1 / UNIT, 1.0])
    best = None
    for missing_left in (True, False):
        left = np.cumsum(hist[:, 1:], axis=1)[:, :-1] + (hist[:, :1] if missing_left else 0)
        right = whole - left
        gain = value(left * scale) + value(right * scale) - value(whole * scale)
        gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), gain, -np.inf)
        if gain.size and gain.max() > 1e-9 and (best is None or gain.max() > best[0]):
            feature, last = np.unravel_index(int(gain.argmax()), gain.shape)
            best = float(gain.max()), int(feature), int(last) + 1, missing_left
    return best


def _goes(split: tuple[int, int, int, bool], left: bool) -> Column:
    _, feature, last, missing_left = split
    b = F.col(f"b{feature}")
    to_left = (b <= last) if missing_left else (b <= last) & (b > 0)
    return to_left if left else ~to_left


def _added(tree: Tree):
    @F.pandas_udf("double")
    def added(margin: pd.Series, *columns: pd.Series) -> pd.Series:
        return margin + np.array(tree.values)[tree.leaves(np.column_stack(columns))]

    return added


def fit_gbt(df: DataFrame, features: list[str], trees: int = 300, leaves: int = 31, rate: float = 0.05, least: int = 200, bins: int = 64, l2: float = 0.0, label: str = "label") -> Boosted:
    """Boosting of the logistic loss.  ``least``: rows of a leaf; ``bins``: at most so many of a feature, by quantiles."""
    numbers = [F.col(c).cast("double") for c in features]
    cuts = [k / bins for k in range(1, bins)]
    told = df.agg(F.avg(F.col(label).cast("double")), *[F.percentile_approx(F.when(~F.isnan(c), c), cuts, 100_000) for c in numbers]).first()
    rate_of_ones = min(max(told[0] or 0.0, 1e-6), 1 - 1e-6)
    model = Boosted(features, [np.unique(np.array(q or [], np.float64)) for q in told[1:]], float(np.log(rate_of_ones / (1 - rate_of_ones))))
    names = [f"b{k}" for k in range(len(features))]

    @F.pandas_udf(", ".join(f"{n} int" for n in names))
    def binned(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.bins(list(columns)).astype(np.int32), columns=names)

    rows = df.select(F.col(label).cast("double").alias("label"), binned(*numbers).alias("b")).select("label", F.lit(model.base).alias("margin"), "b.*")
    rows = stored(rows.filter("label IS NOT NULL"), "boosting")
    width = max((len(e) for e in model.edges), default=0) + 2

    def histogram(path: list[Column], table: DataFrame) -> np.ndarray:
        for step in path:
            table = table.filter(step)
        p = 1 / (1 + F.exp(-F.col("margin")))
        gradient, hessian = ((F.round(x * UNIT)).cast("long") for x in (p - F.col("label"), p * (1 - p)))
        cells = table.select(gradient.alias("g"), hessian.alias("h"), F.posexplode(F.array(*names)).alias("f", "b"))
        out = np.zeros((len(features), width, 3), np.int64)
        for r in cells.groupBy("f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect():  # features times bins
            out[r["f"], r["b"]] = r["g"], r["h"], r["n"]
        return out

    for _ in range(trees):
        tree, paths = Tree(), [[]]
        hists = [histogram([], rows)]
        splits = [best_split(hists[0], least, l2)]
        while len(hists) < leaves and any(splits):
            leaf = max((k for k, s in enumerate(splits) if s), key=lambda k: (splits[k][0], -k))
            _, feature, last, missing_left = splits[leaf]
            split = (leaf, feature, last, missing_left)
            to_left = hists[leaf][feature, 1 : last + 1, 2].sum() + (hists[leaf][feature, 0, 2] if missing_left else 0)
            small_left = 2 * to_left <= hists[leaf][0, :, 2].sum()
            small = histogram([*paths[leaf], _goes(split, bool(small_left))], rows)
            other = hists[leaf] - small
            paths.append([*paths[leaf], _goes(split, False)])
            paths[leaf] = [*paths[leaf], _goes(split, True)]
            hists[leaf], right = (small, other) if small_left else (other, small)
            hists.append(right)
            tree.splits.append(split)
            splits[leaf] = best_split(hists[leaf], least, l2)
            splits.append(best_split(right, least, l2))
        sums = [h[0].sum(axis=0) if len(features) else np.zeros(3) for h in hists]
        tree.values = [-rate * float(s[0]) / max(float(s[1]) + l2 * UNIT, 1e-9) for s in sums]
        model.trees.append(tree)
        if not tree.splits:
            break

        rows = stored(rows.withColumn("margin", _added(tree)(F.col("margin"), *[F.col(n) for n in names])), "boosting")
    return model
