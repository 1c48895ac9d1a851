"""Classifiers and calibration with MLlib, on feature columns where null means missing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import stored
from .metrics import ranking_metrics, threshold_curve


def _filled(df: DataFrame, features: list[str], fill: float, log: bool = False, flags: bool = False) -> tuple[DataFrame, list[str]]:
    """``df`` with features free of nulls, as ``_x_...`` columns, and these columns."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float(fill)))
    out = {f"_x_{c}": F.log1p(value(c)) if log else value(c) for c in features}
    if flags:
        out |= {f"_m_{c}": F.col(c).isNull().cast("double") for c in features}
    return df.withColumns(out), list(out)


class Fitted:
    """A fitted pipeline with the way its input is filled."""

    def __init__(self, model: PipelineModel, features: list[str], how: dict):
        self.model, self.features, self.how = model, features, how

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        rows, _ = _filled(df, self.features, **self.how)
        return self.model.transform(rows).withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def _fit(df: DataFrame, features: list[str], stages, how: dict, label: str) -> Fitted:
    rows, names = _filled(df, features, **how)
    rows = rows.withColumn("_label", F.col(label).cast("double"))
    return Fitted(Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_raw"), *stages(names)]).fit(rows), features, how)


def fit_logistic(df: DataFrame, features: list[str], fill: float = 720.0, c: float = 1.0, label: str = "label") -> Fitted:
    """Constant for missing, log1p, standard scale, L2 with strength 1 / (c n)."""
    n = max(1, df.count())
    return _fit(
        df, features, lambda names: [StandardScaler(withMean=True, inputCol="_raw", outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol="_label", regParam=1 / (c * n), maxIter=100)], {"fill": fill, "log": True}, label
    )


def linear_score(df: DataFrame, coefficients: dict[str, float], intercept: float, out: str = "score") -> DataFrame:
    """Logistic score of stored coefficients by column arithmetic."""
    z = reduce(Column.__add__, [F.col(c) * b for c, b in coefficients.items()], F.lit(intercept))
    return df.withColumn(out, 1 / (1 + F.exp(-z)))


def fit_gbt(df: DataFrame, features: list[str], categorical: int | None = None, trees: int = 40, rate: float = 0.1, depth: int = 5, least: int = 20, label: str = "label", seed: int = 1) -> Fitted:
    """Boosted trees; missing values are a number of their own with flags.  ``categorical``: features of at most so
    many values are taken as categories."""
    index = [VectorIndexer(inputCol="_raw", outputCol="_features", maxCategories=categorical, handleInvalid="keep")] if categorical else []
    gbt = GBTClassifier(featuresCol="_features" if categorical else "_raw", labelCol="_label", maxIter=trees, stepSize=rate, maxDepth=depth, minInstancesPerNode=least, seed=seed)
    return _fit(df, features, lambda names: [*index, gbt], {"fill": -1.0, "flags": True}, label)


class CategoricalFitted:
    """Boosted trees over numbers and categories (texts); a category that training has not seen is one of its own."""

    def __init__(self, df: DataFrame, numbers: list[str], categories: list[str], trees: int = 40, rate: float = 0.1, depth: int = 5, least: int = 20, label: str = "label", seed: int = 1):
        self.numbers, self.categories = numbers, categories
        rows, names = self._rows(df)
        rows = rows.withColumn("_label", F.col(label).cast("double"))
        index = StringIndexer(inputCols=[f"_t{k}" for k in range(len(categories))], outputCols=[f"_c{k}" for k in range(len(categories))], handleInvalid="keep").fit(rows)
        widest = max((len(x) for x in index.labelsArray), default=0) + 1
        # the indexer's metadata make these columns categories to the trees, which need a bin for each
        vector = VectorAssembler(inputCols=[*names, *index.getOutputCols()], outputCol="_raw")
        gbt = GBTClassifier(featuresCol="_raw", labelCol="_label", maxIter=trees, stepSize=rate, maxDepth=depth, minInstancesPerNode=least, maxBins=max(32, widest), seed=seed)
        self.model = Pipeline(stages=[index, vector, gbt]).fit(rows)

    def _rows(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        rows, names = _filled(df, self.numbers, fill=-1.0, flags=True)
        return rows.withColumns({f"_t{k}": F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in enumerate(self.categories)}), names

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        return self.model.transform(self._rows(df)[0]).withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def fit_mlp(df: DataFrame, features: list[str], layers: tuple[int, ...] = (64, 32), label: str = "label", seed: int = 1) -> Fitted:
    """Filled, flagged, scaled, then a multilayer perceptron."""
    return _fit(
        df, features, lambda names: [StandardScaler(withMean=True, inputCol="_raw", outputCol="_features"), MultilayerPerceptronClassifier(featuresCol="_features", labelCol="_label", layers=[len(names), *layers, 2], maxIter=100, seed=seed)],
        {"fill": 0.0, "flags": True}, label,
    )


def rule_score(df: DataFrame, col: str, out: str = "score") -> DataFrame:
    return df.withColumn(out, (F.coalesce(F.col(col), F.lit(0)) > 0).cast("double"))


def constant_score(df: DataFrame, p: float, out: str = "score") -> DataFrame:
    return df.withColumn(out, F.lit(float(p)))


def ensemble(df: DataFrame, a: str, b: str, out: str = "score") -> DataFrame:
    return df.withColumn(out, (F.col(a) + F.col(b)) / 2)


def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pool-adjacent-violators over blocks (low, high, hits, n) that come in the order of their scores.  Blocks that are
    pooled in a part of the order are pooled in the whole, so parts may be pooled first."""
    stack: list[list[float]] = []
    for pdf in batches:
        for low, high, hits, n in pdf[["low", "high", "hits", "n"]].itertuples(index=False):
            block = [low, high, hits, n]
            while stack and stack[-1][2] * block[3] >= block[2] * stack[-1][3]:
                before = stack.pop()
                block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
            stack.append(block)
    yield pd.DataFrame(stack, columns=["low", "high", "hits", "n"])


class Calibration:
    """Isotonic map of scores, fitted on one period and applied to another, within [0, 1].

    Rows are counted by score; the counts are pooled in ranges of scores, and the blocks that are left in one task.  Blocks
    have different rates, which are fractions of whole rows, so of N rows there are of the order of N^(2/3) at most, and a
    few hundred as a rule.  Between blocks the map is linear, outside it is constant; null scores have no probability."""

    def __init__(self, scored: DataFrame, score: str = "score", label: str = "label"):
        self.score = score
        rows = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("low")).agg(F.sum(F.col(label).cast("long")).alias("hits"), F.count("*").alias("n"))
        kinds = "low double, high double, hits long, n long"
        parts = rows.withColumn("high", F.col("low")).repartitionByRange("low").sortWithinPartitions("low").mapInPandas(pooled, kinds)
        self.blocks = stored(parts.repartition(1).sortWithinPartitions("low").mapInPandas(pooled, kinds), "isotonic")

    def apply(self, scored: DataFrame, out: str = "probability") -> DataFrame:
        blocks = self.blocks.orderBy("low").toPandas()
        x = blocks[["low", "high"]].to_numpy().ravel()
        y = np.clip(np.repeat((blocks["hits"] / blocks["n"]).to_numpy(float), 2), 0.0, 1.0)

        @F.pandas_udf("double")
        def interpolated(values: pd.Series) -> pd.Series:
            known = values.notna()
            return pd.Series(np.interp(values.fillna(0.0), x, y) if len(x) else np.full(len(values), np.nan)).where(known.to_numpy() & bool(len(x)), None)

        return scored.withColumn(out, interpolated(F.col(self.score).cast("double")))


def grid_search_time(train: DataFrame, inner: DataFrame, features: list[str], grid: list[dict], label: str = "label") -> tuple[dict, Fitted, list[float]]:
    """The grid point of best average precision on the later, inner period (the first of equal ones), what was fitted with
    it, and the average precision of every point."""
    best: tuple[float, dict, Fitted] | None = None
    tried = []
    for point in grid:
        fitted = fit_gbt(train, features, label=label, **point)
        ap = ranking_metrics(threshold_curve(fitted.score(inner).withColumn("label", F.col(label)))).first()["average_precision"] or 0.0
        tried.append(ap)
        if best is None or ap > best[0]:
            best = (ap, point, fitted)
    return best[1], best[2], tried


class MixtureOfExperts:
    """P(fault) as the sum over fault types of P(type) times P(fault given type); a type with one class is constant.  Each
    type is fitted by itself, so more than ``MOST_TYPES`` of them are an error."""

    MOST_TYPES = 64

    def __init__(self, df: DataFrame, features: list[str], type_col: str, label: str = "label", **gbt):
        kinds = df.select(type_col).filter(F.col(type_col).isNotNull()).distinct().orderBy(type_col)
        self.types = [r[0] for r in kinds.limit(self.MOST_TYPES + 1).collect()]
        if len(self.types) > self.MOST_TYPES:
            raise ValueError(f"{type_col} has more than {self.MOST_TYPES} types")
        codes = F.create_map(*[F.lit(x) for k, t in enumerate(self.types) for x in (t, float(k))])
        rows, names = _filled(df.filter(F.col(type_col).isNotNull()), features, -1.0)
        forest = RandomForestClassifier(featuresCol="_raw", labelCol="_type", numTrees=40, maxDepth=8, seed=1)
        self.router = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_raw"), forest]).fit(rows.withColumn("_type", F.element_at(codes, F.col(type_col))))
        self.features, self.experts = features, {}
        for t in self.types:
            own = df.filter(F.col(type_col) == t)
            rate = own.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
            self.experts[t] = rate if rate in (0.0, 1.0) else fit_gbt(own, features, label=label, **gbt)

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        rows, _ = _filled(df, self.features, -1.0)
        rows = self.router.transform(rows).withColumn("_by_type", vector_to_array("probability")).select(*df.columns, "_by_type")
        total = F.lit(0.0)
        for k, t in enumerate(self.types):
            expert = self.experts[t]
            rows = rows.withColumn(f"_e{k}", F.lit(expert)) if isinstance(expert, float) else expert.score(rows, f"_e{k}")
            total = total + F.col("_by_type")[k] * F.col(f"_e{k}")
        return rows.withColumn(out, total).select(*df.columns, out)


def multiclass_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class: rows, precision, recall, F1; and the accuracy of all."""
    cells = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).count()
    hits = cells.filter("l = p").select(F.col("l").alias("class"), F.col("count").alias("tp"))
    of_l, of_p = cells.groupBy(F.col("l").alias("class")).agg(F.sum("count").alias("row_count")), cells.groupBy(F.col("p").alias("class")).agg(F.sum("count").alias("predicted"))
    accuracy = cells.agg(F.try_divide(F.sum(F.when(F.col("l") == F.col("p"), F.col("count")).otherwise(0)), F.sum("count")).alias("accuracy"))
    rows = of_l.join(of_p, "class", "full_outer").join(hits, "class", "left").fillna(0, ["row_count", "predicted", "tp"])
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = rows.select("class", "row_count", safe(F.col("tp"), F.col("predicted")).alias("precision"), safe(F.col("tp"), F.col("row_count")).alias("recall"), safe(2 * F.col("tp"), F.col("predicted") + F.col("row_count")).alias("f1"))
    return rows.crossJoin(accuracy)
