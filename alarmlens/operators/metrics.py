"""Thresholds and evaluation of scores.  ``scored`` frames have label (0, 1) and score; curves are made from counts by
distinct score, so that only these, not the rows, are ever ordered as a whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.steps import stored, with_rank
from ..functions.time import label_bucket, midnight


def _zero_safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def threshold_curve(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """For each distinct score (rounded to ``digits``, if given): tp and fp at or above it, and all positives."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    groups = scored.groupBy(score.alias("threshold")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    down = W.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    return groups.select("threshold", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(whole).alias("positives"))


def _precision() -> Column:
    return _zero_safe(F.col("tp"), F.col("tp") + F.col("fp"))


def _recall() -> Column:
    return _zero_safe(F.col("tp"), F.col("positives"))


def _f1() -> Column:
    return _zero_safe(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives"))


def max_f1_threshold(curve: DataFrame) -> DataFrame:
    """Best F1; of equal ones the highest threshold."""
    best = F.max(F.struct(_f1().alias("f1"), "threshold"))
    return curve.agg(best.alias("b")).select("b.threshold", "b.f1")


def confusion(predicted: Column, label: Column) -> list[Column]:
    """Aggregates tp, fp, fn, tn and what follows from them."""
    yes, pos = F.coalesce(predicted, F.lit(False)), label == 1
    tp, fp, fn, tn = F.count_if(yes & pos), F.count_if(yes & (label == 0)), F.count_if(~yes & pos), F.count_if(~yes & (label == 0))
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), _zero_safe(tp, tp + fp).alias("precision"), _zero_safe(tp, tp + fn).alias("recall"),
        _zero_safe(2 * tp, 2 * tp + fp + fn).alias("f1"), _zero_safe(1000 * (tp + fp), F.count("*")).alias("alerts_per_1000"),
    ]


def confusion_at(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.agg(*confusion(F.col("score") >= threshold, F.col("label")))


def recall_at_precision(curve: DataFrame, target: float) -> DataFrame:
    """Best recall among thresholds of at least this precision, 0 if none."""
    return curve.agg(F.coalesce(F.max(F.when(_precision() >= target, _recall())), F.lit(0.0)).alias("recall"))


def precision_at_recall(curve: DataFrame, target: float) -> DataFrame:
    return curve.agg(F.coalesce(F.max(F.when(_recall() >= target, _precision())), F.lit(0.0)).alias("precision"))


def margin_threshold(curve: DataFrame, precision: float = 0.7, recall: float = 0.5, eligible_only: bool = False) -> DataFrame:
    """Threshold of the largest smaller margin of precision and recall over their targets (none, if eligible only and
    no threshold reaches both); of equal ones the highest."""
    margin = F.least(_precision() - precision, _recall() - recall)
    rows = curve.withColumn("margin", margin)
    rows = rows.filter("margin >= 0") if eligible_only else rows
    return rows.agg(F.max(F.struct("margin", "threshold")).alias("b")).select("b.threshold", "b.margin")


def precision_threshold(curve: DataFrame, min_recall: float = 0.5) -> DataFrame:
    """Threshold of the highest precision among those of at least this recall; of equal ones the highest."""
    return curve.filter(_recall() >= min_recall).agg(F.max(F.struct(_precision().alias("precision"), "threshold")).alias("b")).select("b.threshold", "b.precision")


def fixed_threshold(curve: DataFrame, precision: float = 0.7, recall: float = 0.5) -> DataFrame:
    """The margin threshold where both targets are reached, else that of best F1."""
    margin = margin_threshold(curve, precision, recall, True).select(F.col("threshold").alias("m"))
    return margin.crossJoin(max_f1_threshold(curve)).select(F.coalesce("m", "threshold").alias("threshold"), F.col("m").isNotNull().alias("by_margin"))


def ranking_metrics(curve: DataFrame) -> DataFrame:
    """Average precision and area under the ROC curve."""
    down = W.orderBy(F.desc("threshold"))
    tp0, fp0 = F.coalesce(F.lag("tp").over(down), F.lit(0)), F.coalesce(F.lag("fp").over(down), F.lit(0))
    rows = curve.select("tp", "fp", "positives", ((F.col("tp") - tp0) * _precision()).alias("ap"), ((F.col("fp") - fp0) * (F.col("tp") + tp0) / 2).alias("area"))
    return rows.agg(F.try_divide(F.sum("ap"), F.max("positives")).alias("average_precision"), F.try_divide(F.sum("area"), F.max("positives") * F.max("fp")).alias("roc_auc"))


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier"))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Rows, mean score and rate of positives by bin of score, the last one closed."""
    at = sum(((F.col("score") >= i / bins).cast("int") for i in range(1, bins)), F.lit(0))
    return scored.groupBy(at.alias("bin")).agg(F.count("*").alias("row_count"), F.avg("score").alias("mean_score"), F.avg("label").alias("rate"))


def subset_report(scored: DataFrame, threshold: float, recent: Column) -> DataFrame:
    """Confusion of all rows and of those with a recent record."""
    tags = F.when(recent, F.array(F.lit("all"), F.lit("recent"))).otherwise(F.array(F.lit("all")))
    return scored.withColumn("subset", F.explode(tags)).groupBy("subset").agg(*confusion(F.col("score") >= threshold, F.col("label")))


def metrics_by_month(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.groupBy(F.date_trunc("month", "as_of").cast("timestamp_ntz").alias("month")).agg(*confusion(F.col("score") >= threshold, F.col("label")))


def recall_by(scored: DataFrame, threshold: float, by: str) -> DataFrame:
    """Recall of positives by type."""
    return scored.filter("label = 1").groupBy(by).agg(F.count("*").alias("positives"), F.count_if(F.col("score") >= threshold).alias("found"), F.avg((F.col("score") >= threshold).cast("double")).alias("recall"))


def alerts_per_day(scored: DataFrame, threshold: float) -> DataFrame:
    """Mean, median and most alerts of a day; days without any count."""
    daily = scored.groupBy("as_of").agg(F.count_if(F.col("score") >= threshold).alias("n"))
    return daily.agg(F.count("*").alias("days"), F.avg("n").alias("mean_alerts"), F.percentile("n", F.lit(0.5)).alias("median_alerts"), F.max("n").alias("most_alerts"))


def alert_table(scored: DataFrame, threshold: float) -> DataFrame:
    """Alerts, hits and positives by object."""
    yes = F.col("score") >= threshold
    return scored.groupBy("object_id").agg(F.count_if(yes).alias("alerts"), F.count_if(yes & (F.col("label") == 1)).alias("hits"), F.count_if(F.col("label") == 1).alias("positives"))


def alert_concentration(scored: DataFrame, threshold: float, top: int = 5) -> DataFrame:
    """Share of alerts of the ``top`` objects, and the confusion without them."""
    first = alert_table(scored, threshold).orderBy(F.desc("alerts"), "object_id").limit(top).select("object_id", F.lit(True).alias("_top"))
    rows = scored.join(first, "object_id", "left").withColumn("_top", F.coalesce("_top", F.lit(False)))
    yes = F.col("score") >= threshold
    rest = F.when(~F.col("_top"), F.col("label"))
    tp, fp, fn = F.count_if(yes & (rest == 1)), F.count_if(yes & (rest == 0)), F.count_if(~yes & (rest == 1))
    return rows.agg(_zero_safe(F.count_if(yes & F.col("_top")), F.count_if(yes)).alias("top_share"), _zero_safe(tp, tp + fp).alias("precision_rest"), _zero_safe(tp, tp + fn).alias("recall_rest"))


def episode_coverage(episodes: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """Episode starts: all, those with an eligible snapshot at the midnight before, those alerted there."""
    starts = episodes.withColumn("as_of", label_bucket(F.col("first_alarm_at")))
    rows = starts.join(scored.select("channel_id", "as_of", "score"), ["channel_id", "as_of"], "left")
    return rows.agg(F.count("*").alias("starts"), F.count("score").alias("matched"), F.count_if(F.col("score") >= threshold).alias("alerted"))


def coverage_by_reason(episodes: DataFrame, examples: DataFrame) -> DataFrame:
    """Episode starts by the reason why their snapshot is not eligible (``no_snapshot``, ``eligible``)."""
    starts = episodes.withColumn("as_of", label_bucket(F.col("first_alarm_at")))
    rows = starts.join(examples.select("channel_id", "as_of", "exclusion_reason", F.lit(True).alias("_there")), ["channel_id", "as_of"], "left")
    reason = F.when(F.col("_there").isNull(), F.lit("no_snapshot")).otherwise(F.coalesce("exclusion_reason", F.lit("eligible")))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("starts"))


def incident_report(incidents: DataFrame, object_days: DataFrame, threshold: float) -> DataFrame:
    """Incidents: all, on an eligible object-day, on an alerted one."""
    days = object_days.groupBy("object_id", F.col("as_of").alias("day")).agg(F.max("score").alias("score"))
    rows = incidents.join(days, ["object_id", "day"], "left")
    return rows.agg(F.count("*").alias("incidents"), F.count("score").alias("eligible"), F.count_if(F.col("score") >= threshold).alias("alerted"))


def unit_report(scored: DataFrame, threshold: float) -> DataFrame:
    """Confusion, alerts per day, recall at precision 0.7, and the same of the rule.

    One pass: every row counts under its score and under its day, and all that is asked for follows from these counts."""
    pos, neg, rule = F.col("label") == 1, F.col("label") == 0, F.coalesce(F.col("rule") >= 1, F.lit(False))
    keys = F.array(F.struct(F.col("score").alias("threshold"), F.lit(None).cast("timestamp_ntz").alias("day")), F.struct(F.lit(None).cast("double").alias("threshold"), midnight(F.col("as_of")).alias("day")))
    rows = scored.select(pos.alias("_p"), neg.alias("_n"), rule.alias("_r"), F.posexplode(keys).alias("_kind", "_key"))
    counts = rows.groupBy("_kind", "_key").agg(F.count_if("_p").alias("p"), F.count_if("_n").alias("n"), F.count_if(F.col("_r") & F.col("_p")).alias("rp"), F.count_if(F.col("_r") & F.col("_n")).alias("rn"), F.count("*").alias("rows"))
    down = W.partitionBy("_kind").orderBy(F.desc("_key.threshold"), F.desc("_key.day"))
    whole = W.partitionBy("_kind")
    curve = counts.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down), "positives": F.sum("p").over(whole)})
    scores = F.col("_kind") == 0
    yes = scores & F.coalesce(F.col("_key.threshold") >= threshold, F.lit(False))
    no = scores & ~F.coalesce(F.col("_key.threshold") >= threshold, F.lit(False))
    total = lambda keep, c: F.coalesce(F.sum(F.when(keep, F.col(c))), F.lit(0))
    found = curve.agg(
        total(yes, "p").alias("tp"), total(yes, "n").alias("fp"), total(no, "p").alias("fn"), total(no, "n").alias("tn"), total(scores, "rows").alias("_rows"), F.count_if((F.col("_kind") == 1) & F.col("_key.day").isNotNull()).alias("days"),
        F.coalesce(F.max(F.when(scores & (_precision() >= 0.7), _recall())), F.lit(0.0)).alias("recall_at_70"), total(scores, "rp").alias("_rp"), total(scores, "rn").alias("_rn"), total(scores, "p").alias("_pos"),
    )
    of = lambda tp, fp, positives: (_zero_safe(tp, tp + fp), _zero_safe(tp, positives), _zero_safe(2 * tp, tp + fp + positives))
    own, ruled = of(F.col("tp"), F.col("fp"), F.col("tp") + F.col("fn")), of(F.col("_rp"), F.col("_rn"), F.col("_pos"))
    alerts = F.col("tp") + F.col("fp")
    return found.select(
        "tp", "fp", "fn", "tn", *[c.alias(n) for c, n in zip(own, ("precision", "recall", "f1"), strict=True)], _zero_safe(1000 * alerts, F.col("_rows")).alias("alerts_per_1000"), "days", "recall_at_70",
        *[c.alias(f"rule_{n}") for c, n in zip(ruled, ("precision", "recall", "f1"), strict=True)], _zero_safe(alerts, F.col("days")).alias("alerts_per_day"),
    )


def holdout_eval(selection: DataFrame, held_out: DataFrame) -> DataFrame:
    """Threshold of best F1 on the selection period, scored once on the held-out one."""
    threshold = max_f1_threshold(threshold_curve(selection)).select("threshold")
    rows = held_out.crossJoin(F.broadcast(threshold))
    return rows.agg(F.first("threshold").alias("threshold"), *confusion(F.col("score") >= F.col("threshold"), F.col("label")))


def qualify(results: DataFrame, most_base_rate: float = 0.35) -> DataFrame:
    """Variants (name, margin, base_rate, f1, rule_f1, ap, precision) that may be chosen."""
    return results.filter((F.col("margin") >= 0) & (F.col("base_rate") <= most_base_rate) & (F.col("f1") > F.col("rule_f1")))


def choose(results: DataFrame, base: str, least_gain: float = 0.01) -> DataFrame:
    """The qualified variant of best AP, if it gains on ``base`` without loss of precision; else ``base``."""
    b = results.filter(F.col("name") == base).select(F.col("ap").alias("_ap"), F.col("precision").alias("_p"))
    better = qualify(results).crossJoin(b).filter((F.col("ap") >= F.col("_ap") + least_gain) & (F.col("precision") >= F.col("_p")) | (F.col("name") == base)).select(*results.columns)
    return better.unionByName(results.filter(F.col("name") == base)).orderBy(F.desc("ap"), "name").limit(1)


def _interval(reps: DataFrame) -> DataFrame:
    """95 % interval of precision and recall over replicates (tp, pred, pos)."""
    reps = reps.select(F.try_divide("tp", "pred").alias("precision"), F.try_divide("tp", "pos").alias("recall"))
    return reps.agg(*[F.percentile(m, F.lit(q)).alias(f"{m}_{s}") for m in ("precision", "recall") for q, s in ((0.025, "low"), (0.975, "high"))])


def bootstrap(scored: DataFrame, threshold: float, by: str, n: int = 1000, seed: int = 7) -> DataFrame:
    """95 % interval of precision and recall over ``n`` replicates, each of as many whole clusters (values of ``by``) as
    there are, drawn with replacement.

    Clusters are reduced to counts and numbered by their id.  Draw k of replicate r takes the cluster whose number is the
    checksum of seed, r and k, modulo the clusters; draws are made where they are counted and joined by number, so the work
    is clusters times replicates, spread evenly, and no product of tables is formed."""
    yes, pos = F.col("score") >= threshold, F.col("label") == 1
    cells = scored.groupBy(F.col(by).cast("string").alias("c")).agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes).alias("pred"), F.count_if(pos).alias("pos"))
    cells = stored(with_rank(cells, "c"), "clusters")
    size = cells.count()
    draws = scored.sparkSession.range(n * size).select(F.floor(F.col("id") / max(1, size)).alias("r"), (F.col("id") % max(1, size)).alias("k"))
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), "r", "k").cast("binary"))
    draws = draws.select("r", (F.conv(F.substring(mark, 1, 13), 16, 10).cast("long") % max(1, size) + 1).alias("rank"))
    return _interval(draws.join(cells, "rank").groupBy("r").agg(*[F.sum(c).alias(c) for c in ("tp", "pred", "pos")]))


def bootstrap_rows(scored: DataFrame, threshold: float, n: int = 1000, seed: int = 7) -> DataFrame:
    """95 % interval of precision and recall over ``n`` replicates of as many rows as there are, drawn with replacement.

    What counts of a row is its cell (hit, false alert, miss, neither), so a replicate is a multinomial draw over the four
    cells: three binomial numbers, whose generator is seeded by seed and replicate."""
    yes, pos = F.col("score") >= threshold, F.col("label") == 1
    cell = scored.agg(F.count_if(yes & pos).alias("a"), F.count_if(yes & ~pos).alias("b"), F.count_if(~yes & pos).alias("c"), F.count("*").alias("n")).first()
    total = cell["n"]
    shares = [cell[x] / total if total else 0.0 for x in "abc"]

    @F.pandas_udf("tp long, pred long, pos long")
    def draw(replicates: pd.Series) -> pd.DataFrame:
        rows = []
        for r in replicates:
            tp, fp, fn, _ = np.random.Generator(np.random.PCG64([seed, int(r)])).multinomial(total, [*shares, max(0.0, 1 - sum(shares))])
            rows.append((tp, tp + fp, tp + fn))
        return pd.DataFrame(rows, columns=["tp", "pred", "pos"])

    return _interval(scored.sparkSession.range(n).select(draw("id").alias("x")).select("x.*"))


def shuffle_labels(df: DataFrame, by: list[Column], seed: int = 11) -> DataFrame:
    """Labels permuted over the whole table: the k-th row in one order gets the label of the k-th row in another.  Both
    orders are by checksums of the texts ``by``, which should name a row."""
    mark = lambda salt: F.md5(F.concat_ws("|", F.lit(f"{seed}{salt}"), *by).cast("binary"))
    to = with_rank(df.withColumn("_mark", mark("to")), "_mark", "_k").drop("_mark")
    labels = with_rank(df.select("label", mark("from").alias("_mark")), "_mark", "_k").select(F.col("label").alias("_label"), "_k")
    return to.join(labels, "_k").withColumn("label", F.col("_label")).select(*df.columns)
