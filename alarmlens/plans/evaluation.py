"""Queries of metrics, telemetry and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.steps import stored
from ..operators import boosting
from ..operators import episodes as ep
from ..operators import metrics as mt
from ..operators import models as ml
from ..operators import objects as ob
from ..operators import telemetry as tl
from .base import LONG, SHORT, TEST, directory, table
from .core import INC, ORACLES, QUERIES, SC_CTES, V1_CTES, eps_of, query, scored, v1_of, v2_of

__all__ = ["ORACLES", "QUERIES"]

CURVE = """cv AS (SELECT score AS threshold, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM sc GROUP BY 1)),
cp AS (SELECT *, tp / (tp + fp) AS prec, CASE WHEN pos > 0 THEN tp / pos ELSE 0.0 END AS rec, 2 * tp / (tp + fp + pos) AS f1 FROM cv)"""
C = (*SC_CTES, CURVE)


def curve(spark: SparkSession, d: str) -> DataFrame:
    return mt.threshold_curve(scored(spark, d))


def confusion_sql(rel: str, by: str = "", yes: str = "score >= 0.5") -> str:
    """Confusion columns by ``by``."""
    inner = f"SELECT {by + ',' if by else ''} count(*) FILTER (WHERE {yes} AND label = 1) AS tp, count(*) FILTER (WHERE {yes} AND label = 0) AS fp, count(*) FILTER (WHERE NOT ({yes}) AND label = 1) AS fn, count(*) FILTER (WHERE NOT ({yes}) AND label = 0) AS tn, count(*) AS n FROM {rel}" + (f" GROUP BY {by}" if by else "")
    return f"""SELECT {by.split(' AS ')[-1] + ',' if by else ''} tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, 1000 * (tp + fp) / n AS alerts_per_1000 FROM ({inner})"""


@query("SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(pos AS BIGINT) AS positives FROM cv", C)
def threshold_curve(spark, d):
    return curve(spark, d)


@query("SELECT threshold, f1 FROM cp ORDER BY f1 DESC, threshold DESC LIMIT 1", C)
def max_f1_threshold(spark, d):
    return mt.max_f1_threshold(curve(spark, d))


@query("SELECT threshold, round(least(prec - 0.2, rec - 0.1), 12) AS margin FROM cp ORDER BY least(prec - 0.2, rec - 0.1) DESC, threshold DESC LIMIT 1", C)
def margin_threshold(spark, d):
    return mt.margin_threshold(curve(spark, d), 0.2, 0.1).withColumn("margin", F.round("margin", 12))


@query("SELECT threshold, prec AS precision FROM cp WHERE rec >= 0.1 ORDER BY prec DESC, threshold DESC LIMIT 1", C)
def precision_threshold(spark, d):
    return mt.precision_threshold(curve(spark, d), 0.1)


@query(confusion_sql("sc"), SC_CTES)
def confusion_at(spark, d):
    return mt.confusion_at(scored(spark, d), 0.5)


@query("SELECT coalesce(max(rec) FILTER (WHERE prec >= 0.15), 0.0) AS recall FROM cp", C)
def recall_at_precision(spark, d):
    return mt.recall_at_precision(curve(spark, d), 0.15)


@query("SELECT coalesce(max(prec) FILTER (WHERE rec >= 0.1), 0.0) AS precision FROM cp", C)
def precision_at_recall(spark, d):
    return mt.precision_at_recall(curve(spark, d), 0.1)


@query("SELECT round(sum(d * prec) / max(pos), 9) AS average_precision FROM (SELECT *, tp - coalesce(lag(tp) OVER (ORDER BY threshold DESC), 0) AS d FROM cp)", C)
def average_precision(spark, d):
    return mt.ranking_metrics(curve(spark, d)).select(F.round("average_precision", 9).alias("average_precision"))


@query("SELECT round(sum((p.n) * (CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) * a.k) / ((SELECT count(*) FROM sc WHERE label = 1) * (SELECT count(*) FROM sc WHERE label = 0)), 9) AS roc_auc FROM (SELECT score, count(*) AS k FROM sc WHERE label = 1 GROUP BY 1) a CROSS JOIN (SELECT score, count(*) AS n FROM sc WHERE label = 0 GROUP BY 1) b JOIN (SELECT score, count(*) AS n FROM sc WHERE label = 0 GROUP BY 1) p ON p.score = b.score", SC_CTES)
def roc_auc(spark, d):
    return mt.ranking_metrics(curve(spark, d)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("SELECT round(avg((score - label) * (score - label)), 9) AS brier FROM sc", SC_CTES)
def brier(spark, d):
    return mt.brier(scored(spark, d)).select(F.round("brier", 9).alias("brier"))


@query("SELECT CAST(bin AS INTEGER) AS bin, count(*) AS row_count, round(avg(score), 9) AS mean_score, round(avg(label), 9) AS rate FROM (SELECT *, CASE WHEN score >= 0.9 THEN 9 WHEN score >= 0.8 THEN 8 WHEN score >= 0.7 THEN 7 WHEN score >= 0.6 THEN 6 WHEN score >= 0.5 THEN 5 WHEN score >= 0.4 THEN 4 WHEN score >= 0.3 THEN 3 WHEN score >= 0.2 THEN 2 WHEN score >= 0.1 THEN 1 ELSE 0 END AS bin FROM sc) GROUP BY 1", SC_CTES)
def reliability_bins(spark, d):
    rows = mt.reliability(scored(spark, d))
    return rows.select("bin", "row_count", F.round("mean_score", 9).alias("mean_score"), F.round("rate", 9).alias("rate"))


@query(confusion_sql("sc", "CAST(date_trunc('month', as_of) AS TIMESTAMP) AS month").replace("GROUP BY CAST(date_trunc('month', as_of) AS TIMESTAMP) AS month", "GROUP BY 1"), SC_CTES)
def metrics_by_month(spark, d):
    return mt.metrics_by_month(scored(spark, d), 0.5)


@query("SELECT count(*) AS days, avg(n) AS mean_alerts, quantile_cont(n, 0.5) AS median_alerts, max(n) AS most_alerts FROM (SELECT as_of, count(*) FILTER (WHERE score >= 0.5) AS n FROM sc GROUP BY 1)", SC_CTES)
def alerts_per_day(spark, d):
    return mt.alerts_per_day(scored(spark, d), 0.5)


@query("SELECT object_id, count(*) FILTER (WHERE score >= 0.5) AS alerts, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS hits, count(*) FILTER (WHERE label = 1) AS positives FROM sc GROUP BY 1", SC_CTES)
def per_object_alert_table(spark, d):
    return mt.alert_table(scored(spark, d), 0.5)


TOP = "top5 AS (SELECT object_id FROM (SELECT object_id, count(*) FILTER (WHERE score >= 0.5) AS a FROM sc GROUP BY 1) ORDER BY a DESC, object_id LIMIT 5)"


@query("""SELECT CASE WHEN y > 0 THEN yt / y ELSE 0.0 END AS top_share, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision_rest, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall_rest FROM (SELECT count(*) FILTER (WHERE score >= 0.5) AS y, count(*) FILTER (WHERE score >= 0.5 AND t) AS yt,
 count(*) FILTER (WHERE score >= 0.5 AND NOT t AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT t AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND NOT t AND label = 1) AS fn FROM (SELECT *, object_id IN (SELECT object_id FROM top5) AS t FROM sc))""", (*SC_CTES, TOP))
def alert_concentration(spark, d):
    return mt.alert_concentration(scored(spark, d), 0.5)


@query("SELECT count(*) AS starts, count(score) AS matched, count(*) FILTER (WHERE score >= 0.5) AS alerted FROM (SELECT e.channel_id, CAST(date_trunc('day', first_alarm_at - INTERVAL 1 MICROSECOND) AS TIMESTAMP) AS as_of FROM eps e) LEFT JOIN sc USING (channel_id, as_of)", SC_CTES)
def episode_coverage(spark, d):
    return mt.episode_coverage(eps_of(spark, d), scored(spark, d), 0.5)


@query("SELECT CASE WHEN v.channel_id IS NULL THEN 'no_snapshot' ELSE coalesce(exclusion_reason, 'eligible') END AS reason, count(*) AS starts FROM (SELECT channel_id AS c, CAST(date_trunc('day', first_alarm_at - INTERVAL 1 MICROSECOND) AS TIMESTAMP) AS a FROM eps) LEFT JOIN v1 v ON v.channel_id = c AND v.as_of = a GROUP BY 1", V1_CTES)
def coverage_by_reason(spark, d):
    return mt.coverage_by_reason(eps_of(spark, d), v1_of(spark, d))


@query("SELECT count(*) AS incidents, count(score) AS eligible, count(*) FILTER (WHERE score >= 0.5) AS alerted FROM inc LEFT JOIN (SELECT object_id, as_of AS day, max(score) AS score FROM sc GROUP BY 1, 2) USING (object_id, day)", (*SC_CTES, INC))
def alerted_membership(spark, d):
    return mt.incident_report(ep.incidents(eps_of(spark, d), directory(spark, d)), scored(spark, d), 0.5)


@query("SELECT object_id, as_of, max(score) AS score, max(label) AS label, max(rule) AS rule FROM sc GROUP BY 1, 2", SC_CTES)
def object_day_scores(spark, d):
    return ob.object_day_scores(scored(spark, d))


@query(confusion_sql("(SELECT *, unnest(CASE WHEN rule = 1 THEN ['all', 'recent'] ELSE ['all'] END) AS subset FROM sc)", "subset"), SC_CTES)
def subset_report(spark, d):
    return mt.subset_report(scored(spark, d), 0.5, F.col("rule") == 1)


@query("SELECT sensor_type, count(*) AS positives, count(*) FILTER (WHERE score >= 0.5) AS found, avg(CAST(score >= 0.5 AS DOUBLE)) AS recall FROM sc WHERE label = 1 GROUP BY 1", SC_CTES)
def recall_by_fault_type(spark, d):
    return mt.recall_by(scored(spark, d), 0.5, "sensor_type")


@query(confusion_sql("sc", yes="rule >= 1").replace("SELECT  tp, fp, fn, tn", "SELECT tp, fp, fn, tn"), SC_CTES)
def rule_score(spark, d):
    return mt.confusion_at(ml.rule_score(scored(spark, d).drop("score"), "rule"), 0.5)


@query(f"""SELECT tp, fp, fn, tn, precision, recall, f1, alerts_per_1000, (SELECT count(DISTINCT as_of) FROM sc) AS days, (SELECT coalesce(max(rec) FILTER (WHERE prec >= 0.7), 0.0) FROM cp) AS recall_at_70,
 (SELECT precision FROM ({confusion_sql('sc', yes='rule >= 1')})) AS rule_precision, (SELECT recall FROM ({confusion_sql('sc', yes='rule >= 1')})) AS rule_recall, (SELECT f1 FROM ({confusion_sql('sc', yes='rule >= 1')})) AS rule_f1, (tp + fp) / (SELECT count(DISTINCT as_of) FROM sc) AS alerts_per_day FROM ({confusion_sql('sc')})""", C)
def unit_report(spark, d):
    return mt.unit_report(scored(spark, d), 0.5)


SEL = "sel AS (SELECT * FROM sc WHERE split <> 'test')"
HELD = """best AS (SELECT threshold FROM (SELECT score AS threshold, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM sel GROUP BY 1)) ORDER BY 2 * tp / (tp + fp + pos) DESC, threshold DESC LIMIT 1)"""


@query(f"SELECT (SELECT threshold FROM best) AS threshold, * FROM ({confusion_sql(chr(40) + 'SELECT * FROM sc WHERE split = ' + chr(39) + 'test' + chr(39) + chr(41), yes='score >= (SELECT threshold FROM best)')})", (*SC_CTES, SEL, HELD))
def holdout_eval(spark, d):
    rows = scored(spark, d)
    return mt.holdout_eval(rows.filter("split <> 'test'"), rows.filter("split = 'test'"))


#: A checksum's first 13 hexadecimal digits as a number.
_DRAW = "list_reduce([instr('0123456789abcdef', x) - 1 FOR x IN string_split(left(md5('7|' || r || '|' || k), 13), '')], lambda a, b: a * 16 + b)"


@query(f"""SELECT quantile_cont(p, 0.025) AS precision_low, quantile_cont(p, 0.975) AS precision_high, quantile_cont(q, 0.025) AS recall_low, quantile_cont(q, 0.975) AS recall_high
 FROM (SELECT sum(tp) / nullif(sum(pred), 0) AS p, sum(tp) / nullif(sum(pos), 0) AS q FROM (SELECT r, {_DRAW} % (SELECT count(*) FROM cells) AS i FROM range(1000) a(r), range((SELECT count(*) FROM cells)::BIGINT) b(k)) JOIN cells USING (i) GROUP BY r)""",
 (*SC_CTES, "cells AS (SELECT row_number() OVER (ORDER BY object_id) - 1 AS i, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5) AS pred, count(*) FILTER (WHERE label = 1) AS pos FROM sc GROUP BY object_id)"))
def bootstrap_ci(spark, d):
    return mt.bootstrap(scored(spark, d), 0.5, "object_id")


@query()
def bootstrap_rows_ci(spark, d):
    return mt.bootstrap_rows(scored(spark, d), 0.5)


_MARK = "md5('11{0}|' || channel_id || '|' || strftime(as_of, '%Y-%m-%d'))"
SHUFFLED = f"""mixed AS (SELECT a.score, b.label FROM (SELECT score, row_number() OVER (ORDER BY {_MARK.format('to')}) AS k FROM sc) a JOIN (SELECT label, row_number() OVER (ORDER BY {_MARK.format('from')}) AS k FROM sc) b USING (k)),
mixed_cv AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, p, n FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM mixed GROUP BY 1))"""


@query("SELECT round(sum(p * tp / (tp + fp)) / sum(p), 9) AS average_precision, round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 9) AS roc_auc FROM mixed_cv", (*SC_CTES, SHUFFLED))
def shuffled_label_control(spark, d):
    mixed = mt.shuffle_labels(scored(spark, d), [F.col("channel_id"), F.date_format("as_of", "yyyy-MM-dd")])
    return mt.ranking_metrics(mt.threshold_curve(mixed)).select(*[F.round(c, 9).alias(c) for c in ("average_precision", "roc_auc")])


# ------------------------------------------------------------------ telemetry

TEL = """tel0 AS (SELECT CAST(user_id AS VARCHAR) AS pump_id, CAST(ts AS TIMESTAMP) AS ts, value AS s1, value * 2 + 1 AS s2, event_type = 'purchase' AS fault, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts) - CAST(event_type = 'purchase' AS INTEGER) AS r FROM events),
tel AS (SELECT pump_id, ts, s1, s2, pump_id || '-' || r AS run_id, CASE WHEN fault THEN 'purchase' END AS fault_type, row_number() OVER (PARTITION BY pump_id, r ORDER BY ts) - 1 AS pos, NOT bool_or(fault) OVER (PARTITION BY pump_id, r) AS is_normal FROM tel0)"""
PROFILE = "prof AS (SELECT pump_id, quantile_cont(s1, 0.5) AS m1, quantile_cont(s2, 0.5) AS m2, stddev_samp(s1) AS sd1 FROM tel WHERE NOT is_normal GROUP BY 1)"
W12 = "WINDOW w AS (PARTITION BY run_id ORDER BY pos)"


def telemetry(spark, d) -> DataFrame:
    """A user's events as readings; a purchase is a fault and ends a run, rows after the last one are normal."""
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    fault = F.col("event_type") == "purchase"
    past = W.partitionBy("user_id").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    rows = e.select(F.col("user_id").cast("string").alias("pump_id"), "ts", F.col("value").alias("s1"), (F.col("value") * 2 + 1).alias("s2"), fault.alias("fault"), F.count_if(fault).over(past).alias("r"))
    run = W.partitionBy("pump_id", "r")
    return rows.select(
        "pump_id", "ts", "s1", "s2", F.concat_ws("-", "pump_id", "r").alias("run_id"), F.when(F.col("fault"), F.lit("purchase")).alias("fault_type"),
        (F.row_number().over(run.orderBy("ts")) - 1).cast("long").alias("pos"), (~F.max("fault").over(run)).alias("is_normal"),
    )


def profile(spark, d) -> DataFrame:
    """Of the rows in runs, so that every pump with a run has one."""
    return tl.normal_profile(telemetry(spark, d).withColumn("is_normal", ~F.col("is_normal")), ["s1", "s2"], None, True)


def _rounded(df: DataFrame, keys: list[str], cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in cols])


KEYS = ["run_id", "pos"]


@query(f"SELECT run_id, pos, round(CASE WHEN is_normal THEN 0.0 ELSE s1 - coalesce(lag(s1, 4) OVER w, first(s1) OVER w) END, 6) + 0.0 AS s1_change_4, round(CASE WHEN is_normal OR pos = 0 THEN 0.0 ELSE (s1 - coalesce(lag(s1, 4) OVER w, first(s1) OVER w)) / least(pos, 4) END, 6) + 0.0 AS s1_step_4 FROM tel {W12}", (TEL,))
def lag_change(spark, d):
    return _rounded(tl.lag_change(telemetry(spark, d), ["s1"], 4), KEYS, ["s1_change_4", "s1_step_4"])


@query(f"WITH ch AS (SELECT run_id, pos, CASE WHEN is_normal THEN 0.0 ELSE s1 - coalesce(lag(s1, 3) OVER w, first(s1) OVER w) END AS c FROM tel {W12}) SELECT run_id, pos, round(CASE WHEN pos >= 6 THEN c - lag(c, 3) OVER (PARTITION BY run_id ORDER BY pos) ELSE 0.0 END, 6) + 0.0 AS s1_acceleration FROM ch".replace("WITH ch AS", "SELECT * FROM (WITH ch AS") + ")", (TEL,))
def long_lag_and_acceleration(spark, d):
    return _rounded(tl.long_lags(telemetry(spark, d), ["s1"], (3, 5)), KEYS, ["s1_acceleration"])


P = lambda k: f"CASE WHEN pos >= {k} THEN lag(s1, {k}) OVER w ELSE m1 END"


@query(f"SELECT run_id, pos, round(s1 - {P(4)}, 6) + 0.0 AS s1_change_4, round(s1 - {P(6)}, 6) + 0.0 AS s1_change_6, round(s1 - 2 * ({P(4)}) + {P(8)}, 6) + 0.0 AS s1_acceleration FROM tel LEFT JOIN prof USING (pump_id) {W12}", (TEL, PROFILE))
def profile_padded_lags(spark, d):
    return _rounded(tl.padded_lags(telemetry(spark, d), profile(spark, d), ["s1"], (4, 6)), KEYS, ["s1_change_4", "s1_change_6", "s1_acceleration"])


WIN = lambda n: f"OVER (PARTITION BY run_id ORDER BY pos ROWS {n - 1} PRECEDING)"


@query(f"SELECT run_id, pos, round((sum(s1) {WIN(4)} + (4 - count(s1) {WIN(4)}) * m1) / 4, 6) + 0.0 AS s1_mean_4, round((sum(s2) {WIN(6)} + (6 - count(s2) {WIN(6)}) * m2) / 6, 6) + 0.0 AS s2_mean_6 FROM tel LEFT JOIN prof USING (pump_id)", (TEL, PROFILE))
def rolling_mean_padded(spark, d):
    return _rounded(tl.rolling_mean(telemetry(spark, d), profile(spark, d), ["s1", "s2"], (4, 6)), KEYS, ["s1_mean_4", "s2_mean_6"])


@query("""SELECT run_id, pos, round(regr_slope(y, x), 6) + 0.0 AS s1_slope_5 FROM (SELECT a.run_id, a.pos, k AS x, coalesce(b.s1, p.m1) AS y FROM tel a CROSS JOIN (SELECT unnest(range(0, 5)) AS k) LEFT JOIN tel b ON b.run_id = a.run_id AND b.pos = a.pos - 4 + k LEFT JOIN prof p ON p.pump_id = a.pump_id) GROUP BY 1, 2""", (TEL, PROFILE))
def rolling_slope_padded(spark, d):
    return _rounded(tl.rolling_slope(telemetry(spark, d), profile(spark, d), ["s1"], 5), KEYS, ["s1_slope_5"])


@query(f"SELECT run_id, pos, round(((sum(s1) {WIN(4)} + (4 - count(s1) {WIN(4)}) * m1) / 4 - m1) / nullif(sd1, 0), 5) + 0.0 AS s1_z FROM tel LEFT JOIN prof USING (pump_id)", (TEL, PROFILE))
def deviation_score(spark, d):
    return _rounded(tl.deviation(telemetry(spark, d), profile(spark, d), ["s1"], 4), KEYS, ["s1_z"], 5)


@query("SELECT run_id, pos, coalesce(pos - min(CASE WHEN abs(s1) > 100 THEN pos END) OVER (PARTITION BY run_id ORDER BY pos), -1) AS onset_age FROM tel", (TEL,))
def onset_age(spark, d):
    return tl.onset_age(telemetry(spark, d), "s1", 100.0).select("run_id", "pos", "onset_age")


@query("SELECT run_id, pos, rem AS remaining, run_fault, CAST(coalesce(rem > 0 AND rem <= 10, false) AS INTEGER) AS label_10, CAST(coalesce(rem > 0 AND rem <= 30, false) AS INTEGER) AS label_30 FROM (SELECT *, CASE WHEN NOT is_normal THEN (max(pos) OVER (PARTITION BY run_id) - pos) * 5 END AS rem, max(fault_type) OVER (PARTITION BY run_id) AS run_fault FROM tel) WHERE rem IS NULL OR rem > 0", (TEL,))
def remaining_time_labels(spark, d):
    return tl.remaining_labels(telemetry(spark, d), (10, 30)).select("run_id", "pos", "remaining", "run_fault", "label_10", "label_30")


@query("""WITH rr AS (SELECT pump_id, run_id, row_number() OVER (PARTITION BY pump_id ORDER BY min(ts), run_id) AS k, count(*) OVER (PARTITION BY pump_id) AS n FROM tel WHERE NOT is_normal GROUP BY 1, 2),
nn AS (SELECT run_id, pos, row_number() OVER (PARTITION BY pump_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY pump_id) AS n FROM tel WHERE is_normal)
SELECT run_id, pos, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM (SELECT t.run_id, t.pos, k, n FROM tel t JOIN rr ON rr.run_id = t.run_id UNION ALL SELECT run_id, pos, k, n FROM nn)""".replace("WITH rr AS", "SELECT * FROM (WITH rr AS") + ")", (TEL,))
def grouped_time_split(spark, d):
    return tl.split_by_rank(telemetry(spark, d)).select("run_id", "pos", "split")


@query("SELECT run_id, pos, greatest(s1 / 100, s2 / 300) > 2.8 OR s1 > 82 OR s2 / 1000 > 0.15 OR s1 / 2 > 80 AS alarm FROM tel", (TEL,))
def rule_alarm_threshold(spark, d):
    rows = telemetry(spark, d).withColumns({"v1": F.col("s1") / 100, "v2": F.col("s2") / 300, "dp": F.col("s2") / 1000, "t1": F.col("s1") / 2})
    return rows.select("run_id", "pos", tl.rule_alarm(rows, ["v1", "v2"], ["t1"], "s1", "dp").alias("alarm"))


@query("SELECT pump_id, round(quantile_cont(s1, 0.5), 6) AS s1_median, round(quantile_cont(s2, 0.5), 6) AS s2_median FROM (SELECT *, row_number() OVER (PARTITION BY pump_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY pump_id) AS n FROM tel WHERE is_normal) WHERE k <= floor(n * 0.6) GROUP BY 1", (TEL,))
def normal_profile(spark, d):
    return _rounded(tl.normal_profile(telemetry(spark, d), ["s1", "s2"]), ["pump_id"], ["s1_median", "s2_median"])


@query("SELECT run_id, pos, round((s1 + s2) / 2, 6) AS v_mean, greatest(s1, s2) AS v_max, least(s1, s2) AS v_min FROM tel", (TEL,))
def per_group_sensor_stats(spark, d):
    return tl.signals(telemetry(spark, d), {"v": ["s1", "s2"]}).select("run_id", "pos", F.round("v_mean", 6).alias("v_mean"), "v_max", "v_min")


@query("""SELECT pump_id, round((sum(s1) FILTER (WHERE k <= 12) + (12 - least(max(n), 12)) * any_value(m1)) / 12, 6) AS s1_mean_12, round((sum(s1) FILTER (WHERE k <= 36) + (36 - least(max(n), 36)) * any_value(m1)) / 36, 6) AS s1_mean_36
 FROM (SELECT *, row_number() OVER (PARTITION BY pump_id ORDER BY ts DESC) AS k, least(count(*) OVER (PARTITION BY pump_id), 289) AS n FROM tel WHERE s1 > 1) LEFT JOIN prof USING (pump_id) WHERE k <= 289 GROUP BY 1""", (TEL, PROFILE))
def latest_reading_features(spark, d):
    rows = telemetry(spark, d).select("pump_id", "ts", F.when(F.col("s1") > 1, F.col("s1")).alias("s1"))
    found = tl.latest_features(rows, ["s1"], profile(spark, d))[0]
    return _rounded(found, ["pump_id"], ["s1_mean_12", "s1_mean_36"])


@query("SELECT run_id, pos, coalesce(m1, s1) AS s1 FROM tel LEFT JOIN prof USING (pump_id)", (TEL, PROFILE))
def stuck_sensor(spark, d):
    return tl.freeze_sensor(telemetry(spark, d), profile(spark, d), "s1").select("run_id", "pos", "s1")


def interleaved(spark, d) -> DataFrame:
    """Runs of three readings that start in turn, their rows mixed within steps."""
    e = table(spark, d, "events").select((F.col("event_id") % 8).cast("string").alias("pump_id"), F.floor(F.col("event_id") / 8).alias("first_step"), F.col("value"))
    rows = e.select("pump_id", "value", "first_step", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    rows = rows.select("pump_id", (F.col("first_step") + F.col("k")).alias("step"), (F.col("value") + F.col("k")).alias("score"), F.when(F.col("k") == 2, F.lit("fault")).alias("fault_type"), "first_step", "k")
    return rows.withColumn("row_pos", (F.col("step") * 3 + (2 - F.col("k"))) * 8 + F.col("pump_id").cast("long"))


@query("SELECT CAST(event_id % 8 AS VARCHAR) AS pump_id, event_id // 8 + k AS step, CAST(((event_id // 8) * 3 + 2) * 8 + event_id % 8 AS BIGINT) AS run_id, CAST(k AS INTEGER) AS pos FROM events CROSS JOIN (SELECT unnest(range(0, 3)) AS k)")
def reconstruct_runs(spark, d):
    rows = interleaved(spark, d).select("pump_id", "step", "row_pos", "fault_type", "score")
    return tl.reconstruct_runs(rows, (3,)).select("pump_id", "step", F.col("run_id").cast("long"), F.col("pos").cast("int"))


@query("""SELECT round(avg(d), 9) AS along_runs, round(avg(m), 9) AS at_random FROM (SELECT abs(s.score - lag(s.score) OVER w) AS d, abs(o.score - lag(o.score) OVER w) AS m FROM ranked s JOIN ranked o ON o.pump_id = s.pump_id AND o.step = s.step AND o.r = s.k WINDOW w AS (PARTITION BY s.pump_id, s.run ORDER BY s.step))""", (
    "readings AS (SELECT event_id % 8 AS pump_id, event_id // 8 AS run, event_id // 8 + k AS step, value + k AS score, ((event_id // 8 + k) * 3 + 2 - k) * 8 + event_id % 8 AS row_pos FROM events, range(3) t(k))",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY pump_id, step ORDER BY row_pos) AS k, row_number() OVER (PARTITION BY pump_id, step ORDER BY md5('4|' || row_pos)) AS r FROM readings)",
))
def reconstruction_quality(spark, d):
    rows = interleaved(spark, d).select("pump_id", "step", "row_pos", "fault_type", "score")
    return tl.run_quality(tl.reconstruct_runs(rows, (3,)), "score").select(*[F.round(c, 9).alias(c) for c in ("along_runs", "at_random")])


# ------------------------------------------------------------------ models

FEATURES = [f"event_count_{SHORT}d", f"alarm_count_{SHORT}d", f"alarm_count_{LONG}d", f"episode_starts_{LONG}d", "last_event_age_hours", f"last_alarm_age_hours_{LONG}d"]


def model_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    """Training rows, and those of the held-out period; labels are split by a hash where the journal has one class."""
    # stored once: else the snapshots are built again for the rows to fit and for those to score
    rows = stored(v2_of(spark, d).filter("label IS NOT NULL").select("channel_id", "as_of", "label", *FEATURES), "model-rows")
    return rows.filter(F.col("as_of") < F.lit(TEST).cast("timestamp_ntz")), rows.filter(F.col("as_of") >= F.lit(TEST).cast("timestamp_ntz"))


def fitted_on(train: DataFrame, fit):
    """What ``fit`` makes of ``train``, which is kept for its iterations and given back."""
    train = train.persist()
    try:
        return fit(train)
    finally:
        train.unpersist()


@query()
def fit_logistic(spark, d):
    train, test = model_rows(spark, d)
    return fitted_on(train, lambda rows: ml.fit_logistic(rows, FEATURES)).score(test).select("channel_id", "as_of", "label", "score")


@query()
def fit_gbt(spark, d):
    train, test = model_rows(spark, d)
    return boosting.fit_gbt(train, FEATURES, trees=4, leaves=8, rate=0.1, least=20).score(test).select("channel_id", "as_of", "label", "score")


#: The isotonic value at a score is the largest, over starts at or below it, of the least mean, over ends at or above it.
ISO = """iso AS (SELECT score, row_number() OVER (ORDER BY score) AS i, sum(label) AS s, count(*) AS n FROM sc WHERE split = 'train' GROUP BY 1),
iso_sums AS (SELECT score, i, s, n, sum(s) OVER (ORDER BY i) AS ss, sum(n) OVER (ORDER BY i) AS nn FROM iso),
iso_means AS (SELECT a.i AS j, b.i AS k, (b.ss - a.ss + a.s) / (b.nn - a.nn + a.n) AS m FROM iso_sums a JOIN iso_sums b ON b.i >= a.i),
iso_low AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM iso_means),
fitted AS (SELECT score AS x, (SELECT max(low) FROM iso_low WHERE j <= i AND k = i) AS y FROM iso)"""


@query("""SELECT channel_id, as_of, score, round(CASE WHEN lo IS NULL THEN (SELECT arg_min(y, x) FROM fitted) WHEN hi IS NULL THEN (SELECT arg_max(y, x) FROM fitted) WHEN lo.x = hi.x THEN lo.y ELSE lo.y + (score - lo.x) * (hi.y - lo.y) / (hi.x - lo.x) END, 9) AS probability
 FROM (SELECT channel_id, as_of, score, (SELECT max({'x': x, 'y': y}) FROM fitted WHERE x <= score) AS lo, (SELECT min({'x': x, 'y': y}) FROM fitted WHERE x >= score) AS hi FROM sc WHERE split <> 'train')""", (*SC_CTES, ISO))
def isotonic_calibration(spark, d):
    rows = scored(spark, d)
    found = ml.Calibration(rows.filter("split = 'train'")).apply(rows.filter("split <> 'train'"))
    return found.select("channel_id", "as_of", "score", F.round("probability", 9).alias("probability"))
