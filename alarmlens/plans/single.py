"""Queries of single steps, small models and streams, with their SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import time as tm
from ..operators import episodes as ep
from ..operators import metrics as mt
from ..operators import models as ml
from ..operators import snapshots as sn
from ..operators import telemetry as tl
from ..sources import journal
from ..sources.scratch import shared_path
from ..streaming import operators as so
from ..streaming.run import rocksdb, run_available, run_into
from .base import DAILY, DOWN, EPS, FUTURE, HOURS, OBS, SEEN, TEST, UP, VALIDATION, observations
from .core import CD, ORACLES, QUERIES, RAW_SQL, SC_CTES, V1_CTES, eps_of, query, raw_journal, scored, v1_of
from .evaluation import CURVE, FEATURES, curve, fitted_on, model_rows

__all__ = ["ORACLES", "QUERIES"]
C = (*SC_CTES, CURVE)


@query("SELECT * FROM obs", (OBS,))
def scan_observations(spark, d):
    return observations(spark, d)


@query("SELECT channel_id, occurred_at, raw_value IN ('error', 'signup') AND raw_value = 'signup' AS is_alarm FROM obs", (OBS,))
def class_alarm_filter(spark, d):
    marked = observations(spark, d).withColumn("is_alarm", F.col("raw_value").isin("error", "signup"))
    return ep.with_class_alarm(marked, ["signup"]).select("channel_id", "occurred_at", "is_alarm")


@query("SELECT value, TRY_CAST(value AS DOUBLE) IS NOT NULL AS numeric, count(*) AS row_count FROM raw GROUP BY 1", (RAW_SQL,))
def numeric_value_profile(spark, d):
    return raw_journal(spark, d).groupBy("value").agg(F.bool_or(tx.finite_double(F.col("value"))).alias("numeric"), F.count("*").alias("row_count"))


@query(f"SELECT event_id, {UP.format('occurred_at')} AS snapshot_at, {DOWN.format('occurred_at')} AS label_at FROM obs", (OBS,))
def ceil_to_midnight(spark, d):
    t = F.col("occurred_at")
    return observations(spark, d).select("event_id", tm.snapshot_bucket(t).alias("snapshot_at"), tm.label_bucket(t).alias("label_at"))


@query(f"SELECT event_id, {HOURS.format('occurred_at', chr(84) + 'IMESTAMP ' + chr(39) + TEST + chr(39))} AS hours, date_diff('microsecond', occurred_at, TIMESTAMP '{TEST}') / 86400000000.0 AS days FROM obs", (OBS,))
def age_hours(spark, d):
    t, until = F.col("occurred_at"), sn.ntz(TEST)
    return observations(spark, d).select("event_id", tm.age_hours(t, until).alias("hours"), tm.age_days(t, until).alias("days"))


@query("SELECT channel_id, as_of, CAST(month(as_of) AS INTEGER) AS month, CAST(isodow(as_of) - 1 AS INTEGER) AS weekday FROM daily", (OBS, DAILY))
def calendar_features(spark, d):
    return sn.snapshot_daily(observations(spark, d)).select("channel_id", "as_of", F.month("as_of").alias("month"), tm.weekday(F.col("as_of")).alias("weekday"))


@query(f"SELECT channel_id, as_of, CASE WHEN as_of < TIMESTAMP '{VALIDATION}' THEN 'train' WHEN as_of < TIMESTAMP '{TEST}' THEN 'validation' ELSE 'test' END AS split FROM daily", (OBS, DAILY))
def assign_split(spark, d):
    return sn.snapshot_daily(observations(spark, d)).select("channel_id", "as_of", sn.assign_split(F.col("as_of"), VALIDATION, TEST).alias("split"))


@query("SELECT exclusion_reason, count(*) AS row_count FROM v1 GROUP BY 1", V1_CTES)
def exclusion_reason(spark, d):
    return v1_of(spark, d).groupBy("exclusion_reason").agg(F.count("*").alias("row_count"))


@query("SELECT channel_id, as_of, event_count, first_observation, global_first, global_last FROM daily JOIN seen USING (channel_id) CROSS JOIN bounds", (OBS, DAILY, SEEN))
def join_channel_first_bounds(spark, d):
    o = observations(spark, d)
    return sn.with_bounds(sn.snapshot_daily(o), o).select("channel_id", "as_of", "event_count", "first_observation", "global_first", "global_last")


@query("SELECT channel_id, as_of, coalesce(known_future, 0) AS known_future, coalesce(unknown_future, 0) AS unknown_future FROM daily LEFT JOIN future USING (channel_id, as_of)", (OBS, EPS, DAILY, FUTURE))
def join_future_labels(spark, d):
    return sn.join_future(sn.snapshot_daily(observations(spark, d)).select("channel_id", "as_of"), eps_of(spark, d))


@query("SELECT channel_id, as_of FROM daily WHERE as_of <= (SELECT max(as_of) FROM daily) - INTERVAL 1 DAY", (OBS, DAILY))
def complete_horizon_tail(spark, d):
    return sn.complete_tail(sn.snapshot_daily(observations(spark, d)).select("channel_id", "as_of"), 48)


@query("SELECT channel_id, as_of, round(1 / (1 + exp(-(0.5 * alarm_count - 0.1 * event_count - 1))), 9) AS score FROM daily", (OBS, DAILY))
def manual_logistic_score(spark, d):
    rows = ml.linear_score(sn.snapshot_daily(observations(spark, d)), {"alarm_count": 0.5, "event_count": -0.1}, -1.0)
    return rows.select("channel_id", "as_of", F.round("score", 9).alias("score"))


@query("SELECT channel_id, as_of, round((score + rule) / 2, 9) AS both FROM sc", SC_CTES)
def score_ensemble(spark, d):
    return ml.ensemble(scored(spark, d), "score", "rule", "both").select("channel_id", "as_of", F.round("both", 9).alias("both"))


@query("SELECT coalesce((SELECT threshold FROM cp WHERE least(prec - 0.2, rec - 0.1) >= 0 ORDER BY least(prec - 0.2, rec - 0.1) DESC, threshold DESC LIMIT 1), (SELECT threshold FROM cp ORDER BY f1 DESC, threshold DESC LIMIT 1)) AS threshold, (SELECT count(*) FROM cp WHERE least(prec - 0.2, rec - 0.1) >= 0) > 0 AS by_margin", C)
def naive_baselines(spark, d):
    return mt.fixed_threshold(curve(spark, d), 0.2, 0.1)


@query("""SELECT l AS class, n AS row_count, CASE WHEN p > 0 THEN tp / p ELSE 0.0 END AS precision, CASE WHEN n > 0 THEN tp / n ELSE 0.0 END AS recall, 2 * tp / (p + n) AS f1, (SELECT avg(CAST(label = rule AS INTEGER)) FROM sc) AS accuracy
 FROM (SELECT l, (SELECT count(*) FROM sc WHERE label = l) AS n, (SELECT count(*) FROM sc WHERE rule = l) AS p, (SELECT count(*) FROM sc WHERE rule = l AND label = l) AS tp FROM (VALUES (0), (1)) v(l))""", SC_CTES)
def router_report(spark, d):
    return ml.multiclass_report(scored(spark, d), "label", "rule")


@query("SELECT channel_id, as_of, label FROM sc WHERE split <> 'validation'", SC_CTES)
def union_parts(spark, d):
    rows = scored(spark, d).select("channel_id", "as_of", "label", "split")
    return tl.union_parts(rows.filter("split = 'train'"), rows.filter("split = 'test'")).select("channel_id", "as_of", "label")


@query("SELECT avg(label) AS score, count(*) AS row_count FROM sc WHERE split = 'train'", SC_CTES)
def constant_score(spark, d):
    """The prevalence among training rows as everybody's score."""
    train = scored(spark, d).filter("split = 'train'")
    rate = train.agg(F.avg("label").alias("score"))
    return train.drop("score").crossJoin(F.broadcast(rate)).groupBy("score").agg(F.count("*").alias("row_count"))


@query()
def fit_mlp(spark, d):
    train, test = model_rows(spark, d)
    return fitted_on(train, lambda rows: ml.fit_mlp(rows, FEATURES, (8,))).score(test).select("channel_id", "as_of", "label", "score")


@query()
def mixture_of_experts(spark, d):
    rows = scored(spark, d).withColumn("kind", F.pmod(F.col("channel_id").cast("long"), F.lit(3)).cast("string"))
    mixture = fitted_on(rows.filter("split = 'train'"), lambda train: ml.MixtureOfExperts(train, ["score", "rule"], "kind", trees=5, depth=3))
    return mixture.score(rows.filter("split <> 'train'"), "mixed").select("channel_id", "as_of", "mixed")


# ------------------------------------------------------------------ streams


def _folder(rows: DataFrame, name: str, key: str, parts: int = 4) -> str:
    """``rows`` as files that a stream reads one by one: slices of the range of ``key``, written in this order."""
    path = shared_path(rows.sparkSession, name)
    low, high = rows.agg(F.min(key), F.max(key)).first()
    at = F.least(F.floor((F.col(key) - low) * parts / max(1, high - low)), F.lit(parts - 1)) if low is not None else F.lit(0)
    for k in range(parts):
        rows.filter(at == k).drop(key).coalesce(1).write.mode("append").parquet(path)
    return path


@lru_cache(maxsize=32)
def _journal(spark, d: str) -> str:
    return _folder(observations(spark, d).withColumn("_at", tm.micros(F.col("occurred_at"))), "journal", "_at")


def events_stream(spark, d, files: int = 1) -> DataFrame:
    """The journal in four files, oldest records first."""
    return journal.stream_observations(spark, _journal(spark, d), files_per_trigger=files)


@lru_cache(maxsize=32)
def _raw(spark, d: str) -> str:
    return _folder(raw_journal(spark, d).withColumn("_k", F.pmod(F.xxhash64("event_id", "channel_id", "date", "time"), F.lit(1000))), "raw-journal", "_k")


def raw_stream(spark, d) -> DataFrame:
    """Spoiled journal text in four files."""
    return journal.stream_observations(spark, _raw(spark, d), "event_id string, channel_id string, date string, time string, alarm string, value string")


@query("SELECT channel_id, day, row_count, alarm_count FROM cd", (OBS, CD))
def stream_daily_counts(spark, d):
    return run_available(so.stream_daily_counts(events_stream(spark, d)), "complete").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("SELECT channel_id, CAST(date_trunc('day', occurred_at) AS TIMESTAMP) + INTERVAL 1 DAY * k AS as_of, count(*) AS event_count, count(*) FILTER (WHERE is_alarm) AS alarm_count FROM obs CROSS JOIN (SELECT unnest(range(1, 4)) AS k) GROUP BY 1, 2", (OBS,))
def stream_trailing_counts(spark, d):
    return run_available(so.stream_trailing_counts(events_stream(spark, d), "3 days", "1 day"), "complete").withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))


@query("SELECT * FROM obs", (OBS,))
def stream_dedupe(spark, d):
    stream = events_stream(spark, d)
    return run_available(so.stream_dedupe(stream.union(stream), delay="60 days"))


@query(ORACLES["normalize_quarantine"])
def stream_normalize(spark, d):
    """Good rows of a spoiled stream; ``stream_rejects`` has the others."""
    return run_available(so.stream_normalize(raw_stream(spark, d))[0])


@query(ORACLES["quarantined_rows"])
def stream_rejects(spark, d):
    """Rejected rows that a sink of both kinds has kept; its last batch runs twice."""
    path = shared_path(spark, "normalized")
    keep = so.normalize_into(path)
    twice = lambda batch, epoch: (keep(batch, epoch), keep(batch, epoch))
    run_into(raw_stream(spark, d), twice)
    return so.rejected_rows(spark, path)


@query(f"SELECT channel_id, first_alarm_at, last_alarm_at, alarm_row_count FROM eps WHERE last_alarm_at + INTERVAL 43200 SECOND < (SELECT max(occurred_at) FROM obs) - INTERVAL 1 HOUR", (OBS, EPS))
def stream_session_episodes(spark, d):
    rows = run_available(so.stream_session_episodes(events_stream(spark, d), 43_200, "1 hour"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_alarm_at", "last_alarm_at")})


@query("""SELECT channel_id, first_alarm_at, last_alarm_at, alarm_row_count, left_boundary, 'observed_quiet_gap' AS right_boundary FROM eps
 WHERE last_alarm_at + INTERVAL 43200 SECOND < (SELECT date_trunc('milliseconds', max(occurred_at)) FROM obs) - INTERVAL 1 HOUR""", (OBS, EPS))
def stream_episodes(spark, d):
    """Episodes that were over when the watermark, the last record less an hour, had passed the gap after them."""
    with rocksdb(spark):
        return run_available(so.stream_episodes(events_stream(spark, d), 43_200, "1 hour"))
