"""Queries of sources, sinks and jobs: each writes what Spark derives from the tables to files of its own and reads these."""

from __future__ import annotations

from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import models as ml
from ..sources import journal
from ..sources.scratch import shared_path
from ..streaming import operators as so
from ..streaming import risks as rk
from ..streaming.run import rocksdb, run_into, run_until_told
from .base import GAP, LONG, OBS, SHORT, TEST, directory, observations, table
from .core import query
from .evaluation import FEATURES, fitted_on, model_rows
from .single import events_stream


def _csv(df: DataFrame, name: str) -> str:
    path = shared_path(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, event_type AS value, props AS note FROM events")
def scan_journal_csv(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("Event"), F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.date_format("ts", "HH:mm:ss").alias("Time"), F.col("event_type").alias("Value"), F.col("props").alias("Note"))
    path = shared_path(spark, "journal-csv")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return journal.scan_journal_csv(spark, path, {"Event": "event_id", "Date": "date", "Time": "time", "Value": "value", "Note": "note"}, escape='"')


@query("SELECT CAST(c_custkey AS VARCHAR) AS channel_id, CAST(c_nationkey AS VARCHAR) AS object_id, c_mktsegment AS sensor_type FROM customer")
def scan_directory(spark, d):
    path = _csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "directory-csv")
    return journal.scan_directory(spark, path, {"c_custkey": "channel_id", "c_nationkey": "object_id", "c_mktsegment": "sensor_type"})


@query("SELECT CAST(ts AS TIMESTAMP) AS ts, value AS temperature, (1000 + value / 10) * 0.750062 AS pressure FROM events")
def scan_weather(spark, d):
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"), F.col("value").alias("t2m"), (1000 + F.col("value") / 10).alias("sp"), F.lit("x").alias("other"))
    return journal.scan_weather(spark, _csv(rows, "weather-csv"), {"time": "ts", "t2m": "temperature", "sp": "pressure"})


@query("SELECT CAST(user_id AS VARCHAR) AS pump_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_type = 'error' THEN event_type END AS fault_type, value AS s1, -value AS s2 FROM events")
def scan_telemetry(spark, d):
    fault = F.when(F.col("event_type") == "error", F.col("event_type"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("pump_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), fault.alias("fault_type"), F.col("value").alias("s1"), F.lit(0).alias("unused"), (-F.col("value")).alias("s2"))
    return journal.scan_telemetry(spark, _csv(rows, "telemetry-csv"), ["s1", "s2"])


@query("SELECT *, true AS refused_again FROM obs", (OBS,))
def write_parquet_once(spark, d):
    """What was published, and that a second publication at the same place is refused."""
    o, path = observations(spark, d), shared_path(spark, "published")
    journal.write_once(o, path)
    try:
        journal.write_once(o.limit(1), path)
        refused = False
    except AnalysisException:
        refused = True
    return journal.scan_observations(spark, path).withColumn("refused_again", F.lit(refused))


@query("SELECT max(occurred_at) AS last_at, max(occurred_at) < now()::TIMESTAMP - INTERVAL 1 HOUR AS stale FROM obs", (OBS,))
def stream_gap_monitor(spark, d):
    """What the monitor tells once all records are old: their newest moment."""
    with rocksdb(spark):
        told = run_until_told(so.stream_gap_monitor(events_stream(spark, d, 100), 3600))
    return told.select("last_at", (F.col("kind") == "stale").alias("stale"))


RISK = {f"alarm_count_{SHORT}d": 0.8, f"event_count_{LONG}d": -0.05}


@query(f"""WITH obs AS (SELECT CAST(user_id AS VARCHAR) AS channel_id, CAST(ts AS TIMESTAMP) AS occurred_at, event_type = 'error' AS is_alarm FROM events),
moment AS (SELECT date_trunc('milliseconds', max(occurred_at)) + INTERVAL 999 MICROSECOND AS t FROM obs),
facts AS (SELECT channel_id, t, min(occurred_at) AS f, max(occurred_at) AS l, max(CASE WHEN is_alarm THEN occurred_at END) AS la, count_if(is_alarm AND occurred_at > t - INTERVAL {SHORT} DAY) AS a, count_if(occurred_at > t - INTERVAL {LONG} DAY) AS n FROM obs, moment GROUP BY ALL),
channels AS (SELECT channel_id, t, 1 / (1 + exp(-(0.8 * a - 0.05 * n - 1))) AS score FROM facts WHERE l > t - INTERVAL {LONG} DAY AND f <= t - INTERVAL 1 DAY AND (la IS NULL OR la < t - INTERVAL {GAP} SECOND)),
best AS (SELECT CAST(c_nationkey AS VARCHAR) AS object_id, t, max(score) AS score FROM channels JOIN customer ON CAST(c_custkey AS VARCHAR) = channel_id AND c_acctbal >= 0 GROUP BY ALL)
SELECT object_id, 'alarm' AS model, t AS opened_at, t + INTERVAL 1 DAY AS window_end, score, 'open' AS status FROM best WHERE score >= 0.5""")
def stream_risk_scoring(spark, d):
    """Risks after the whole journal has come in one batch; the batch of features that comes again opens none twice."""
    place = shared_path(spark, "risks")
    no_gaps = spark.createDataFrame([], "start_at timestamp_ntz, end_at timestamp_ntz")
    job = rk.risk_job(directory(spark, d), no_gaps, RISK, -1.0, place, gap_seconds=GAP, long=LONG)

    def twice(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            job(batch, epoch)
            job(batch, epoch + 1)
        finally:
            batch.unpersist()

    with rocksdb(spark):
        run_into(rk.stream_features(events_stream(spark, d, 100), GAP, SHORT, LONG), twice)
    return rk.open_risks(spark, place).drop("epoch", "window_day")


RESULTS = "results AS (SELECT c_mktsegment AS name, avg(c_acctbal) / 10000 - 0.3 AS margin, count_if(c_acctbal < 0) / count(*) AS base_rate, count_if(c_acctbal > 3000) / count(*) AS f1, count_if(c_acctbal > 6000) / count(*) AS rule_f1, count_if(c_acctbal > 5000) / count(*) AS ap, count_if(c_acctbal > 4000) / count(*) AS precision FROM customer GROUP BY 1)"


@query("SELECT r.* FROM results r, (SELECT ap AS a, precision AS p FROM results WHERE name = 'BUILDING') WHERE name = 'BUILDING' OR margin >= 0 AND base_rate <= 0.35 AND f1 > rule_f1 AND ap >= a + 0.01 AND precision >= p ORDER BY ap DESC, name LIMIT 1", (RESULTS,))
def qualify_and_choose(spark, d):
    share = lambda c: F.count_if(c) / F.count("*")
    debt = F.col("c_acctbal")
    results = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(
        (F.avg(debt) / 10000 - 0.3).alias("margin"), share(debt < 0).alias("base_rate"), share(debt > 3000).alias("f1"), share(debt > 6000).alias("rule_f1"), share(debt > 5000).alias("ap"), share(debt > 4000).alias("precision")
    )
    return mt.choose(results, "BUILDING")


@query()
def fit_categorical_gbt(spark, d):
    train, test = ((x.join(directory(spark, d).hint("merge"), "channel_id", "left")) for x in model_rows(spark, d))
    fitted = fitted_on(train, lambda rows: ml.CategoricalFitted(rows, FEATURES, ["sensor_type"], trees=5, depth=4))
    return fitted.score(test).select("channel_id", "as_of", "label", "score")


GRID = [dict(zip(("trees", "depth", "rate", "least"), x, strict=True)) for x in product((2, 4), (1, 3), (0.1, 0.3), (5, 20))]


@query()
def grid_search_time(spark, d):
    """Held-out scores of the best of 16 grid points on the last days of training, with the point and its figure there."""
    train, test = model_rows(spark, d)
    inner = F.col("as_of") >= F.lit("2024-01-20").cast("timestamp_ntz")
    point, fitted, tried = fitted_on(train, lambda rows: ml.grid_search_time(rows.filter(~inner), rows.filter(inner), FEATURES, GRID))
    return fitted.score(test).select("channel_id", "as_of", "label", "score", *[F.lit(v).alias(f"chosen_{k}") for k, v in point.items()], F.lit(max(tried)).alias("inner_average_precision"))
