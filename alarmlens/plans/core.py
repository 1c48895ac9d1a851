"""Queries of ingest, episodes, snapshots, objects and serving, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import time as tm
from ..operators import episodes as ep
from ..operators import ingest, objects as ob, serving as sv, snapshots as sn
from ..sources import journal
from ..sources.scratch import shared_path
from .base import (
    DAILY, DENSE, DIR, DOWN, EPS, FUTURE, GAP, GAP_HOURS, GAP_ROWS, GRID, HOURS, LONG, OBJECTS, OBS, SEEN, SHORT, TEST, TRAIL, V1, V2, VALIDATION,
    directory, episodes_sql, gaps, objects, observations, table,
)

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, ctes: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return add


def eps_of(spark: SparkSession, d: str) -> DataFrame:
    return ep.build_episodes(observations(spark, d), GAP)


def v1_of(spark: SparkSession, d: str) -> DataFrame:
    return sn.build_examples(observations(spark, d), eps_of(spark, d), gaps(spark), VALIDATION, TEST, GAP)


def v2_of(spark: SparkSession, d: str) -> DataFrame:
    return sn.build_examples_v2(observations(spark, d), eps_of(spark, d), gaps(spark), VALIDATION, TEST, GAP, SHORT, LONG)


# ------------------------------------------------------------------ ingest

BAD = "CASE WHEN event_id % 97 = 0 THEN '' ELSE CAST(event_id AS {s}) END AS event_id, CASE WHEN event_id % 89 = 0 THEN NULL ELSE concat(' ', CAST(user_id AS {s})) END AS channel_id"
ALARM = "CASE WHEN event_id % 83 = 0 THEN 'maybe' WHEN event_type = 'error' THEN ' TRUE' ELSE 'f ' END AS alarm"
RAW_SQL = f"""raw AS (SELECT {BAD.format(s='VARCHAR')}, CASE WHEN event_id % 79 = 0 THEN strftime(ts, '%Y-%-m-%-d') ELSE strftime(ts, '%Y-%m-%d') END AS date,
  CASE WHEN event_id % 73 = 0 THEN '25:00:00' ELSE strftime(ts, '%H:%M:%S') END AS time, {ALARM}, CASE WHEN event_id % 71 = 0 THEN '' WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE event_type END AS value FROM events)"""
#: date texts as the strict parser wants them
REASON_SQL = """marked AS (SELECT *, TRY_CAST(CASE WHEN regexp_full_match(trim(date), '\\d{4}-\\d{2}-\\d{2}') THEN trim(date) || ' ' || trim(time) END AS TIMESTAMP) AS moment,
  CASE WHEN lower(trim(alarm)) IN ('true', 't') THEN true WHEN lower(trim(alarm)) IN ('false', 'f') THEN false END AS mark FROM raw),
judged AS (SELECT *, CASE WHEN event_id IS NULL OR trim(event_id) = '' OR channel_id IS NULL OR trim(channel_id) = '' THEN 'missing_id' WHEN moment IS NULL THEN 'timestamp' WHEN mark IS NULL THEN 'alarm' END AS reason FROM marked)"""


def raw_journal(spark: SparkSession, d: str) -> DataFrame:
    """The events as journal text, some rows spoiled."""
    e = table(spark, d, "events")
    return e.selectExpr(
        *BAD.format(s="STRING").split(", CASE WHEN event_id % 89")[:1],
        "CASE WHEN event_id % 89" + BAD.format(s="STRING").split(", CASE WHEN event_id % 89")[1],
        "CASE WHEN event_id % 79 = 0 THEN date_format(ts, 'yyyy-M-d') ELSE date_format(ts, 'yyyy-MM-dd') END AS date",
        "CASE WHEN event_id % 73 = 0 THEN '25:00:00' ELSE date_format(ts, 'HH:mm:ss') END AS time", ALARM,
        "CASE WHEN event_id % 71 = 0 THEN '' WHEN event_id % 2 = 0 THEN CAST(event_id AS STRING) ELSE event_type END AS value",
    )


@query("SELECT trim(event_id) AS event_id, trim(channel_id) AS channel_id, moment AS occurred_at, mark AS is_alarm, value AS raw_value FROM judged WHERE reason IS NULL", (RAW_SQL, REASON_SQL))
def normalize_quarantine(spark, d):
    return ingest.normalize_quarantine(raw_journal(spark, d))[0]


@query("SELECT event_id, channel_id, date, time, alarm, value, reason FROM judged WHERE reason IS NOT NULL", (RAW_SQL, REASON_SQL))
def quarantined_rows(spark, d):
    return ingest.normalize_quarantine(raw_journal(spark, d))[1]


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS channel_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS occurred_at, event_type = 'error' AS is_alarm, event_type AS raw_value FROM events")
def normalize_strict(spark, d):
    e = table(spark, d, "events")
    raw = e.select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("channel_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"), (F.col("event_type") == "error").cast("string").alias("alarm"), F.col("event_type").alias("value"))
    return ingest.normalize_strict(raw)


@query("SELECT event_id, CAST(ts AS TIMESTAMP) AS local_at, CASE WHEN hour(ts) BETWEEN 0 AND 23 THEN CAST(ts AS TIMESTAMP) - INTERVAL 1 HOUR END AS utc_at FROM events")
def local_to_utc_unambiguous(spark, d):
    """January has no clock change, so Central European time is one hour ahead throughout."""
    return table(spark, d, "events").select("event_id", F.col("ts").alias("local_at"), tm.local_to_utc(F.col("ts"), "Europe/Berlin").alias("utc_at"))


@query("SELECT alarm, CAST(count(*) AS BIGINT) AS row_count, bool_or(mark) AS parsed FROM marked GROUP BY alarm", (RAW_SQL, REASON_SQL))
def parse_bool_token(spark, d):
    raw = raw_journal(spark, d)
    return raw.groupBy("alarm").agg(F.count("*").alias("row_count"), F.bool_or(tx.parse_bool_token(F.col("alarm"))).alias("parsed"))


@query("SELECT event_type, count(*) AS row_count FROM (SELECT CASE WHEN event_id % 50 = 0 THEN 'value' ELSE event_type END AS event_type, CASE WHEN event_id % 50 = 0 THEN 'alarm' ELSE 'x' END AS mark FROM events) WHERE NOT (event_type = 'value' AND mark = 'alarm') GROUP BY 1")
def drop_repeated_headers(spark, d):
    spoiled = F.col("event_id") % 50 == 0
    rows = table(spark, d, "events").select(F.when(spoiled, "value").otherwise(F.col("event_type")).alias("event_type"), F.when(spoiled, "alarm").otherwise("x").alias("mark"))
    return ingest.drop_repeated_headers(rows, {"event_type": "value", "mark": "alarm"}).groupBy("event_type").agg(F.count("*").alias("row_count"))


DOUBLED = "doubled AS (SELECT * FROM obs UNION ALL SELECT * FROM obs WHERE CAST(event_id AS BIGINT) % 10 = 0 UNION ALL SELECT event_id, channel_id, occurred_at + INTERVAL 1 SECOND, is_alarm, raw_value FROM obs WHERE CAST(event_id AS BIGINT) % 15 = 0)"


def doubled(spark, d) -> DataFrame:
    o = observations(spark, d)
    n = F.col("event_id").cast("long")
    return o.union(o.filter(n % 10 == 0)).union(o.filter(n % 15 == 0).withColumn("occurred_at", F.col("occurred_at") + tm.seconds(1)))


@query("SELECT DISTINCT * FROM doubled", (OBS, DOUBLED))
def dedupe_exact(spark, d):
    return ingest.dedupe_exact(doubled(spark, d))


@query("SELECT (SELECT count(*) FROM doubled) AS rows_in, (SELECT count(*) FROM (SELECT DISTINCT * FROM doubled)) AS rows_out, (SELECT count(*) FROM doubled) - (SELECT count(*) FROM (SELECT DISTINCT * FROM doubled)) AS removed", (OBS, DOUBLED))
def dedupe_removed_rows(spark, d):
    return ingest.removed_rows(doubled(spark, d))


@query("""SELECT count(*) AS duplicated_ids, CAST(sum(n) AS BIGINT) AS rows_in_groups, CAST(sum(n - 1) AS BIGINT) AS extra_rows, count(*) FILTER (WHERE p > 1) AS conflicting_ids, count(*) FILTER (WHERE c > 1) AS multi_channel_ids,
 count(*) FILTER (WHERE t > 1) AS multi_time_ids FROM (SELECT event_id, count(*) AS n, count(DISTINCT (channel_id, occurred_at, is_alarm, raw_value)) AS p, count(DISTINCT channel_id) AS c, count(DISTINCT occurred_at) AS t FROM doubled GROUP BY 1 HAVING count(*) > 1)""", (OBS, DOUBLED))
def duplicate_id_diagnosis(spark, d):
    return ingest.diagnose_duplicates(doubled(spark, d))


@query("SELECT count(*) AS near_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM renamed GROUP BY channel_id, occurred_at, is_alarm, raw_value HAVING count(DISTINCT event_id) > 1)", (OBS, "renamed AS (SELECT * FROM obs UNION ALL SELECT event_id || 'b', channel_id, occurred_at, is_alarm, raw_value FROM obs WHERE CAST(event_id AS BIGINT) % 12 = 0)"))
def near_duplicate_rows(spark, d):
    o = observations(spark, d)
    return ingest.near_duplicates(o.union(o.filter(F.col("event_id").cast("long") % 12 == 0).withColumn("event_id", F.concat("event_id", F.lit("b")))))


@query("""SELECT count(*) AS row_count, count(DISTINCT event_id) AS distinct_event_ids, count(*) FILTER (WHERE mark) AS alarm_rows, count(*) FILTER (WHERE mark IS NULL) AS invalid_alarm, count(*) FILTER (WHERE moment IS NULL) AS invalid_time,
 count(*) FILTER (WHERE event_id IS NULL OR trim(event_id) = '') AS missing_event_id, count(*) FILTER (WHERE channel_id IS NULL OR trim(channel_id) = '') AS missing_channel_id, count(*) FILTER (WHERE trim(value) = '') AS empty_value,
 count(*) FILTER (WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL) AS numeric_value, count(*) FILTER (WHERE d.channel_id IS NULL) AS unmapped_rows, count(DISTINCT CASE WHEN d.channel_id IS NULL THEN m.channel_id END) AS unmapped_channels, min(moment) AS first_at, max(moment) AS last_at
 FROM (SELECT event_id, channel_id, value, mark, moment FROM marked) m LEFT JOIN dir d ON trim(m.channel_id) = d.channel_id""".replace("event_id IS NULL OR trim(event_id)", "m.event_id IS NULL OR trim(m.event_id)").replace("WHERE channel_id IS NULL OR trim(channel_id)", "WHERE m.channel_id IS NULL OR trim(m.channel_id)"), (RAW_SQL, REASON_SQL, DIR))
def profile_journal(spark, d):
    return ingest.profile_journal(raw_journal(spark, d), directory(spark, d))


@query("""SELECT count(*) AS row_count, count(*) FILTER (WHERE reason IS NULL) AS valid, count(*) FILTER (WHERE reason = 'missing_id') AS rejected_missing_id, count(*) FILTER (WHERE reason = 'timestamp') AS rejected_timestamp, count(*) FILTER (WHERE reason = 'alarm') AS rejected_alarm,
 min(moment) FILTER (WHERE reason IS NULL) AS first_at, max(moment) FILTER (WHERE reason IS NULL) AS last_at, count(DISTINCT trim(j.channel_id)) FILTER (WHERE reason IS NULL AND d.channel_id IS NULL) AS unmatched_channels FROM judged j LEFT JOIN dir d ON trim(j.channel_id) = d.channel_id""", (RAW_SQL, REASON_SQL, DIR))
def audit_report(spark, d):
    return ingest.audit_report(raw_journal(spark, d), directory(spark, d))


@query("SELECT channel_id, count(*) AS row_count FROM obs WHERE channel_id NOT IN (SELECT channel_id FROM dir) GROUP BY 1", (OBS, DIR))
def anti_unmapped(spark, d):
    return ingest.unmapped(observations(spark, d), directory(spark, d))


@query("SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)) AS repeated_channels, (SELECT count(*) FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(*) > 1)) AS repeated_facilities, (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) AS missing_facility")
def fk_check(spark, d):
    """Keys of all customers, those that are not in the directory too."""
    channels = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("channel_id"), F.col("c_nationkey").cast("string").alias("object_id"))
    return ingest.catalogue_report(channels, objects(spark, d))


CD = "cd AS (SELECT channel_id, CAST(date_trunc('day', occurred_at) AS TIMESTAMP) AS day, count(*) AS row_count, count(*) FILTER (WHERE is_alarm) AS alarm_count, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM obs GROUP BY 1, 2)"


@query("SELECT * FROM cd", (OBS, CD))
def write_channel_day(spark, d):
    """What the sink holds after all days were written, and the last one again."""
    o, path = observations(spark, d), shared_path(spark, "channel-days")
    journal.write_channel_day(o, path)
    last = o.agg(F.max("occurred_at").alias("last_at")).first()["last_at"]
    journal.write_channel_day(o.filter(tm.midnight(F.col("occurred_at")) == tm.midnight(F.lit(last).cast("timestamp_ntz"))), path)
    return journal.read_channel_day(spark, path)


@query("SELECT day, CAST(sum(row_count) AS BIGINT) AS row_count, CAST(sum(alarm_count) AS BIGINT) AS alarm_count, count(*) AS active_channels FROM cd GROUP BY 1", (OBS, CD))
def daily_counts(spark, d):
    return ingest.daily_counts(journal.channel_day(observations(spark, d)))


@query("SELECT day, row_count FROM (SELECT day, CAST(sum(row_count) AS BIGINT) AS row_count FROM cd GROUP BY 1) ORDER BY row_count DESC, day LIMIT 3", (OBS, CD))
def top_alarm_days(spark, d):
    return ingest.daily_counts(journal.channel_day(observations(spark, d))).orderBy(F.desc("row_count"), "day").limit(3).select("day", "row_count")


@query("SELECT count(*) AS channels, round(min(s), 9) AS least, round(quantile_cont(s, 0.5), 9) AS middle, round(max(s), 9) AS most FROM (SELECT count(*) / (date_diff('day', min(day), max(day)) + 1) AS s FROM cd GROUP BY channel_id)", (OBS, CD))
def channel_coverage(spark, d):
    rows = ingest.channel_coverage(journal.channel_day(observations(spark, d)))
    return rows.select("channels", *[F.round(c, 9).alias(c) for c in ("least", "middle", "most")])


@query("SELECT CAST(g AS TIMESTAMP) AS day FROM (SELECT unnest(generate_series((SELECT min(day) FROM cd), (SELECT max(day) FROM cd), INTERVAL 1 DAY)) AS g) WHERE g NOT IN (SELECT day FROM cd)", (OBS, CD))
def missing_calendar_days(spark, d):
    return ingest.missing_days(observations(spark, d))


@query("SELECT count(*) AS channels, round(quantile_cont(m, 0.05), 6) AS q05, round(quantile_cont(m, 0.5), 6) AS q50, round(quantile_cont(m, 0.95), 6) AS q95 FROM (SELECT channel_id, quantile_cont(s, 0.5) AS m FROM (SELECT channel_id, date_diff('microsecond', lag(occurred_at) OVER (PARTITION BY channel_id ORDER BY occurred_at), occurred_at) / 1000000.0 AS s FROM obs) WHERE s IS NOT NULL GROUP BY 1)", (OBS,))
def interarrival_quantiles(spark, d):
    rows = ingest.interarrival(observations(spark, d))
    return rows.select("channels", *[F.round(c, 6).alias(c) for c in ("q05", "q50", "q95")])


@query("SELECT (SELECT count(*) FROM (SELECT occurred_at, lag(occurred_at) OVER (ORDER BY CAST(event_id AS BIGINT)) AS p FROM obs) WHERE occurred_at < p) AS steps_back, (SELECT count(*) FROM (SELECT 1 FROM obs WHERE is_alarm GROUP BY channel_id, occurred_at HAVING count(*) > 1)) AS repeated_alarm_moments, (SELECT count(*) FROM (SELECT channel_id FROM obs GROUP BY 1 HAVING bool_and(is_alarm))) AS alarm_only_channels", (OBS,))
def journal_order_checks(spark, d):
    return ingest.order_checks(observations(spark, d).withColumn("source_row", F.col("event_id").cast("long")))


@query("SELECT count(DISTINCT event_id) AS distinct_values FROM obs", (OBS,))
def exact_distinct_partitioned(spark, d):
    return ingest.exact_distinct(observations(spark, d), "event_id").agg(F.sum("distinct_values").alias("distinct_values"))


@query("SELECT channel_id FROM (SELECT DISTINCT channel_id FROM obs) ORDER BY md5(channel_id || '|2'), channel_id LIMIT 50", (OBS,))
def hash_sample_channels(spark, d):
    return ingest.sample_channels(observations(spark, d), 50)


@query(f"""SELECT channel_id, as_of, label, stratum FROM (SELECT *, CASE label WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'excluded' END AS stratum FROM v1)
 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('3|' || channel_id || '|' || strftime(as_of, '%Y-%m-%d'))) <= 20""", (OBS, EPS, DAILY, FUTURE, SEEN, GAP_ROWS, V1))
def stratified_sample(spark, d):
    strata = {"positive": F.col("label") == 1, "negative": F.col("label") == 0, "excluded": F.col("label").isNull()}
    by = [F.col("channel_id"), F.date_format("as_of", "yyyy-MM-dd")]
    return ingest.stratified_sample(v1_of(spark, d), strata, 20, by=by).select("channel_id", "as_of", "label", "stratum")


# ------------------------------------------------------------------ episodes


@query("SELECT * FROM eps", (OBS, EPS))
def sessionize_alarms(spark, d):
    return eps_of(spark, d)


@query("SELECT * FROM eps2", (OBS, episodes_sql("eps2", "is_alarm AND raw_value IN ('error')", 86_400)))
def class_episodes(spark, d):
    marked = observations(spark, d).withColumn("is_alarm", F.col("raw_value").isin("error", "purchase"))
    return ep.build_episodes(ep.with_class_alarm(marked, ["error"]), 86_400)


@query("SELECT p + INTERVAL 1 MICROSECOND AS start_at, t AS end_at, date_diff('microsecond', p, t) / 1000000.0 AS seconds_between_records FROM (SELECT occurred_at AS t, lag(occurred_at) OVER (ORDER BY occurred_at) AS p FROM obs) WHERE date_diff('microsecond', p, t) >= 1200000000", (OBS,))
def detect_log_gaps(spark, d):
    return ep.log_gaps(observations(spark, d), 1200)


INC = f"""inc_s AS (SELECT coalesce(object_id, 'unknown') AS object_id, first_alarm_at AS t FROM eps LEFT JOIN dir USING (channel_id)),
inc_g AS (SELECT *, lag(t) OVER (PARTITION BY object_id ORDER BY t) AS p FROM inc_s), inc_n AS (SELECT *, count(CASE WHEN p IS NULL OR t - p > INTERVAL 60 MINUTE THEN 1 END) OVER (PARTITION BY object_id ORDER BY t) AS n FROM inc_g),
inc AS (SELECT object_id, min(t) AS started_at, max(t) AS ended_at, {DOWN.format('min(t)')} AS day, count(*) AS size FROM inc_n GROUP BY object_id, n)"""


@query("SELECT * FROM inc", (OBS, EPS, DIR, INC))
def incident_chaining(spark, d):
    return ep.incidents(eps_of(spark, d), directory(spark, d))


@query("""SELECT count(*) AS starts, count(*) FILTER (WHERE ok) AS recovered, count(*) FILTER (WHERE ok) / count(*) AS share FROM (SELECT e.channel_id, e.first_alarm_at, (SELECT max(o.occurred_at) FROM obs o WHERE o.channel_id = e.channel_id AND NOT o.is_alarm AND o.occurred_at < e.first_alarm_at) > p AS ok
 FROM (SELECT channel_id, first_alarm_at, lag(last_alarm_at) OVER (PARTITION BY channel_id ORDER BY first_alarm_at) AS p FROM eps) e WHERE p IS NOT NULL)""", (OBS, EPS))
def episode_recovery_stats(spark, d):
    return ep.recovery_stats(observations(spark, d), eps_of(spark, d))


# ------------------------------------------------------------------ snapshots


@query("SELECT * FROM daily", (OBS, DAILY))
def snapshot_daily(spark, d):
    return sn.snapshot_daily(observations(spark, d))


@query("SELECT * FROM future", (OBS, EPS, FUTURE))
def known_unknown_future(spark, d):
    return sn.future_starts(eps_of(spark, d))


V1_CTES = (OBS, EPS, DAILY, FUTURE, SEEN, GAP_ROWS, V1)
V1_COLS = f"channel_id, as_of, event_count AS event_count_24h, alarm_count AS alarm_count_24h, {HOURS.format('last_event', 'as_of')} AS last_event_age_hours, {HOURS.format('last_alarm', 'as_of')} AS last_alarm_age_hours_24h, split, label, exclusion_reason, 'recorded_alarm_episode' AS label_scope"


@query(f"SELECT {V1_COLS} FROM v1", V1_CTES)
def snapshots_v1(spark, d):
    return v1_of(spark, d)


@query("SELECT * FROM grid", (OBS, DAILY, GRID))
def activity_islands(spark, d):
    return sn.activity_grid(sn.snapshot_daily(observations(spark, d)), LONG)


@query("SELECT * FROM dense", (OBS, EPS, DAILY, GRID, DENSE))
def grid_densify_join(spark, d):
    daily = sn.snapshot_daily(observations(spark, d))
    return sn.densify(sn.activity_grid(daily, LONG), daily, eps_of(spark, d))


@query("SELECT * FROM trail", (OBS, EPS, DAILY, GRID, TRAIL))
def trailing_windows(spark, d):
    daily = sn.snapshot_daily(observations(spark, d))
    return sn.trailing(sn.densify(sn.activity_grid(daily, LONG), daily, eps_of(spark, d)), SHORT, LONG)


@query("SELECT * FROM gap_hours", (OBS, DAILY, GRID, GAP_ROWS, GAP_HOURS))
def gap_overlap_hours(spark, d):
    return sn.gap_hours(sn.activity_grid(sn.snapshot_daily(observations(spark, d)), LONG), gaps(spark), LONG, f"log_gap_hours_{LONG}d")


@query("SELECT as_of, (SELECT count(*) FROM gaps WHERE start_at <= as_of + INTERVAL 1 DAY AND end_at > as_of - INTERVAL 1 DAY) > 0 AS in_gap FROM (SELECT DISTINCT as_of FROM daily)", (OBS, DAILY, GAP_ROWS))
def exists_gap_overlap(spark, d):
    days = sn.snapshot_daily(observations(spark, d)).select("as_of").distinct()
    return sn.overlaps_gap(days, gaps(spark), tm.hours(24), tm.hours(24))


V2_COLS = f"""channel_id, as_of, event_count_24h, alarm_count_24h, event_count_{SHORT}d, alarm_count_{SHORT}d, event_count_{LONG}d, alarm_count_{LONG}d, active_days_{LONG}d, episode_starts_{SHORT}d, episode_starts_{LONG}d,
 {HOURS.format('last_event', 'as_of')} AS last_event_age_hours, {HOURS.format('last_alarm', 'as_of')} AS last_alarm_age_hours_{LONG}d, date_diff('microsecond', first_observation, as_of) / 86400000000.0 AS channel_age_days, log_gap_hours_{LONG}d, split, label, exclusion_reason, 'recorded_alarm_episode' AS label_scope"""


@query(f"SELECT {V2_COLS} FROM v2", (V2,))
def snapshots_v2(spark, d):
    return v2_of(spark, d)


@query("SELECT split, exclusion_reason, count(*) AS row_count, count(*) FILTER (WHERE label = 1) AS positives, min(as_of) AS first_as_of, max(as_of) AS last_as_of FROM v2 GROUP BY 1, 2", (V2,))
def split_summary(spark, d):
    return sn.split_summary(v2_of(spark, d))


@query("SELECT CAST(0 AS BIGINT) AS label_without_reason, CAST(0 AS BIGINT) AS windows_not_nested, CAST(0 AS BIGINT) AS more_alarms_than_rows, CAST(0 AS BIGINT) AS too_many_days, CAST(0 AS BIGINT) AS negative_age")
def dataset_invariants(spark, d):
    return sn.invariants(v2_of(spark, d), SHORT, LONG)


CLS = episodes_sql("cls", "raw_value = 'view'")


@query(f"""SELECT channel_id, as_of, label, CASE WHEN exclusion_reason IS NOT NULL OR coalesce(u, 0) > 0 THEN NULL ELSE CAST(coalesce(k, 0) > 0 AS INTEGER) END AS label_view FROM v1 LEFT JOIN
 (SELECT channel_id, {DOWN.format('first_alarm_at')} AS as_of, count(*) FILTER (WHERE left_boundary = 'observed_quiet_gap') AS k, count(*) FILTER (WHERE left_boundary = 'unknown') AS u FROM cls GROUP BY 1, 2) USING (channel_id, as_of)""", (*V1_CTES, CLS))
def class_labels(spark, d):
    views = ep.build_episodes(observations(spark, d).withColumn("is_alarm", F.col("raw_value") == "view"), GAP)
    return sn.class_labels(v1_of(spark, d), {"view": views}).select("channel_id", "as_of", "label", "label_view")


@query("""SELECT channel_id, as_of, CASE WHEN count(*) FILTER (WHERE left_boundary = 'unknown') > 0 THEN NULL ELSE CAST(count(*) FILTER (WHERE left_boundary = 'observed_quiet_gap') > 0 AS INTEGER) END AS label_72h
 FROM daily LEFT JOIN (SELECT channel_id, first_alarm_at, left_boundary FROM eps) e USING (channel_id) WHERE false GROUP BY 1, 2
 UNION ALL SELECT channel_id, as_of, CASE WHEN u > 0 THEN NULL ELSE CAST(k > 0 AS INTEGER) END FROM (SELECT d.channel_id, d.as_of, count(e.first_alarm_at) FILTER (WHERE left_boundary = 'observed_quiet_gap') AS k, count(e.first_alarm_at) FILTER (WHERE left_boundary = 'unknown') AS u
 FROM daily d LEFT JOIN eps e ON e.channel_id = d.channel_id AND e.first_alarm_at > d.as_of AND e.first_alarm_at <= d.as_of + INTERVAL 3 DAY GROUP BY 1, 2)""", (OBS, EPS, DAILY))
def horizon_labels(spark, d):
    return sn.horizon_labels(sn.snapshot_daily(observations(spark, d)).select("channel_id", "as_of"), eps_of(spark, d), 72)


@query(f"SELECT channel_id, as_of, as_of + INTERVAL 1 DAY <= TIMESTAMP '{VALIDATION}' AS in_train, as_of >= TIMESTAMP '{VALIDATION}' AND as_of + INTERVAL 1 DAY <= TIMESTAMP '{TEST}' AS in_eval FROM daily", (OBS, DAILY))
def fold_masks(spark, d):
    return sn.fold_masks(sn.snapshot_daily(observations(spark, d)).select("channel_id", "as_of"), VALIDATION, TEST)


@query(f"SELECT channel_id, as_of, as_of < TIMESTAMP '{VALIDATION}' - INTERVAL 3 DAY AS in_train, as_of >= TIMESTAMP '{VALIDATION}' AND as_of + INTERVAL 3 DAY <= TIMESTAMP '{TEST}' AS in_eval FROM daily WHERE as_of <= (SELECT max(as_of) FROM daily) - INTERVAL 2 DAY", (OBS, DAILY))
def horizon_split_masks(spark, d):
    rows = sn.complete_tail(sn.snapshot_daily(observations(spark, d)).select("channel_id", "as_of"), 72)
    return sn.horizon_masks(rows, 72, VALIDATION, TEST)


@query("SELECT channel_id, sensor_type, CAST(code AS INTEGER) AS code FROM dir LEFT JOIN (SELECT w, row_number() OVER (ORDER BY w) - 1 AS code FROM (SELECT DISTINCT sensor_type AS w FROM dir WHERE sensor_type <> 'BUILDING')) ON sensor_type = w", (DIR,))
def category_codes(spark, d):
    rows = directory(spark, d)
    return sn.category_codes(rows, "sensor_type", rows.filter("sensor_type <> 'BUILDING'").select("sensor_type"), "code").select("channel_id", "sensor_type", "code")


@query(f"SELECT channel_id, as_of, CAST(event_count AS DOUBLE) AS event_count_24h, CAST(alarm_count AS DOUBLE) AS alarm_count_24h, {HOURS.format('last_event', 'as_of')} AS last_event_age_hours, CASE WHEN {HOURS.format('last_alarm', 'as_of')} < 24 THEN {HOURS.format('last_alarm', 'as_of')} END AS last_alarm_age_hours_24h FROM v1", V1_CTES)
def model_matrix_v1(spark, d):
    return sn.model_matrix_v1(v1_of(spark, d))


V2_MATRIX = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in [f"{c}_{w}" for w in ("24h", f"{SHORT}d", f"{LONG}d") for c in ("event_count", "alarm_count")] + [f"active_days_{LONG}d", f"episode_starts_{SHORT}d", f"episode_starts_{LONG}d"])


@query(f"SELECT channel_id, as_of, {V2_MATRIX}, {HOURS.format('last_event', 'as_of')} AS last_event_age_hours, {HOURS.format('last_alarm', 'as_of')} AS last_alarm_age_hours_{LONG}d, least(date_diff('microsecond', first_observation, as_of) / 86400000000.0, 365.0) AS channel_age_days, log_gap_hours_{LONG}d, CAST(month(as_of) AS DOUBLE) AS month, CAST(isodow(as_of) - 1 AS DOUBLE) AS weekday FROM v2", (V2,))
def model_matrix_v2(spark, d):
    return sn.model_matrix_v2(v2_of(spark, d), SHORT, LONG, True)


# ------------------------------------------------------------------ objects

EX = f"ex AS (SELECT {V2_COLS}, object_id, sensor_type FROM v2 LEFT JOIN dir USING (channel_id))"


def examples_of_objects(spark, d) -> DataFrame:
    return v2_of(spark, d).join(directory(spark, d), "channel_id", "left")


TYPES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _rollup_sql() -> str:
    w = ("24h", f"{SHORT}d", f"{LONG}d")
    sums = [f"{c}_{x}" for x in w for c in ("event_count", "alarm_count")] + [f"episode_starts_{LONG}d"]
    maxima = [f"alarm_count_{SHORT}d", f"episode_starts_{SHORT}d", f"episode_starts_{LONG}d", f"active_days_{LONG}d"]
    minima = [f"last_alarm_age_hours_{LONG}d", "last_event_age_hours"]
    active = [f"alarm_count_{SHORT}d", f"alarm_count_{LONG}d", f"episode_starts_{SHORT}d"]
    lead = [*sums, f"active_days_{LONG}d", f"episode_starts_{SHORT}d", "last_event_age_hours", f"last_alarm_age_hours_{LONG}d", "channel_age_days", f"log_gap_hours_{LONG}d"]
    cols = ["count(*) AS channels"] + [f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in sums] + [f"max({c}) AS max_{c}" for c in maxima] + [f"min({c}) AS min_{c}" for c in minima]
    cols += [f"count(*) FILTER (WHERE {c} > 0) AS active_{c}" for c in active] + [f"count(*) FILTER (WHERE {c} > 0) / count(*) AS share_{c}" for c in active]
    cols += [f"count(*) FILTER (WHERE sensor_type = '{t}') AS \"channels_{t}\"" for t in TYPES] + [f"CAST(coalesce(sum(episode_starts_{SHORT}d) FILTER (WHERE sensor_type = '{t}'), 0) AS BIGINT) AS \"starts_{t}\"" for t in TYPES]
    cols += [f"max({c}) FILTER (WHERE r = 1) AS lead_{c}" for c in lead] + ["CAST(month(as_of) AS INTEGER) AS month", "CAST(isodow(as_of) - 1 AS INTEGER) AS weekday"]
    ranked = f"SELECT *, row_number() OVER (PARTITION BY object_id, as_of ORDER BY alarm_count_{SHORT}d DESC, episode_starts_{LONG}d DESC, last_alarm_age_hours_{LONG}d ASC NULLS LAST, channel_id) AS r FROM ex WHERE object_id IS NOT NULL"
    return f"SELECT object_id, as_of, {', '.join(cols)} FROM ({ranked}) GROUP BY object_id, as_of"


@query(_rollup_sql(), (V2, DIR, EX))
def object_day_rollup(spark, d):
    return ob.object_day_rollup(examples_of_objects(spark, d).filter("object_id IS NOT NULL"), TYPES, SHORT, LONG)


@query("SELECT object_id, as_of, max(label) AS label, max(CAST(alarm_count_24h > 0 AS INTEGER)) AS rule FROM ex WHERE label IS NOT NULL AND object_id IS NOT NULL GROUP BY 1, 2", (V2, DIR, EX))
def object_day_labels(spark, d):
    return ob.object_labels(examples_of_objects(spark, d).filter("object_id IS NOT NULL"))


@query(f"SELECT object_id, as_of, channel_id FROM ex WHERE object_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY object_id, as_of ORDER BY alarm_count_{SHORT}d DESC, episode_starts_{LONG}d DESC, last_alarm_age_hours_{LONG}d ASC NULLS LAST, channel_id) = 1", (V2, DIR, EX))
def lead_channel(spark, d):
    return ob.lead_channel(examples_of_objects(spark, d).filter("object_id IS NOT NULL"), SHORT, LONG).select("object_id", "as_of", "channel_id")


@query("""SELECT e.channel_id, e.as_of, (SELECT CAST(sum(x.alarm_count_24h) AS BIGINT) FROM ex x WHERE x.object_id = e.object_id AND x.as_of = e.as_of) - e.alarm_count_24h AS object_other_alarm_count_24h,
 (SELECT CAST(sum(x.alarm_count_24h) AS BIGINT) FROM ex x WHERE x.object_id = e.object_id AND x.sensor_type = e.sensor_type AND x.as_of = e.as_of) - e.alarm_count_24h AS type_other_alarm_count_24h,
 CASE WHEN object_id IS NOT NULL THEN (SELECT count(*) FROM ex x WHERE x.object_id = e.object_id AND x.as_of = e.as_of) - 1 END AS object_other_channels FROM ex e""", (V2, DIR, EX))
def neighbour_minus_self(spark, d):
    rows = ob.neighbour_features(examples_of_objects(spark, d), ["alarm_count_24h"])
    return rows.select("channel_id", "as_of", "object_other_alarm_count_24h", "type_other_alarm_count_24h", "object_other_channels")


@query("SELECT channel_id, coalesce(object_id, 'none') AS object_id, count(*) AS row_count FROM obs LEFT JOIN dir USING (channel_id) GROUP BY 1, 2", (OBS, DIR))
def join_directory(spark, d):
    return ep.with_object(observations(spark, d), directory(spark, d), "none").groupBy("channel_id", "object_id").agg(F.count("*").alias("row_count"))


OD = "od AS (SELECT DISTINCT object_id, as_of FROM daily JOIN dir USING (channel_id)), os AS (SELECT object_id, first_alarm_at AS t FROM eps JOIN dir USING (channel_id))"
OD_CTES = (OBS, EPS, DAILY, DIR, OD)


def object_days(spark, d) -> DataFrame:
    return ep.with_object(sn.snapshot_daily(observations(spark, d)).select("channel_id", "as_of"), directory(spark, d)).filter("object_id IS NOT NULL").select("object_id", "as_of").distinct()


def object_starts(spark, d) -> DataFrame:
    return ep.with_object(eps_of(spark, d), directory(spark, d)).filter("object_id IS NOT NULL").select("object_id", F.col("first_alarm_at").alias("occurred_at"))


def _n(cond: str, rel: str = "os") -> str:
    return f"(SELECT count(*) FROM {rel} s WHERE s.object_id = od.object_id AND {cond})"


@query(f"SELECT object_id, as_of, {_n('s.t <= as_of AND s.t > as_of - INTERVAL 24 HOUR')} AS starts_24h, {_n('s.t <= as_of AND s.t > as_of - INTERVAL 168 HOUR')} AS starts_168h, {_n('s.t <= as_of AND s.t > as_of - INTERVAL 720 HOUR')} AS starts_720h, least({HOURS.format('(SELECT max(s.t) FROM os s WHERE s.object_id = od.object_id AND s.t <= as_of)', 'as_of')}, 720.0) AS last_start_age_hours FROM od", OD_CTES)
def target_history(spark, d):
    return ob.target_history(object_days(spark, d), eps_of(spark, d), directory(spark, d))


def _rhythm_sql() -> str:
    day = "CAST(as_of AS DATE)"
    on = lambda shift: f"(SELECT count(*) FROM os s WHERE s.object_id = od.object_id AND CAST(s.t AS DATE) = {day} - {shift})"
    active = lambda w: f"(SELECT count(DISTINCT CAST(s.t AS DATE)) FROM os s WHERE s.object_id = od.object_id AND CAST(s.t AS DATE) < {day} AND CAST(s.t AS DATE) >= {day} - {w})"
    streak = f"""(SELECT CAST(coalesce(min(k), 400) - 1 AS BIGINT) FROM (SELECT unnest(range(1, 60)) AS k) WHERE NOT EXISTS (SELECT 1 FROM os s WHERE s.object_id = od.object_id AND CAST(s.t AS DATE) = {day} - CAST(k AS INTEGER)))"""
    return f"""SELECT object_id, as_of, {_n('s.t <= as_of AND s.t > as_of - INTERVAL 90 DAY')} AS starts_90d, {_n('s.t <= as_of AND s.t > as_of - INTERVAL 365 DAY')} AS starts_365d,
 {_n('s.t >= as_of - INTERVAL 7 DAY AND s.t < as_of - INTERVAL 7 DAY + INTERVAL 72 HOUR')} AS same_window_1w, {_n('s.t >= as_of - INTERVAL 14 DAY AND s.t < as_of - INTERVAL 14 DAY + INTERVAL 72 HOUR')} AS same_window_2w,
 {active(7)} AS active_7d, {active(30)} AS active_30d, {active(90)} AS active_90d, {streak} AS streak, {on(7)} + {on(14)} + {on(21)} + {on(28)} AS same_weekday_4w FROM od"""


@query(_rhythm_sql(), OD_CTES)
def rhythm_features(spark, d):
    return ob.rhythm(object_days(spark, d), object_starts(spark, d), 72)


@query(f"SELECT object_id, as_of, {_n('s.t <= as_of AND s.t > as_of - INTERVAL 24 HOUR')} AS count_24h, {_n('s.t <= as_of AND s.t > as_of - INTERVAL 72 HOUR')} AS count_72h FROM od", OD_CTES)
def range_count_between(spark, d):
    rows = ob.count_in_windows(object_days(spark, d), object_starts(spark, d), "object_id", (24, 72))
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("count_24h", "count_72h")})


@query("SELECT object_id, as_of, (SELECT max(s.t) FROM os s WHERE s.object_id = od.object_id AND s.t <= as_of) AS previous_at FROM od", OD_CTES)
def asof_previous_start(spark, d):
    return ob.asof_previous(object_days(spark, d), object_starts(spark, d), "object_id")


@query("SELECT a.object_id, b.object_id AS sibling_id FROM objects a JOIN objects b ON a.parent_id = b.parent_id AND a.object_id <> b.object_id", (OBJECTS,))
def sibling_join(spark, d):
    return ob.siblings(objects(spark, d))


ACT = """oe AS (SELECT object_id, occurred_at AS t FROM obs JOIN dir USING (channel_id) WHERE raw_value = 'purchase'),
own AS (SELECT o.object_id, d.as_of, (SELECT count(*) FROM oe s WHERE s.object_id = o.object_id AND s.t <= d.as_of AND s.t > d.as_of - INTERVAL 24 HOUR) AS c1, (SELECT count(*) FROM oe s WHERE s.object_id = o.object_id AND s.t <= d.as_of AND s.t > d.as_of - INTERVAL 72 HOUR) AS c3,
 (SELECT count(*) FROM oe s WHERE s.object_id = o.object_id AND s.t <= d.as_of AND s.t > d.as_of - INTERVAL 168 HOUR) AS c7, CAST((SELECT count(*) FROM oe s WHERE s.object_id = o.object_id) > 0 AS INTEGER) AS has,
 (SELECT count(*) FROM os s WHERE s.object_id = o.object_id AND s.t <= d.as_of AND s.t > d.as_of - INTERVAL 24 HOUR) AS f1 FROM objects o CROSS JOIN (SELECT DISTINCT as_of FROM od) d),
own2 AS (SELECT *, CASE WHEN c7 > 0 THEN c1 / (c7 / 7) ELSE 0.0 END AS flap FROM own),
near AS (SELECT a.object_id, x.as_of, sum(c1) AS c1, sum(c3) AS c3, sum(c7) AS c7, sum(flap) AS flap, sum(has) AS has, sum(f1) AS f1 FROM objects a JOIN objects b ON a.parent_id = b.parent_id AND a.object_id <> b.object_id JOIN own2 x ON x.object_id = b.object_id GROUP BY 1, 2)"""


@query("""SELECT od.object_id, od.as_of, o.c1 AS on_24h, o.c3 AS on_72h, o.c7 AS on_168h, round(o.flap, 9) AS flap_ratio, o.has AS has_machines, CAST(coalesce(n.c1, 0) AS BIGINT) AS sibling_on_24h, CAST(coalesce(n.c3, 0) AS BIGINT) AS sibling_on_72h, CAST(coalesce(n.c7, 0) AS BIGINT) AS sibling_on_168h,
 round(coalesce(n.flap, 0.0), 9) AS sibling_flap_ratio, CAST(coalesce(n.has, 0) AS BIGINT) AS sibling_has_machines, CAST(coalesce(n.f1, 0) AS BIGINT) AS sibling_flood_24h FROM od LEFT JOIN own2 o USING (object_id, as_of) LEFT JOIN near n USING (object_id, as_of)""", (*OD_CTES, OBJECTS, ACT))
def pump_activity_features(spark, d):
    on = ep.with_object(observations(spark, d).filter("raw_value = 'purchase'"), directory(spark, d)).filter("object_id IS NOT NULL").select("object_id", "occurred_at")
    rows = ob.activity_features(object_days(spark, d), on, object_starts(spark, d), objects(spark, d), (24, 72, 168), (24,))
    return rows.withColumns({c: F.round(c, 9) for c in ("flap_ratio", "sibling_flap_ratio")})


WX = "wx AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, round(avg(value), 6) - 100 AS temperature, round(max(value), 6) AS pressure, round(min(value), 6) AS wind_speed, round(avg(value), 6) AS precipitation FROM events GROUP BY 1)"


def weather(spark, d) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    return e.agg((F.round(F.avg("value"), 6) - 100).alias("temperature"), F.round(F.max("value"), 6).alias("pressure"), F.round(F.min("value"), 6).alias("wind_speed"), F.round(F.avg("value"), 6).alias("precipitation"))


WX_W = "ww AS (SELECT d.as_of, w.*, d.as_of - INTERVAL 3 HOUR AS cut, CAST((temperature > 0) <> (lag(temperature) OVER (PARTITION BY d.as_of ORDER BY w.ts) > 0) AS INTEGER) AS x FROM (SELECT DISTINCT as_of FROM daily) d LEFT JOIN wx w ON w.ts <= d.as_of - INTERVAL 3 HOUR AND w.ts > d.as_of - INTERVAL 75 HOUR)"


@query("""SELECT as_of, CASE WHEN n1 = 24 THEN round(tm, 5) END AS temperature_mean_24h, CASE WHEN n1 = 24 THEN tl END AS temperature_min_24h, CASE WHEN n1 = 24 THEN tx END AS temperature_max_24h, CASE WHEN n3 = 72 THEN CAST(x AS BIGINT) END AS freeze_thaw_72h, p AS pressure,
 CASE WHEN n1 = 24 THEN wm END AS wind_max_24h, round(p - p0, 6) AS pressure_change_24h FROM (SELECT as_of, count(*) FILTER (WHERE ts > cut - INTERVAL 1 DAY) AS n1, count(ts) AS n3, avg(temperature) FILTER (WHERE ts > cut - INTERVAL 1 DAY) AS tm, min(temperature) FILTER (WHERE ts > cut - INTERVAL 1 DAY) AS tl,
 max(temperature) FILTER (WHERE ts > cut - INTERVAL 1 DAY) AS tx, sum(x) AS x, max(pressure) FILTER (WHERE ts = cut) AS p, max(pressure) FILTER (WHERE ts = cut - INTERVAL 1 DAY) AS p0, max(wind_speed) FILTER (WHERE ts > cut - INTERVAL 1 DAY) AS wm FROM ww GROUP BY 1)""", (OBS, DAILY, WX, WX_W))
def weather_window_features(spark, d):
    rows = ob.weather_features(weather(spark, d), sn.snapshot_daily(observations(spark, d)), 1)
    return rows.withColumn("temperature_mean_24h", F.round("temperature_mean_24h", 5)).withColumn("pressure_change_24h", F.round("pressure_change_24h", 6))


@query("SELECT as_of, CASE WHEN count(*) FILTER (WHERE ts > cut - INTERVAL 1 DAY) = 24 THEN round(sum(precipitation) FILTER (WHERE ts > cut - INTERVAL 1 DAY), 4) END AS precipitation_24h, CASE WHEN count(ts) = 72 THEN round(sum(precipitation), 4) END AS precipitation_72h FROM ww GROUP BY 1", (OBS, DAILY, WX, WX_W))
def precipitation_sums(spark, d):
    rows = ob.precipitation(weather(spark, d), sn.snapshot_daily(observations(spark, d)))
    return rows.select("as_of", *[F.round(c, 4).alias(c) for c in ("precipitation_24h", "precipitation_72h")])


@query("SELECT as_of, temperature AS temperature_at FROM (SELECT DISTINCT as_of FROM daily) LEFT JOIN wx ON ts = as_of", (OBS, DAILY, WX))
def exact_time_lookup(spark, d):
    return ob.value_at(sn.snapshot_daily(observations(spark, d)).select("as_of").distinct(), weather(spark, d), "as_of", "ts", "temperature", "temperature_at")


# ------------------------------------------------------------------ serving

MOMENT = "2024-01-20 10:30:00"
MOMENTS = f"asked AS (SELECT DISTINCT channel_id, m AS t FROM obs CROSS JOIN (VALUES (TIMESTAMP '{MOMENT}'), (TIMESTAMP '2024-01-12 00:00:00')) v(m))"
GAP2 = "sgaps AS (SELECT * FROM (VALUES (TIMESTAMP '2024-01-18 06:00:00', TIMESTAMP '2024-01-18 08:30:00')) t(start_at, end_at))"


def moments(spark, d) -> DataFrame:
    times = F.array(*[F.lit(x).cast("timestamp_ntz") for x in (MOMENT, "2024-01-12 00:00:00")])
    return observations(spark, d).select("channel_id").distinct().withColumn("t", F.explode(times))


def serving_gaps(spark) -> DataFrame:
    return spark.sql("SELECT TIMESTAMP_NTZ '2024-01-18 06:00:00' AS start_at, TIMESTAMP_NTZ '2024-01-18 08:30:00' AS end_at")


@query(f"""SELECT a.channel_id, a.t, count(*) FILTER (WHERE o.occurred_at > t - INTERVAL 1 DAY) AS event_count_24h, count(*) FILTER (WHERE is_alarm AND o.occurred_at > t - INTERVAL 1 DAY) AS alarm_count_24h,
 count(*) FILTER (WHERE o.occurred_at > t - INTERVAL {SHORT} DAY) AS event_count_{SHORT}d, count(*) FILTER (WHERE is_alarm AND o.occurred_at > t - INTERVAL {SHORT} DAY) AS alarm_count_{SHORT}d, count(*) AS event_count_{LONG}d, count(*) FILTER (WHERE is_alarm) AS alarm_count_{LONG}d,
 count(DISTINCT date_diff('microsecond', o.occurred_at, t) // 86400000000) AS active_days_{LONG}d, count(*) FILTER (WHERE st AND o.occurred_at > t - INTERVAL {SHORT} DAY) AS episode_starts_{SHORT}d, count(*) FILTER (WHERE st) AS episode_starts_{LONG}d,
 {HOURS.format('max(o.occurred_at)', 't')} AS last_event_age_hours, {HOURS.format('max(o.occurred_at) FILTER (WHERE is_alarm)', 't')} AS last_alarm_age_hours_{LONG}d, date_diff('microsecond', any_value(first_observation), t) / 86400000000.0 AS channel_age_days,
 (SELECT coalesce(sum(date_diff('microsecond', greatest(start_at, a.t - INTERVAL {LONG} DAY), least(end_at, a.t))), 0) / 3600000000.0 FROM sgaps WHERE start_at < a.t AND end_at > a.t - INTERVAL {LONG} DAY) AS log_gap_hours_{LONG}d
 FROM asked a JOIN (SELECT *, is_alarm AND coalesce(date_diff('microsecond', lag(occurred_at) OVER (PARTITION BY channel_id, is_alarm ORDER BY occurred_at), occurred_at) > {GAP * 1000000}, true) AS st FROM obs) o ON o.channel_id = a.channel_id AND o.occurred_at <= t AND o.occurred_at > t - INTERVAL {LONG} DAY JOIN seen s ON s.channel_id = a.channel_id GROUP BY a.channel_id, a.t""", (OBS, SEEN, MOMENTS, GAP2))
def point_in_time_features(spark, d):
    return sv.features_at(observations(spark, d), moments(spark, d), serving_gaps(spark), GAP, SHORT, LONG)


@query(f"""SELECT channel_id, t, CASE WHEN t - INTERVAL {LONG} DAY < (SELECT min(occurred_at) FROM obs) THEN 'global_history' WHEN (SELECT max(occurred_at) FROM obs WHERE occurred_at <= a.t) < t - INTERVAL 1 HOUR THEN 'stale_journal'
 WHEN (SELECT count(*) FROM sgaps WHERE start_at <= a.t AND end_at > a.t - INTERVAL 1 DAY) > 0 THEN 'known_log_gap' WHEN f IS NULL THEN 'unknown_channel' WHEN l <= t - INTERVAL {LONG} DAY THEN 'no_recent_records' WHEN t - INTERVAL 1 DAY < f THEN 'channel_history' WHEN la >= t - INTERVAL {GAP} SECOND THEN 'active_alarm' ELSE 'ok' END AS status
 FROM asked a LEFT JOIN (SELECT x.channel_id, x.t, min(occurred_at) AS f, max(occurred_at) AS l, max(occurred_at) FILTER (WHERE is_alarm) AS la FROM asked x JOIN obs o ON o.channel_id = x.channel_id AND o.occurred_at <= x.t GROUP BY 1, 2) USING (channel_id, t)""", (OBS, MOMENTS, GAP2))
def serving_refusals(spark, d):
    return sv.serving_status(observations(spark, d), moments(spark, d), serving_gaps(spark), GAP, LONG)


@query(f"""SELECT a.channel_id, a.t, count(c.t) FILTER (WHERE c.t > a.t - INTERVAL {LONG} DAY AND c.t <= a.t AND c.st) AS class_starts, coalesce(bool_or(c.t < a.t), false) AS ever_seen FROM asked a LEFT JOIN (SELECT channel_id, occurred_at AS t, coalesce(date_diff('microsecond', lag(occurred_at) OVER (PARTITION BY channel_id ORDER BY occurred_at), occurred_at) > {GAP * 1000000}, true) AS st FROM obs WHERE is_alarm AND raw_value = 'error') c ON c.channel_id = a.channel_id GROUP BY 1, 2""", (OBS, MOMENTS))
def class_history(spark, d):
    return sv.class_history(observations(spark, d), moments(spark, d), ["error"], GAP, LONG)


SC = "sc AS (SELECT channel_id, coalesce(object_id, 'unknown') AS object_id, sensor_type, as_of, label, split, CAST(alarm_count AS DOUBLE) / event_count AS score, CAST(alarm_count > 0 AS INTEGER) AS rule FROM v1 LEFT JOIN dir USING (channel_id) WHERE label IS NOT NULL)"
SC_CTES = (*V1_CTES, DIR, SC)


def scored(spark, d) -> DataFrame:
    rows = v1_of(spark, d).filter("label IS NOT NULL").join(directory(spark, d).hint("merge"), "channel_id", "left")
    return rows.select("channel_id", F.coalesce("object_id", F.lit("unknown")).alias("object_id"), "sensor_type", "as_of", "label", "split", (F.col("alarm_count_24h").cast("double") / F.col("event_count_24h")).alias("score"), (F.col("alarm_count_24h") > 0).cast("int").alias("rule"))


CH = "ch AS (SELECT object_id, channel_id, sensor_type, max(score) AS score FROM sc GROUP BY 1, 2, 3)"


def channel_scores(spark, d) -> DataFrame:
    return scored(spark, d).groupBy("object_id", "channel_id", "sensor_type").agg(F.max("score").alias("score"))


@query("SELECT object_id, channel_id, score, CAST(row_number() OVER (PARTITION BY object_id ORDER BY score DESC NULLS LAST, channel_id) AS INTEGER) AS rank FROM ch QUALIFY rank <= 5", (*SC_CTES, CH))
def top_suspects(spark, d):
    return sv.top_suspects(channel_scores(spark, d)).select("object_id", "channel_id", "score", "rank")


OBJ_SCORE = "ob AS (SELECT o.object_id, p AS probability, p AS score FROM objects o LEFT JOIN (SELECT object_id, max(score) AS p FROM sc GROUP BY 1) USING (object_id))"


@query("SELECT object_id, probability, score, CAST(row_number() OVER (ORDER BY probability DESC NULLS LAST, score DESC NULLS LAST, object_id) AS INTEGER) AS rank, coalesce(score >= 0.5, false) AS alert FROM ob", (*SC_CTES, OBJECTS, OBJ_SCORE))
def risk_map_rank(spark, d):
    best = scored(spark, d).groupBy("object_id").agg(F.max("score").alias("score"))
    rows = objects(spark, d).select("object_id").join(best, "object_id", "left").withColumn("probability", F.col("score"))
    return sv.risk_map(rows, 0.5).select("object_id", "probability", "score", "rank", "alert")


FAMILIES = "fam AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS family)"


@query("""SELECT object_id, coalesce((SELECT string_agg(family, ',' ORDER BY family) FROM fam WHERE NOT EXISTS (SELECT 1 FROM dir x WHERE x.object_id = d.object_id AND x.sensor_type = family)), '') AS missing, count(*) FILTER (WHERE o.channel_id IS NULL) AS silent_channels
 FROM dir d LEFT JOIN (SELECT DISTINCT channel_id FROM obs) o USING (channel_id) GROUP BY 1""", (OBS, DIR, FAMILIES))
def blind_spots(spark, d):
    rows = sv.blind_spots(directory(spark, d), TYPES, observations(spark, d))
    return rows.select("object_id", F.array_join(F.array_sort("missing"), ",").alias("missing"), "silent_channels")


@query("SELECT DISTINCT object_id, 'alarm' AS model FROM sc WHERE score >= 0.5 AND NOT (CAST(TRY_CAST(object_id AS INTEGER) AS INTEGER) % 3 = 0 AND TIMESTAMP '2024-01-25' > TIMESTAMP '2024-01-20')".replace("CAST(TRY_CAST(object_id AS INTEGER) AS INTEGER) % 3 = 0", "coalesce(TRY_CAST(object_id AS INTEGER) % 3 = 0, false)"), SC_CTES)
def open_risk_antijoin(spark, d):
    alerts = scored(spark, d).filter("score >= 0.5").select("object_id").distinct().withColumn("model", F.lit("alarm"))
    known = objects(spark, d).select("object_id", F.lit("alarm").alias("model"), F.when(F.col("object_id").cast("int") % 3 == 0, F.lit("2024-01-25")).otherwise(F.lit("2024-01-10")).cast("timestamp_ntz").alias("window_end"), F.lit("open").alias("status"))
    return sv.new_risks(alerts, known, F.lit("2024-01-20").cast("timestamp_ntz"))


@query("""SELECT 'alarm_count' AS column_name, count(*) FILTER (WHERE a.alarm_count <> b.alarm_count) AS mismatches, count(*) FILTER (WHERE b.channel_id IS NULL) AS left_only, count(*) FILTER (WHERE a.channel_id IS NULL) AS right_only FROM daily a FULL JOIN (SELECT channel_id, as_of, event_count, CASE WHEN event_count % 5 = 0 THEN alarm_count + 1 ELSE alarm_count END AS alarm_count FROM daily WHERE event_count % 7 <> 0) b ON a.channel_id = b.channel_id AND a.as_of = b.as_of
 UNION ALL SELECT 'event_count', 0, count(*) FILTER (WHERE event_count % 7 = 0), 0 FROM daily""", (OBS, DAILY))
def parity_compare(spark, d):
    a = sn.snapshot_daily(observations(spark, d)).select("channel_id", "as_of", "event_count", "alarm_count")
    n = F.col("event_count")
    b = a.filter(n % 7 != 0).withColumn("alarm_count", F.when(n % 5 == 0, F.col("alarm_count") + 1).otherwise(F.col("alarm_count")))
    return sv.compare_tables(a, b, ["channel_id", "as_of"])


@query("SELECT (SELECT count(*) FROM (SELECT channel_id, as_of FROM grid EXCEPT SELECT channel_id, as_of FROM daily)) AS missing, (SELECT count(*) FROM (SELECT channel_id, as_of FROM daily EXCEPT SELECT channel_id, as_of FROM grid)) AS extra, (SELECT count(*) FROM (SELECT channel_id, as_of FROM daily INTERSECT SELECT channel_id, as_of FROM grid)) AS common", (OBS, DAILY, GRID))
def grid_diff(spark, d):
    daily = sn.snapshot_daily(observations(spark, d))
    return sv.grid_diff(sn.activity_grid(daily, LONG).select("channel_id", "as_of"), daily.select("channel_id", "as_of"))


@query("SELECT channel_id, as_of, a.event_count, b.last_event FROM daily a JOIN daily b USING (channel_id, as_of)", (OBS, DAILY))
def aligned_feature_join(spark, d):
    daily = sn.snapshot_daily(observations(spark, d))
    return sv.join_aligned(daily.select("channel_id", "as_of", "event_count"), daily.select("channel_id", "as_of", "last_event"), ["channel_id", "as_of"])


@query("""SELECT channel_id, as_of, CASE WHEN label IS NULL THEN 'no data' ELSE CAST(CAST(round(label * 100) AS BIGINT) AS VARCHAR) || ' %' END AS label_text, CAST(event_count AS VARCHAR) AS count_text, CASE WHEN last_alarm IS NULL THEN 'no data' ELSE CAST(CAST(round(date_diff('microsecond', last_alarm, as_of) / 3600000000.0, 1) AS DECIMAL(38, 1)) AS VARCHAR) END AS age_text FROM v1""", V1_CTES)
def readable_value(spark, d):
    rows = v1_of(spark, d)
    return rows.select("channel_id", "as_of", tx.readable(F.col("label"), "percent").alias("label_text"), tx.readable(F.col("event_count_24h"), "count").alias("count_text"), tx.readable(F.col("last_alarm_age_hours_24h"), "number").alias("age_text"))


RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY score DESC NULLS LAST, channel_id) AS r FROM ch)"


@query("SELECT object_id, object_id || CASE WHEN max(score) >= 0.5 THEN ' at risk' ELSE ' calm' END || '; ' || CAST(CAST(round(max(score) * 100) AS BIGINT) AS VARCHAR) || ' %; see ' || string_agg(channel_id, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS verdict FROM rk GROUP BY 1", (*SC_CTES, CH, RANKED))
def risk_verdict(spark, d):
    rows = channel_scores(spark, d)
    best = rows.groupBy("object_id").agg(F.max("score").alias("score")).join(sv.suspects(rows), "object_id")
    return best.select("object_id", tx.verdict(F.col("score"), F.lit(0.5), F.col("object_id"), F.col("suspects.channel_id")).alias("verdict"))


@query("SELECT object_id, coalesce(min_by(CASE sensor_type WHEN 'MACHINERY' THEN 'mechanical' WHEN 'HOUSEHOLD' THEN 'domestic' END, r) FILTER (WHERE r <= 5 AND sensor_type IN ('MACHINERY', 'HOUSEHOLD')), 'other') AS risk_type FROM rk GROUP BY 1", (*SC_CTES, CH, RANKED))
def incident_type_map(spark, d):
    kept = sv.top_suspects(channel_scores(spark, d)).groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("rank", "sensor_type"))).alias("s"))
    return kept.select("object_id", sv.risk_type(F.col("s"), {"MACHINERY": "mechanical", "HOUSEHOLD": "domestic"}, "other").alias("risk_type"))


@query("""SELECT channel_id, as_of, coalesce((SELECT string_agg(f, ',' ORDER BY c DESC, f) FROM (VALUES (0.5 * alarm_count, 'alarm_count_24h'), (0.1 * event_count, 'event_count_24h')) x(c, f) WHERE c > 0), '') AS factors FROM v1""", V1_CTES)
def top_factors(spark, d):
    rows = sv.top_factors(v1_of(spark, d), {"alarm_count_24h": 0.5, "event_count_24h": 0.1, "last_event_age_hours": -0.2})
    return rows.select("channel_id", "as_of", F.array_join(F.col("factors.feature"), ",").alias("factors"))


