"""Inputs of the registered queries, in Spark and in SQL: the events table read as an alarm journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameters for a journal of 30 days.
GAP = 43_200
VALIDATION, TEST = "2024-01-16 00:00:00", "2024-01-24 00:00:00"
SHORT, LONG = 3, 7
GAPS = (("2024-01-05 06:00:00", "2024-01-05 08:30:00"), ("2024-01-19 20:00:00", "2024-01-20 01:00:00"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("channel_id"), F.col("ts").alias("occurred_at"),
        (F.col("event_type") == "error").alias("is_alarm"), F.col("event_type").alias("raw_value"),
    )


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels with a debt are not in the directory."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    return c.select(F.col("c_custkey").cast("string").alias("channel_id"), F.col("c_nationkey").cast("string").alias("object_id"), F.col("c_mktsegment").alias("sensor_type"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("object_id"), F.col("n_regionkey").cast("string").alias("parent_id"))


def gaps(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"(TIMESTAMP_NTZ '{a}', TIMESTAMP_NTZ '{b}')" for a, b in GAPS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(start_at, end_at)")


OBS = """obs AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS channel_id, CAST(ts AS TIMESTAMP) AS occurred_at,
  event_type = 'error' AS is_alarm, event_type AS raw_value FROM events)"""
DIR = """dir AS (SELECT CAST(c_custkey AS VARCHAR) AS channel_id, CAST(c_nationkey AS VARCHAR) AS object_id, c_mktsegment AS sensor_type FROM customer WHERE c_acctbal >= 0)"""
OBJECTS = "objects AS (SELECT CAST(n_nationkey AS VARCHAR) AS object_id, CAST(n_regionkey AS VARCHAR) AS parent_id FROM nation)"
GAP_ROWS = "gaps AS (SELECT * FROM (VALUES " + ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in GAPS) + ") t(start_at, end_at))"
#: The first midnight at or after a moment, and the last before it.
UP = "CASE WHEN {0} = CAST(CAST({0} AS DATE) AS TIMESTAMP) THEN {0} ELSE CAST(CAST({0} AS DATE) + 1 AS TIMESTAMP) END"
DOWN = "(" + UP + " - INTERVAL 1 DAY)"
HOURS = "date_diff('microsecond', {}, {}) / 3600000000.0"


def episodes_sql(name: str = "eps", alarm: str = "is_alarm", gap: int = GAP) -> str:
    """CTE of episodes, stated by ranges: a head is an alarm moment that no alarm of its channel precedes within the gap;
    an episode is all alarms from a head up to the next; a boundary is known if the channel has a record beyond the gap."""
    return f"""{name}_alarm AS (SELECT channel_id, occurred_at AS t FROM obs WHERE {alarm}),
{name}_head AS (SELECT DISTINCT channel_id, t AS head FROM {name}_alarm x
  WHERE NOT EXISTS (FROM {name}_alarm y WHERE y.channel_id = x.channel_id AND y.t BETWEEN x.t - INTERVAL {gap} SECOND AND x.t - INTERVAL 1 MICROSECOND)),
{name}_span AS (SELECT h.channel_id, h.head, max(x.t) AS tail, count(*) AS rows_in FROM {name}_head h JOIN {name}_alarm x ON x.channel_id = h.channel_id AND x.t >= h.head
  WHERE NOT EXISTS (FROM {name}_head k WHERE k.channel_id = h.channel_id AND k.head > h.head AND k.head <= x.t) GROUP BY h.channel_id, h.head),
{name} AS (SELECT channel_id, head AS first_alarm_at, tail AS last_alarm_at, rows_in AS alarm_row_count,
  if(EXISTS (FROM obs o WHERE o.channel_id = e.channel_id AND o.occurred_at < head - INTERVAL {gap} SECOND), 'observed_quiet_gap', 'unknown') AS left_boundary,
  if(EXISTS (FROM obs o WHERE o.channel_id = e.channel_id AND o.occurred_at > tail + INTERVAL {gap} SECOND), 'observed_quiet_gap', 'unknown') AS right_boundary
  FROM {name}_span e)"""


EPS = episodes_sql()
#: Calendar days with records: what happened in the day up to each midnight.
DAILY = f"""daily AS (SELECT channel_id, midnight AS as_of, count(*) AS event_count, count_if(is_alarm) AS alarm_count, max(occurred_at) AS last_event, max(if(is_alarm, occurred_at, NULL)) AS last_alarm
  FROM (SELECT *, {UP.format('occurred_at')} AS midnight FROM obs) GROUP BY ALL)"""
FUTURE = f"""future AS (SELECT channel_id, eve AS as_of, count_if(left_boundary <> 'unknown') AS known_future, count_if(left_boundary = 'unknown') AS unknown_future
  FROM (SELECT channel_id, left_boundary, {DOWN.format('first_alarm_at')} AS eve FROM eps) GROUP BY ALL)"""
SEEN = "seen AS (SELECT channel_id, min(occurred_at) AS first_observation FROM obs GROUP BY ALL), bounds AS (SELECT min(occurred_at) AS global_first, max(occurred_at) AS global_last FROM obs)"


def diagnosed_sql(rows: str, history_days: int, name: str) -> str:
    """CTE: ``rows`` with split, exclusion_reason and label.  Every reason that holds for a snapshot is a row of its own;
    the one of the lowest number counts."""
    day = "INTERVAL 1 DAY"
    crossing = f"as_of < TIMESTAMP '{{0}}' AND as_of + {day} >= TIMESTAMP '{{0}}'"
    reasons = [
        ("global_history", f"as_of < global_first + INTERVAL {history_days} DAY"),
        ("channel_history", f"as_of < first_observation + {day}"),
        ("future_window", f"global_last < as_of + {day}"),
        ("split_boundary", f"({crossing.format(VALIDATION)}) OR ({crossing.format(TEST)})"),
        ("known_log_gap", f"as_of IN (SELECT as_of FROM {name}_facts, gaps WHERE as_of BETWEEN start_at - {day} AND end_at + {day} - INTERVAL 1 MICROSECOND)"),
        ("active_alarm", f"as_of <= last_alarm + INTERVAL {GAP} SECOND"),
        ("uncertain_first_episode", "unknown_future <> 0"),
    ]
    held = " UNION ALL ".join(f"SELECT channel_id, as_of, {k} AS k, '{reason}' AS reason FROM {name}_facts WHERE {rule}" for k, (reason, rule) in enumerate(reasons))
    return f"""{name}_facts AS (FROM {rows} JOIN seen USING (channel_id) LEFT JOIN future USING (channel_id, as_of), bounds),
{name}_reasons AS (SELECT channel_id, as_of, arg_min(reason, k) AS exclusion_reason FROM ({held}) GROUP BY ALL),
{name} AS (SELECT f.*, ['train', 'validation', 'test'][1 + (as_of >= TIMESTAMP '{VALIDATION}')::INT + (as_of >= TIMESTAMP '{TEST}')::INT] AS split,
  exclusion_reason, if(exclusion_reason IS NULL, (coalesce(known_future, 0) > 0)::INT, NULL) AS label FROM {name}_facts f LEFT JOIN {name}_reasons USING (channel_id, as_of))"""


V1 = diagnosed_sql("daily", 1, "v1")
#: A channel is active at a midnight if it has a record in the days of the long window before it.
GRID = f"grid AS (SELECT DISTINCT channel_id, as_of + to_days(CAST(later AS INTEGER)) AS as_of FROM daily, range({LONG}) t(later))"
_DAY_OF = "o.channel_id = g.channel_id AND o.occurred_at BETWEEN g.as_of - INTERVAL 1 DAY + INTERVAL 1 MICROSECOND AND g.as_of"
DENSE = f"""dense AS (SELECT g.channel_id, g.as_of, count(o.occurred_at) AS event_count, count_if(coalesce(o.is_alarm, false)) AS alarm_count, max(o.occurred_at) AS last_event, max(if(o.is_alarm, o.occurred_at, NULL)) AS last_alarm,
  (SELECT count(*) FROM eps e WHERE e.channel_id = g.channel_id AND {UP.format('e.first_alarm_at')} = g.as_of) AS episode_starts FROM grid g LEFT JOIN obs o ON {_DAY_OF} GROUP BY ALL)"""


def _within(moment: str, days: int) -> str:
    return f"{moment} > g.as_of - INTERVAL {days} DAY"


#: Windows counted on the records themselves.
TRAIL = f"""window_events AS (SELECT g.channel_id, g.as_of, {", ".join(f"count_if({_within('o.occurred_at', n)}) AS event_count_{w}, count_if(o.is_alarm AND {_within('o.occurred_at', n)}) AS alarm_count_{w}" for n, w in ((1, '24h'), (SHORT, f'{SHORT}d'), (LONG, f'{LONG}d')))},
  count(DISTINCT {UP.format('o.occurred_at')}) AS active_days_{LONG}d, max(o.occurred_at) AS last_event, max(if(o.is_alarm, o.occurred_at, NULL)) AS last_alarm
  FROM grid g JOIN obs o ON o.channel_id = g.channel_id AND o.occurred_at <= g.as_of AND {_within('o.occurred_at', LONG)} GROUP BY ALL),
trail AS (SELECT g.*, {", ".join(f"(SELECT count(*) FROM eps e WHERE e.channel_id = g.channel_id AND e.first_alarm_at <= g.as_of AND {_within('e.first_alarm_at', n)}) AS episode_starts_{n}d" for n in (SHORT, LONG))} FROM window_events g)"""
#: Silent time up to a moment; the hours of a window are the difference at its ends.
_SILENT = "(SELECT sum(greatest(0, least(epoch_us({0}), epoch_us(end_at)) - epoch_us(start_at))) FROM gaps)"
GAP_HOURS = f"""gap_hours AS (SELECT as_of, ({_SILENT.format('as_of')} - {_SILENT.format(f'as_of - INTERVAL {LONG} DAY')}) / 3600000000.0 AS log_gap_hours_{LONG}d FROM (SELECT DISTINCT as_of FROM grid))"""
V2_ROWS = "v2_rows AS (FROM trail JOIN gap_hours USING (as_of))"
V2 = ",\n".join([OBS, EPS, DAILY, FUTURE, SEEN, GAP_ROWS, GRID, TRAIL, GAP_HOURS, V2_ROWS, diagnosed_sql("v2_rows", LONG, "v2")])
