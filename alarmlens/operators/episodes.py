"""Alarm episodes, silences of the whole journal, and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import label_bucket, micros_between

KNOWN, UNKNOWN = "observed_quiet_gap", "unknown"


def with_class_alarm(obs: DataFrame, states: list[str]) -> DataFrame:
    """Alarm rows of one class: those whose value is one of ``states``; all rows stay as observations."""
    return obs.withColumn("is_alarm", F.col("is_alarm") & F.coalesce(F.col("raw_value").isin(*states), F.lit(False)))


def _boundary(known: Column) -> Column:
    return F.when(known, F.lit(KNOWN)).otherwise(F.lit(UNKNOWN))


def build_episodes(obs: DataFrame, gap_seconds: float = 900) -> DataFrame:
    """Alarm rows of a channel less than or exactly ``gap_seconds`` apart form one episode.

    The left boundary is known if the channel was seen, quiet, for longer than the gap before; the right one if it was
    seen for longer than the gap after.

    Two steps: runs of alarms within each day of a channel (and its other rows as one), then runs that meet at the edges of
    days.  So only these few rows of a channel are ordered together, whatever share of the journal it has."""
    gap = int(gap_seconds * 1_000_000)
    at = F.col("occurred_at")
    rows = obs.select("channel_id", "occurred_at", F.coalesce("is_alarm", F.lit(False)).alias("is_alarm"), F.to_date("occurred_at").alias("day"))
    timed = W.partitionBy("channel_id", "day", "is_alarm").orderBy("occurred_at")
    opens = lambda before, start: F.when(before.isNull() | (micros_between(before, start) > gap), 1).otherwise(0)
    rows = rows.withColumn("opens", F.when(F.col("is_alarm"), opens(F.lag("occurred_at").over(timed), at)).otherwise(0))
    rows = rows.withColumn("number", F.sum("opens").over(timed.rangeBetween(W.unboundedPreceding, W.currentRow)))
    runs = rows.groupBy("channel_id", "day", "is_alarm", "number").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))
    whole = W.partitionBy("channel_id")
    runs = runs.select("channel_id", "is_alarm", "first_at", "last_at", "n", F.min("first_at").over(whole).alias("first_seen"), F.max("last_at").over(whole).alias("last_seen")).filter("is_alarm")
    edges = whole.orderBy("first_at")
    runs = runs.withColumn("opens", opens(F.lag("last_at").over(edges), F.col("first_at"))).withColumn("number", F.sum("opens").over(edges.rowsBetween(W.unboundedPreceding, W.currentRow)))
    found = runs.groupBy("channel_id", "number").agg(
        F.min("first_at").alias("first_alarm_at"), F.max("last_at").alias("last_alarm_at"), F.sum("n").alias("alarm_row_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    left = (F.col("number") > 1) | (micros_between(F.col("first_seen"), F.col("first_alarm_at")) > gap)
    right = micros_between(F.col("last_alarm_at"), F.col("last_seen")) > gap
    return found.select("channel_id", "first_alarm_at", "last_alarm_at", "alarm_row_count", _boundary(left).alias("left_boundary"), _boundary(right).alias("right_boundary"))


def log_gaps(obs: DataFrame, threshold_seconds: float = 3600) -> DataFrame:
    """Silences of the whole journal of at least the threshold: start_at (just after the last record), end_at,
    seconds_between_records.

    Two steps: first and last record of each bucket of time, no longer than the threshold, then neighbours among these
    few rows.  The buckets of a year are ordered together; years meet at their edges."""
    width = int(min(threshold_seconds, 3600) * 1_000_000)
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    bucket = F.floor(micros_between(start, F.col("occurred_at")) / width)
    edges = obs.groupBy(bucket.alias("bucket"), F.year("occurred_at").alias("year")).agg(F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))
    inside = edges.withColumn("before", F.lag("last_at").over(W.partitionBy("year").orderBy("bucket")))
    years = edges.groupBy("year").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    across = years.select("first_at", F.lag("last_at").over(W.orderBy("year")).alias("before"))  # a row a year
    pairs = inside.select("first_at", "before").unionByName(across).filter("before is not null")
    silent = micros_between(F.col("before"), F.col("first_at"))
    return pairs.filter(silent >= int(threshold_seconds * 1_000_000)).select(
        (F.col("before") + F.expr("INTERVAL 0.000001 SECOND")).alias("start_at"), F.col("first_at").alias("end_at"), (silent / F.lit(1e6)).alias("seconds_between_records")
    )


def with_object(df: DataFrame, directory: DataFrame, unknown: str | None = None) -> DataFrame:
    """Add ``object_id`` of the channel; unmapped channels get ``unknown``."""
    found = df.join(directory.select("channel_id", "object_id"), "channel_id", "left")
    return found.withColumn("object_id", F.coalesce("object_id", F.lit(unknown))) if unknown is not None else found


def incidents(episodes: DataFrame, directory: DataFrame, gap_minutes: int = 60, unknown: str = "unknown") -> DataFrame:
    """Episode starts of an object at most ``gap_minutes`` apart form one incident: object_id, started_at, ended_at,
    day (as a label day), size."""
    gap = gap_minutes * 60_000_000
    rows = with_object(episodes, directory, unknown).select("object_id", "first_alarm_at", F.to_date("first_alarm_at").alias("day"))
    # as in episodes: runs within a day, then at the edges of days; unmapped channels are one object, perhaps a large one
    opens = lambda before, start: F.when(before.isNull() | (micros_between(before, start) > gap), 1).otherwise(0)
    timed = W.partitionBy("object_id", "day").orderBy("first_alarm_at")
    rows = rows.withColumn("opens", opens(F.lag("first_alarm_at").over(timed), F.col("first_alarm_at")))
    rows = rows.withColumn("number", F.sum("opens").over(timed.rangeBetween(W.unboundedPreceding, W.currentRow)))
    runs = rows.groupBy("object_id", "day", "number").agg(F.min("first_alarm_at").alias("first_at"), F.max("first_alarm_at").alias("last_at"), F.count("*").alias("n"))
    edges = W.partitionBy("object_id").orderBy("first_at")
    runs = runs.select("object_id", "first_at", "last_at", "n", opens(F.lag("last_at").over(edges), F.col("first_at")).alias("opens"))
    runs = runs.withColumn("number", F.sum("opens").over(edges.rowsBetween(W.unboundedPreceding, W.currentRow)))
    found = runs.groupBy("object_id", "number").agg(F.min("first_at").alias("started_at"), F.max("last_at").alias("ended_at"), F.sum("n").alias("size"))
    return found.select("object_id", "started_at", "ended_at", label_bucket(F.col("started_at")).alias("day"), "size")


def recovery_stats(obs: DataFrame, episodes: DataFrame) -> DataFrame:
    """How many episode starts have a normal row of their channel since the last alarm row before.

    What comes before a start is looked for in its day, and among the last rows of each day before; so only a row a day of a
    channel is ordered as a whole."""
    moment = {"last_alarm": F.when(F.col("is_alarm"), F.col("occurred_at")), "last_normal": F.when(~F.col("is_alarm"), F.col("occurred_at"))}
    day = F.to_date("occurred_at").alias("day")
    starts = episodes.select("channel_id", F.col("first_alarm_at").alias("occurred_at"), F.lit(None).cast("boolean").alias("is_alarm"), F.lit(True).alias("starts"))
    rows = obs.select("channel_id", "occurred_at", "is_alarm", F.lit(False).alias("starts")).unionByName(starts).select("*", day)
    past = W.partitionBy("channel_id", "day").orderBy("occurred_at", F.desc("starts")).rowsBetween(W.unboundedPreceding, -1)
    found = rows.select("channel_id", "day", "starts", *[F.max(c).over(past).alias(n) for n, c in moment.items()]).filter("starts")
    daily = rows.groupBy("channel_id", "day").agg(*[F.max(c).alias(n) for n, c in moment.items()])
    before = W.partitionBy("channel_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    daily = daily.select("channel_id", "day", *[F.max(n).over(before).alias(f"{n}_before") for n in moment])
    found = found.join(daily, ["channel_id", "day"]).select(*[F.coalesce(n, f"{n}_before").alias(n) for n in moment]).filter("last_alarm IS NOT NULL")
    recovered = F.col("last_normal") > F.col("last_alarm")
    return found.agg(F.count("*").alias("starts"), F.count_if(recovered).alias("recovered"), F.try_divide(F.count_if(recovered), F.count("*")).alias("share"))
