"""Normalisation, audit and exact de-duplication of raw journals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.steps import once
from ..functions.text import finite_double, parse_bool_token
from ..functions.time import local_to_utc, micros_between, midnight

#: How the journal writes a local moment: date, blank, time, all digits, of our era.
MOMENT = r"^(?!0000)\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def local_moment(date: Column, time: Column) -> Column:
    """Local moment of a date and a time text; null unless they are written in full and name a moment that there is."""
    both = F.concat_ws(" ", F.trim(date), F.trim(time))
    return F.when(both.rlike(MOMENT), both.try_cast("timestamp_ntz"))


def _parsed(raw: DataFrame, zone: str, ambiguous: str) -> DataFrame:
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    # each step's value is used several times by the next
    rows = once(raw, _local=local_moment(F.col("date"), F.col("time")))
    rows = once(rows, occurred_at=local_to_utc(F.col("_local"), zone, ambiguous), is_alarm=parse_bool_token(F.col("alarm")))
    reason = F.when(blank("event_id") | blank("channel_id"), F.lit("missing_id")).when(F.col("occurred_at").isNull(), F.lit("timestamp")).when(F.col("is_alarm").isNull(), F.lit("alarm"))
    return rows.drop("_local").withColumn("reason", reason)


def _observation(rows: DataFrame) -> DataFrame:
    return rows.select(F.trim("event_id").alias("event_id"), F.trim("channel_id").alias("channel_id"), "occurred_at", "is_alarm", F.col("value").alias("raw_value"))


def normalize_strict(raw: DataFrame, zone: str = "UTC", ambiguous: str = "reject") -> DataFrame:
    """Observations in UTC; any bad row fails the job."""
    rows = _parsed(raw, zone, ambiguous)
    stop = F.raise_error(F.concat(F.lit("bad row: "), F.col("reason")))
    return _observation(rows.withColumn("event_id", F.when(F.col("reason").isNotNull(), stop).otherwise(F.col("event_id"))))


def normalize_quarantine(raw: DataFrame, zone: str = "UTC", ambiguous: str = "reject") -> tuple[DataFrame, DataFrame]:
    """Observations, and rejected raw rows with the first reason that holds."""
    rows = _parsed(raw, zone, ambiguous)
    return _observation(rows.filter("reason IS NULL")), rows.filter("reason IS NOT NULL").select(*raw.columns, "reason")


def judged(raw: DataFrame, zone: str = "UTC", ambiguous: str = "reject") -> DataFrame:
    """(raw, observation, reason): every row as it came and as it is read; ``reason`` is null for a good one."""
    rows = _parsed(raw, zone, ambiguous)
    read = F.struct(F.trim("event_id").alias("event_id"), F.trim("channel_id").alias("channel_id"), "occurred_at", "is_alarm", F.col("value").alias("raw_value"))
    return rows.select(F.struct(*raw.columns).alias("raw"), read.alias("observation"), "reason")


def normalize_events(raw: DataFrame, zone: str = "UTC", on_error: str = "fail", ambiguous: str = "reject"):
    return normalize_strict(raw, zone, ambiguous) if on_error == "fail" else normalize_quarantine(raw, zone, ambiguous)


def drop_repeated_headers(df: DataFrame, header: dict[str, str]) -> DataFrame:
    """Without rows whose every field is its column's name in the file (our name -> file name)."""
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(n)) for c, n in header.items()])
    return df.filter(~same)


def dedupe_exact(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct full rows (of ``cols``)."""
    return df.dropDuplicates(cols or df.columns)


def removed_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: rows before, after, removed."""
    n = df.groupBy(*(cols or df.columns)).count()
    return n.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows_in"), F.count("*").alias("rows_out"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("removed"))


def unmapped(obs: DataFrame, directory: DataFrame) -> DataFrame:
    """Channels without an entry in the directory, with their rows; null channels too."""
    return obs.groupBy("channel_id").agg(F.count("*").alias("row_count")).join(directory.select("channel_id").filter("channel_id IS NOT NULL").distinct(), "channel_id", "left_anti")


def profile_journal(raw: DataFrame, directory: DataFrame) -> DataFrame:
    """One row about a raw text journal."""
    known = directory.select(F.trim("channel_id").alias("_known")).distinct()
    rows = raw.join(known, F.trim(raw.channel_id) == F.col("_known"), "left")
    token = parse_bool_token(F.col("alarm"))
    moment = local_moment(F.col("date"), F.col("time"))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    lost = F.col("_known").isNull()
    return rows.agg(
        F.count("*").alias("row_count"), F.countDistinct("event_id").alias("distinct_event_ids"), F.count_if(token).alias("alarm_rows"), F.count_if(token.isNull()).alias("invalid_alarm"),
        F.count_if(moment.isNull()).alias("invalid_time"), F.count_if(blank("event_id")).alias("missing_event_id"), F.count_if(blank("channel_id")).alias("missing_channel_id"),
        F.count_if(blank("value")).alias("empty_value"), F.count_if(finite_double(F.col("value"))).alias("numeric_value"),
        F.count_if(lost).alias("unmapped_rows"), F.countDistinct(F.when(lost, F.col("channel_id"))).alias("unmapped_channels"), F.min(moment).alias("first_at"), F.max(moment).alias("last_at"),
    )


def audit_report(raw: DataFrame, directory: DataFrame, zone: str = "UTC") -> DataFrame:
    """One row: valid and rejected rows by reason, span of valid ones, channels without an entry."""
    rows = _parsed(raw, zone, "reject").withColumn("_id", F.trim("channel_id"))
    rows = rows.join(directory.select(F.col("channel_id").alias("_known")).distinct(), F.col("_id") == F.col("_known"), "left")
    valid = F.col("reason").isNull()
    return rows.agg(
        F.count("*").alias("row_count"), F.count_if(valid).alias("valid"), *[F.count_if(F.col("reason") == r).alias(f"rejected_{r}") for r in ("missing_id", "timestamp", "alarm")],
        F.min(F.when(valid, F.col("occurred_at"))).alias("first_at"), F.max(F.when(valid, F.col("occurred_at"))).alias("last_at"),
        F.countDistinct(F.when(valid & F.col("_known").isNull(), F.col("_id"))).alias("unmatched_channels"),
    )


def catalogue_report(channels: DataFrame, facilities: DataFrame, key: str = "channel_id", facility: str = "object_id") -> DataFrame:
    """One row: repeated channel keys, repeated facility keys, channels whose facility is missing."""
    again = lambda df, c, out: df.groupBy(c).count().filter("count > 1").agg(F.count("*").alias(out))
    lost = channels.join(facilities.select(facility), facility, "left_anti").agg(F.count("*").alias("missing_facility"))
    one = again(channels, key, "repeated_channels")
    return one.crossJoin(again(facilities, facility, "repeated_facilities")).crossJoin(lost)


def check_catalogue(channels: DataFrame, facilities: DataFrame, key: str = "channel_id", facility: str = "object_id") -> None:
    broken = {k: v for k, v in catalogue_report(channels, facilities, key, facility).first().asDict().items() if v}
    if broken:
        raise ValueError(f"broken catalogue: {broken}")


def daily_counts(channel_days: DataFrame) -> DataFrame:
    """Rows, alarms and active channels of each day."""
    return channel_days.groupBy("day").agg(F.sum("row_count").alias("row_count"), F.sum("alarm_count").alias("alarm_count"), F.count("*").alias("active_channels"))


def exact_distinct(df: DataFrame, col: str, buckets: int = 64) -> DataFrame:
    """Distinct values by hash bucket; their sum is the exact number.  Nulls do not count."""
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return values.groupBy(F.pmod(F.xxhash64(col), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("distinct_values"))


def diagnose_duplicates(obs: DataFrame) -> DataFrame:
    """One row about ids that occur more than once."""
    payload = F.struct("channel_id", "occurred_at", "is_alarm", "raw_value")
    ids = obs.groupBy("event_id").agg(F.count("*").alias("n"), F.countDistinct(payload).alias("payloads"), F.countDistinct("channel_id").alias("channels"), F.countDistinct("occurred_at").alias("times")).filter("n > 1")
    return ids.agg(
        F.count("*").alias("duplicated_ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"),
        F.count_if(F.col("payloads") > 1).alias("conflicting_ids"), F.count_if(F.col("channels") > 1).alias("multi_channel_ids"), F.count_if(F.col("times") > 1).alias("multi_time_ids"),
    )


def near_duplicates(obs: DataFrame) -> DataFrame:
    """One row about rows that are equal but for their id."""
    groups = obs.groupBy("channel_id", "occurred_at", "is_alarm", "raw_value").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids")).filter("ids > 1")
    return groups.agg(F.count("*").alias("near_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def channel_coverage(channel_days: DataFrame) -> DataFrame:
    """One row: share of days with records within a channel's span."""
    spans = channel_days.groupBy("channel_id").agg((F.count("*") / (F.datediff(F.max("day"), F.min("day")) + 1)).alias("share"))
    return spans.agg(F.count("*").alias("channels"), F.min("share").alias("least"), F.percentile("share", F.lit(0.5)).alias("middle"), F.max("share").alias("most"))


def missing_days(obs: DataFrame) -> DataFrame:
    """Calendar days of the journal's span without any record."""
    seen = obs.select(midnight(F.col("occurred_at")).alias("day")).distinct()
    span = seen.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day")).join(seen, "day", "left_anti")


def interarrival(obs: DataFrame, points: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """One row: quantiles over channels of each channel's median seconds between records."""
    before = F.lag("occurred_at").over(W.partitionBy("channel_id").orderBy("occurred_at"))
    steps = obs.select("channel_id", (micros_between(before, F.col("occurred_at")) / F.lit(1e6)).alias("step")).filter("step IS NOT NULL")
    medians = steps.groupBy("channel_id").agg(F.percentile("step", F.lit(0.5)).alias("middle"))
    return medians.agg(F.count("*").alias("channels"), *[F.percentile("middle", F.lit(p)).alias(f"q{int(p * 100):02d}") for p in points])


def order_checks(obs: DataFrame, position: str = "source_row") -> DataFrame:
    """One row: steps back in time in file order, repeated alarm moments of a channel, channels with alarms only.

    Neighbours in file order are looked at within blocks of rows, then across the blocks' edges."""
    block = F.floor(F.col(position) / 1_000_000).alias("block")
    timed = W.partitionBy("block").orderBy(position)
    rows = obs.select(block, position, "occurred_at").withColumn("before", F.lag("occurred_at").over(timed))
    inside = rows.agg(F.count_if(F.col("occurred_at") < F.col("before")).alias("n"))
    edges = obs.groupBy(block).agg(F.min_by("occurred_at", position).alias("first_at"), F.max_by("occurred_at", position).alias("last_at"))
    across = edges.select("first_at", F.lag("last_at").over(W.orderBy("block")).alias("before")).agg(F.count_if(F.col("first_at") < F.col("before")).alias("n"))
    repeats = obs.filter("is_alarm").groupBy("channel_id", "occurred_at").count().filter("count > 1").agg(F.count("*").alias("repeated_alarm_moments"))
    only = obs.groupBy("channel_id").agg(F.bool_and("is_alarm").alias("only")).agg(F.count_if("only").alias("alarm_only_channels"))
    steps = inside.unionByName(across).agg(F.sum("n").alias("steps_back"))
    return steps.crossJoin(repeats).crossJoin(only)


def sample_channels(df: DataFrame, n: int, seed: int = 2) -> DataFrame:
    """A stable sample of channels: those of the least hashes of id and seed."""
    ids = df.select("channel_id").distinct()
    return ids.orderBy(F.md5(F.concat("channel_id", F.lit(f"|{seed}"))), "channel_id").limit(n)


def stratified_sample(df: DataFrame, strata: dict[str, Column], per_stratum: int, seed: int = 3, by: list[Column] | None = None) -> DataFrame:
    """``per_stratum`` rows of each named predicate, those of the least hashes of the texts ``by`` (the whole row as JSON,
    if not given); a top-n of each, not a window."""
    text = F.concat_ws("|", F.lit(str(seed)), *(by or [F.to_json(F.struct(*[F.col(c) for c in df.columns]))]))
    parts = [df.filter(p).withColumn("stratum", F.lit(n)).orderBy(F.md5(text), text).limit(per_stratum) for n, p in strata.items()]
    return reduce(DataFrame.unionByName, parts)
