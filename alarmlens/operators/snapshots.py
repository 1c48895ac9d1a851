"""Leak-free daily snapshots of channels: trailing windows, future labels, ordered reasons for exclusion, splits.

Time rules: history is (t - w, t], the label window (t, t + h].  Observations are brought down to channel-days before
any window, so that windows run over days, not rows.  Both kinds of snapshots store channel-days and episode starts once
and go on from these tables, so observations are read once here and once for their episodes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.steps import stored
from ..functions.time import age_days, age_hours, day_number, days, hours, label_bucket, micros_between, seconds, snapshot_bucket
from .episodes import KNOWN, UNKNOWN

SCOPE = "recorded_alarm_episode"


def ntz(moment: str | datetime) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")


def channel_days(obs: DataFrame) -> DataFrame:
    """``snapshot_daily`` with ``first_event``, from which the bounds of channels and of the journal follow too."""
    alarm_at = F.when(F.col("is_alarm"), F.col("occurred_at"))
    return obs.groupBy("channel_id", snapshot_bucket(F.col("occurred_at")).alias("as_of")).agg(
        F.count("*").alias("event_count"), F.count_if("is_alarm").alias("alarm_count"), F.max("occurred_at").alias("last_event"), F.max(alarm_at).alias("last_alarm"), F.min("occurred_at").alias("first_event")
    )


def snapshot_daily(obs: DataFrame) -> DataFrame:
    """Per channel and snapshot midnight: event_count, alarm_count, last_event, last_alarm of the day before."""
    return channel_days(obs).drop("first_event")


def future_starts(episodes: DataFrame) -> DataFrame:
    """Known and unknown episode starts in the day after each midnight."""
    return episodes.groupBy("channel_id", label_bucket(F.col("first_alarm_at")).alias("as_of")).agg(
        F.count_if(F.col("left_boundary") == KNOWN).alias("known_future"), F.count_if(F.col("left_boundary") == UNKNOWN).alias("unknown_future")
    )


def join_future(examples: DataFrame, episodes: DataFrame) -> DataFrame:
    """Add known_future and unknown_future; starts are counted first, so rows never multiply."""
    found = examples.join(future_starts(episodes).hint("merge"), ["channel_id", "as_of"], "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("known_future", "unknown_future")})


def with_bounds(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Add the first observation of the channel and the first and last of the journal (one row, so broadcast).
    ``source``: observations, or their ``channel_days``, which spares another scan.

    Channels, here and in ``join_future``, grow with the journal and are never broadcast: Spark would judge them by the size
    of compressed files, a tenth of what the driver gets."""
    low, high = ("first_event", "last_event") if "first_event" in source.columns else ("occurred_at", "occurred_at")
    first = source.groupBy("channel_id").agg(F.min(low).alias("first_observation"))
    bounds = source.agg(F.min(low).alias("global_first"), F.max(high).alias("global_last"))
    return rows.join(first.hint("merge"), "channel_id").crossJoin(F.broadcast(bounds))


def assign_split(as_of: Column, validation: str, test: str) -> Column:
    if str(validation) >= str(test):
        raise ValueError("validation must start before test")
    return F.when(as_of < ntz(validation), F.lit("train")).when(as_of < ntz(test), F.lit("validation")).otherwise(F.lit("test"))


def overlaps_gap(df: DataFrame, gaps: DataFrame, back: Column, ahead: Column, out: str = "in_gap") -> DataFrame:
    """Flag rows whose (as_of - back, as_of + ahead] meets a gap.  Evaluated once for each distinct midnight."""
    moments = df.select("as_of").distinct()
    hit = moments.join(gaps, (F.col("start_at") <= F.col("as_of") + ahead) & (F.col("end_at") > F.col("as_of") - back), "left_semi").withColumn(out, F.lit(True))
    return df.join(hit, "as_of", "left").withColumn(out, F.coalesce(out, F.lit(False)))


def gap_hours(moments: DataFrame, gaps: DataFrame, days_back: int = 30, out: str = "log_gap_hours") -> DataFrame:
    """Hours of gaps within ``days_back`` days before each distinct as_of, 0 if none."""
    back = F.col("as_of") - days(days_back)
    met = moments.select("as_of").distinct().join(gaps, (F.col("start_at") < F.col("as_of")) & (F.col("end_at") > back), "left")
    part = micros_between(F.greatest("start_at", back), F.least("end_at", "as_of"))
    return met.groupBy("as_of").agg((F.coalesce(F.sum(F.when(F.col("start_at").isNotNull(), part)), F.lit(0)) / F.lit(3.6e9)).alias(out))


def exclusion_reason(history: Column, gap_seconds: float, validation: str, test: str) -> Column:
    """First reason that holds; null for a usable row.  Wants the columns of with_bounds, join_future, in_gap, split,
    last_alarm."""
    t, ahead = F.col("as_of"), F.col("as_of") + hours(24)
    crosses = ((F.col("split") == "train") & (ahead >= ntz(validation))) | ((F.col("split") == "validation") & (ahead >= ntz(test)))
    return (
        F.when(t - history < F.col("global_first"), F.lit("global_history"))
        .when(t - hours(24) < F.col("first_observation"), F.lit("channel_history"))
        .when(ahead > F.col("global_last"), F.lit("future_window"))
        .when(crosses, F.lit("split_boundary"))
        .when(F.col("in_gap"), F.lit("known_log_gap"))
        .when(F.col("last_alarm") >= t - seconds(gap_seconds), F.lit("active_alarm"))
        .when(F.col("unknown_future") > 0, F.lit("uncertain_first_episode"))
    )


def label_column() -> Column:
    return F.when(F.col("exclusion_reason").isNull(), (F.col("known_future") > 0).cast("int"))


def _starts(episodes: DataFrame) -> DataFrame:
    """What snapshots need of episodes, stored."""
    return stored(episodes.select("channel_id", "first_alarm_at", "left_boundary"), "episode-starts")


def _diagnosed(rows: DataFrame, source: DataFrame, episodes: DataFrame, gaps: DataFrame, history: Column, gap_seconds: float, validation: str, test: str) -> DataFrame:
    rows = join_future(with_bounds(rows, source), episodes).withColumn("split", assign_split(F.col("as_of"), validation, test))
    rows = overlaps_gap(rows, gaps, hours(24), hours(24))
    return rows.withColumn("exclusion_reason", exclusion_reason(history, gap_seconds, validation, test)).withColumn("label", label_column()).withColumn("label_scope", F.lit(SCOPE))


def build_examples(obs: DataFrame, episodes: DataFrame, gaps: DataFrame, validation: str, test: str, gap_seconds: float = 900) -> DataFrame:
    """Snapshots of days with records."""
    daily, episodes = stored(channel_days(obs), "channel-days"), _starts(episodes)
    rows = daily.drop("first_event").withColumnsRenamed({"event_count": "event_count_24h", "alarm_count": "alarm_count_24h"})
    rows = _diagnosed(rows, daily, episodes, gaps, hours(24), gap_seconds, validation, test)
    t = F.col("as_of")
    return rows.select(
        "channel_id", "as_of", "event_count_24h", "alarm_count_24h", age_hours(F.col("last_event"), t).alias("last_event_age_hours"),
        age_hours(F.col("last_alarm"), t).alias("last_alarm_age_hours_24h"), "split", "label", "exclusion_reason", "label_scope",
    )


def activity_grid(daily: DataFrame, keep: int = 30) -> DataFrame:
    """All days of each island of active days; a break of more than ``keep`` days ends one, and it lasts ``keep`` - 1
    days beyond its last active day."""
    timed = W.partitionBy("channel_id").orderBy("as_of")
    before = F.lag("as_of").over(timed)
    marks = daily.select("channel_id", "as_of", F.when(before.isNull() | (F.col("as_of") - before > days(keep)), 1).otherwise(0).alias("opens"))
    marks = marks.withColumn("island", F.sum("opens").over(timed.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = marks.groupBy("channel_id", "island").agg(F.min("as_of").alias("first_day"), (F.max("as_of") + days(keep - 1)).alias("last_day"))
    return spans.select("channel_id", F.explode(F.sequence("first_day", "last_day", F.expr("INTERVAL 1 DAY"))).alias("as_of"))


def densify(grid: DataFrame, daily: DataFrame, episodes: DataFrame) -> DataFrame:
    """Grid days with counts of rows, alarms and episode starts, 0 where there are none."""
    starts = episodes.groupBy("channel_id", snapshot_bucket(F.col("first_alarm_at")).alias("as_of")).agg(F.count("*").alias("episode_starts"))
    rows = grid.join(daily, ["channel_id", "as_of"], "left").join(starts, ["channel_id", "as_of"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("event_count", "alarm_count", "episode_starts")})


def trailing(dense: DataFrame, short: int = 7, long: int = 30) -> DataFrame:
    """Sums and last moments over the trailing ``short`` and ``long`` days of a dense grid."""
    frame = lambda n: W.partitionBy("channel_id").orderBy("_day").rangeBetween(1 - n, 0)
    a, b = frame(short), frame(long)
    rows = dense.withColumn("_day", day_number(F.col("as_of")))
    return rows.select(
        "channel_id", "as_of", F.col("event_count").alias("event_count_24h"), F.col("alarm_count").alias("alarm_count_24h"),
        *[F.sum(c).over(w).alias(f"{c}_{n}d") for n, w in ((short, a), (long, b)) for c in ("event_count", "alarm_count")],
        F.sum((F.col("event_count") > 0).cast("long")).over(b).alias(f"active_days_{long}d"),
        *[F.sum("episode_starts").over(w).alias(f"episode_starts_{n}d") for n, w in ((short, a), (long, b))],
        F.max("last_event").over(b).alias("last_event"), F.max("last_alarm").over(b).alias("last_alarm"),
    )


def _midnights(daily: DataFrame, keep: int) -> DataFrame:
    """Every midnight that a grid over ``daily`` can hold: a row a day of the journal."""
    span = daily.agg(F.min("as_of").alias("a"), (F.max("as_of") + days(keep - 1)).alias("b")).filter("a IS NOT NULL")
    return span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("as_of"))


def build_examples_v2(obs: DataFrame, episodes: DataFrame, gaps: DataFrame, validation: str, test: str, gap_seconds: float = 900, short: int = 7, long: int = 30) -> DataFrame:
    """Snapshots of every day of an active channel, with windows of one, ``short`` and ``long`` days."""
    daily, episodes = stored(channel_days(obs), "channel-days"), _starts(episodes)
    rows = trailing(densify(activity_grid(daily, long), daily.drop("first_event"), episodes), short, long)
    rows = rows.join(gap_hours(_midnights(daily, long), gaps, long, f"log_gap_hours_{long}d"), "as_of")
    rows = _diagnosed(rows, daily, episodes, gaps, days(long), gap_seconds, validation, test)
    t = F.col("as_of")
    names = [f"{c}_{w}" for w in ("24h", f"{short}d", f"{long}d") for c in ("event_count", "alarm_count")]
    return rows.select(
        "channel_id", "as_of", *names, f"active_days_{long}d", f"episode_starts_{short}d", f"episode_starts_{long}d",
        age_hours(F.col("last_event"), t).alias("last_event_age_hours"), age_hours(F.col("last_alarm"), t).alias(f"last_alarm_age_hours_{long}d"),
        age_days(F.col("first_observation"), t).alias("channel_age_days"), f"log_gap_hours_{long}d", "split", "label", "exclusion_reason", "label_scope",
    )


def class_labels(examples: DataFrame, episodes_by_class: dict[str, DataFrame]) -> DataFrame:
    """A label for each class: null if an unknown start of it lies ahead (or the row is excluded), else whether a known
    one does."""
    rows = examples
    for name, episodes in episodes_by_class.items():
        found = future_starts(episodes).withColumnsRenamed({"known_future": "_known", "unknown_future": "_unknown"})
        rows = rows.join(found, ["channel_id", "as_of"], "left")
        label = F.when(F.col("exclusion_reason").isNotNull() | (F.coalesce("_unknown", F.lit(0)) > 0), F.lit(None).cast("int")).otherwise((F.coalesce("_known", F.lit(0)) > 0).cast("int"))
        rows = rows.withColumn(f"label_{name}", label).drop("_known", "_unknown")
    return rows


def horizon_labels(examples: DataFrame, episodes: DataFrame, horizon_hours: int) -> DataFrame:
    """Label over (t, t + h] for whole days h: each start is laid on the midnights that look ahead to it."""
    n = horizon_hours // 24
    if n * 24 != horizon_hours or n < 1:
        raise ValueError("horizons are whole days")
    last = label_bucket(F.col("first_alarm_at"))
    starts = episodes.select("channel_id", "left_boundary", F.explode(F.sequence(last - days(n - 1), last, F.expr("INTERVAL 1 DAY"))).alias("as_of"))
    counts = starts.groupBy("channel_id", "as_of").agg(F.count_if(F.col("left_boundary") == KNOWN).alias("_known"), F.count_if(F.col("left_boundary") == UNKNOWN).alias("_unknown"))
    rows = examples.join(counts, ["channel_id", "as_of"], "left")
    label = F.when(F.coalesce("_unknown", F.lit(0)) > 0, F.lit(None).cast("int")).otherwise((F.coalesce("_known", F.lit(0)) > 0).cast("int"))
    return rows.withColumn(f"label_{horizon_hours}h", label).drop("_known", "_unknown")


def split_summary(examples: DataFrame) -> DataFrame:
    return examples.groupBy("split", "exclusion_reason").agg(F.count("*").alias("row_count"), F.count_if(F.col("label") == 1).alias("positives"), F.min("as_of").alias("first_as_of"), F.max("as_of").alias("last_as_of"))


def invariants(examples: DataFrame, short: int = 7, long: int = 30) -> DataFrame:
    """One row: how many snapshots break each rule that all of them keep."""
    c = F.col
    return examples.agg(
        F.count_if(c("label").isNull() != c("exclusion_reason").isNotNull()).alias("label_without_reason"),
        F.count_if((c("event_count_24h") > c(f"event_count_{short}d")) | (c(f"event_count_{short}d") > c(f"event_count_{long}d"))).alias("windows_not_nested"),
        F.count_if((c("alarm_count_24h") > c("event_count_24h")) | (c(f"alarm_count_{long}d") > c(f"event_count_{long}d"))).alias("more_alarms_than_rows"),
        F.count_if(c(f"active_days_{long}d") > long).alias("too_many_days"),
        F.count_if((c("last_event_age_hours") < 0) | (c(f"last_alarm_age_hours_{long}d") < 0)).alias("negative_age"),
    )


def check_invariants(examples: DataFrame, short: int = 7, long: int = 30) -> None:
    broken = {k: v for k, v in invariants(examples, short, long).first().asDict().items() if v}
    if broken:
        raise ValueError(f"broken invariants: {broken}")


def refuse_held_out(examples: DataFrame, test: str) -> DataFrame:
    """``examples``, or an error if any row is of the held-out period."""
    if examples.filter(F.col("as_of") >= ntz(test)).limit(1).count():
        raise ValueError("rows of the held-out period")
    return examples


def fold_masks(df: DataFrame, validation: str, until: str, horizon_days: int = 1) -> DataFrame:
    """Expanding window: ``in_train`` up to the purge before ``validation``, ``in_eval`` from it on to ``until``."""
    ahead = F.col("as_of") + days(horizon_days)
    return df.withColumn("in_train", ahead <= ntz(validation)).withColumn("in_eval", (F.col("as_of") >= ntz(validation)) & (ahead <= ntz(until)))


def horizon_masks(df: DataFrame, horizon_hours: int, validation: str, until: str) -> DataFrame:
    """Purge by horizon: training labels end before ``validation``; evaluation labels end by ``until``."""
    return df.withColumn("in_train", F.col("as_of") < ntz(validation) - hours(horizon_hours)).withColumn(
        "in_eval", (F.col("as_of") >= ntz(validation)) & (F.col("as_of") + hours(horizon_hours) <= ntz(until))
    )


def complete_tail(df: DataFrame, horizon_hours: int) -> DataFrame:
    """Without the last days, whose label window is not complete."""
    last = df.agg(F.max("as_of").alias("_last"))
    return df.crossJoin(F.broadcast(last)).filter(F.col("as_of") <= F.col("_last") - hours(horizon_hours - 24)).drop("_last")


def category_codes(df: DataFrame, col: str, vocabulary: DataFrame, out: str) -> DataFrame:
    """Index of the value in the sorted vocabulary, null if unknown."""
    words = vocabulary.select(F.col(vocabulary.columns[0]).alias("_word")).distinct().filter("_word is not null")
    codes = words.withColumn(out, F.row_number().over(W.orderBy("_word")) - 1)  # a vocabulary, not the data
    return df.join(codes, F.col(col) == F.col("_word"), "left").drop("_word")


def model_matrix_v1(df: DataFrame) -> DataFrame:
    """Four columns; an alarm age counts only below a day."""
    age = F.col("last_alarm_age_hours_24h")
    return df.select("channel_id", "as_of", F.col("event_count_24h").cast("double"), F.col("alarm_count_24h").cast("double"), "last_event_age_hours", F.when(age < 24, age).alias("last_alarm_age_hours_24h"))


def model_matrix_v2(df: DataFrame, short: int = 7, long: int = 30, calendar: bool = False) -> DataFrame:
    """Thirteen columns, channel age at most a year; with month and weekday (Monday 0) if wanted."""
    counts = [f"{c}_{w}" for w in ("24h", f"{short}d", f"{long}d") for c in ("event_count", "alarm_count")] + [f"active_days_{long}d", f"episode_starts_{short}d", f"episode_starts_{long}d"]
    more = [F.month("as_of").cast("double").alias("month"), F.weekday("as_of").cast("double").alias("weekday")] if calendar else []
    return df.select(
        "channel_id", "as_of", *[F.col(c).cast("double").alias(c) for c in counts], "last_event_age_hours", f"last_alarm_age_hours_{long}d",
        F.least(F.col("channel_age_days"), F.lit(365.0)).alias("channel_age_days"), f"log_gap_hours_{long}d", *more,
    )


