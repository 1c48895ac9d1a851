"""From channels to objects: roll-ups, history, neighbours, rhythm, activity and weather."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.steps import stored
from ..functions.time import age_hours, day_number, hours, micros
from .episodes import with_object

MICRO_HOUR = 3_600_000_000


def lead_order(short: int, long: int) -> list[Column]:
    """Most alarms, then most starts, then the youngest alarm; the id settles ties."""
    return [F.desc(f"alarm_count_{short}d"), F.desc(f"episode_starts_{long}d"), F.asc_nulls_last(f"last_alarm_age_hours_{long}d"), F.asc("channel_id")]


def lead_channel(examples: DataFrame, short: int = 7, long: int = 30) -> DataFrame:
    """The leading channel's row of each object-day."""
    return examples.withColumn("_rank", F.row_number().over(W.partitionBy("object_id", "as_of").orderBy(*lead_order(short, long)))).filter("_rank = 1").drop("_rank")


def object_day_rollup(examples: DataFrame, types: list[str], short: int = 7, long: int = 30) -> DataFrame:
    """One row per (object_id, as_of): channels, sums, maxima, minima, active counts and shares, channels and starts of
    each sensor type, the leading channel's features and the calendar.  ``examples`` have object_id and sensor_type."""
    w = ("24h", f"{short}d", f"{long}d")
    sums = [f"{c}_{x}" for x in w for c in ("event_count", "alarm_count")] + [f"episode_starts_{long}d"]
    maxima = [f"alarm_count_{short}d", f"episode_starts_{short}d", f"episode_starts_{long}d", f"active_days_{long}d"]
    minima = [f"last_alarm_age_hours_{long}d", "last_event_age_hours"]
    active = [f"alarm_count_{short}d", f"alarm_count_{long}d", f"episode_starts_{short}d"]
    lead = [*sums, f"active_days_{long}d", f"episode_starts_{short}d", "last_event_age_hours", f"last_alarm_age_hours_{long}d", "channel_age_days", f"log_gap_hours_{long}d"]
    n = F.count("*")
    first = F.struct(
        (-F.col(f"alarm_count_{short}d")).alias("a"), (-F.col(f"episode_starts_{long}d")).alias("b"), F.coalesce(f"last_alarm_age_hours_{long}d", F.lit(float("inf"))).alias("c"), F.col("channel_id").alias("d")
    )
    rows = examples.groupBy("object_id", "as_of").agg(
        n.alias("channels"), *[F.sum(c).alias(f"sum_{c}") for c in sums], *[F.max(c).alias(f"max_{c}") for c in maxima], *[F.min(c).alias(f"min_{c}") for c in minima],
        *[F.count_if(F.col(c) > 0).alias(f"active_{c}") for c in active], *[(F.count_if(F.col(c) > 0) / n).alias(f"share_{c}") for c in active],
        *[F.count_if(F.col("sensor_type") == t).alias(f"channels_{t}") for t in types],
        *[F.coalesce(F.sum(F.when(F.col("sensor_type") == t, F.col(f"episode_starts_{short}d"))), F.lit(0)).alias(f"starts_{t}") for t in types],
        F.min_by(F.struct(*lead), first).alias("_lead"),
    )
    rows = rows.select("*", *[F.col(f"_lead.{c}").alias(f"lead_{c}") for c in lead]).drop("_lead")
    return rows.withColumn("month", F.month("as_of")).withColumn("weekday", F.weekday("as_of"))


def object_labels(examples: DataFrame) -> DataFrame:
    """Per object-day with a known label: the largest label, and whether a channel had an alarm in the last day."""
    known = examples.filter("label IS NOT NULL")
    return known.groupBy("object_id", "as_of").agg(F.max("label").alias("label"), F.max((F.col("alarm_count_24h") > 0).cast("int")).alias("rule"))


def object_day_scores(scored: DataFrame) -> DataFrame:
    """Largest score, label and rule of each object-day."""
    return scored.groupBy("object_id", "as_of").agg(F.max("score").alias("score"), F.max("label").alias("label"), F.max("rule").alias("rule"))


def neighbour_features(examples: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Totals of the other channels of the object, and of those of the same type, on the same day; null where the
    channel has no object.  Excluded rows feed their neighbours too."""
    of_object, of_type = W.partitionBy("object_id", "as_of"), W.partitionBy("object_id", "sensor_type", "as_of")
    mapped = examples.filter("object_id IS NOT NULL")  # the others would all meet in one group
    for c in columns:
        mapped = mapped.withColumn(f"object_other_{c}", F.sum(c).over(of_object) - F.col(c)).withColumn(f"type_other_{c}", F.sum(c).over(of_type) - F.col(c))
    mapped = mapped.withColumn("object_other_channels", F.count("*").over(of_object) - 1)
    return mapped.unionByName(examples.filter("object_id IS NULL"), allowMissingColumns=True)


def siblings(objects: DataFrame) -> DataFrame:
    """(object_id, sibling_id): other objects with the same, non-empty parent."""
    named = objects.filter("parent_id IS NOT NULL AND parent_id <> ''")
    other = named.select(F.col("object_id").alias("sibling_id"), F.col("parent_id").alias("_p"))
    return named.join(other, (F.col("parent_id") == F.col("_p")) & (F.col("object_id") != F.col("sibling_id"))).select("object_id", "sibling_id")


def _seen(left: DataFrame, right: DataFrame, by: str, on: str, at: str, counts: dict[str, tuple[int, int]], last: str | None = None) -> DataFrame:
    """``left`` with the number of ``right`` rows of the same ``by`` in (t + low, t + high], for each name of ``counts``
    (microseconds), and the latest moment at or before t as ``last``.

    A count is the difference of two running ones, at the ends of its window, so no frame is gone through again for a row.
    Running counts are made within a day of ``by``, then over its days: only these few are ordered together."""
    day = F.floor(F.col("_t") / (24 * MICRO_HOUR)).alias("_day")
    left = stored(left, "moments")
    events = stored(right.select(by, micros(F.col(at)).alias("_t"), F.col(at).alias("_at")).filter("_t IS NOT NULL").select("*", day), "events")
    ends = sorted({x for pair in counts.values() for x in pair} | ({0} if last else set()))
    asked = left.select(by, micros(F.col(on)).alias("_q")).filter("_q IS NOT NULL").distinct()
    asked = asked.select("*", F.explode(F.array(*[F.lit(x).cast("long") for x in ends])).alias("_end")).withColumn("_t", F.col("_q") + F.col("_end")).select("*", day)
    both = asked.unionByName(events, allowMissingColumns=True)
    known = F.count(F.when(F.col("_q").isNull(), 1))
    within = W.partitionBy(by, "_day").orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    found = both.select(by, "_day", "_q", "_end", known.over(within).alias("_n"), F.max("_at").over(within).alias("_at")).filter("_q IS NOT NULL")
    before = W.partitionBy(by).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    daily = asked.select(by, "_day").distinct().unionByName(events.select(by, "_day", "_at"), allowMissingColumns=True).groupBy(by, "_day").agg(F.count("_at").alias("_n"), F.max("_at").alias("_at"))
    daily = daily.select(F.col(by).alias("_by"), F.col("_day").alias("_on"), F.sum("_n").over(before).alias("_n_before"), F.max("_at").over(before).alias("_at_before"))
    found = found.join(daily, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_day") == F.col("_on")))
    total, latest = F.col("_n") + F.coalesce("_n_before", F.lit(0)), F.coalesce("_at", "_at_before")
    of = lambda end, value: F.max(F.when(F.col("_end") == end, value))
    found = found.groupBy(F.col(by).alias("_by"), "_q").agg(*[(of(high, total) - of(low, total)).alias(name) for name, (low, high) in counts.items()], *([of(0, latest).alias(last)] if last else []))
    rows = left.join(found, F.col(by).eqNullSafe(F.col("_by")) & (micros(F.col(on)) == F.col("_q")), "left").drop("_by", "_q")
    return rows.withColumns({name: F.coalesce(name, F.lit(0).cast("long")) for name in counts})


def count_in_windows(left: DataFrame, right: DataFrame, by: str, windows_hours: Iterable[int], on: str = "as_of", at: str = "occurred_at", prefix: str = "count") -> DataFrame:
    """``left`` with the number of ``right`` rows of the same ``by`` in (t - w, t], for each w."""
    return _seen(left, right, by, on, at, {f"{prefix}_{w}h": (-w * MICRO_HOUR, 0) for w in windows_hours})


def asof_previous(left: DataFrame, right: DataFrame, by: str, on: str = "as_of", at: str = "occurred_at", out: str = "previous_at") -> DataFrame:
    """``left`` with the latest ``right`` moment of the same ``by`` at or before t."""
    return _seen(left, right, by, on, at, {}, out)


def value_at(left: DataFrame, series: DataFrame, on: str, at: str, value: str, out: str) -> DataFrame:
    """``left`` with the value of exactly the moment ``on``, else null."""
    return left.join(series.select(F.col(at).alias("_at"), F.col(value).alias(out)), F.col(on) == F.col("_at"), "left").drop("_at")


def target_history(object_days: DataFrame, episodes: DataFrame, directory: DataFrame, windows_hours: Iterable[int] = (24, 168, 720), cap_hours: float = 720.0) -> DataFrame:
    """Starts of the object's episodes in each window, and the age of the last start, at most ``cap_hours``."""
    starts = with_object(episodes, directory).filter("object_id IS NOT NULL").select("object_id", F.col("first_alarm_at").alias("occurred_at"))
    rows = _seen(object_days, starts, "object_id", "as_of", "occurred_at", {f"starts_{w}h": (-w * MICRO_HOUR, 0) for w in windows_hours}, "_last")
    return rows.withColumn("last_start_age_hours", F.least(age_hours(F.col("_last"), F.col("as_of")), F.lit(float(cap_hours)))).drop("_last")


def rhythm(object_days: DataFrame, starts: DataFrame, horizon_hours: int, count_days: Iterable[int] = (90, 365), active_days: Iterable[int] = (7, 30, 90)) -> DataFrame:
    """When an object's starts (object_id, occurred_at) usually come, seen from each day:

    starts in (t - w, t]; starts in [t - 7k d, t - 7k d + h) for k = 1, 2; active days among the w before t; the streak
    of active days up to the day before t; starts on the same weekday of the four weeks before.  Days are plain dates."""
    day_us = 24 * MICRO_HOUR
    starts = stored(starts, "starts")
    counts = {f"starts_{d}d": (-d * day_us, 0) for d in count_days}
    counts |= {f"same_window_{k}w": (-7 * k * day_us - 1, -7 * k * day_us + horizon_hours * MICRO_HOUR - 1) for k in (1, 2)}
    rows = _seen(object_days, starts, "object_id", "as_of", "occurred_at", counts).withColumn("_day", day_number(F.col("as_of")))

    per_day = starts.groupBy("object_id", day_number(F.col("occurred_at")).alias("_day")).agg(F.count("*").alias("_n"))
    by_day = W.partitionBy("object_id").orderBy("_day")
    # an island of active days keeps day - row number, and its length grows along it
    islands = per_day.withColumn("_island", F.col("_day") - F.row_number().over(by_day))
    islands = islands.withColumn("_streak", F.row_number().over(W.partitionBy("object_id", "_island").orderBy("_day"))).drop("_island")
    asked = rows.select("object_id", "_day").distinct()
    joined = islands.withColumn("_asked", F.lit(0)).unionByName(asked.withColumn("_asked", F.lit(1)), allowMissingColumns=True)
    active = (F.col("_asked") == 0).cast("long")
    for d in active_days:
        joined = joined.withColumn(f"active_{d}d", F.coalesce(F.sum(active).over(by_day.rangeBetween(-d, -1)), F.lit(0)))
    joined = joined.withColumn("streak", F.coalesce(F.max("_streak").over(by_day.rangeBetween(-1, -1)), F.lit(0)).cast("long"))
    weekday = sum((F.coalesce(F.sum("_n").over(by_day.rangeBetween(-7 * k, -7 * k)), F.lit(0)) for k in range(1, 5)), F.lit(0))
    joined = joined.withColumn("same_weekday_4w", weekday).filter("_asked = 1").drop("_n", "_streak", "_asked")
    return rows.join(joined, ["object_id", "_day"]).drop("_day")


def activity_features(object_days: DataFrame, on_events: DataFrame, floods: DataFrame, objects: DataFrame, windows_hours: tuple[int, int, int] = (24, 168, 720), flood_hours: tuple[int, ...] = (24, 168)) -> DataFrame:
    """Switch-on events of an object's machines (object_id, occurred_at): counts in windows, the last day's count over
    the daily mean of the longest window, whether it has any machine; the same summed over its siblings, with their
    flood starts.

    Counts are made once for each (object, day), stored, and joined over siblings, so events never multiply; what is given
    is read once, too."""
    object_days, on_events, floods = stored(object_days, "object-days"), stored(on_events, "on-events"), stored(floods, "floods")
    long = windows_hours[2] // 24
    all_days = object_days.select("as_of").distinct().crossJoin(objects.select("object_id").distinct())
    own = count_in_windows(all_days, on_events, "object_id", windows_hours, prefix="on")
    daily = F.col(f"on_{windows_hours[2]}h") / long
    own = own.withColumn("flap_ratio", F.when(daily > 0, F.col(f"on_{windows_hours[0]}h") / daily).otherwise(0.0))
    own = own.join(on_events.select("object_id").distinct().withColumn("has_machines", F.lit(1)), "object_id", "left").withColumn("has_machines", F.coalesce("has_machines", F.lit(0)))
    own = count_in_windows(own, floods, "object_id", flood_hours, prefix="flood")
    own = stored(own, "object-activity")
    features = [f"on_{w}h" for w in windows_hours] + ["flap_ratio", "has_machines"]
    near = siblings(objects).join(own.withColumnRenamed("object_id", "sibling_id"), "sibling_id")
    near = near.groupBy("object_id", "as_of").agg(*[F.sum(c).alias(f"sibling_{c}") for c in features], *[F.sum(f"flood_{w}h").alias(f"sibling_flood_{w}h") for w in flood_hours])
    rows = object_days.join(own.select("object_id", "as_of", *features), ["object_id", "as_of"], "left").join(near, ["object_id", "as_of"], "left")
    added = [c for c in rows.columns if c not in object_days.columns]
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in added})


def weather_features(weather: DataFrame, moments: DataFrame, step_hours: int = 3, lag_hours: int = 3) -> DataFrame:
    """For each distinct as_of, over readings up to t - lag: 24 h temperature mean, least, most; changes of its sign in
    72 h; pressure at the cut and its change in 24 h; strongest wind in 24 h.  A window that misses a reading is null."""
    cut = moments.select("as_of").distinct().withColumn("cut", F.col("as_of") - hours(lag_hours))
    w = cut.join(weather, (F.col("ts") <= F.col("cut")) & (F.col("ts") > F.col("cut") - hours(72)))
    timed = W.partitionBy("as_of").orderBy("ts")
    w = w.withColumn("crosses", ((F.col("temperature") > 0) != (F.lag("temperature").over(timed) > 0)).cast("long"))
    day = F.col("ts") > F.col("cut") - hours(24)
    n1, n3 = 24 // step_hours, 72 // step_hours
    whole = lambda c, n, when=None: F.count(c if when is None else F.when(when, F.col(c))) == n
    t, p, v = F.col("temperature"), F.col("pressure"), F.col("wind_speed")
    day_t, day_v = whole("temperature", n1, day), whole("wind_speed", n1, day)
    found = w.groupBy("as_of").agg(
        F.when(day_t, F.avg(F.when(day, t))).alias("temperature_mean_24h"), F.when(day_t, F.min(F.when(day, t))).alias("temperature_min_24h"), F.when(day_t, F.max(F.when(day, t))).alias("temperature_max_24h"),
        F.when(whole("temperature", n3), F.sum("crosses")).alias("freeze_thaw_72h"), F.max(F.when(F.col("ts") == F.col("cut"), p)).alias("pressure"),
        F.max(F.when(F.col("ts") == F.col("cut") - hours(24), p)).alias("_before"), F.when(day_v, F.max(F.when(day, v))).alias("wind_max_24h"),
    )
    found = found.withColumn("pressure_change_24h", F.col("pressure") - F.col("_before")).drop("_before")
    return cut.select("as_of").join(found, "as_of", "left")


def precipitation(weather: DataFrame, moments: DataFrame, step_hours: int = 1, lag_hours: int = 3) -> DataFrame:
    """24 h and 72 h sums up to t - lag, null where a reading is missing."""
    cut = moments.select("as_of").distinct().withColumn("cut", F.col("as_of") - hours(lag_hours))
    w = cut.join(weather, (F.col("ts") <= F.col("cut")) & (F.col("ts") > F.col("cut") - hours(72)), "left")
    p = lambda h: F.when(F.col("ts") > F.col("cut") - hours(h), F.col("precipitation"))
    return w.groupBy("as_of").agg(*[F.when(F.count(p(h)) == h // step_hours, F.sum(p(h))).alias(f"precipitation_{h}h") for h in (24, 72)])


