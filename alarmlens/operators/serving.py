"""Features at any moment, refusals, ranked risk maps and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import age_days, age_hours, days, hours, micros_between, seconds

DAY_US = 86_400_000_000


def _asked(obs: DataFrame, moments: DataFrame, long: int, gap_seconds: float) -> DataFrame:
    """Observations of each asked (channel_id, t) that its features need, the lead-in of one gap included."""
    pairs = obs.join(moments, "channel_id")
    return pairs.filter((F.col("occurred_at") <= F.col("t")) & (F.col("occurred_at") > F.col("t") - days(long) - seconds(gap_seconds)))


def features_at(obs: DataFrame, moments: DataFrame, gaps: DataFrame, gap_seconds: float = 900, short: int = 7, long: int = 30) -> DataFrame:
    """All snapshot features at the moments asked for (channel_id, t); active days are 24-hour spans back from t."""
    rows = _asked(obs, moments, long, gap_seconds)
    t, at = F.col("t"), F.col("occurred_at")
    timed = W.partitionBy("channel_id", "t", "is_alarm").orderBy("occurred_at")
    before = F.lag("occurred_at").over(timed)
    opens = F.col("is_alarm") & (before.isNull() | (micros_between(before, at) > int(gap_seconds * 1e6)))
    rows = rows.withColumn("opens", opens).filter(at > t - days(long))
    inside = {"24h": at > t - days(1), f"{short}d": at > t - days(short), f"{long}d": F.lit(True)}
    found = rows.groupBy("channel_id", "t").agg(
        *[x for n, w in inside.items() for x in (F.count_if(w).alias(f"event_count_{n}"), F.count_if(w & F.col("is_alarm")).alias(f"alarm_count_{n}"))],
        F.countDistinct(F.floor(micros_between(at, t) / DAY_US)).alias(f"active_days_{long}d"),
        *[F.count_if(inside[f"{n}d"] & F.col("opens")).alias(f"episode_starts_{n}d") for n in (short, long)],
        age_hours(F.max("occurred_at"), F.col("t")).alias("last_event_age_hours"), age_hours(F.max(F.when(F.col("is_alarm"), at)), F.col("t")).alias(f"last_alarm_age_hours_{long}d"),
    )
    first = obs.groupBy("channel_id").agg(F.min("occurred_at").alias("_first"))
    met = moments.select("t").distinct().join(gaps, (F.col("start_at") < t) & (F.col("end_at") > t - days(long)), "left")
    part = micros_between(F.greatest("start_at", t - days(long)), F.least("end_at", "t"))
    gap_hours = met.groupBy("t").agg((F.coalesce(F.sum(F.when(F.col("start_at").isNotNull(), part)), F.lit(0)) / F.lit(3.6e9)).alias(f"log_gap_hours_{long}d"))
    return found.join(first, "channel_id").withColumn("channel_age_days", age_days(F.col("_first"), t)).drop("_first").join(gap_hours, "t")


def serving_status(obs: DataFrame, moments: DataFrame, gaps: DataFrame, gap_seconds: float = 900, long: int = 30, stale_seconds: float = 3600) -> DataFrame:
    """(channel_id, t, status): ``ok`` or the first reason to refuse."""
    at, t = F.col("occurred_at"), F.col("t")
    times = moments.select("t").distinct()
    past = obs.select("channel_id", "occurred_at", "is_alarm")
    # the journal before t: whole days from a row a day, t's own day from its rows
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    by_day = past.groupBy(day(at).alias("day")).agg(F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"))
    earlier = times.join(by_day, F.col("day") < day(t)).select("t", "first", "last")
    same = times.withColumn("day", day(t)).join(past.withColumn("day", day(at)), "day").filter(at <= t).select("t", at.alias("first"), at.alias("last"))
    journal = earlier.unionByName(same).groupBy("t").agg(F.min("first").alias("journal_first"), F.max("last").alias("journal_last"))
    gap = times.join(gaps, (F.col("start_at") <= t) & (F.col("end_at") > t - hours(24)), "left_semi").withColumn("in_gap", F.lit(True))
    own = past.join(moments, "channel_id").filter(at <= t).groupBy("channel_id", "t").agg(
        F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.max(F.when(F.col("is_alarm"), at)).alias("last_alarm")
    )
    rows = moments.join(journal, "t", "left").join(gap, "t", "left").join(own, ["channel_id", "t"], "left")
    status = (
        F.when(F.col("journal_first").isNull() | (t - days(long) < F.col("journal_first")), F.lit("global_history"))
        .when(F.col("journal_last") < t - seconds(stale_seconds), F.lit("stale_journal"))
        .when(F.coalesce("in_gap", F.lit(False)), F.lit("known_log_gap"))
        .when(F.col("first_at").isNull(), F.lit("unknown_channel"))
        .when(F.col("last_at") <= t - days(long), F.lit("no_recent_records"))
        .when(t - hours(24) < F.col("first_at"), F.lit("channel_history"))
        .when(F.col("last_alarm") >= t - seconds(gap_seconds), F.lit("active_alarm"))
        .otherwise(F.lit("ok"))
    )
    return rows.select("channel_id", "t", status.alias("status"))


def class_history(obs: DataFrame, moments: DataFrame, states: list[str], gap_seconds: float = 900, long: int = 30) -> DataFrame:
    """Starts of a class in the ``long`` days before t, and whether the channel ever had it before t."""
    alarms = obs.filter(F.col("is_alarm") & F.col("raw_value").isin(*states))
    rows = _asked(alarms, moments, long, gap_seconds)
    before = F.lag("occurred_at").over(W.partitionBy("channel_id", "t").orderBy("occurred_at"))
    rows = rows.withColumn("opens", before.isNull() | (micros_between(before, F.col("occurred_at")) > int(gap_seconds * 1e6)))
    starts = rows.groupBy("channel_id", "t").agg(F.count_if(F.col("opens") & (F.col("occurred_at") > F.col("t") - days(long))).alias("class_starts"))
    first = alarms.groupBy("channel_id").agg(F.min("occurred_at").alias("_first"))
    found = moments.join(starts, ["channel_id", "t"], "left").join(first, "channel_id", "left")
    return found.select("channel_id", "t", F.coalesce("class_starts", F.lit(0)).alias("class_starts"), F.coalesce(F.col("_first") < F.col("t"), F.lit(False)).alias("ever_seen"))


def top_suspects(scored: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` channels of highest score of each object, ranked; ties by id."""
    rank = F.row_number().over(W.partitionBy("object_id").orderBy(F.desc_nulls_last("score"), "channel_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def suspects(scored: DataFrame, k: int = 5) -> DataFrame:
    """object_id with an ordered array of its top suspects."""
    kept = top_suspects(scored, k).groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("rank", "channel_id", "score"))).alias("suspects"))
    return kept


def top_factors(df: DataFrame, coefficients: dict[str, float], k: int = 3) -> DataFrame:
    """``df`` with up to ``k`` features of the largest positive contributions to a linear score."""
    parts = F.array(*[F.struct((-F.coalesce(F.col(c), F.lit(0.0)) * b).alias("minus"), F.lit(c).alias("feature")) for c, b in coefficients.items()])
    positive = F.filter(parts, lambda x: x["minus"] < 0)
    return df.withColumn("factors", F.transform(F.slice(F.array_sort(positive), 1, k), lambda x: F.struct(x["feature"].alias("feature"), (-x["minus"]).alias("contribution"))))


def risk_map(objects: DataFrame, threshold: float) -> DataFrame:
    """Objects (object_id, probability, score) by falling probability, then score; unknown ones last."""
    order = W.orderBy(F.desc_nulls_last("probability"), F.desc_nulls_last("score"), "object_id")  # one row an object
    alert = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return objects.withColumn("rank", F.row_number().over(order)).withColumn("alert", alert)


def blind_spots(directory: DataFrame, families: list[str], seen: DataFrame | None = None) -> DataFrame:
    """Sensor families that an object lacks, and how many of its channels are silent."""
    rows = directory.filter("object_id IS NOT NULL")
    if seen is not None:
        rows = rows.join(seen.select("channel_id").distinct().withColumn("_seen", F.lit(True)), "channel_id", "left")
    else:
        rows = rows.withColumn("_seen", F.lit(True))
    wanted = F.array(*[F.lit(f) for f in sorted(families)])
    return rows.groupBy("object_id").agg(F.array_except(wanted, F.collect_set("sensor_type")).alias("missing"), F.count_if(F.col("_seen").isNull()).alias("silent_channels"))


def risk_type(suspect_list: Column, types: dict[str, str], default: str) -> Column:
    """Risk type of the first suspect (an array of structs with sensor_type) whose type is mapped."""
    table = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    mapped = F.filter(F.transform(suspect_list, lambda s: F.element_at(table, s["sensor_type"])), lambda x: x.isNotNull())
    return F.coalesce(F.get(mapped, F.lit(0)), F.lit(default))


def new_risks(alerts: DataFrame, open_risks: DataFrame, now: Column) -> DataFrame:
    """Alerts (object_id, model) without an open risk of the same whose window is not over."""
    live = open_risks.filter((F.col("status") == "open") & (F.col("window_end") > now)).select("object_id", "model").distinct()
    return alerts.join(live, ["object_id", "model"], "left_anti")


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row per column: values that differ by more than the tolerance (null equals null); rows on one side only."""
    columns = [c for c in a.columns if c not in keys]
    both = a.withColumn("_a", F.lit(True)).alias("a").join(b.withColumn("_b", F.lit(True)).alias("b"), keys, "full_outer")

    def differs(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        kind = dict(a.dtypes)[c]
        unequal = F.abs(x.cast("double") - y.cast("double")) > tolerance if kind in ("double", "float", "int", "bigint", "long") or kind.startswith("decimal") else x != y
        return F.col("_a").isNotNull() & F.col("_b").isNotNull() & (x.isNull() != y.isNull()) | F.coalesce(unequal, F.lit(False))

    one = both.agg(*[F.count_if(differs(c)).alias(c) for c in columns], F.count_if(F.col("_b").isNull()).alias("_left"), F.count_if(F.col("_a").isNull()).alias("_right"))
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {stack}) AS (column_name, mismatches)", "_left AS left_only", "_right AS right_only")


def grid_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only in ``a`` (missing), only in ``b`` (extra), and in both."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(a.exceptAll(b), "missing").crossJoin(count(b.exceptAll(a), "extra")).crossJoin(count(a.intersect(b), "common"))


def join_aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that refuses tables with different key sets."""
    odd = a.select(*keys, F.lit(1).alias("_a")).join(b.select(*keys, F.lit(1).alias("_b")), keys, "full_outer").filter("_a IS NULL OR _b IS NULL")
    if odd.limit(1).count():
        raise ValueError("key sets differ")
    return a.join(b, keys)
