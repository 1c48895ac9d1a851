"""Run-to-failure sensor telemetry.  Rows have run_id, pos (from 0 within the run) and sensor columns; a profile has the
normal value of each sensor by pump."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.steps import stored


def by_run():
    return W.partitionBy("run_id").orderBy("pos")


def normal_profile(t: DataFrame, sensors: list[str], share: float | None = 0.6, spread: bool = False) -> DataFrame:
    """Median (and deviation) of each sensor of each pump over normal rows, of the first ``share`` by time."""
    rows = t.filter("is_normal")
    if share is not None:
        whole = W.partitionBy("pump_id")
        rows = rows.withColumn("_k", F.row_number().over(whole.orderBy("ts"))).withColumn("_n", F.count("*").over(whole)).filter(F.col("_k") <= F.floor(F.col("_n") * share))
    return rows.groupBy("pump_id").agg(*[F.percentile(s, F.lit(0.5)).alias(f"{s}_median") for s in sensors], *([F.stddev_samp(s).alias(f"{s}_sd") for s in sensors] if spread else []))


def signals(t: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Mean, largest and least of each group of sensors in a row."""
    out = {}
    for name, cols in groups.items():
        out[f"{name}_mean"] = reduce(Column.__add__, [F.col(c) for c in cols]) / len(cols)
        out[f"{name}_max"] = F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
        out[f"{name}_min"] = F.least(*cols) if len(cols) > 1 else F.col(cols[0])
    return t.withColumns(out)


def lag_change(t: DataFrame, sensors: list[str], w: int = 12) -> DataFrame:
    """Change over min(pos, w) rows and its mean step; 0 on normal rows and at the start."""
    rows = t
    for s in sensors:
        before = F.coalesce(F.lag(s, w).over(by_run()), F.first(s).over(by_run().rowsBetween(W.unboundedPreceding, W.currentRow)))
        change = F.when(F.col("is_normal"), F.lit(0.0)).otherwise(F.col(s) - before)
        rows = rows.withColumn(f"{s}_change_{w}", change).withColumn(f"{s}_step_{w}", F.when(F.col("pos") > 0, change / F.least(F.col("pos"), F.lit(w))).otherwise(0.0))
    return rows


def acceleration(t: DataFrame, sensors: list[str], w: int = 12, start: int = 24) -> DataFrame:
    """Change less the change ``w`` rows ago, from row ``start`` on; 0 before."""
    return t.withColumns({f"{s}_acceleration": F.when(F.col("pos") >= start, F.col(f"{s}_change_{w}") - F.lag(f"{s}_change_{w}", w).over(by_run())).otherwise(0.0) for s in sensors})


def long_lags(t: DataFrame, sensors: list[str], windows: tuple[int, ...] = (12, 36, 96)) -> DataFrame:
    """Changes over several windows, and acceleration of the shortest."""
    for w in windows:
        t = lag_change(t, sensors, w)
    return acceleration(t, sensors, windows[0], 2 * windows[0])


def padded_lags(t: DataFrame, profile: DataFrame, sensors: list[str], windows: tuple[int, ...] = (12, 36, 96)) -> DataFrame:
    """Changes where the rows before a run are the pump's normal profile, and acceleration of the shortest window."""
    rows = t.join(profile, "pump_id", "left")
    before = lambda s, k: F.when(F.col("pos") >= k, F.lag(s, k).over(by_run())).otherwise(F.col(f"{s}_median"))
    w0 = windows[0]
    out = {f"{s}_change_{w}": F.col(s) - before(s, w) for s in sensors for w in windows}
    out |= {f"{s}_acceleration": F.col(s) - 2 * before(s, w0) + before(s, 2 * w0) for s in sensors}
    return rows.withColumns(out).drop(*[c for c in profile.columns if c != "pump_id"])


def rolling_mean(t: DataFrame, profile: DataFrame, sensors: list[str], windows: tuple[int, ...] = (12, 36, 96, 288)) -> DataFrame:
    """Mean of the last w rows; rows missing before the run are the profile."""
    rows = t.join(profile, "pump_id", "left")
    out = {}
    for s in sensors:
        for w in windows:
            frame = by_run().rowsBetween(1 - w, 0)
            out[f"{s}_mean_{w}"] = (F.sum(s).over(frame) + (w - F.count(s).over(frame)) * F.col(f"{s}_median")) / w
    return rows.withColumns(out).drop(*[c for c in profile.columns if c != "pump_id"])


def rolling_slope(t: DataFrame, profile: DataFrame, sensors: list[str], w: int = 36) -> DataFrame:
    """Least-squares slope over the last w rows, missing ones being the profile.

    With x = 0 .. w - 1 the slope is (sum(x y) - xm sum(y)) / sum((x - xm)^2); window sums of y and pos * y give both."""
    rows = t.join(profile, "pump_id", "left")
    frame = by_run().rowsBetween(1 - w, 0)
    middle, scale = (w - 1) / 2, w * (w * w - 1) / 12
    out = {}
    for s in sensors:
        m = F.col(f"{s}_median")
        missing = w - F.count(s).over(frame)
        total = F.sum(s).over(frame) + missing * m
        shift = F.col("pos") - (w - 1)
        weighted = F.sum(F.col("pos") * F.col(s)).over(frame) - shift * F.sum(s).over(frame) + m * missing * (missing - 1) / 2
        out[f"{s}_slope_{w}"] = (weighted - middle * total) / scale
    return rows.withColumns(out).drop(*[c for c in profile.columns if c != "pump_id"])


def deviation(t: DataFrame, profile: DataFrame, sensors: list[str], w: int = 12) -> DataFrame:
    """(mean of the last ``w`` rows less the median) over the deviation; null where that is 0."""
    rows = rolling_mean(t, profile.select("pump_id", *[f"{s}_median" for s in sensors]), sensors, (w,)).join(profile, "pump_id", "left")
    return rows.withColumns({f"{s}_z": F.try_divide(F.col(f"{s}_mean_{w}") - F.col(f"{s}_median"), F.col(f"{s}_sd")) for s in sensors}).drop(*[c for c in profile.columns if c != "pump_id"])


def onset_age(t: DataFrame, z: str, limit: float = 4.0, out: str = "onset_age") -> DataFrame:
    """Rows since the run's first with abs(z) over the limit; -1 while there is none."""
    first = F.min(F.when(F.abs(z) > limit, F.col("pos"))).over(by_run().rowsBetween(W.unboundedPreceding, W.currentRow))
    return t.withColumn(out, F.coalesce(F.col("pos") - first, F.lit(-1)))


def remaining_labels(t: DataFrame, horizons: tuple[int, ...] = (30, 60), minutes: int = 5) -> DataFrame:
    """Minutes to the run's last row, a label for each horizon, the fault type carried back; the fault row is left out."""
    whole = W.partitionBy("run_id")
    left = (F.max("pos").over(whole) - F.col("pos")) * minutes
    rows = t.withColumn("remaining", F.when(~F.col("is_normal"), left)).withColumn("run_fault", F.max("fault_type").over(whole))
    rows = rows.withColumns({f"label_{h}": F.coalesce((F.col("remaining") > 0) & (F.col("remaining") <= h), F.lit(False)).cast("int") for h in horizons})
    return rows.filter("remaining IS NULL OR remaining > 0")


def rule_alarm(t: DataFrame, vibration: list[str], temperature: list[str], current: str, pressure_drop: str) -> Column:
    """Any vibration over 2.8, current over 82, filter pressure drop over 0.15, any temperature over 80."""
    most = lambda cols: F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
    return (most(vibration) > 2.8) | (F.col(current) > 82) | (F.col(pressure_drop) > 0.15) | (most(temperature) > 80)


def latest_features(readings: DataFrame, sensors: list[str], profile: DataFrame, max_rows: int = 289, windows: tuple[int, ...] = (12, 36)) -> tuple[DataFrame, DataFrame]:
    """Features of each pump's newest reading from its last ``max_rows``; readings with a missing or non-finite sensor
    are refused (second frame)."""
    fine = reduce(Column.__and__, [F.col(s).isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) for s in sensors])
    good = readings.filter(fine).withColumn("_k", F.row_number().over(W.partitionBy("pump_id").orderBy(F.desc("ts")))).filter(F.col("_k") <= max_rows)
    rows = good.withColumn("run_id", F.col("pump_id")).withColumn("pos", F.count("*").over(W.partitionBy("pump_id")) - F.col("_k")).withColumn("is_normal", F.lit(False))
    rows = rolling_mean(rows, profile, sensors, windows)
    for w in windows:
        rows = rolling_slope(rows, profile, sensors, w)
    return rows.filter("_k = 1").drop("_k", "run_id", "is_normal"), readings.filter(~fine | fine.isNull())


def split_by_rank(t: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Per pump, runs in order of their start and normal rows in order of time: the first part trains, the next
    validates, the rest tests."""
    runs = t.filter("NOT is_normal").groupBy("pump_id", "run_id").agg(F.min("ts").alias("_start"))
    of_pump = W.partitionBy("pump_id")
    part = lambda k, n: F.when(k <= F.floor(n * train), "train").when(k <= F.floor(n * (train + validation)), "validation").otherwise("test")
    runs = runs.withColumn("split", part(F.row_number().over(of_pump.orderBy("_start", "run_id")), F.count("*").over(of_pump))).drop("_start")
    normal = t.filter("is_normal")
    normal = normal.withColumn("split", part(F.row_number().over(of_pump.orderBy("ts")), F.count("*").over(of_pump)))
    return t.filter("NOT is_normal").join(runs, ["pump_id", "run_id"]).unionByName(normal)


def reconstruct_runs(t: DataFrame, lengths: tuple[int, ...] = (12, 96, 288), allow_extra: bool = False) -> DataFrame:
    """Rows (pump_id, step, row_pos, fault_type) of interleaved runs with ``run_id`` (the row_pos of the run's first
    row) and ``pos``.

    The k-th row of a step is the k-th run still open; a labelled row closes its run.  So an unlabelled row points to
    row k less the labelled rows before it of the next step, which gives each row the row before it.  First rows are found
    by contraction (``first_rows``).  With ``allow_extra``, all runs of a pump start together and a step may lead with one
    normal row, which is dropped where counts demand it."""
    rows = t
    if allow_extra:
        steps = t.groupBy("pump_id", "step").agg(F.count("*").alias("n"), F.count("fault_type").alias("ends"), F.min("row_pos").alias("lead_row"))
        open_ = F.sum("ends").over(W.partitionBy("pump_id").orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, W.currentRow))
        extra = steps.withColumn("surplus", F.col("n") - open_)
        bad = F.when(~F.col("surplus").isin(0, 1), F.raise_error(F.lit("more than one extra row in a step")))
        extra = extra.withColumn("surplus", F.coalesce(bad.cast("long"), F.col("surplus"))).select("pump_id", "step", "surplus", "lead_row")
        rows = t.join(extra, ["pump_id", "step"]).filter(~((F.col("surplus") == 1) & (F.col("row_pos") == F.col("lead_row")))).drop("surplus", "lead_row")
    at = W.partitionBy("pump_id", "step").orderBy("row_pos")
    rows = rows.withColumn("_k", F.row_number().over(at)).withColumn("_ended", F.count("fault_type").over(at.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_next_k", F.when(F.col("fault_type").isNull(), F.col("_k") - F.col("_ended")))
    follow = rows.select("pump_id", (F.col("step") + 1).alias("step"), F.col("_next_k").alias("_k"), F.col("row_pos").alias("_from")).filter("_k IS NOT NULL")
    linked = rows.join(follow, ["pump_id", "step", "_k"], "left")
    heads = first_rows(linked.select("pump_id", "step", F.col("row_pos").alias("id"), F.col("_from").alias("before")))
    out = t.join(heads.select("pump_id", F.col("id").alias("row_pos"), F.col("root").alias("run_id"), "pos"), ["pump_id", "row_pos"])
    return out.select(*t.columns, "run_id", "pos")


def first_rows(chains: DataFrame) -> DataFrame:
    """(pump_id, id, root, pos): the first row of each row's chain, and how many rows lie between.

    ``chains``: pump_id, step, id, and ``before``, the id of the row one step before it in its chain, null for a first one.
    Each round sets every second row (by a digit of its step) aside and lets the others point past it; rows that point to
    a row already known are known and leave.  When none is left, the rounds are undone: a row set aside is one pointer
    behind a row that is known by then.  Rounds halve, so all rows together are joined about twice; each is stored."""
    active = stored(chains, "chains")
    known = [active.filter("before IS NULL").select("pump_id", "id", F.col("id").alias("root"), F.lit(0).cast("long").alias("pos"))]
    active = active.filter("before IS NOT NULL")
    aside: list[DataFrame] = []
    k = 0
    while not active.isEmpty():
        odd = F.shiftright("step", k).bitwiseAND(F.lit(1)) == 1
        aside.append(active.filter(odd))
        past = aside[-1].select("pump_id", F.col("id").alias("before"), F.col("before").alias("_further"))
        ends = reduce(DataFrame.unionByName, known).select("pump_id", F.col("id").alias("before"), "root", "pos")
        hop = past.withColumns({"root": F.lit(None).cast(ends.schema["root"].dataType), "pos": F.lit(None).cast("long")}).unionByName(ends.withColumn("_further", F.lit(None).cast(past.schema["_further"].dataType)))
        met = stored(active.filter(~odd).join(hop, ["pump_id", "before"], "left"), "chains")
        known.append(met.filter("root IS NOT NULL").select("pump_id", "id", "root", (F.col("pos") + F.lit(1 << k)).alias("pos")))
        active = met.filter("root IS NULL AND _further IS NOT NULL").select("pump_id", "step", "id", F.col("_further").alias("before"))
        k += 1
    while aside:
        k -= 1
        ends = reduce(DataFrame.unionByName, known).select("pump_id", F.col("id").alias("before"), "root", "pos")
        behind = aside.pop().join(ends, ["pump_id", "before"])
        known.append(stored(behind.select("pump_id", "id", "root", (F.col("pos") + F.lit(1 << k)).alias("pos")), "chains"))
    return reduce(DataFrame.unionByName, known)


def check_runs(runs: DataFrame, lengths: tuple[int, ...] = (12, 96, 288)) -> DataFrame:
    """One row: runs of another length, with a gap in steps, without exactly one label."""
    per = runs.groupBy("pump_id", "run_id").agg(F.count("*").alias("n"), (F.max("step") - F.min("step") + 1).alias("span"), F.count("fault_type").alias("labels"))
    return per.agg(F.count_if(~F.col("n").isin(*lengths)).alias("odd_length"), F.count_if(F.col("n") != F.col("span")).alias("with_gap"), F.count_if(F.col("labels") != 1).alias("odd_labels"))


def run_quality(runs: DataFrame, score: str, seed: int = 4) -> DataFrame:
    """Mean change of the score along runs, and along a random matching inside (pump, step), by a checksum of the row."""
    step = W.partitionBy("pump_id", "step")
    real = runs.withColumn("d", F.abs(F.col(score) - F.lag(score).over(W.partitionBy("pump_id", "run_id").orderBy("step"))))
    shuffled = runs.withColumn("_k", F.row_number().over(step.orderBy("row_pos"))).withColumn("_r", F.row_number().over(step.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "row_pos").cast("binary")))))
    other = shuffled.select("pump_id", "step", F.col("_r").alias("_k"), F.col(score).alias("_score"))
    mixed = shuffled.join(other, ["pump_id", "step", "_k"]).withColumn("d", F.abs(F.col("_score") - F.lag("_score").over(W.partitionBy("pump_id", "run_id").orderBy("step"))))
    return real.agg(F.avg("d").alias("along_runs")).crossJoin(mixed.agg(F.avg("d").alias("at_random")))


def freeze_sensor(t: DataFrame, profile: DataFrame, sensor: str) -> DataFrame:
    """A stuck sensor: its normal median everywhere."""
    return t.join(profile.select("pump_id", F.col(f"{sensor}_median").alias("_m")), "pump_id", "left").withColumn(sensor, F.coalesce("_m", F.col(sensor))).drop("_m")


def union_parts(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
