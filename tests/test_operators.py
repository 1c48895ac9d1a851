"""Boundaries, refusals and random trials of single operators."""

import math
import random
from datetime import datetime, timedelta

import oracle
import pytest
from pyspark.sql import functions as F

from alarmlens.functions import steps
from alarmlens.functions import text as tx
from alarmlens.functions import time as tm
from alarmlens.operators import boosting, episodes, ingest, metrics, models, objects, serving, snapshots, telemetry
from alarmlens.plans import registry
from alarmlens.sources import journal

OBS = "event_id string, channel_id string, occurred_at timestamp_ntz, is_alarm boolean, raw_value string"
T0 = datetime(2024, 1, 1)


def at(seconds, micros=0):
    return T0 + timedelta(seconds=seconds, microseconds=micros)


def observations(spark, rows):
    return spark.createDataFrame([(str(k), c, t, a, "x") for k, (c, t, a) in enumerate(rows)], OBS)


def brute_episodes(rows, gap):
    out = []
    for channel in {c for c, _, _ in rows}:
        own = sorted((t, a) for c, t, a in rows if c == channel)
        groups = []
        for t in [t for t, a in own if a]:
            if groups and (t - groups[-1][-1]).total_seconds() <= gap:
                groups[-1].append(t)
            else:
                groups.append([t])
        for k, g in enumerate(groups):
            left = k > 0 or (g[0] - own[0][0]).total_seconds() > gap
            right = (own[-1][0] - g[-1]).total_seconds() > gap
            name = lambda known: "observed_quiet_gap" if known else "unknown"
            out.append((channel, g[0], g[-1], len(g), name(left), name(right)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_random_episodes(spark, seed):
    rng = random.Random(seed)
    gap = rng.choice([1, 60, 900])
    rows = [(rng.choice("abc"), at(rng.randint(0, 40) * gap // 2, rng.choice([0, 1])), rng.random() < 0.5) for _ in range(rng.randint(0, 69))]
    got = sorted(tuple(r) for r in episodes.build_episodes(observations(spark, rows), gap).collect())
    assert got == brute_episodes(rows, gap)


@pytest.mark.parametrize("step, micros, count", [(900, 0, 1), (900, 1, 2), (0, 0, 1)])
def test_episode_gap_is_strict(spark, step, micros, count):
    rows = [("a", at(0), True)] * 2 + [("a", at(step, micros), True)] * 2
    assert episodes.build_episodes(observations(spark, rows), 900).count() == count


@pytest.mark.parametrize("silence, found", [(3599, 0), (3600, 1), (3601, 1), (86_400, 1), (275_299, 1)])
def test_log_gaps(spark, silence, found):
    got = episodes.log_gaps(observations(spark, [("a", at(0), False), ("b", at(silence), False)]), 3600).collect()
    assert [(r.start_at, r.end_at, r.seconds_between_records) for r in got] == [(at(0, 1), at(silence), float(silence))] * found


def test_gap_over_new_year(spark):
    got = episodes.log_gaps(observations(spark, [("a", datetime(2023, 12, 31, 23), False), ("a", datetime(2024, 1, 1, 2), False)])).collect()
    assert [r.seconds_between_records for r in got] == [10_800.0]


@pytest.mark.parametrize("t, midnight", [(at(0), at(0)), (at(0, 1), at(86_400)), (at(86_400), at(86_400)), (at(86_400, 1), at(172_800))])
def test_midnight_belongs_to_its_day(spark, t, midnight):
    row = observations(spark, [("a", t, True)]).select(tm.snapshot_bucket(F.col("occurred_at")).alias("s"), tm.label_bucket(F.col("occurred_at")).alias("l")).first()
    assert (row.s, row.l) == (midnight, midnight - timedelta(days=1))


def test_local_time(spark):
    rows = [(datetime(2024, 3, 31, 2, 30), None), (datetime(2024, 10, 27, 2, 30), None), (datetime(2024, 7, 1, 12), datetime(2024, 7, 1, 10)), (datetime(2024, 10, 27, 3, 30), datetime(2024, 10, 27, 2, 30))]
    df = spark.createDataFrame(rows, "local timestamp_ntz, want timestamp_ntz")
    assert [r.got for r in df.select(tm.local_to_utc(F.col("local"), "Europe/Berlin").alias("got")).collect()] == [w for _, w in rows]


RAW = "event_id string, channel_id string, date string, time string, alarm string, value string"


def test_quarantine_reasons(spark):
    rows = [
        ("1", "c", "2024-01-02", "10:00:00", " T ", "v"), ("", "c", "2024-1-2", "10:00:00", "t", "v"), ("2", None, "2024-01-02", "10:00:00", "t", "v"),
        ("3", "c", "2024-1-2", "10:00:00", "x", "v"), ("4", "c", "2024-01-02", "25:00:00", "t", "v"), ("5", "c", "2024-02-30", "10:00:00", "t", "v"), ("6", "c", "2024-01-02", "10:00:00", "maybe", None),
    ]
    raw = spark.createDataFrame(rows, RAW)
    good, bad = ingest.normalize_quarantine(raw)
    assert [tuple(r) for r in good.collect()] == [("1", "c", datetime(2024, 1, 2, 10), True, "v")]
    assert {r.event_id: r.reason for r in bad.collect()} == {"": "missing_id", "2": "missing_id", "3": "timestamp", "4": "timestamp", "5": "timestamp", "6": "alarm"}
    with pytest.raises(Exception, match="bad row"):
        ingest.normalize_strict(raw).collect()
    assert ingest.normalize_strict(raw.limit(1)).count() == 1


def test_headers_and_tokens(spark):
    df = spark.createDataFrame([("id", "ch"), ("id", None), (None, None), ("1", "2")], "a string, b string")
    assert ingest.drop_repeated_headers(df, {"a": "id", "b": "ch"}).count() == 3
    tokens = spark.createDataFrame([(t,) for t in ("TRUE", " t", "False ", "f", "1", "", None)], "t string")
    assert [r[0] for r in tokens.select(tx.parse_bool_token(F.col("t"))).collect()] == [True, True, False, False, None, None, None]
    numbers = spark.createDataFrame([(t,) for t in ("1.5", "x", "NaN", "Infinity", None, "-3e2")], "t string")
    assert [r[0] for r in numbers.select(tx.finite_double(F.col("t"))).collect()] == [True, False, False, False, False, True]


def test_csv_scan(spark, tmp_path):
    good, ragged, other = tmp_path / "good.csv", tmp_path / "ragged.csv", tmp_path / "other.csv"
    good.write_text("﻿ID,Channel\n1,a\n2,b\n")
    ragged.write_text("ID,Channel\n1,a\n2\n")
    other.write_text("ID,Other\n1,a\n")
    columns = {"ID": "event_id", "Channel": "channel_id"}
    assert [tuple(r) for r in journal.scan_journal_csv(spark, str(good), columns).collect()] == [("1", "a"), ("2", "b")]
    with pytest.raises(Exception, match="ragged"):
        journal.scan_journal_csv(spark, str(ragged), columns).collect()
    with pytest.raises(ValueError):
        journal.scan_journal_csv(spark, str(other), columns)
    with pytest.raises(ValueError):
        journal.scan_journal_csv(spark, str(good), {"ID": "x", "Channel": "x"})


def test_sources_and_sinks(spark, tmp_path):
    obs = observations(spark, [("a", at(0), True), ("a", at(90_000), False)])
    journal.write_once(obs, str(tmp_path / "obs"))
    with pytest.raises(Exception, match="(?i)exists"):
        journal.write_once(obs, str(tmp_path / "obs"))
    assert journal.scan_observations(spark, str(tmp_path / "obs")).count() == 2
    journal.write_channel_day(obs, str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).count() == 2
    (tmp_path / "w.csv").write_text("time,t,p\n2024-01-01 00:00:00,1.5,1000\n")
    w = journal.scan_weather(spark, str(tmp_path / "w.csv"), {"time": "ts", "t": "temperature", "p": "pressure"}).first()
    assert (w.temperature, round(w.pressure, 3)) == (1.5, 750.062)
    (tmp_path / "d.csv").write_text("channel,object\n007,o1\n")
    assert journal.scan_directory(spark, str(tmp_path / "d.csv"), {"channel": "channel_id", "object": "object_id"}).first().channel_id == "007"
    (tmp_path / "t.csv").write_text("timestamp,pump_id,fault_type,s1\n2024-01-01 00:00:00,p,,2.5\n")
    assert journal.scan_telemetry(spark, str(tmp_path / "t.csv"), ["s1"]).first().s1 == 2.5


def test_future_rows_do_not_change_features(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), at(rng.randint(0, 20 * 86_400)), rng.random() < 0.3) for _ in range(300)]
    later = rows + [("a", at(20 * 86_400 + k * 3000), True) for k in range(50)]
    none = spark.createDataFrame([], "start_at timestamp_ntz, end_at timestamp_ntz")

    def features(r):
        obs = observations(spark, r)
        df = snapshots.build_examples_v2(obs, episodes.build_episodes(obs), none, "2024-01-10", "2024-01-15", short=3, long=7)
        df = df.filter(F.col("as_of") <= F.lit("2024-01-20").cast("timestamp_ntz")).drop("label", "exclusion_reason")
        return sorted(map(repr, df.collect()))

    assert features(rows) == features(later)


def test_splits_and_refusals(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 10, 20)], "as_of timestamp_ntz")
    assert [r[0] for r in df.select(snapshots.assign_split(F.col("as_of"), "2024-01-10", "2024-01-20")).collect()] == ["train", "validation", "test"]
    with pytest.raises(ValueError):
        snapshots.assign_split(F.col("as_of"), "2024-01-20", "2024-01-10")
    with pytest.raises(ValueError):
        snapshots.refuse_held_out(df, "2024-01-20")
    with pytest.raises(ValueError):
        serving.join_aligned(df, df.limit(1), ["as_of"])


def test_threshold_ties_and_empty(spark):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label int, score double")
    curve = metrics.threshold_curve(scored)
    assert [(r.threshold, r.tp, r.fp, r.positives) for r in curve.orderBy(F.desc("threshold")).collect()] == [(0.9, 1, 1, 2), (0.5, 2, 1, 2), (0.1, 2, 2, 2)]
    assert tuple(metrics.max_f1_threshold(curve).first()) == (0.5, 0.8)
    assert metrics.margin_threshold(curve, 0.9, 0.9, True).first().threshold is None
    nobody = metrics.threshold_curve(scored.filter("label = 0"))
    assert metrics.recall_at_precision(nobody, 0.5).first()[0] == 0.0
    assert metrics.ranking_metrics(nobody).first().average_precision is None
    assert metrics.confusion_at(scored.filter("false"), 0.5).first().precision == 0.0


def test_choice_of_variants(spark):
    rows = [("base", 0.1, 0.3, 0.6, 0.5, 0.70, 0.8), ("better", 0.1, 0.3, 0.7, 0.5, 0.72, 0.8), ("careless", 0.1, 0.3, 0.7, 0.5, 0.9, 0.7), ("barred", -0.1, 0.3, 0.7, 0.5, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "name string, margin double, base_rate double, f1 double, rule_f1 double, ap double, precision double")
    assert metrics.choose(df, "base").first().name == "better"


@pytest.mark.parametrize("extra", [False, True])
def test_reconstruct_runs(spark, extra):
    rng = random.Random(7)
    rows, truth = [], {}
    runs = [(rng.choice("pq"), 0 if extra else rng.randint(0, 20), rng.choice([3, 8])) for _ in range(30)]
    by_step = {}
    for k, (p, s, n) in enumerate(sorted(runs, key=lambda r: r[1])):
        for j in range(n):
            by_step.setdefault((p, s + j), []).append((s, k, j, n))
    pos = 0
    for (p, step) in sorted(by_step):
        own = sorted(by_step[p, step], key=lambda r: (r[0], r[1]))
        if extra and step % 4 == 0 and all(r[2] > 0 for r in own):
            rows.append((p, step, pos, None))
            pos += 1
        for s, k, j, n in own:
            rows.append((p, step, pos, "f" if j == n - 1 else None))
            truth[pos] = (k, j)
            pos += 1
    df = spark.createDataFrame(rows, "pump_id string, step long, row_pos long, fault_type string")
    got = {r.row_pos: (r.run_id, r.pos) for r in telemetry.reconstruct_runs(df, (3, 8), allow_extra=extra).collect()}
    assert set(got) == set(truth)
    first = {}
    for row, (k, j) in truth.items():
        if j == 0:
            first[k] = row
    assert got == {row: (first[k], j) for row, (k, j) in truth.items()}


def test_models_score_what_they_were_taught(spark):
    rng = random.Random(3)
    rows = [(k, rng.random(), rng.random() if k % 9 else None, "u" if k % 2 else "v") for k in range(600)]
    rows = [(k, a, b, t, int(a > 0.5)) for k, a, b, t in rows]
    df = spark.createDataFrame(rows, "id int, a double, b double, kind string, label int").cache()
    for fitted in (models.fit_logistic(df, ["a", "b"]), models.fit_gbt(df, ["a", "b"], trees=5, depth=3), models.MixtureOfExperts(df, ["a", "b"], "kind", trees=5, depth=3), models.fit_mlp(df, ["a", "b"], (4,))):
        scored = fitted.score(df)
        assert scored.columns == [*df.columns, "score"]
        assert metrics.ranking_metrics(metrics.threshold_curve(scored)).first().roc_auc > 0.9
    point, _, tried = models.grid_search_time(df.filter("id < 400"), df.filter("id >= 400"), ["a", "b"], [{"trees": 1, "depth": 1, "least": 500}, {"trees": 5, "depth": 3}])
    assert point["trees"] == 5
    report = models.multiclass_report(df.withColumn("prediction", F.lit(1)))
    assert {r["class"]: round(r.recall, 3) for r in report.collect()} == {0: 0.0, 1: 1.0}
    both = models.ensemble(df.withColumn("x", F.lit(0.2)).withColumn("y", F.lit(0.6)), "x", "y").first()
    assert round(both.score, 6) == 0.4
    linear = models.linear_score(df, {"a": 2.0}, -1.0).first()
    assert 0 < linear.score < 1 and models.constant_score(df, 0.3).first().score == 0.3


def test_siblings_leave_out_self_and_empty_parents(spark):
    df = spark.createDataFrame([("a", "5"), ("b", "5"), ("c", "7"), ("d", ""), ("e", "5"), ("f", None)], "object_id string, parent_id string")
    got = sorted(tuple(r) for r in objects.siblings(df).collect())
    assert got == [(x, y) for x in "abe" for y in "abe" if x != y]


def test_categories_and_grid(spark):
    """Trees on a category learn what no number tells; the grid point of best average precision is taken."""
    from alarmlens.operators import models

    kinds = ["a", "b", "c", None]
    rows = [(k, float(k % 7), kinds[k % 4], int(k % 4 == 1)) for k in range(800)]
    df = spark.createDataFrame(rows, "id long, x double, kind string, label int")
    fitted = models.CategoricalFitted(df, ["x"], ["kind"], trees=3, depth=3)
    asked = spark.createDataFrame([(9001, None, "b", 0), (9002, 1.0, "unseen", 0), (9003, 2.0, None, 0)], df.schema)
    score = {r.id: r.score for r in fitted.score(df.unionByName(asked)).collect()}
    assert all((score[k] > 0.5) == bool(y) for k, _, _, y in rows) and score[9001] > 0.5 > score[9003] and 0 <= score[9002] <= 1
    rows = [(k, float(k % 40), float((k * 7919) % 101), int(k % 40 // 10 % 2)) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, x double, noise double, label int")
    train, inner = df.filter("id % 3 > 0"), df.filter("id % 3 = 0")
    grid = [{"trees": 1, "depth": 1}, {"trees": 5, "depth": 4, "least": 1}]
    best, fitted, tried = models.grid_search_time(train, inner, ["x", "noise"], grid)
    assert len(tried) == 2 and grid[tried.index(max(tried))] == best
    assert best == grid[1] and all((r.score > 0.5) == bool(r.label) for r in fitted.score(inner).collect())


def test_days_of_the_sink_are_written_again(spark, tmp_path):
    """A second write replaces the days that it holds and no others; a day's channels are spread over files."""
    path = str(tmp_path / "days")
    obs = observations(spark, [(c, at(86_400 * day + 60), day == 1) for c in "abcdefgh" for day in range(3)])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")  # or so few rows would be put together again
    try:
        journal.write_channel_day(obs, path, spread=4)
    finally:
        spark.conf.set(key, was)
    assert len(list((tmp_path / "days").glob("year=*/date=*"))) == 3
    assert max(len(list(f.glob("*.parquet"))) for f in (tmp_path / "days").glob("year=*/date=*")) > 1
    before = {(r.channel_id, r.day): r.row_count for r in journal.read_channel_day(spark, path).collect()}
    assert set(before.values()) == {1} and len(before) == 24
    second = observations(spark, [("a", at(86_400 + 60), True), ("a", at(86_400 + 70), True), ("new", at(86_400 + 70), True)])
    for _ in range(2):  # the same again changes nothing
        journal.write_channel_day(second, path, spread=4)
        after = {(r.channel_id, r.day): r.row_count for r in journal.read_channel_day(spark, path).collect()}
        day = at(86_400)
        assert {k: v for k, v in after.items() if k[1] == day} == {("a", day): 2, ("new", day): 1}
        assert {k: v for k, v in after.items() if k[1] != day} == {k: v for k, v in before.items() if k[1] != day}
    only = journal.read_channel_day(spark, path, str(at(86_400).date()), str(at(86_400).date()))
    assert only.count() == 2 and "PartitionFilters: [isnotnull(date" in only._jdf.queryExecution().toString()


def test_missing_days_and_keys(spark):
    """Made-up holes: two days without a record; an object that is missing, one that is there twice."""
    obs = observations(spark, [("a", at(0), True), ("b", at(86_400), False), ("a", at(4 * 86_400), False)])
    assert sorted(r.day for r in ingest.missing_days(obs).collect()) == [at(2 * 86_400).replace(hour=0, minute=0, second=0), at(3 * 86_400).replace(hour=0, minute=0, second=0)]
    channels = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "9")], "channel_id string, object_id string")
    found = ingest.catalogue_report(channels, spark.createDataFrame([("1", "0"), ("1", "0"), ("2", "0")], "object_id string, parent_id string")).first()
    assert (found.repeated_channels, found.repeated_facilities, found.missing_facility) == (1, 1, 1)


def test_keys_of_all_customers(spark, tmp_path):
    """A repeated key and a missing nation among customers with a debt."""
    rows = [(1, 0, 5.0), (2, 1, -5.0), (2, 1, -6.0), (3, 7, -1.0), (4, 8, 1.0)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int").coalesce(1).write.parquet(str(tmp_path / "n"))
    for folder, name in (("c", "customer"), ("n", "nation")):
        next((tmp_path / folder).glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    found = registry.QUERIES["fk_check"](spark, str(tmp_path))
    assert found.first().asDict() == {"repeated_channels": 1, "repeated_facilities": 0, "missing_facility": 2}
    assert oracle.spark_rows(found) == oracle.duck_rows(str(tmp_path), registry.ORACLES["fk_check"])


def test_windows_are_differences_of_running_counts(spark):
    """Counts and last moments of a brute search, at the very edges too; no frame slides over an object's moments."""
    rng = random.Random(5)
    edges = [at(86_400 * 3), at(86_400 * 2), at(86_400 * 2, 1), at(86_400 * 3, 1), at(86_400 * 3 - 1, 999_999)]
    starts = [("a", x) for x in edges] + [(rng.choice("ab"), at(rng.randrange(-9 * 86_400, 6 * 86_400))) for _ in range(300)] + [(None, at(5)), ("a", None)]
    asked = [(o, at(86_400 * k)) for o in "abc" for k in range(-8, 6)] + [("a", at(86_400 * 3)), (None, at(60))]
    left = spark.createDataFrame(asked, "object_id string, as_of timestamp_ntz")
    right = spark.createDataFrame(starts, "object_id string, occurred_at timestamp_ntz")
    near = lambda o, t, low, high: sum(k == o and u is not None and low < u - t <= high for k, u in starts)
    hour = timedelta(hours=1)
    found = objects.count_in_windows(left, right, "object_id", (24, 72))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((o, t, near(o, t, -24 * hour, 0 * hour), near(o, t, -72 * hour, 0 * hour))) for o, t in asked)
    last = objects.asof_previous(left, right, "object_id")
    assert sorted(map(repr, map(tuple, last.collect()))) == sorted(repr((o, t, max((u for k, u in starts if k == o and u is not None and u <= t), default=None))) for o, t in asked)
    known, days = right.filter("object_id IS NOT NULL AND occurred_at IS NOT NULL"), left.filter("object_id IS NOT NULL").distinct()
    rows = objects.rhythm(days, known, 72)
    us = timedelta(microseconds=1)
    for r in rows.collect():
        assert (r.starts_90d, r.same_window_1w) == (near(r.object_id, r.as_of, -90 * 24 * hour, 0 * hour), near(r.object_id, r.as_of, -168 * hour - us, -96 * hour - us))
    for plan in (found, last, rows):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in text.split("windowspecdefinition(") if " _t#" in x.split("ASC")[0] and "unboundedpreceding" not in x]


def test_a_hot_channel_is_not_one_task(spark):
    """A channel with a third of all rows: its rows are dealt by day, and only its runs are ordered together."""
    rng = random.Random(8)
    rows = [("hot", at(rng.randrange(40 * 86_400)), rng.random() < 0.5) for _ in range(6000)] + [(f"c{k % 400}", at(rng.randrange(40 * 86_400)), True) for k in range(12_000)]
    got = episodes.build_episodes(observations(spark, rows), 3600)
    found = {(r.channel_id, r.first_alarm_at): (r.last_alarm_at, r.alarm_row_count) for r in got.collect()}
    want = {}
    for c in {r[0] for r in rows}:
        last = None
        for t in sorted(r[1] for r in rows if r[0] == c and r[2]):
            if last is None or (t - last).total_seconds() > 3600:
                start, n = t, 0
            last, n = t, n + 1
            want[c, start] = (last, n)
    assert found == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(channel_id" in plan and "day" in plan
    per_task = observations(spark, rows).repartition(16, "channel_id", F.to_date("occurred_at"), "is_alarm").groupBy(F.spark_partition_id()).count().select("count").collect()
    sizes = sorted(r[0] for r in per_task)
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]


def test_ranks_of_a_whole_table(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("m")).repartition(7)
    got = steps.with_rank(df, "m").collect()
    assert [r.m for r in sorted(got, key=lambda r: r["rank"])] == sorted(r.m for r in got) and sorted(r["rank"] for r in got) == list(range(1, 5001))
    assert steps.with_rank(df.limit(0), "m").count() == 0


def test_shuffled_labels_are_a_permutation(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") < 300).cast("int").alias("label"))
    rows = {r.key: r.label for r in metrics.shuffle_labels(df, [F.col("key")]).collect()}
    assert len(rows) == 3000 and sum(rows.values()) == 300
    assert 5 < sum(rows[str(k)] for k in range(300)) < 80  # 30 of the 300 are expected to stay
    assert rows != {r.key: r.label for r in metrics.shuffle_labels(df, [F.col("key")], 12).collect()}


def test_bootstrap_draws_with_replacement(spark):
    """The spread of a share over whole objects, and over rows, is that of the binomial; one object alone has none."""
    rows = [(f"o{k}", float(k % 2 == 0), 1) for k in range(400)]
    df = spark.createDataFrame(rows, "object_id string, score double, label int")
    half = 1.96 * (0.25 / 400) ** 0.5
    for got in (metrics.bootstrap(df, 0.5, "object_id", 400).first(), metrics.bootstrap_rows(df, 0.5, 400).first()):
        assert got.recall_low == pytest.approx(0.5 - half, abs=0.02) and got.recall_high == pytest.approx(0.5 + half, abs=0.02) and got.precision_low == got.precision_high == 1.0
    one = metrics.bootstrap(df.withColumn("object_id", F.lit("o")), 0.5, "object_id", 50).first()
    assert one.recall_low == one.recall_high == 0.5
    assert metrics.bootstrap(df.limit(0), 0.5, "object_id", 10).first().recall_low is None


def test_isotonic_is_the_min_max_of_means(spark):
    rng = random.Random(6)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3 + 0.4 * (k % 3 == 0))) for k in range(1500)]
    rows += [(None, 1)]
    fit = spark.createDataFrame(rows, "score double, label int").repartition(6)
    scores = sorted({s for s, _ in rows if s is not None})
    total = {s: (sum(y for x, y in rows if x == s), sum(x == s for x, _ in rows)) for s in scores}
    mean = lambda j, k: sum(total[s][0] for s in scores[j : k + 1]) / sum(total[s][1] for s in scores[j : k + 1])
    want = {s: max(min(mean(j, k) for k in range(i, len(scores))) for j in range(i + 1)) for i, s in enumerate(scores)}
    got = models.Calibration(fit).apply(spark.createDataFrame([(s,) for s in scores] + [(-1.0,), (2.0,), (None,)], "score double")).collect()
    found = {r.score: r.probability for r in got}
    assert all(found[s] == pytest.approx(want[s]) for s in scores)
    assert found[-1.0] == pytest.approx(want[scores[0]]) and found[2.0] == pytest.approx(want[scores[-1]]) and found[None] is None
    assert models.Calibration(fit.limit(0)).apply(fit).filter("probability IS NOT NULL").count() == 0


def test_first_rows_by_contraction(spark):
    """Chains of many lengths that start at any step; what is still joined halves from round to round."""
    rng = random.Random(9)
    rows, want, ident = [], {}, 0
    for pump in "pq":
        for length in [1, 2, 3, 12, 96, 288, 700, *[rng.randrange(1, 40) for _ in range(30)]]:
            start, first = rng.randrange(100), ident
            for k in range(length):
                rows.append((pump, start + k, ident, ident - 1 if k else None))
                want[pump, ident] = (first, k)
                ident += 1
    df = spark.createDataFrame(rows, "pump_id string, step long, id long, before long").repartition(4)
    assert {(r.pump_id, r.id): (r.root, r.pos) for r in telemetry.first_rows(df).collect()} == want
    assert telemetry.first_rows(df.limit(0)).count() == 0


def plain_boosting(rows, trees, leaves, rate, least):
    """Scores of trees grown leaf by leaf, every value a cut, a missing one to the better side."""
    ones = sum(y for *_, y in rows) / len(rows)
    margin = [math.log(ones / (1 - ones))] * len(rows)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - r[-1] for a, r in zip(p, rows, strict=True)], [a * (1 - a) for a in p]
        value = lambda part: sum(g[i] for i in part) ** 2 / sum(h[i] for i in part)
        parts = [list(range(len(rows)))]
        while len(parts) < leaves:
            best = None
            for k, part in enumerate(parts):
                for missing_left in (True, False):
                    for f in range(len(rows[0]) - 1):
                        for cut in sorted({rows[i][f] for i in range(len(rows)) if rows[i][f] is not None}):
                            left = [i for i in part if (missing_left if rows[i][f] is None else rows[i][f] <= cut)]
                            inside = set(left)
                            right = [i for i in part if i not in inside]
                            if min(len(left), len(right)) >= least:
                                gain = value(left) + value(right) - value(part)
                                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                    best = gain, k, left, right
            if best is None:
                break
            parts[best[1]] = best[2]
            parts.append(best[3])
        for part in parts:
            step = -rate * sum(g[i] for i in part) / sum(h[i] for i in part)
            for i in part:
                margin[i] += step
    return [1 / (1 + math.exp(-m)) for m in margin]


def test_trees_grow_leaf_by_leaf(spark):
    """Against the same trees by plain loops, missing values among the features."""
    rng = random.Random(12)
    rows = []
    for _ in range(240):
        x, z = rng.choice([None, *range(9)]), rng.choice([None, 0.5, 1.5, 2.5, 7.0])
        rows.append((x, z, int(rng.random() < (0.8 if x is None or (z or 0) > 2 else 0.1 + 0.05 * x))))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, x int, z double, label int").repartition(5)
    for leaves in (2, 6):
        model = boosting.fit_gbt(df, ["x", "z"], trees=3, leaves=leaves, rate=0.3, least=15)
        assert [len(t.values) for t in model.trees] == [leaves] * 3
        got = [r.score for r in model.score(df).orderBy("id").collect()]
        assert got == pytest.approx(plain_boosting(rows, 3, leaves, 0.3, 15), abs=1e-6)
    again = boosting.fit_gbt(df.repartition(3), ["x", "z"], trees=3, leaves=6, rate=0.3, least=15)
    assert again.trees == model.trees  # sums are of whole numbers: the order of rows makes no difference
    one_class = boosting.fit_gbt(df.filter("label = 1"), ["x", "z"], trees=2, leaves=4, least=5)
    assert all(r.score > 0.99 for r in one_class.score(df).collect())
    assert boosting.fit_gbt(df.limit(0), ["x", "z"], trees=2).score(df).count() == 240


def test_types_of_a_mixture_are_bounded(spark):
    df = spark.range(70).select(F.col("id").cast("string").alias("kind"), F.lit(1.0).alias("x"), (F.col("id") % 2).alias("label"))
    with pytest.raises(ValueError, match="more than 64"):
        models.MixtureOfExperts(df, ["x"], "kind")


def test_incidents_and_recoveries_across_midnights(spark):
    """Chains of starts that run over midnight, and what came before a start days ago, against plain loops."""
    rng = random.Random(13)
    rows = [(rng.choice("abcd"), at(60 * rng.randrange(6 * 1440)), rng.random() < 0.4) for _ in range(900)]
    obs = observations(spark, rows)
    eps = episodes.build_episodes(obs, 600)
    directory = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "C")], "channel_id string, object_id string")
    of = {"a": "A", "b": "A", "c": "C", "d": "unknown"}
    starts = brute_episodes(rows, 600)
    want = []
    for o in ("A", "C", "unknown"):
        groups = []
        for t in sorted(e[1] for e in starts if of[e[0]] == o):
            if groups and (t - groups[-1][-1]).total_seconds() <= 10800:
                groups[-1].append(t)
            else:
                groups.append([t])
        want += [(o, g[0], g[-1], len(g)) for g in groups]
    got = episodes.incidents(eps, directory, 180).collect()
    assert sorted((r.object_id, r.started_at, r.ended_at, r["size"]) for r in got) == sorted(want)
    assert any(r.started_at.date() != r.ended_at.date() for r in got)
    told = [(c, s, max((t for x, t, a in rows if x == c and a and t < s), default=None), max((t for x, t, a in rows if x == c and not a and t < s), default=None)) for c, s, *_ in starts]
    told = [(alarm, normal) for *_, alarm, normal in told if alarm is not None]
    found = episodes.recovery_stats(obs, eps).first()
    assert (found.starts, found.recovered) == (len(told), sum(normal is not None and normal > alarm for alarm, normal in told))


def test_growing_sides_are_not_broadcast(spark):
    """Channels and their days are joined by shuffles, however small their compressed files are."""
    from alarmlens.plans import core

    plan = core.scored(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "channel_id" in line]
    assert len(joins) >= 3 and all("SortMergeJoin" in line for line in joins), plan
