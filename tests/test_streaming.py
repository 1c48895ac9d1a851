"""Streams with all data available give what batches give."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alarmlens.operators import episodes, serving
from alarmlens.sources import journal
from alarmlens.streaming import operators as so
from alarmlens.streaming import risks as rk
from alarmlens.streaming.run import run_available, run_into

T0 = datetime(2024, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    """Observations in several files, shuffled within an hour; the last row closes everything."""
    rng = random.Random(1)
    rows = [(f"e{k}", rng.choice("abc"), T0 + timedelta(seconds=rng.randint(0, 4 * 86_400)), rng.random() < 0.4, "x") for k in range(400)]
    rows.sort(key=lambda r: (r[2] + timedelta(seconds=rng.randint(0, 1500))))
    rows += [("end", "z", T0 + timedelta(days=30), False, "x"), ("end2", "z", T0 + timedelta(days=31), False, "x")]
    for k in range(0, len(rows), 100):
        spark.createDataFrame(rows[k : k + 100], journal.OBSERVATION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path


def run(df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    query.stop()
    return df.sparkSession.table(name)


def test_daily_counts(spark, folder):
    batch = spark.read.parquet(str(folder / "in")).filter("channel_id <> 'z'")
    want = {(r.channel_id, r.day, r.row_count, r.alarm_count) for r in journal.channel_day(batch).collect()}
    got = run(so.stream_daily_counts(journal.stream_observations(spark, str(folder / "in"), files_per_trigger=10), "10 days"), folder, "daily_counts")
    assert {(r.channel_id, r.day, r.row_count, r.alarm_count) for r in got.filter("channel_id <> 'z'").collect()} == want


def test_trailing_counts(spark, folder):
    got = run(so.stream_trailing_counts(journal.stream_observations(spark, str(folder / "in"), files_per_trigger=10), "2 days", "1 day", "10 days"), folder, "trailing_counts")
    rows = spark.read.parquet(str(folder / "in")).filter("channel_id <> 'z'").collect()
    for r in got.filter("channel_id <> 'z'").collect():
        own = [x for x in rows if x.channel_id == r.channel_id and r.as_of - timedelta(days=2) <= x.occurred_at < r.as_of]
        assert (r.event_count, r.alarm_count) == (len(own), sum(x.is_alarm for x in own))


def test_dedupe(spark, folder):
    stream = journal.stream_observations(spark, str(folder / "in"), files_per_trigger=10)
    got = run(so.stream_dedupe(stream.union(stream), delay="60 days"), folder, "deduped")
    assert got.count() == spark.read.parquet(str(folder / "in")).distinct().count()


@pytest.mark.parametrize("form", ["sessions", "states"])
def test_episodes(spark, folder, form):
    batch = spark.read.parquet(str(folder / "in")).filter("channel_id <> 'z'")
    stream = journal.stream_observations(spark, str(folder / "in"), files_per_trigger=10)
    make = so.stream_session_episodes if form == "sessions" else so.stream_episodes
    got = run(make(stream, 900, "10 days"), folder, f"episodes_{form}")
    columns = ["channel_id", "first_alarm_at", "last_alarm_at", "alarm_row_count"] + ["left_boundary"] * (form == "states")
    rows = lambda df: sorted(tuple(str(v) for v in r) for r in df.select(*columns).filter("channel_id <> 'z'").collect())
    assert rows(got) == rows(episodes.build_episodes(batch, 900))
    if form == "states":
        assert {r.right_boundary for r in got.collect()} == {"observed_quiet_gap"}


def test_normalize(spark, tmp_path):
    raw = [("1", "c", "2024-01-02", "10:00:00", "t", "v"), ("2", "c", "2024-1-2", "10:00:00", "t", "v")]
    schema = "event_id string, channel_id string, date string, time string, alarm string, value string"
    spark.createDataFrame(raw, schema).write.parquet(str(tmp_path / "raw"))
    good, bad = so.stream_normalize(spark.readStream.schema(schema).parquet(str(tmp_path / "raw")))
    assert run(good, tmp_path, "good").count() == 1
    assert [r.reason for r in run(bad, tmp_path, "bad").collect()] == ["timestamp"]


def test_rejects_have_a_sink(spark, tmp_path):
    """Both kinds of rows of several batches, the last of which runs twice."""
    schema = "event_id string, channel_id string, date string, time string, alarm string, value string"
    rows = [("1", " c ", "2024-01-02", "10:00:00", "t", "v"), ("", "c", "2024-01-02", "10:00:00", "t", "v"), ("3", "c", "2024-1-2", "10:00:00", "t", None), ("4", "c", "2024-01-02", "10:00:00", "maybe", "v"), (None, None, None, None, None, None)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
    keep = so.normalize_into(str(tmp_path / "out"))
    again = lambda batch, epoch: [keep(batch, epoch) for _ in range(2)]
    run_into(journal.stream_observations(spark, str(tmp_path / "raw"), schema, 2), again)
    good = so.kept_observations(spark, str(tmp_path / "out")).collect()
    assert [tuple(r) for r in good] == [("1", "c", datetime(2024, 1, 2, 10), True, "v")]
    bad = so.rejected_rows(spark, str(tmp_path / "out")).collect()
    assert sorted((str(r.event_id), r.value, r.reason) for r in bad) == [("", "v", "missing_id"), ("3", None, "timestamp"), ("4", "v", "alarm"), ("None", None, "missing_id")]


def test_a_silence_is_told_while_it_lasts(spark, tmp_path):
    """The input stops and the alarm comes, once; records come again and that is told; then silence again."""
    def send(k: int) -> datetime:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        spark.createDataFrame([(f"e{k}", "c", now - timedelta(hours=k), False, "x"), (f"f{k}", "c", now, False, "x"), (f"g{k}", "c", None, False, "x")], journal.OBSERVATION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return now

    def told(n: int) -> list:
        for _ in range(600):
            rows = spark.read.schema(schema).parquet(out).orderBy("noticed_at").collect() if (tmp_path / "out").exists() else []
            if len(rows) >= n:
                return rows
            time.sleep(0.1)
        raise AssertionError("nothing was told")

    out, first = str(tmp_path / "out"), send(1)
    stream = so.stream_gap_monitor(journal.stream_observations(spark, str(tmp_path / "in")), 6)
    schema = stream.schema
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").foreachBatch(lambda df, epoch: df.write.mode("append").parquet(out)).start()
    try:
        rows = told(1)
        assert [(r.kind, r.last_at) for r in rows] == [("stale", first)] and rows[0].noticed_at - first > timedelta(seconds=6)
        time.sleep(2)
        assert len(told(1)) == 1  # once
        second = send(2)
        assert [(r.kind, r.last_at) for r in told(3)] == [("stale", first), ("resumed", second), ("stale", second)]
    finally:
        query.stop()


def test_run_available_outlasts_a_limit(spark, folder, monkeypatch):
    """A stream longer than any limit gives all its rows; here a limit is over at once."""
    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: wait(self, timeout and 0.001))
    got = run_available(journal.stream_observations(spark, str(folder / "in"), files_per_trigger=1))
    assert got.count() == spark.read.parquet(str(folder / "in")).count() == 402


def features_of(spark, rows, folder, slices, **how):
    """Streamed features over ``rows`` that come in ``slices`` by time, as {(channel, t): row}."""
    rows = sorted(rows, key=lambda r: r[2])
    for k in range(slices):
        part = rows[k * len(rows) // slices : (k + 1) * len(rows) // slices]
        spark.createDataFrame(part, journal.OBSERVATION).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    got = []
    run_into(rk.stream_features(journal.stream_observations(spark, f"{folder}/in"), **how), lambda df, epoch: got.extend(df.collect()))
    assert len({(r.channel_id, r.t) for r in got}) == len(got)
    return {(r.channel_id, r.t): r.asDict() for r in got}


@pytest.mark.parametrize("slices", [1, 5])
def test_features_from_state(spark, tmp_path, slices):
    """The features that a batch job finds in the whole journal, at the moments at which the stream scored."""
    rng = random.Random(slices)
    moment = lambda: T0 + timedelta(microseconds=rng.choice([rng.randrange(20 * 86_400_000_000), rng.randrange(200) * 3_600_000_000]))
    rows = [(f"e{k}", rng.choice("aabc"), moment(), rng.random() < 0.3, "x") for k in range(1500)]
    rows += [(f"h{k}", "hot", T0 + timedelta(seconds=37 * k), k % 5 == 0, "x") for k in range(3000)]
    got = features_of(spark, rows, str(tmp_path), slices, gap_seconds=5000, short=2, long=7)
    assert len({t for _, t in got}) == slices
    history = spark.createDataFrame(rows, journal.OBSERVATION)
    moments = spark.createDataFrame(list(got), "channel_id string, t timestamp_ntz")
    gaps = spark.createDataFrame([], "start_at timestamp_ntz, end_at timestamp_ntz")
    want = serving.features_at(history, moments, gaps, 5000, 2, 7).drop("log_gap_hours_7d").collect()
    names = [c for c in want[0].asDict() if c not in ("channel_id", "t")]
    within = {k for k, r in got.items() if r["event_count_7d"]}
    assert {(r.channel_id, r.t) for r in want} == within
    for r in want:
        mine = got[r.channel_id, r.t]
        assert [mine[c] == pytest.approx(r[c]) if r[c] is not None else mine[c] is None for c in names] == [True] * len(names), (r, mine)


def test_risk_job(spark, tmp_path):
    """Refused channels and objects with an open risk get none; a batch that runs again changes nothing."""
    day = timedelta(days=1)
    rows = [(f"{c}{k}", c, T0 - k * day - timedelta(hours=2), c == "bad" and 0 < k < 4, "v") for c in ("bad", "calm", "shut") for k in range(9)]
    rows += [("n", "new", T0 - timedelta(hours=2), True, "v"), ("last", "calm", T0, False, "v"), ("x", "shut", T0 - timedelta(minutes=5), True, "v")]
    directory = spark.createDataFrame([("bad", "A"), ("calm", "B"), ("new", "C"), ("shut", "D")], "channel_id string, object_id string")
    far, near = ("2023-01-01 00:00:00", "2023-01-02 00:00:00"), ("2023-12-31 10:00:00", "2023-12-31 11:00:00")
    gaps = lambda *g: spark.createDataFrame(list(g), "a string, b string").selectExpr("CAST(a AS timestamp_ntz) AS start_at", "CAST(b AS timestamp_ntz) AS end_at")
    spark.createDataFrame(rows, journal.OBSERVATION).coalesce(1).write.parquet(str(tmp_path / "in"))
    batches = []
    run_into(rk.stream_features(journal.stream_observations(spark, str(tmp_path / "in")), 900, 7, 8), lambda df, epoch: batches.append(spark.createDataFrame(df.collect(), df.schema)))
    scored = next(b for b in batches if b.count())
    t = scored.first().t
    assert T0 <= t < T0 + timedelta(milliseconds=1)
    path = str(tmp_path / "risks")
    job = rk.risk_job(directory, gaps(far), {"alarm_count_7d": 1.0}, -2.0, path, gap_seconds=900, long=8)
    assert rk.open_risks(spark, path).count() == 0
    for epoch in (0, 0, 1):
        job(scored, epoch)
        assert [(r.object_id, r.opened_at, r.window_end, r.epoch) for r in rk.open_risks(spark, path).collect()] == [("A", t, t + day, 0)]
    job(scored.limit(0), 2)
    assert rk.open_risks(spark, path).count() == 1
    folders = len(list((tmp_path / "risks").rglob("epoch=*")))
    assert folders == 1  # batches that open nothing leave nothing
    later = scored.withColumn("t", F.col("t") + F.expr("INTERVAL 2 DAYS")).withColumn("last_at", F.col("t"))
    job(later, 3)
    assert sorted((r.object_id, r.epoch) for r in rk.open_risks(spark, path).collect()) == [("A", 0), ("A", 3)]
    for how in ({"gaps": gaps(near)}, {"gaps": gaps(far), "since": "2023-12-30 00:00:00"}):
        rk.risk_job(directory, how.pop("gaps"), {"alarm_count_7d": 1.0}, -2.0, f"{path}-refused", gap_seconds=900, long=8, **how)(scored, 0)
        assert rk.open_risks(spark, f"{path}-refused").count() == 0


class Kept:
    """State in memory that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("getValueState", "getMapState"):
                return self
            if name == "get":
                return self.value
            if name == "update":
                self.value = args[0]
            if name in ("registerTimer", "deleteTimer"):
                (self.timers.add if name == "registerTimer" else self.timers.discard)(args[0])
            if name == "containsKey":
                return args[0] in self.map
            if name == "getValue":
                return self.map[args[0]]
            if name == "updateValue":
                self.map[args[0]] = args[1]
            if name == "removeKey":
                del self.map[args[0]]
            return list(self.map) if name == "keys" else None

        return call


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


@pytest.mark.parametrize("module, make", [(so, lambda: so.EpisodeProcessor(7200)), (rk, lambda: rk.ChannelFeatures(7200, 3, 7))])
def test_few_calls_for_a_small_channel(monkeypatch, module, make):
    """What is kept in one piece and what is spread over hours give the same; the first takes a few calls a batch."""
    rng = random.Random(11)
    days = [[Row(at_us=1_704_067_200_000_000 + rng.randrange(d * 86_400_000, (d + 2) * 86_400_000) * 1000, alarm=rng.random() < 0.4) for _ in range(60)] for d in range(12)]
    told, calls = [], []
    for small in (4096, 100, 7):
        monkeypatch.setattr(module, "SMALL", small)
        one, kept, found, mark = make(), Kept(), [], 0
        one.init(kept)
        kept.calls = 0
        for rows in [*days, []]:
            before = kept.calls
            if rows:
                found += list(one.handleInputRows(("a",), iter(rows), Clock(mark)))
                mark = max(r.at_us for r in rows) // 1000 - 3_600_000
            else:
                mark += 10 * 86_400_000
            for due in sorted(t for t in kept.timers if t <= mark):
                kept.timers.discard(due)
                found += list(one.handleExpiredTimer(("a",), Clock(mark), None))
            calls.append((small, kept.calls - before))
        told.append(found)
    assert told[0] and told[0] == told[1] == told[2]
    assert max(n for small, n in calls if small == 4096) <= 12 < max(n for small, n in calls if small == 7)
