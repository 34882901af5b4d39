"""Streams against their batch twins on the same files."""

import pandas as pd
from helpers import when

from campuspulse.operators import activity, sessions
from campuspulse.sources import tables
from campuspulse.streaming import jobs

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def arrive(spark, folder, name, rows):
    data = [(i, when(t), u, "view", 1.0, '{"k": 5}') for i, u, t in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("overwrite").parquet(str(folder / name))


def stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return jobs.click_stream(jobs.file_stream(spark, str(folder / "*"), schema, "part-*", files_per_batch=1))


def test_closed_sessions_equal_batch(spark, sf):
    schema = tables.table(spark, sf, "events").schema
    live = jobs.collect_available(jobs.live_sessions(jobs.click_stream(jobs.file_stream(spark, sf, schema, "events.parquet"))), "t")
    batch = sessions.sessions(activity.hourly(tables.activity(spark, sf)), ["user_id"])
    closed = {tuple(r) for r in live.select("user_id", "started_at", "ended_at", "n_events").collect()}
    every = {tuple(r) for r in batch.select("user_id", "started_at", "ended_at", "n_events").collect()}
    assert closed <= every and len(every) - len(closed) < 10


def test_ingest_drops_duplicates_and_resumes(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    arrive(spark, src, "a", [(1, 1, "2024-01-01 10:00"), (2, 1, "2024-01-01 10:05"), (1, 1, "2024-01-01 10:00")])
    jobs.run_available(jobs.deduplicated(stream(spark, src)), out, ck)
    assert spark.read.parquet(out).count() == 2
    arrive(spark, src, "b", [(2, 1, "2024-01-01 10:05"), (3, 1, "2024-01-01 10:30")])
    jobs.run_available(jobs.deduplicated(stream(spark, src)), out, ck)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_inactivity_fires_once_the_silence_is_certain(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    arrive(spark, src, "a", [(1, 1, "2024-01-01 10:00"), (2, 2, "2024-01-01 11:00")])
    jobs.run_available(jobs.inactivity_alerts(stream(spark, src)), out, ck)
    assert spark.read.parquet(out).count() == 0
    arrive(spark, src, "b", [(3, 2, "2024-01-04 09:00"), (4, 2, "2024-01-04 13:00")])
    jobs.run_available(jobs.inactivity_alerts(stream(spark, src)), out, ck)
    got = spark.read.parquet(out).collect()
    assert [(r.user_id, r.last_seen) for r in got] == [(1, when("2024-01-01 10:00"))]


def test_late_events_are_dropped(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    arrive(spark, src, "a", [(1, 1, "2024-01-02 10:00")])
    jobs.run_available(jobs.live_sessions(stream(spark, src)), out, ck)
    arrive(spark, src, "b", [(2, 1, "2024-01-01 10:00"), (3, 1, "2024-01-03 10:00")])
    jobs.run_available(jobs.live_sessions(stream(spark, src)), out, ck)
    assert [(r.started_at, r.n_events) for r in spark.read.parquet(out).collect()] == [(when("2024-01-02 10:00"), 1)]


def test_rescoring_keeps_state_over_restarts_and_fires_timers(spark, tmp_path):
    src, base = tmp_path / "in", tmp_path / "state"
    args = (str(base / "alerts"), str(base / "ck"))
    arrive(spark, src, "a", [(1, 1, "2024-01-01 10:00"), (2, 2, "2024-01-01 10:00"), (3, 1, "2024-01-01 10:20")])
    jobs.rescore_alerts(stream(spark, src), *args, min_hours=2, idle_hours=24)
    first = {r.user_id: (r.active_hours, r.alert_few_hours, r.alert_inactive) for r in jobs.latest_alerts(spark, args[0]).collect()}
    assert first == {1: (1, 1, 0), 2: (1, 1, 0)}
    arrive(spark, src, "b", [(4, 1, "2024-01-01 12:00"), (5, 1, "2024-01-01 10:40")])
    jobs.rescore_alerts(stream(spark, src), *args, min_hours=2, idle_hours=24)
    arrive(spark, src, "c", [(6, 1, "2024-01-02 13:00")])
    jobs.rescore_alerts(stream(spark, src), *args, min_hours=2, idle_hours=24)
    got = {r.user_id: (r.active_hours, r.last_ts, r.alert_few_hours, r.alert_inactive) for r in jobs.latest_alerts(spark, args[0]).collect()}
    assert got == {1: (3, when("2024-01-02 13:00"), 0, 0), 2: (1, when("2024-01-01 10:00"), 1, 1)}
    # Each batch wrote rows of its own students only.
    rows = spark.read.parquet(args[0]).where("user_id = 2").collect()
    assert sorted(r.alert_inactive for r in rows) == [0, 1]


def test_trending_counts_slide(spark, tmp_path):
    src = tmp_path / "in"
    arrive(spark, src, "a", [(1, 1, "2024-01-01 10:10"), (2, 1, "2024-01-01 11:10"), (3, 1, "2024-01-03 11:10")])
    got = jobs.collect_available(jobs.trending(stream(spark, src), "2 hours", "1 hour"), "t").orderBy("window_start").collect()
    assert [(r.window_start, r.views) for r in got] == [(when("2024-01-01 09:00"), 1), (when("2024-01-01 10:00"), 2), (when("2024-01-01 11:00"), 1)]


class Calls:
    """A state variable or handle in memory that counts its calls."""

    def __init__(self):
        self.kept, self.value, self.timers, self.calls = {}, None, [], 0

    def getMapState(self, *a):
        return self

    def getValueState(self, *a):
        return Single(self)

    def containsKey(self, key):
        self.calls += 1
        return key in self.kept

    def getValue(self, key):
        self.calls += 1
        return self.kept[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.kept[key] = value

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class Single:
    def __init__(self, calls):
        self.all = calls

    def exists(self):
        self.all.calls += 1
        return self.all.value is not None

    def get(self):
        self.all.calls += 1
        return self.all.value

    def update(self, value):
        self.all.calls += 1
        self.all.value = value


def test_state_calls_do_not_grow_with_the_hours_of_a_batch():
    state, handle = jobs.ActivityState(10, 24.0), Calls()
    state.init(handle)
    batch = lambda hours: iter([pd.DataFrame({"hour": hours, "us": [h * 3_600_000_000 for h in hours]})])
    out = list(state.handleInputRows((7,), batch([*range(1000, 1200), 1000, -5]), None))
    assert out[0].active_hours[0] == 201 and out[0].last_us[0] == 1199 * 3_600_000_000 and handle.calls < 10
    out = list(state.handleInputRows((7,), batch([-5, -6, 1100, 5000, 1024]), None))
    assert out[0].active_hours[0] == 203 and out[0].last_us[0] == 5000 * 3_600_000_000 and len(handle.timers) == 1
    assert out[0].alert_few_hours[0] == 0 and handle.calls < 30
