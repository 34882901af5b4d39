import math

import numpy as np
import pytest
from helpers import dated, events, hours, one
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from campuspulse.operators import access, activity, calendar, frames, sessions, weekly


def test_sessions_fixture(spark):
    rows = [(1, f"2024-01-01 {t}", 1) for t in ("10:00", "10:30", "11:30", "14:00")]
    r = one(sessions.session_features(hours(spark, rows), 2.0))
    assert r.session_count == 3
    assert (r.session_gap_min, r.session_gap_max, r.session_gap_mean) == (1.0, 2.5, 1.75)
    assert r.session_gap_std == pytest.approx(0.75)
    assert r.session_regularity == pytest.approx(1 - 0.75 / 1.75)
    assert r.sessions_per_week == 1.5
    listed = sessions.sessions(hours(spark, rows)).orderBy("session_no").collect()
    assert [x.n_events for x in listed] == [2, 1, 1]


def test_single_event_gives_zeros(spark):
    r = one(sessions.session_features(hours(spark, [(1, "2024-01-01 10:00", 1)]), 2.0))
    assert r.session_count == 0 and r.sessions_per_week == 0.0
    p = one(frames.activity_profile(dated(hours(spark, [(1, "2024-01-01 10:00", 1)]))))
    assert p.session_count == 0 and p.weekly_cv == 0.0 and p.weekly_range == 0


def test_one_inter_session_gap_is_regular(spark):
    r = one(sessions.session_features(hours(spark, [(1, "2024-01-01 10:00", 1), (1, "2024-01-01 15:00", 1)]), 1.0))
    assert (r.session_count, r.session_gap_std, r.session_regularity) == (2, 0.0, 1.0)


def test_count_expansion_passes_the_guard(spark):
    r = one(sessions.session_features(hours(spark, [(1, "2024-01-01 10:00", 3)]), 1.0))
    assert r.session_count == 1
    expanded = activity.expand_counts(events(spark, [(1, "2024-01-01 10:00", 3), (1, "2024-01-01 11:00", 0)]))
    assert expanded.count() == 3


def test_gap_buckets_match_events_for_other_thresholds(spark):
    rng = np.random.default_rng(3)
    minutes = np.sort(rng.integers(0, 60 * 24 * 6, 200))
    rows = [(1, f"2024-01-{1 + m // 1440:02d} {m % 1440 // 60:02d}:{m % 60:02d}", 1) for m in minutes]
    for gap in (0.25, 1.5):
        buckets = activity.gap_buckets(events(spark, rows), activity.KEYS, gap)
        r = one(sessions.session_features(buckets, 1.0, gap_hours=gap))
        gaps = np.diff(minutes) / 60
        assert r.session_count == 1 + (gaps >= gap).sum()
        assert r.session_gap_mean == pytest.approx(gaps[gaps >= gap].mean())


def test_event_gaps_equal_plain_lag(spark):
    rng = np.random.default_rng(5)
    rows = [(int(u), f"2024-01-{d:02d} {h:02d}:{m:02d}", 1) for u, d, h, m in
            zip(rng.integers(1, 3, 80), rng.integers(1, 4, 80), rng.integers(0, 24, 80), rng.integers(0, 60, 80))]
    e = events(spark, rows)
    got = {r.event_id: r.gap_hours for r in sessions.event_gaps(e).collect()}
    seen = {}
    for r in sorted(e.collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        want = None if r.user_id not in seen else (r.ts - seen[r.user_id]).total_seconds() / 3600
        assert got[r.event_id] == (want if want is None else pytest.approx(want))
        seen[r.user_id] = r.ts


def test_slot_tie_keeps_both_flags(spark):
    rows = [(1, f"2024-01-01 07:{i:02d}", 1) for i in range(5)] + [(1, f"2024-01-01 19:{i:02d}", 1) for i in range(5)]
    r = one(calendar.time_of_day(hours(spark, rows)))
    assert (r.dominant_time, r.is_morning_studier, r.is_evening_studier) == ("morning", 1, 1)
    assert (r.strong_morning, r.strong_evening) == (1, 0)


def test_dominant_night_fixture(spark):
    rows = [(1, "2024-01-01 07:00", 19), (1, "2024-01-01 13:00", 94), (1, "2024-01-01 20:00", 26), (1, "2024-01-01 23:00", 117)]
    assert one(calendar.time_of_day(hours(spark, rows), evening_end=22)).dominant_time == "night"


WEEKLY = [("2024-01-01 10:00", 2), ("2024-01-08 10:00", 4), ("2024-01-15 10:00", 8), ("2024-01-22 10:00", 2), ("2024-01-29 10:00", 2)]


def test_weekly_fixture(spark):
    series = weekly.weekly_series(weekly.weekly_counts(hours(spark, [(1, t, c) for t, c in WEEKLY])))
    t = one(weekly.trajectory_features(series))
    assert t.engagement_velocity == pytest.approx(-0.2)
    assert t.trend_reversals == 1
    assert t.early_engagement_ratio == pytest.approx(14 / 18)
    assert t.late_surge == pytest.approx(4 / (2 * 14 / 3))
    w = one(weekly.workload_features(series))
    assert (w.peak_count_type1, w.peak_count_type2, w.peak_count_type3, w.weekly_range) == (0, 0, 1, 6)


def test_missing_weeks_are_absent(spark):
    rows = [(1, "2024-01-01 10:00", 1), (1, "2024-01-08 10:00", 1), (1, "2024-01-29 10:00", 1)]
    series = weekly.weekly_series(weekly.weekly_counts(hours(spark, rows)))
    assert [(r.week, r.x) for r in series.orderBy("week").collect()] == [(1, 0), (2, 1), (5, 2)]


def test_weekly_decline(spark):
    series = weekly.weekly_series(weekly.weekly_counts(hours(spark, [(1, t, c) for t, c in WEEKLY])))
    assert [(r.week, r.previous_cnt, r.cnt) for r in weekly.weekly_decline(series).collect()] == [(4, 8, 2)]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(counts=st.lists(st.integers(1, 60), min_size=3, max_size=12))
def test_trajectory_matches_numpy(spark, counts):
    rows = [(1, i + 1, c) for i, c in enumerate(counts)]
    frame = spark.createDataFrame([(1, *r) for r in rows], "course_id long, user_id long, week int, cnt long")
    t = one(weekly.trajectory_features(weekly.weekly_series(frame)))
    x, y = np.arange(len(counts)), np.array(counts, float)
    assert t.engagement_velocity == pytest.approx(np.polyfit(x, y, 1)[0], abs=1e-8)
    assert t.engagement_acceleration == pytest.approx(2 * np.polyfit(x, y, 2)[0], abs=1e-7)
    assert t.weekly_cv == pytest.approx(y.std() / y.mean())
    d = np.diff(y)
    assert t.trend_reversals == (d[1:] * d[:-1] < 0).sum()


def test_dct_matches_definition(spark):
    rows = [(1, f"2024-01-0{d} {h:02d}:00", d + h) for d in range(1, 8) for h in (3, 9, 20)]
    got = one(calendar.dct_rhythm(hours(spark, rows)))
    v = np.zeros(168)
    for _, t, c in rows:
        v[(int(t[8:10]) - 1) * 24 + int(t[11:13])] += c  # 2024-01-01 is a Monday
    v /= v.sum()
    for k in range(12):
        scale = math.sqrt((1 if k == 0 else 2) / 168)
        want = scale * sum(v[i] * math.cos(math.pi * k * (2 * i + 1) / 336) for i in range(168))
        assert got[f"dct_coef_{k}"] == pytest.approx(want, abs=1e-12)
    assert got.dct_coef_0 == pytest.approx(1 / math.sqrt(168))


def test_block_shares_sum_to_one(spark):
    rows = [(1, "2024-01-01 07:00", 2), (1, "2024-01-06 13:00", 3), (1, "2024-01-07 03:00", 5)]
    r = one(calendar.block_shares(hours(spark, rows)))
    assert sum(r[f"{b}_pct"] for b in calendar.BLOCKS) == pytest.approx(1.0)
    assert r.weekend_night_pct == 0.5


def test_profile_equals_single_operators(spark):
    rng = np.random.default_rng(11)
    rows = [(int(u), f"2024-01-{d:02d} {h:02d}:{m:02d}", int(c)) for u, d, h, m, c in zip(
        rng.integers(1, 5, 300), rng.integers(1, 31, 300), rng.integers(0, 24, 300), rng.integers(0, 60, 300), rng.integers(1, 4, 300))]
    h = hours(spark, rows)
    prof = {r.user_id: r.asDict() for r in frames.activity_profile(dated(h)).collect()}
    series = weekly.weekly_series(weekly.weekly_counts(h))
    start, end = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp")
    singles = [
        sessions.session_features(h, 30 / 7), calendar.block_shares(h), calendar.block_weekly_sd(h), calendar.dct_rhythm(h),
        weekly.trajectory_features(series), weekly.workload_features(series),
        access.access_time_pct(activity.expand_counts(events(spark, rows)), start, end, activity.KEYS),
    ]
    for df in singles:
        for r in df.collect():
            for name, value in r.asDict().items():
                assert prof[r.user_id][name] == pytest.approx(value, abs=1e-9), name


def test_access_time_needs_five_events(spark):
    start, end = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp")
    four = events(spark, [(1, f"2024-01-0{i} 10:00", 1) for i in range(2, 6)])
    assert one(access.access_time_pct(four, start, end, activity.KEYS)).access_time_pct == 0.0
    five = events(spark, [(1, f"2024-01-{i:02d} 10:00", 1) for i in (1, 4, 7, 10, 13)])
    want = math.exp(np.mean(np.log([0.001, 3 / 30, 6 / 30, 9 / 30, 12 / 30])))
    assert one(access.access_time_pct(five, start, end, activity.KEYS)).access_time_pct == pytest.approx(want)
