"""Streaming jobs run over the event file; the SQL twin lists what the watermark must have closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from campuspulse.plans import inputs
from campuspulse.plans.registry import add_cte, query
from campuspulse.session import run_dir
from campuspulse.sources import tables
from campuspulse.streaming import jobs


def clicks(spark, d):
    schema = tables.table(spark, d, "events").schema
    return jobs.click_stream(jobs.file_stream(spark, d, schema, "events.parquet"))


# Spark keeps watermarks in whole milliseconds.
add_cte("wm", "SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR AS mark FROM events", [])


def _sessions(gap: str) -> str:
    return f"""SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events FROM (
        SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, no
        HAVING max(ts) + INTERVAL {gap} <= (SELECT mark FROM wm)"""


@query("stream_sessions", "wm", _sessions("1 HOUR"))
def stream_sessions(spark, d):
    return jobs.collect_available(jobs.live_sessions(clicks(spark, d)), "stream-sessions")


@query("stream_alerts", "wm", f"SELECT user_id, ended_at AS last_seen, n_events AS events_before FROM ({_sessions('24 HOUR')})")
def stream_alerts(spark, d):
    """Silences of 24 hours, which the 30 days of events contain often enough to compare."""
    return jobs.collect_available(jobs.inactivity_alerts(clicks(spark, d), "24 hours"), "stream-alerts")


@query("stream_alerts_72h", "wm", f"SELECT user_id, ended_at AS last_seen, n_events AS events_before FROM ({_sessions('72 HOUR')})")
def stream_alerts_72h(spark, d):
    return jobs.collect_available(jobs.inactivity_alerts(clicks(spark, d), "72 hours"), "stream-alerts-72h")


@query("stream_trending", "wm", """
    SELECT start AS window_start, start + INTERVAL 24 HOUR AS window_end, resource_id, count(*) AS views FROM (
        SELECT date_trunc('hour', ts) - to_hours(i) AS start, CAST(json_extract_string(props, '$.k') AS INTEGER) AS resource_id
        FROM events, (SELECT CAST(i AS INTEGER) AS i FROM range(24) t(i))) GROUP BY ALL
    HAVING start + INTERVAL 24 HOUR <= (SELECT mark FROM wm)""")
def stream_trending(spark, d):
    return jobs.collect_available(jobs.trending(clicks(spark, d)), "stream-trending")


@query("stream_hourly", "enr wm", """
    SELECT course_id, hour, count(*) AS cnt FROM (SELECT course_id, date_trunc('hour', ts) AS hour FROM events JOIN enr USING (user_id))
    WHERE hour + INTERVAL 1 HOUR <= (SELECT mark FROM wm) GROUP BY course_id, hour""")
def stream_hourly(spark, d):
    return jobs.collect_available(jobs.hourly_feed(clicks(spark, d), inputs.members(spark, d)), "stream-hourly")


@query("stream_ingest", "", "SELECT event_id, user_id, ts, event_type AS kind FROM events")
def stream_ingest(spark, d):
    return jobs.collect_available(jobs.deduplicated(clicks(spark, d)), "stream-ingest").select("event_id", "user_id", "ts", "kind")


@query("stream_rescore", "", """SELECT user_id, count(DISTINCT date_trunc('hour', ts)) AS active_hours, max(ts) AS last_ts,
    CASE WHEN count(DISTINCT date_trunc('hour', ts)) < 10 THEN 1 ELSE 0 END AS alert_few_hours FROM events GROUP BY ALL""")
def stream_rescore(spark, d):
    """Active hours from keyed state: no stored batch is read again."""
    return rescored(spark, d, 72.0).select("user_id", "active_hours", "last_ts", "alert_few_hours")


def rescored(spark, d, idle_hours):
    base = run_dir(spark, "stream-rescore")
    jobs.rescore_alerts(clicks(spark, d), f"{base}/alerts", f"{base}/checkpoint", idle_hours=idle_hours)
    return jobs.latest_alerts(spark, f"{base}/alerts")


@query("stream_idle_timers", "wm", """SELECT user_id, max(ts) AS last_ts, count(DISTINCT date_trunc('hour', ts)) AS active_hours FROM events GROUP BY ALL
    HAVING date_trunc('milliseconds', max(ts)) + INTERVAL 24 HOUR <= (SELECT mark FROM wm)""")
def stream_idle_timers(spark, d):
    """Students whose timer of 24 silent hours has fired and who have not come back."""
    return rescored(spark, d, 24.0).where("alert_inactive = 1").select("user_id", "last_ts", "active_hours")
