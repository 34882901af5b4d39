"""Course windows on folded hours against a filter of the events."""

from helpers import events, when
from pyspark.sql import functions as F

from campuspulse.operators import frames

ROWS = [
    (1, "2024-01-01 10:00", 1), (1, "2024-01-01 10:29", 2), (1, "2024-01-01 10:30", 3), (1, "2024-01-01 10:59", 4), (1, "2024-01-02 08:00", 1),
    (1, "2024-01-03 09:15", 5), (1, "2024-01-03 09:16", 6), (2, "2024-01-02 01:00", 1), (2, "2023-12-31 23:59", 9), (3, "2024-01-01 10:30", 7), (4, "2024-01-02 10:00", 1),
]


def setup(spark, copies=1):
    views = events(spark, ROWS * copies).drop("course_id")
    roster = spark.createDataFrame([(7, 1), (8, 1), (7, 2), (9, 3), (5, 4)], "course_id long, user_id long")
    dates = [(7, when("2024-01-01 10:30"), when("2024-01-03 09:15")), (8, when("2024-01-01 10:30"), when("2024-01-01 10:40")), (9, when("2024-01-01 10:30"), when("2024-01-01 10:30")), (5, None, when("2024-01-05"))]
    return views, roster, spark.createDataFrame(dates, "course_id long, start_at timestamp, end_at timestamp")


def expected(views, roster, courses):
    met = views.join(roster, "user_id").join(courses, "course_id").where("ts between start_at and end_at")
    return met


def test_folded_hours_hold_the_events_of_the_window(spark):
    views, roster, courses = setup(spark)
    got = frames.hours_in_window(views, roster, courses, big=F.max("cnt"))
    assert got.columns == ["course_id", "user_id", "hour", "first_ts", "last_ts", "cnt", "big"]
    want = expected(views, roster, courses).groupBy("course_id", "user_id", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("cnt").alias("cnt"), F.max("cnt").alias("big"))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 6


def test_heavy_users_are_dealt_in_proportion(spark):
    views, roster, courses = setup(spark, 30)
    heavy = {r.user_id: r.n for r in frames.heavy_users(views, 0.25).collect()}
    assert heavy[1] == 210 and set(heavy) <= {1, 2, 3, 4}
    got = frames.in_course_window(views, roster, courses)
    columns = ["course_id", "user_id", "event_id", "ts", "cnt"]
    assert sorted(got.select(*columns).collect()) == sorted(expected(views, roster, courses).select(*columns).collect())
