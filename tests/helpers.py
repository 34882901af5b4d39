"""Small builders for hand-made events."""

from datetime import datetime

from pyspark.sql import functions as F

from campuspulse.operators import activity


def when(text: str) -> datetime:
    return datetime.fromisoformat(text)


def events(spark, rows):
    """rows: (user_id, 'YYYY-MM-DD HH:MM', cnt)"""
    data = [(1, u, i, when(t), c) for i, (u, t, c) in enumerate(rows)]
    return spark.createDataFrame(data, "course_id long, user_id long, event_id long, ts timestamp, cnt int")


def hours(spark, rows):
    return activity.hourly(events(spark, rows), keys=activity.KEYS)


def dated(df, start="2024-01-01", end="2024-01-31"):
    return df.withColumn("start_at", F.lit(start).cast("timestamp")).withColumn("end_at", F.lit(end).cast("timestamp"))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]
