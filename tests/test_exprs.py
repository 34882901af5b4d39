import pytest
from helpers import one
from pyspark.sql import functions as F

from campuspulse.functions import exprs


def col(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return one(df.select(expr.alias("x"))).x


def test_parse_ts_skips_malformed(spark):
    texts = ["bad", "", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00-04:00", "2024-01-01 10:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in df.select(F.date_format(exprs.parse_ts(F.col("t")), "HH").alias("x")).collect()]
    assert got == [None, None, "10", "14", "10"]


def test_local_time_follows_daylight_saving(spark):
    df = spark.createDataFrame([("2025-07-15T14:00:00Z",), ("2025-09-15T14:00:00Z",)], "t string")
    got = [r.h for r in df.select(F.hour(exprs.to_local(exprs.parse_ts(F.col("t")), "America/Santiago")).alias("h")).collect()]
    assert got == [10, 11]


def test_slot_scales_differ_only_late_in_the_evening(spark):
    times = ["05:59", "06:00", "12:00", "18:00", "21:59", "22:00", "23:59"]
    df = spark.createDataFrame([(f"2024-01-01 {t}:00",) for t in times], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    a = [r.x for r in df.select(exprs.slot_of_day(F.col("ts"), 22).alias("x")).collect()]
    b = [r.x for r in df.select(exprs.slot_of_day(F.col("ts"), 24).alias("x")).collect()]
    assert a == ["night", "morning", "afternoon", "evening", "evening", "night", "night"]
    assert b == ["night", "morning", "afternoon", "evening", "evening", "evening", "evening"]


def test_url_parsing(spark):
    df = spark.createDataFrame([("/courses/86/files/1",), ("/courses/860",), ("/about",)], "url string")
    ids = [r.x for r in df.select(exprs.course_id_from_url(F.col("url")).alias("x")).collect()]
    assert ids == [86, 860, None]
    loose = [r.x for r in df.select(exprs.url_in_course(F.col("url"), F.lit(86)).alias("x")).collect()]
    assert loose == [True, True, False]
    assert [r.x for r in df.select(exprs.is_resource_url(F.col("url")).alias("x")).collect()] == [True, False, False]


@pytest.mark.parametrize(
    "score, keep, fail", [(None, None, 1), (0.0, 1, 1), (56.99, 1, 1), (57.0, 0, 0), (100.0, 0, 0)]
)
def test_failed_null_policies(spark, score, keep, fail):
    value = F.lit(score).cast("double")
    assert col(spark, exprs.failed(value)) == keep
    assert col(spark, exprs.failed(value, "fail")) == fail


def test_valid_grade_bounds(spark):
    df = spark.createDataFrame([(None,), (0.0,), (56.99,), (57.0,), (100.0,), (101.0,)], "s double")
    assert [r.s for r in df.where(exprs.valid_grade(F.col("s"))).collect()] == [56.99, 57.0, 100.0]


def test_risk_bins_are_right_closed(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.3, 0.300001, 0.5, 0.7, 1.0)], "p double")
    got = [r.x for r in df.select(exprs.risk_level(F.col("p")).alias("x")).collect()]
    assert got == [None, "Low", "Medium", "Medium", "High", "Critical"]


def test_days_floor_then_clamp(spark):
    early, start = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert col(spark, exprs.floor_days(early, start)) == -1
    assert col(spark, exprs.days_since(early, start)) == 0


def test_course_defaults(spark):
    none = F.lit(None).cast("timestamp")
    as_of = F.lit("2024-05-01 00:00:00").cast("timestamp")
    start, end = exprs.course_window(none, none, none, as_of)
    assert str(col(spark, start.cast("string"))) == "2024-01-02 00:00:00"
    assert str(col(spark, end.cast("string"))) == "2024-05-01 00:00:00"
    assert col(spark, exprs.course_weeks(none, none)) == 15.0
    assert col(spark, exprs.course_weeks(as_of, as_of)) == 1.0
    assert col(spark, exprs.course_days(as_of, as_of)) == 120


def test_submission_status(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-02"), (None, "2024-01-02"), ("2024-01-01", None)], "s string, d string"
    ).select(F.col("s").cast("timestamp").alias("s"), F.col("d").cast("timestamp").alias("d"))
    got = [r.x for r in df.select(exprs.submission_status(F.col("s"), F.col("d")).alias("x")).collect()]
    assert got == ["on_time", "late", "missing", "floating"]


def test_roles_ratios_labels(spark):
    assert col(spark, exprs.role_of(F.lit("TeacherEnrollment"))) == "teacher"
    assert col(spark, exprs.role_of(F.lit("TaEnrollment"))) == "ta"
    assert col(spark, exprs.role_of(F.lit("StudentEnrollment"))) == "other"
    assert col(spark, exprs.safe_ratio(F.lit(1), F.lit(0))) == 0.0
    assert col(spark, exprs.ratio_or_null(F.lit(1), F.lit(0))) is None
    assert col(spark, exprs.shorten(F.lit("x" * 31))) == "x" * 30 + "..."
    assert col(spark, exprs.shorten(F.lit("x" * 30))) == "x" * 30
    assert col(spark, exprs.stars(F.lit(0.005))) == "**"
    assert col(spark, exprs.name_matches(F.lit("Prueba SUMATIVA 1"), "sumativa")) is True
    score = exprs.engagement_composite(F.lit(3), F.lit(2), F.lit(0.5), F.lit(None).cast("double"))
    assert col(spark, score) == pytest.approx(25 * (0.9 + 0.6 + 0.1 + 0.2))


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, (3.0, "a"))], "course_id int, x_norm int, g struct<s:double,t:string>")
    assert exprs.flatten_struct(df, "g", "grade_").columns == ["course_id", "x_norm", "grade_s", "grade_t"]
    assert exprs.available(df, ["g", "nope"]) == ["g"]
    assert exprs.feature_columns(df) == ["g"]
