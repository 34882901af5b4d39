"""Readers for the platform's record files. All schemas are declared, none inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from campuspulse import schemas
from campuspulse.functions.exprs import parse_ts
from campuspulse.sources import bundles


def _json(spark: SparkSession, path: str, schema: StructType, multiline: bool) -> DataFrame:
    """JSON lines split across tasks; ``multiline`` is for files holding one array each."""
    return spark.read.schema(schema).json(path, multiLine=multiline)


def _as_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: parse_ts(F.col(c)) for c in columns})


def read_courses(spark, path, multiline=False) -> DataFrame:
    return _as_time(_json(spark, path, schemas.COURSE, multiline), "start_at", "end_at", "created_at")


def read_enrollments(spark, path, multiline=False) -> DataFrame:
    """Enrollments with the nested grades lifted to the top level."""
    df = _json(spark, path, schemas.ENROLLMENT, multiline)
    return _as_time(
        df.select(
            "course_id", "user_id", "type", "enrollment_state",
            F.coalesce("total_activity_time", F.lit(0)).alias("total_activity_time"),
            "last_activity_at", "grades.*",
        ),
        "last_activity_at",
    )


def read_summaries(spark, path, multiline=False) -> DataFrame:
    """Student summaries; absent counts become zero."""
    df = _json(spark, path, schemas.STUDENT_SUMMARY, multiline)
    counts = ["page_views", "page_views_level", "participations", "participations_level"]
    return df.select(
        "course_id", F.col("id").alias("user_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        *[
            F.coalesce(f"tardiness_breakdown.{c}", F.lit(0)).alias(c)
            for c in schemas.TARDINESS.names
        ],
    )


def read_submissions(spark, path, multiline=False) -> DataFrame:
    return _as_time(_json(spark, path, schemas.SUBMISSION, multiline), "submitted_at", "graded_at")


def read_assignments(spark, path, multiline=False) -> DataFrame:
    return _as_time(_json(spark, path, schemas.ASSIGNMENT, multiline), "due_at")


def explode_hourly(df: DataFrame) -> DataFrame:
    """Hourly map to event rows (course_id, user_id, ts, cnt); bad keys and counts <= 0 go."""
    return (
        df.select("course_id", "user_id", F.explode("page_views").alias("key", "cnt"))
        .select("course_id", "user_id", parse_ts(F.col("key")).alias("ts"), "cnt")
        .where("ts is not null and cnt > 0")
    )


def read_hourly_activity(spark, path, multiline=False) -> DataFrame:
    return explode_hourly(_json(spark, path, schemas.HOURLY_ACTIVITY, multiline))


def read_participations(spark, path, multiline=False) -> DataFrame:
    df = _json(spark, path, schemas.HOURLY_ACTIVITY, multiline)
    return _as_time(
        df.select("course_id", "user_id", F.explode("participations").alias("p"))
        .select("course_id", "user_id", "p.created_at", "p.url"),
        "created_at",
    )


def read_page_views(spark, path) -> DataFrame:
    """A folder of parquet files, one or more per student, read as one table."""
    return spark.read.schema(schemas.PAGE_VIEW).parquet(path)


def read_module_progress(spark, path, fmt="json", multiline=False) -> DataFrame:
    if fmt == "csv":
        df = spark.read.schema(schemas.MODULE_PROGRESS).csv(path, header=True)
    else:
        df = _json(spark, path, schemas.MODULE_PROGRESS, multiline)
    return _as_time(df, "completed_at")


def read_features_csv(spark, path, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_hour_matrix(spark, path, block_bytes: int = bundles.BLOCK_BYTES) -> DataFrame:
    """``{course: 7 x 24 matrix}`` documents as (course_id, dow, hour, cnt) rows; one document is read by many tasks."""
    entries = bundles.named_values(bundles.blocks(spark, path, block_bytes), block_bytes)
    rows = bundles.parsed(entries, None, schemas.HOUR_MATRIX.valueType).where("r is not null")
    return (
        rows.select(F.col("field").cast("long").alias("course_id"), F.posexplode("r").alias("dow", "hours"))
        .select("course_id", "dow", F.posexplode("hours").alias("hour", "cnt"))
    )


def hour_matrix_rows(texts: DataFrame) -> DataFrame:
    """Matrix documents in the column ``value`` as (course_id, dow, hour, cnt) rows."""
    docs = texts.select(F.from_json("value", schemas.HOUR_MATRIX).alias("m"))
    return (
        docs.select(F.explode("m").alias("course_id", "rows"))
        .select(F.col("course_id").cast("long"), F.posexplode("rows").alias("dow", "hours"))
        .select("course_id", "dow", F.posexplode("hours").alias("hour", "cnt"))
    )


def read_course_bundle(spark, path, multiline=True, block_bytes: int = bundles.BLOCK_BYTES) -> dict[str, DataFrame]:
    """A course bundle (four arrays in one document) fanned out into four frames.

    With ``multiline`` documents may span lines and have any size: each is read by as many tasks as it has blocks. JSON lines are split by Spark.
    """
    parts = ("enrollments", "student_summaries", "submissions", "assignments")
    if multiline:
        known = bundles.blocks(spark, path, block_bytes)
        records = {part: bundles.array_records(known, block_bytes, part) for part in parts}
        return {part: bundles.parsed(records[part], part, schemas.COURSE_BUNDLE[part].dataType.elementType).select("r.*") for part in parts}
    bundle = _json(spark, path, schemas.COURSE_BUNDLE, multiline)
    return {part: bundle.select(F.explode(part).alias("r")).select("r.*") for part in parts}


def read_wrapped(spark, path, field: str, schema: StructType, multiline=True) -> DataFrame:
    """Records held under one list-valued field of a wrapper object; with ``multiline`` a file is one task."""
    wrapper = StructType().add(field, schemas.ArrayType(schema))
    return _json(spark, path, wrapper, multiline).select(F.explode(field).alias("r")).select("r.*")


def unprocessed(to_process: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys have not been ingested yet."""
    return to_process.join(processed.select(*keys), keys, "left_anti")


def ingest_profile(df: DataFrame, user: str, ts: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(user).alias("n_users"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )
