"""Declared schemas of the learning-platform records."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


GRADES = _struct(
    current_score=DoubleType(), final_score=DoubleType(),
    current_grade=StringType(), final_grade=StringType(),
)
TARDINESS = _struct(
    on_time=IntegerType(), late=IntegerType(), missing=IntegerType(), floating=IntegerType(),
)
COURSE = _struct(
    id=LongType(), name=StringType(), enrollment_term_id=IntegerType(), account_id=LongType(),
    total_students=IntegerType(), start_at=StringType(), end_at=StringType(), created_at=StringType(),
)
ENROLLMENT = _struct(
    course_id=LongType(), user_id=LongType(), type=StringType(), enrollment_state=StringType(),
    total_activity_time=LongType(), last_activity_at=StringType(), grades=GRADES,
)
STUDENT_SUMMARY = _struct(
    course_id=LongType(), id=LongType(), page_views=LongType(), page_views_level=IntegerType(),
    participations=LongType(), participations_level=IntegerType(), tardiness_breakdown=TARDINESS,
)
SUBMISSION = _struct(
    course_id=LongType(), user_id=LongType(), assignment_id=LongType(), score=DoubleType(),
    submitted_at=StringType(), graded_at=StringType(), workflow_state=StringType(),
    late=BooleanType(), missing=BooleanType(), excused=BooleanType(),
)
ASSIGNMENT = _struct(
    course_id=LongType(), id=LongType(), name=StringType(), points_possible=DoubleType(),
    due_at=StringType(), assignment_group_id=LongType(), submission_types=ArrayType(StringType()),
)
PARTICIPATION = _struct(created_at=StringType(), url=StringType())
HOURLY_ACTIVITY = _struct(
    course_id=LongType(), user_id=LongType(),
    page_views=MapType(StringType(), IntegerType()), participations=ArrayType(PARTICIPATION),
)
PAGE_VIEW = _struct(
    user_id=LongType(), course_id=LongType(), url=StringType(), context_type=StringType(),
    asset_type=StringType(), controller=StringType(), action=StringType(),
    interaction_seconds=DoubleType(), created_at=TimestampType(), participated=BooleanType(),
)
MODULE_PROGRESS = _struct(
    course_id=LongType(), user_id=LongType(), module_id=LongType(), module_name=StringType(),
    state=StringType(), completed_at=StringType(), items_count=IntegerType(),
)
COURSE_RESOURCES = _struct(
    course_id=LongType(), name=StringType(), students=IntegerType(), modules=IntegerType(),
    assignments=IntegerType(), quizzes=IntegerType(), pages=IntegerType(), files=IntegerType(),
    discussions=IntegerType(),
)
HOUR_MATRIX = MapType(StringType(), ArrayType(ArrayType(DoubleType())))
COURSE_BUNDLE = _struct(
    course_id=LongType(),
    enrollments=ArrayType(ENROLLMENT), student_summaries=ArrayType(STUDENT_SUMMARY),
    submissions=ArrayType(SUBMISSION), assignments=ArrayType(ASSIGNMENT),
)
