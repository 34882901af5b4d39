"""The driver's star-schema tables seen as learning-platform records.

Joins carry no broadcast hints: Spark broadcasts a side only after checking its
size against ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The observation window of the event table.
COURSE_START = "2024-01-01 00:00:00"
COURSE_END = "2024-01-31 00:00:00"
PARTICIPATION_KINDS = ("purchase", "signup")


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; its footer is read for the schema once per session, not once per use."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def _centi(amount: Column, per_point: int) -> Column:
    """``amount / per_point`` rounded to 2 digits with integer arithmetic, so every engine agrees."""
    cents = F.round(amount * 100).cast("long")
    return F.floor((cents * 2 + per_point) / F.lit(2 * per_point)).cast("long") / F.lit(100.0)


def courses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("course_id"),
        F.col("r_name").alias("course_name"),
        F.lit(COURSE_START).cast("timestamp").alias("start_at"),
        F.lit(COURSE_END).cast("timestamp").alias("end_at"),
    )


def enrollments(spark, sf_dir) -> DataFrame:
    """(course_id, user_id, account_id, program, final_score, current_score)."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer")
    score = _centi(F.col("c_acctbal") + 1000, 110)
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("course_id"),
        F.col("c_custkey").alias("user_id"),
        F.col("n_nationkey").alias("account_id"),
        F.col("c_mktsegment").alias("program"),
        score.alias("final_score"),
        F.when(F.col("c_mktsegment") != "FURNITURE", score).alias("current_score"),
    )


def activity(spark, sf_dir) -> DataFrame:
    """Click-stream rows (event_id, user_id, ts, kind, resource_id, seconds, cnt)."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("resource_id"),
        F.col("value").alias("seconds"),
        F.lit(1).alias("cnt"),
    )


def view_url() -> Column:
    """The URL a click-stream row of each kind would carry."""
    kind = F.col("kind")
    course = F.concat(F.lit("/courses/"), F.col("course_id"))
    return (
        F.when(kind == "view", F.concat(course, F.lit("/pages/"), F.col("resource_id")))
        .when(kind == "click", F.concat(course, F.lit("/files/"), F.col("resource_id")))
        .when(kind == "purchase", F.concat(course, F.lit("/assignments/"), F.col("resource_id")))
        .when(kind == "signup", course)
        .otherwise(F.lit("/about"))
    )


def page_view_counts(spark, sf_dir) -> DataFrame:
    """Views per (course, user, URL); events are reduced per user and resource before the join."""
    members = enrollments(spark, sf_dir).select("user_id", "course_id")
    reduced = activity(spark, sf_dir).groupBy("user_id", "kind", "resource_id").agg(F.sum("cnt").alias("cnt"))
    return reduced.join(members, "user_id").select("course_id", "user_id", view_url().alias("url"), "cnt")


def submissions(spark, sf_dir) -> DataFrame:
    """(user_id, assignment_id, submission_id, score, submitted_at, due_at, workflow_state)."""
    o = table(spark, sf_dir, "orders")
    state = F.col("o_orderstatus")
    placed = F.col("o_orderdate").cast("timestamp")
    assignment = F.substring("o_orderpriority", 1, 1).cast("long")
    return o.select(
        F.col("o_custkey").alias("user_id"),
        assignment.alias("assignment_id"),
        F.col("o_orderkey").alias("submission_id"),
        F.when(state == "F", F.least(F.lit(100.0), _centi(F.col("o_totalprice"), 5000))).alias("score"),
        F.when(state != "P", placed).alias("submitted_at"),
        F.when(assignment != 5, F.date_trunc("month", placed) + F.expr("INTERVAL 19 DAYS")).alias("due_at"),
        F.when(state == "F", "graded").when(state == "O", "submitted").otherwise("unsubmitted").alias("workflow_state"),
    )


def assignments(spark, sf_dir) -> DataFrame:
    """One row per (course, assignment); assignments 1, 3 and 5 are exams by name."""
    subs = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("assignment_id"),
    ).distinct()
    members = enrollments(spark, sf_dir).select("user_id", "course_id")
    return (
        subs.join(members, "user_id").select("course_id", "assignment_id").distinct()
        .withColumn(
            "name",
            F.concat(F.when(F.col("assignment_id") % 2 == 1, "Prueba SUMATIVA ").otherwise("Tarea "), F.col("assignment_id")),
        )
    )


def tardiness(spark, sf_dir) -> DataFrame:
    """Per-student on_time / late / missing counts; lines fold per order before the join."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    flag = F.col("l_returnflag")
    kinds = {"on_time": "N", "late": "R", "missing": "A"}
    per_order = lines.groupBy("l_orderkey").agg(*[F.count_if(flag == code).alias(k) for k, code in kinds.items()])
    return (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("user_id")
        .agg(*[F.sum(k).alias(k) for k in kinds])
    )


def module_progress_by_user(spark, sf_dir) -> DataFrame:
    """(user_id, module_id, state, completed_at, items_count)."""
    done = F.col("l_linestatus") == "F"
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("timestamp").alias("at")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("module_id")
    )
    per_student = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("user_id", "module_id")
        .agg(
            F.max(F.when(done, 1).otherwise(0)).alias("_done"),
            F.min(F.when(done | (F.col("l_returnflag") != "N"), F.col("at"))).alias("completed_at"),
            F.count("*").alias("items_count"),
        )
    )
    return per_student.select(
        "user_id", "module_id",
        F.when(F.col("_done") == 1, "completed").otherwise("started").alias("state"),
        "completed_at", "items_count",
    )


def module_progress(spark, sf_dir) -> DataFrame:
    """The same with the student's course."""
    members = enrollments(spark, sf_dir).select("user_id", "course_id")
    return module_progress_by_user(spark, sf_dir).join(members, "user_id").select(
        "course_id", "user_id", "module_id", "state", "completed_at", "items_count"
    )


def resource_counts(spark, sf_dir) -> DataFrame:
    """Resources per course section: parts by size class, one kind per part type."""
    kind = F.col("p_type")
    kinds = {
        "modules": "ECONOMY", "assignments": "STANDARD", "quizzes": "SMALL",
        "pages": "MEDIUM", "files": "LARGE", "discussions": "PROMO",
    }
    sections = (
        table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("section_id"))
        .agg(*[F.count_if(kind == code).alias(name) for name, code in kinds.items()])
    )
    students = (
        table(spark, sf_dir, "customer")
        .groupBy((F.pmod("c_custkey", F.lit(50)) + 1).alias("section_id"))
        .agg(F.count("*").alias("students"))
    )
    total = sum((F.col(k) for k in list(kinds)[1:]), F.col("modules"))
    return sections.join(students, "section_id", "left").select(
        "section_id", F.coalesce("students", F.lit(0)).alias("students"), *kinds, total.alias("total_resources")
    )


def messages(spark, sf_dir) -> DataFrame:
    """Conversation turns as dated messages between a student and an instructor."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("user_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("conv_id", F.lit(30)).cast("int")).alias("day"),
        "role",
        F.length("text").alias("n_chars"),
    )
