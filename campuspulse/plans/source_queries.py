"""Readers and writers as queries: the given tables are written as record files, read back with the declared readers and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from campuspulse import schemas
from campuspulse.functions import exprs
from campuspulse.functions import features as names
from campuspulse.operators import access, courses, stats
from campuspulse.operators.activity import KEYS
from campuspulse.plans import inputs
from campuspulse.plans.registry import add_cte, query, rnd, sql_t_p
from campuspulse.plans.stats_queries import pearson
from campuspulse.session import run_dir
from campuspulse.sources import readers, tables, writers


def _iso(column):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _as_json(df, label) -> str:
    path = run_dir(df.sparkSession, label)
    writers.write_json(df, path)
    return path


# --- records ------------------------------------------------------------------------------


@query("read_enrollments", "enr totals", f"""SELECT e.course_id, e.user_id, 'StudentEnrollment' AS type, CAST(coalesce(floor(total_activity_time), 0) AS BIGINT) AS total_activity_time,
    {rnd('final_score')}, {rnd('current_score')} FROM enr e LEFT JOIN totals t ON t.user_id = e.user_id""")
def read_enrollments(spark, d):
    """Enrolment records with nested grades; absent activity time becomes zero."""
    seen = inputs.summaries(spark, d).select(*KEYS, F.floor("total_activity_time").alias("total_activity_time"))
    rows = inputs.members(spark, d).join(seen, KEYS, "left").select(
        *KEYS, F.lit("StudentEnrollment").alias("type"), "total_activity_time", F.struct("current_score", "final_score").alias("grades"))
    back = readers.read_enrollments(spark, _as_json(rows, "enrollments"))
    return back.select(*KEYS, "type", "total_activity_time", "final_score", "current_score")


@query("read_summaries", "enr totals tard", """SELECT e.course_id, e.user_id, coalesce(page_views, 0) AS page_views, coalesce(participations, 0) AS participations,
    CAST(coalesce(on_time, 0) AS INTEGER) AS on_time, CAST(coalesce(late, 0) AS INTEGER) AS late, CAST(coalesce(missing, 0) AS INTEGER) AS missing, CAST(0 AS INTEGER) AS floating
    FROM enr e LEFT JOIN totals t ON t.user_id = e.user_id LEFT JOIN tard x ON x.user_id = e.user_id""")
def read_summaries(spark, d):
    """Student summaries with a nested breakdown that is absent for some students."""
    late = tables.tardiness(spark, d)
    rows = inputs.members(spark, d).select(*KEYS).join(inputs.summaries(spark, d), KEYS, "left").join(late, "user_id", "left")
    nested = F.when(F.col("on_time").isNotNull(), F.struct("on_time", "late", "missing"))
    shaped = rows.select("course_id", F.col("user_id").alias("id"), "page_views", "participations", nested.alias("tardiness_breakdown"))
    back = readers.read_summaries(spark, _as_json(shaped, "summaries"))
    return back.select(*KEYS, "page_views", "participations", "on_time", "late", "missing", "floating")


@query("read_submissions", "sub", f"SELECT course_id, user_id, assignment_id, {rnd('score')}, submitted_at, workflow_state FROM sub")
def read_submissions(spark, d):
    subs = tables.submissions(spark, d).join(inputs.members(spark, d).select(*KEYS), "user_id")
    rows = subs.select(*KEYS, "assignment_id", "score", _iso("submitted_at").alias("submitted_at"), "workflow_state")
    return readers.read_submissions(spark, _as_json(rows, "submissions")).select(*KEYS, "assignment_id", "score", "submitted_at", "workflow_state")


@query("read_assignments", "sub", "SELECT DISTINCT course_id, assignment_id AS id, CASE WHEN assignment_id % 2 = 1 THEN 'Prueba SUMATIVA ' ELSE 'Tarea ' END || assignment_id AS name FROM sub")
def read_assignments(spark, d):
    rows = tables.assignments(spark, d).select("course_id", F.col("assignment_id").alias("id"), "name")
    return readers.read_assignments(spark, _as_json(rows, "assignments")).select("course_id", "id", "name")


@query("read_courses", "", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, TIMESTAMP '2024-01-01' AS start_at, TIMESTAMP '2024-01-31' AS end_at FROM region")
def read_courses(spark, d):
    rows = tables.courses(spark, d).select(F.col("course_id").alias("id"), F.col("course_name").alias("name"), _iso("start_at").alias("start_at"), _iso("end_at").alias("end_at"))
    return readers.read_courses(spark, _as_json(rows, "courses")).select("id", "name", "start_at", "end_at")


@query("read_hourly_activity", "hourly", "SELECT course_id, user_id, hour AS ts, CAST(cnt AS INTEGER) AS cnt FROM hourly")
def read_hourly_activity(spark, d):
    """Hour → count maps, one per student, with a key that is no time and an hour without views."""
    per_hour = F.struct(_iso("hour"), F.col("cnt").cast("int"))
    noise = F.array(F.struct(F.lit("bad"), F.lit(1)), F.struct(F.lit("2030-01-01T00:00:00Z"), F.lit(0)))
    rows = inputs.hours(spark, d).groupBy(*KEYS).agg(F.map_from_entries(F.concat(F.collect_list(per_hour), noise)).alias("page_views"))
    return readers.read_hourly_activity(spark, _as_json(rows, "hourly"))


@query("read_participations", "act", "SELECT course_id, user_id, date_trunc('second', ts) AS created_at, '/courses/' || course_id || '/quizzes/' || resource_id AS url FROM act WHERE kind = 'purchase'")
def read_participations(spark, d):
    made = tables.activity(spark, d).where("kind = 'purchase'").join(inputs.members(spark, d).select(*KEYS), "user_id")
    url = F.concat(F.lit("/courses/"), F.col("course_id"), F.lit("/quizzes/"), F.col("resource_id"))
    rows = made.groupBy(*KEYS).agg(F.collect_list(F.struct(_iso("ts").alias("created_at"), url.alias("url"))).alias("participations"))
    return readers.read_participations(spark, _as_json(rows, "participations"))


@query("read_module_progress", "prog", "SELECT course_id, user_id, module_id, state, completed_at, CAST(items_count AS INTEGER) AS items_count FROM prog")
def read_module_progress(spark, d):
    rows = tables.module_progress(spark, d).withColumn("completed_at", _iso("completed_at"))
    return readers.read_module_progress(spark, _as_json(rows, "modules")).select(*KEYS, "module_id", "state", "completed_at", "items_count")


@query("read_page_views", "act", """SELECT course_id, user_id, kind AS action, count(*) AS n, min(ts) AS first_at, count(*) FILTER (kind IN ('purchase', 'signup')) AS participated FROM act GROUP BY ALL""")
def read_page_views(spark, d):
    """Parquet of page views, written by course in as many files as the plan has, read back as one table."""
    views = tables.activity(spark, d).join(inputs.members(spark, d).select(*KEYS), "user_id")
    rows = views.select(*KEYS, F.col("kind").alias("action"), F.col("ts").alias("created_at"), F.col("kind").isin(*tables.PARTICIPATION_KINDS).alias("participated"))
    path = run_dir(spark, "page-views")
    rows.write.parquet(path)
    back = readers.read_page_views(spark, path)
    return back.groupBy(*KEYS, "action").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.count_if("participated").alias("participated"))


@query("write_by_course", "totals", "SELECT course_id, count(*) AS students, CAST(sum(page_views) AS BIGINT) AS views FROM totals GROUP BY ALL")
def write_by_course(spark, d):
    path = run_dir(spark, "by-course")
    writers.write_by_course(inputs.summaries(spark, d).select(*KEYS, "page_views"), path)
    return spark.read.parquet(path).groupBy(F.col("course_id").cast("long").alias("course_id")).agg(
        F.count("*").alias("students"), F.sum("page_views").alias("views"))


@query("features_csv", "enr totals", f"SELECT e.course_id, e.user_id, {rnd('final_score')}, coalesce(page_views, 0) AS page_views FROM enr e LEFT JOIN totals t ON t.user_id = e.user_id")
def features_csv(spark, d):
    """A feature table written as CSV and read back under its schema."""
    rows = inputs.all_students(spark, d).select(*KEYS, "final_score", "page_views")
    path = run_dir(spark, "features")
    writers.write_csv(rows, path)
    return readers.read_features_csv(spark, path, rows.schema)


@query("results_json", "enr", f"SELECT course_id, count(*) AS n, {rnd('avg(final_score)', 'mean_score')} FROM enr GROUP BY ALL")
def results_json(spark, d):
    rows = inputs.members(spark, d).groupBy("course_id").agg(F.count("*").alias("n"), F.avg("final_score").alias("mean_score"))
    path = _as_json(rows, "results")
    return spark.read.schema(rows.schema).json(path)


HOUR_MATRIX_SQL = """SELECT course_id, CAST(d AS INTEGER) AS dow, CAST(h AS INTEGER) AS hour, CAST(count(a.ts) AS DOUBLE) AS cnt
    FROM (SELECT DISTINCT course_id FROM act), range(7) x(d), range(24) y(h) LEFT JOIN (SELECT course_id AS c, ts, isodow(ts) - 1 AS dw, hour(ts) AS hr FROM act) a ON c = course_id AND dw = d AND hr = h
    GROUP BY ALL"""


def hour_matrix_files(spark, d):
    """{course: 7 x 24} documents, one line each; the matrix of a course is bounded whatever the number of its events."""
    cell = F.struct(F.weekday("hour").alias("d"), F.hour("hour").alias("h"))
    counts = inputs.hours(spark, d).groupBy("course_id", cell.alias("k")).agg(F.sum("cnt").cast("double").alias("n"))
    cells = counts.groupBy("course_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(
        F.try_element_at("m", F.struct(i.alias("d"), h.alias("h"))), F.lit(0.0))))
    path = run_dir(spark, "hour-matrix")
    docs = cells.select(F.to_json(F.create_map(F.col("course_id").cast("string"), grid)).alias("value"))
    docs.write.text(path)
    return path


@query("read_hour_matrix", "act", HOUR_MATRIX_SQL)
def read_hour_matrix(spark, d):
    return readers.hour_matrix_rows(spark.read.text(hour_matrix_files(spark, d)))


@query("read_hour_matrix_blocks", "act", HOUR_MATRIX_SQL)
def read_hour_matrix_blocks(spark, d):
    """The same documents read as byte blocks, several to a document."""
    return readers.read_hour_matrix(spark, hour_matrix_files(spark, d), block_bytes=1024)


BUNDLE_SQL = """SELECT 'enrollments' AS part, course_id, count(*) AS n FROM enr GROUP BY ALL
    UNION ALL SELECT 'assignments', course_id, count(DISTINCT assignment_id) FROM sub GROUP BY ALL"""


def bundle_counts(spark, d, **how):
    """Bundles of one course each, fanned out into frames."""
    enrolled = inputs.members(spark, d).groupBy("course_id").agg(F.collect_list(F.struct(*KEYS)).alias("enrollments"))
    work = tables.assignments(spark, d).groupBy("course_id").agg(F.collect_list(F.struct("course_id", F.col("assignment_id").alias("id"), "name")).alias("assignments"))
    parts = readers.read_course_bundle(spark, _as_json(enrolled.join(work, "course_id"), "bundle"), **how)
    counted = [parts[p].groupBy("course_id").agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "course_id", "n") for p in ("enrollments", "assignments")]
    return counted[0].unionByName(counted[1])


@query("read_course_bundle", "enr sub", BUNDLE_SQL)
def read_course_bundle(spark, d):
    """As JSON lines."""
    return bundle_counts(spark, d, multiline=False)


@query("read_large_bundle", "enr sub", BUNDLE_SQL)
def read_large_bundle(spark, d):
    """As documents of any size and layout, each read by as many tasks as it has blocks."""
    return bundle_counts(spark, d, block_bytes=4096)


@query("read_wrapped", "", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region")
def read_wrapped(spark, d):
    rows = tables.courses(spark, d).select(F.array(F.struct(F.col("course_id").alias("id"), F.col("course_name").alias("name"))).alias("courses"))
    return readers.read_wrapped(spark, _as_json(rows, "wrapped"), "courses", schemas.COURSE, multiline=False).select("id", "name")


# --- lookups and expressions ------------------------------------------------------------


@query("known_modules", "prog", "SELECT course_id, user_id, module_id, state FROM prog WHERE module_id % 2 = 0")
def known_modules(spark, d):
    """Progress on modules that the course lists: here the even ones."""
    progress = tables.module_progress(spark, d)
    listed = progress.select("course_id", "module_id").distinct().where("module_id % 2 = 0")
    return access.known_modules(progress, listed).select(*KEYS, "module_id", "state")


@query("module_names", "prog", "SELECT course_id, user_id, module_id, CASE WHEN module_id % 2 = 0 THEN 'Module ' || module_id ELSE 'Unknown' END AS module_name FROM prog")
def module_names(spark, d):
    progress = tables.module_progress(spark, d)
    listed = progress.select("course_id", "module_id").distinct().where("module_id % 2 = 0").withColumn("module_name", F.concat(F.lit("Module "), F.col("module_id")))
    return access.with_module_names(progress.select(*KEYS, "module_id"), listed)


@query("course_names", "enr", "SELECT e.course_id, user_id, CASE WHEN r_regionkey < 3 THEN r_name ELSE 'Course ' || e.course_id END AS course_name FROM enr e JOIN region ON r_regionkey = e.course_id")
def course_names(spark, d):
    listed = tables.courses(spark, d).where("course_id < 3")
    return courses.with_course_names(inputs.members(spark, d).select(*KEYS), listed)


@query("views_of_course", "act", """SELECT course_id, user_id, count(*) AS views FROM act WHERE kind IN ('view', 'click', 'purchase', 'signup') GROUP BY ALL""")
def views_of_course(spark, d):
    """Views whose URL names the student's course; other pages of the site fall out."""
    counts = tables.page_view_counts(spark, d).where(exprs.url_in_course(F.col("url"), F.col("course_id")))
    return counts.groupBy(*KEYS).agg(F.sum("cnt").alias("views"))


@query("course_windows", "", """SELECT o_orderkey AS course_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate WHEN o_orderkey % 2 = 0 THEN o_orderdate - INTERVAL 10 DAY ELSE TIMESTAMP '1999-01-01' - INTERVAL 120 DAY END AS start_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 DAY ELSE TIMESTAMP '1999-01-01' END AS end_at FROM orders""")
def course_windows(spark, d):
    """Start from start, creation or 120 days back; end from end or the reference time."""
    o = tables.table(spark, d, "orders")
    placed = F.col("o_orderdate").cast("timestamp")
    start, end = exprs.course_window(
        F.when(F.col("o_orderstatus") != "P", placed), F.when(F.col("o_orderstatus") == "F", placed + F.expr("INTERVAL 90 DAYS")),
        F.when(F.col("o_orderkey") % 2 == 0, placed - F.expr("INTERVAL 10 DAYS")), F.lit("1999-01-01").cast("timestamp"))
    return o.select(F.col("o_orderkey").alias("course_id"), start.alias("start_at"), end.alias("end_at"))


@query("parsed_times", "", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN date_trunc('second', ts) + INTERVAL 4 HOUR ELSE date_trunc('second', ts) END AS ts FROM events""")
def parsed_times(spark, d):
    """Times as text: with Z, with an offset, without zone, and unreadable."""
    kind, ts = F.col("event_id") % 5, F.col("ts")
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(kind == 0, "no time").when(kind == 1, F.concat(plain, F.lit("-04:00"))).when(kind == 2, plain).otherwise(F.concat(plain, F.lit("Z")))
    return tables.activity(spark, d).select("event_id", exprs.parse_ts(text).alias("ts"))


@query("flat_grades", "enr", f"SELECT course_id, user_id, {rnd('current_score', 'grades_current_score')}, {rnd('final_score', 'grades_final_score')} FROM enr")
def flat_grades(spark, d):
    nested = inputs.members(spark, d).select(*KEYS, F.struct("current_score", "final_score").alias("grades"))
    return exprs.flatten_struct(nested, "grades", "grades_")


@query("short_labels", "", "SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 10) || '...' ELSE p_name END AS label FROM part")
def short_labels(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", exprs.shorten(F.col("p_name"), 10).alias("label"))


add_cte("starp", f"SELECT course_id, feature, {sql_t_p('t', 'n - 2')} AS p FROM peart", ["peart"])


@query("significance_stars", "starp", "SELECT course_id, feature, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM starp")
def significance_stars(spark, d):
    return stats.with_significance(pearson(spark, d)).select("course_id", "feature", exprs.stars(F.col("p_value")).alias("stars"))


@query("feature_means", "eng", "SELECT feature, round(avg(value), 6) + 0.0 AS mean FROM (SELECT " + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in sorted(names.PURE_ACTIVITY))
       + f" FROM eng) UNPIVOT (value FOR feature IN ({', '.join(sorted(names.PURE_ACTIVITY))})) GROUP BY feature")
def feature_means(spark, d):
    """Means of the activity features that the table has: ids, targets and leaky features left out."""
    table = inputs.engagement(spark, d)
    wanted = [f for f in exprs.available(table, [*names.PURE_ACTIVITY, "page_views_level"]) if f in exprs.feature_columns(table)]
    means = table.agg(*[F.avg(f).alias(f) for f in wanted])
    return means.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(F.col(f), 6).alias("mean")) for f in wanted])))
