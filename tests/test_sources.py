import json

from helpers import one, when
from pyspark.sql import functions as F

from campuspulse import schemas
from campuspulse.sources import readers, writers


def dump(path, records, lines=True):
    text = "\n".join(json.dumps(r) for r in records) if lines else json.dumps(records)
    path.write_text(text)
    return str(path)


def test_enrollments_flatten_grades(spark, tmp_path):
    rows = [
        {"course_id": 1, "user_id": 2, "type": "StudentEnrollment", "total_activity_time": 60, "grades": {"final_score": 57.5}},
        {"course_id": 1, "user_id": 3, "type": "StudentEnrollment", "last_activity_at": "2024-01-01T00:00:00Z"},
    ]
    for lines in (True, False):
        df = readers.read_enrollments(spark, dump(tmp_path / f"e{lines}.json", rows, lines), multiline=not lines)
        got = {r.user_id: r for r in df.collect()}
        assert got[2].final_score == 57.5 and got[3].final_score is None
        assert got[3].total_activity_time == 0 and got[3].last_activity_at == when("2024-01-01")


def test_summaries_fill_zeros(spark, tmp_path):
    path = dump(tmp_path / "s.json", [{"course_id": 1, "id": 2, "page_views": 5, "tardiness_breakdown": {"late": 1}}, {"course_id": 1, "id": 3}])
    got = {r.user_id: r for r in readers.read_summaries(spark, path).collect()}
    assert (got[2].page_views, got[2].late, got[2].on_time) == (5, 1, 0)
    assert got[3].participations == 0 and got[3].floating == 0


def test_hourly_map_explodes_and_skips_bad_keys(spark, tmp_path):
    path = dump(tmp_path / "h.json", [{
        "course_id": 1, "user_id": 2, "page_views": {"2024-01-01T10:00:00Z": 3, "bad": 1, "2024-01-01T10:00:00-04:00": 2, "2024-01-02T10:00:00Z": 0},
        "participations": [{"created_at": "2024-01-01T10:05:00Z", "url": "/courses/1/quizzes/2"}],
    }])
    got = {(str(r.ts), r.cnt) for r in readers.read_hourly_activity(spark, path).collect()}
    assert got == {("2024-01-01 10:00:00", 3), ("2024-01-01 14:00:00", 2)}
    assert one(readers.read_participations(spark, path)).url == "/courses/1/quizzes/2"


def test_other_json_readers(spark, tmp_path):
    subs = dump(tmp_path / "sub.json", [{"course_id": 1, "user_id": 2, "assignment_id": 3, "score": 4.5, "submitted_at": "2024-01-01T00:00:00Z", "late": True}])
    assert one(readers.read_submissions(spark, subs)).submitted_at == when("2024-01-01")
    asg = dump(tmp_path / "a.json", [{"course_id": 1, "id": 3, "name": "Tarea", "submission_types": ["online"]}])
    assert one(readers.read_assignments(spark, asg)).submission_types == ["online"]
    crs = dump(tmp_path / "c.json", [{"id": 1, "name": "x", "start_at": "2024-01-01T00:00:00Z"}])
    assert one(readers.read_courses(spark, crs)).end_at is None
    mod = dump(tmp_path / "m.json", [{"course_id": 1, "user_id": 2, "module_id": 3, "state": "completed", "completed_at": "2024-01-01T00:00:00Z"}])
    assert one(readers.read_module_progress(spark, mod)).completed_at == when("2024-01-01")
    wrapped = dump(tmp_path / "w.json", {"courses": [{"id": 1, "name": "x"}, {"id": 2, "name": "y"}]}, lines=False)
    assert readers.read_wrapped(spark, wrapped, "courses", schemas.COURSE).count() == 2


def test_course_bundle_fans_out(spark, tmp_path):
    bundle = {"course_id": 1, "enrollments": [{"course_id": 1, "user_id": 2}, {"course_id": 1, "user_id": 3}],
              "student_summaries": [{"course_id": 1, "id": 2}], "submissions": [], "assignments": [{"course_id": 1, "id": 9}]}
    parts = readers.read_course_bundle(spark, dump(tmp_path / "b.json", bundle, lines=False))
    assert {k: v.count() for k, v in parts.items()} == {"enrollments": 2, "student_summaries": 1, "submissions": 0, "assignments": 1}


def test_hour_matrix(spark, tmp_path):
    matrix = [[0.0] * 24 for _ in range(7)]
    matrix[6][23] = 5.0
    df = readers.read_hour_matrix(spark, dump(tmp_path / "x.json", {"86": matrix}, lines=False))
    assert df.count() == 168
    hit = one(df.where("cnt > 0"))
    assert (hit.course_id, hit.dow, hit.hour) == (86, 6, 23)


def test_csv_json_parquet_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.5)], "course_id long, user_id long, x double")
    writers.write_csv(df, str(tmp_path / "csv"))
    assert sorted(readers.read_features_csv(spark, str(tmp_path / "csv"), df.schema).collect()) == sorted(df.collect())
    writers.write_json(df, str(tmp_path / "json"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "json")).count() == 2
    writers.write_by_course(df, str(tmp_path / "pq"), rows_per_file=4)
    assert sorted(p.name for p in (tmp_path / "pq").glob("course_id=*")) == ["course_id=1", "course_id=2"]
    pruned = spark.read.parquet(str(tmp_path / "pq")).where("course_id = 1")
    assert pruned.count() == 1


def test_page_views_read_a_folder_and_resume(spark, tmp_path):
    for user in (1, 2):
        rows = [(user, 1, f"/courses/1/files/{i}", 1.0, when("2024-01-01 10:00")) for i in range(3)]
        df = spark.createDataFrame(rows, "user_id long, course_id long, url string, interaction_seconds double, created_at timestamp")
        df.write.parquet(str(tmp_path / "pv" / f"student_{user}.parquet"))
    views = readers.read_page_views(spark, str(tmp_path / "pv" / "*.parquet"))
    profile = one(readers.ingest_profile(views, "user_id", "created_at"))
    assert (profile.n_rows, profile.n_users) == (6, 2)
    todo = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    assert [r.user_id for r in readers.unprocessed(todo, views, ["user_id"]).collect()] == [3]


def test_explain_shows_pushdown_and_pruning(spark, sf):
    from campuspulse.sources import tables

    plan = tables.activity(spark, sf).where(F.col("user_id") == 3).select("user_id", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in plan
    assert "props" not in plan.split("ReadSchema:")[1]


def test_files_by_course_are_even_in_a_skewed_table(spark, tmp_path):
    big = spark.range(20_000).selectExpr("7 as course_id", "id as user_id", "id * 0.5 as x")
    middle = spark.range(2_900).selectExpr("8 as course_id", "id as user_id", "id * 0.5 as x")
    small = spark.range(300).selectExpr("100 + id % 50 as course_id", "id as user_id", "0.0 as x").unionByName(spark.sql("SELECT CAST(NULL AS INT) AS course_id, 1L AS user_id, 1.0 AS x"))
    df = big.unionByName(middle).unionByName(small)
    writers.write_by_course(df, str(tmp_path / "pq"), rows_per_file=1000)
    per_file = spark.read.parquet(str(tmp_path / "pq")).groupBy("course_id", F.input_file_name().alias("f")).count().collect()
    sizes = [r["count"] for r in per_file if r.course_id == 7]
    assert len(sizes) == 20 and max(sizes) < 2 * min(sizes)
    assert len([r for r in per_file if r.course_id == 8]) == 3
    assert len([r for r in per_file if r.course_id not in (7, 8)]) == 51
    assert sum(r["count"] for r in per_file) == df.count()
    writers.write_by_course(df.limit(0), str(tmp_path / "none"))
