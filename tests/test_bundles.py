"""Documents cut into small blocks against a plain parser."""

import json
import random

import numpy as np
import pytest

from campuspulse.sources import bundles, readers

NASTY = ['a"b', "back\\", "\\\\", '{"x": [', "]}", "é😀", "\n\t", '\\"', "", "plain", "\\\\\\", '"name": [']


def document(rng, n):
    def record(i):
        return {"id": i, "s": rng.choice(NASTY) + rng.choice(NASTY), "deep": {"list": [[1, [2]], rng.choice(NASTY)], "o": {}}, "e": []}

    return {"course_id": 5, "alpha": [record(i) for i in range(n)], "skip": {"alpha": [{"id": -1}]}, rng.choice(NASTY) + "odd": [record(900)], "beta": [record(100 + i) for i in range(n)], "none": []}


def write(path, docs, style):
    if style == "array":
        text = json.dumps(docs, indent=1, ensure_ascii=False)
    else:
        text = ("\n" if style == "lines" else " \n\n").join(json.dumps(d, indent=None if style == "lines" else 2, ensure_ascii=style == "lines") for d in docs)
    path.write_text(text, encoding="utf-8")


@pytest.mark.parametrize("style, size", [("pretty", 50), ("lines", 17), ("array", 64), ("pretty", 1 << 20)])
def test_records_of_all_blocks(spark, tmp_path, style, size):
    rng = random.Random(size)
    docs = [document(rng, 6), document(rng, 3), {"alpha": [], "beta": [{"id": 77}]}]
    write(tmp_path / "a.json", docs[:2], style)
    write(tmp_path / "b.json", docs[2:], style)
    (tmp_path / "c.json").write_text("")
    known = bundles.blocks(spark, str(tmp_path), size)
    assert known.count() == sum(-(-p.stat().st_size // size) for p in tmp_path.glob("*.json"))
    for field in ("alpha", "beta"):
        got = [json.loads(r.value) for r in bundles.array_records(known, size, field).where(f"field = '{field}'").collect()]
        want = [r for d in docs for r in d[field]]
        assert sorted(got, key=str) == sorted(want, key=str)
    every = sorted((r.field, r.value) for r in bundles.array_records(known, size).collect())
    assert len(every) == sum(len(v) for d in docs for v in d.values() if isinstance(v, list)) + sum(1 for d in docs for v in d.values() if isinstance(v, dict))
    values = sorted((r.field, json.dumps(json.loads(r.value))) for r in bundles.named_values(known, size).collect())
    assert values == sorted((k, json.dumps(v)) for d in docs for k, v in d.items() if isinstance(v, (list, dict)))


def test_one_large_document_is_read_by_many_tasks(spark, tmp_path):
    enrollments = [{"course_id": 1, "user_id": i, "type": "StudentEnrollment", "grades": {"final_score": i / 10}} for i in range(3000)]
    (tmp_path / "big.json").write_text(json.dumps({"course_id": 1, "enrollments": enrollments, "student_summaries": [], "submissions": [{"user_id": 1, "assignment_id": 2}]}))
    parts = readers.read_course_bundle(spark, str(tmp_path / "big.json"), block_bytes=20_000)
    rows = parts["enrollments"]
    assert rows.rdd.getNumPartitions() >= 8
    assert rows.count() == 3000 and rows.agg({"user_id": "sum"}).first()[0] == sum(range(3000))
    assert parts["submissions"].count() == 1 and parts["student_summaries"].count() == 0 and parts["assignments"].count() == 0


def test_brackets_outside_strings():
    text = b'{"a\\\\": "]\\"[", "b": [1]}'
    places, steps, inside = bundles.structure(np.frombuffer(text, np.uint8), 0, False)
    assert [chr(text[p]) for p in places] == ["{", "[", "]", "}"] and steps.tolist() == [1, 1, -1, -1] and not inside
    for cut in range(1, len(text)):
        head, tail = text[:cut], text[cut:]
        run = len(head) - len(head.rstrip(b"\\"))
        a, _, state = bundles.structure(np.frombuffer(head, np.uint8), 0, False)
        b, _, _ = bundles.structure(np.frombuffer(tail, np.uint8), run, state)
        assert a.tolist() + (b + cut).tolist() == places.tolist()
