"""The document score against plain loops, and the bound of the training sample."""

import math
import random
import re

import numpy as np
import pytest
from llm_helpers import docs

from campuspulse.llm import quality_crf as q

TEXTS = ["", "One line of PLAIN text 12", "A a a b\n\n$$$ ### !!! 77\nÉté À la ÇA ß 中文\nsame same same same", "x" * 500 + "\n" + "THE END\n", "\n\n\n", "w " * 3000 + "\nTail"]


def line_features(text):
    rows = []
    for line in text.split("\n"):
        body, words = line.encode(), [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
        size, n = max(1, len(body)), len(words)
        letters = sum(c.isascii() and c.isalpha() for c in line) + sum(b >= 0xC3 for b in body)
        upper = sum("A" <= c <= "Z" for c in line) + sum(0xC0 <= ord(c) <= 0xDE for c in line)
        f = {"one": 1.0, "upper": upper / max(1, letters), "signs": sum(c in q.SIGNS for c in line) / size, "digits": sum("0" <= c <= "9" for c in line) / size,
             "again": sum(a == b for a, b in zip(words, words[1:])) / max(1, n), "repeated": 1 - len(set(words)) / max(1, n) - (n == 0),
             "words": math.log1p(n) / 5, "length": min(3, size / max(1, n) / 10), "empty": float(n == 0)}
        f |= {"much_upper": float(f["upper"] > 0.25), "many_signs": float(f["signs"] > 0.04), "much_repeated": float(f["repeated"] > 0.45)}
        rows.append(f)
    for i, f in enumerate(rows):
        for tag, j in (("before", i - 1), ("after", i + 1)):
            for name in ("upper", "signs", "again", "repeated"):
                f[f"{tag}_{name}"] = rows[j][name] if 0 <= j < len(rows) else 0.0
        f["first"], f["last"] = float(i == 0), float(i == len(rows) - 1)
    return np.array([[f[name] for name in q.FEATURES] for f in rows])


def score(model, text):
    x = line_features(text)
    e = np.clip(x @ model.weights, -60, 60)
    t = np.exp(model.transition)
    local = [np.array([1.0, math.exp(v)]) for v in e]
    alpha = [local[0] / local[0].sum()]
    for v in local[1:]:
        a = (alpha[-1] @ t) * v
        alpha.append(a / a.sum())
    beta = [np.ones(2)]
    for v in local[:0:-1]:
        b = t @ (v * beta[-1])
        beta.append(b / b.sum())
    good = [a[1] * b[1] / (a @ b) for a, b in zip(alpha, beta[::-1])]
    weight = [len(line.encode()) + 1 for line in text.split("\n")]
    return float(np.clip(np.average(good, weights=weight), 0, 1))


def test_scores_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    model = q.Model(rng.normal(size=len(q.FEATURES)), rng.normal(size=(2, 2)))
    d = docs(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(90, None)])
    got = {r.doc_id: r.score for r in q.quality(d, model).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == pytest.approx(score(model, t), abs=1e-9), t[:30]
    assert got[90] == got[0]


def test_training_takes_whole_documents_up_to_a_number_of_lines(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "\n".join(f"line {j} of {i}" for j in range(rng.randint(1, 900)))) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(q, "fit_chains", lambda x, first, y: seen.update(lines=len(x), docs=int(first.sum()), last=int(x[:, q.FEATURES.index("last")].sum())))
    q.fit(docs(spark, rows), labels, max_lines=3000)
    assert 2000 < seen["lines"] <= 3000 and seen["docs"] == seen["last"] > 2
    q.fit(docs(spark, rows), labels)
    import zlib

    assert seen["lines"] == sum(t.count("\n") + 1 for i, t in rows if zlib.crc32(str(i).encode()) % 5)
