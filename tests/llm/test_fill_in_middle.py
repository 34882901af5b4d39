"""Fill-in-middle: ranks against counting, cuts against a brute-force version."""

import hashlib
import re

import numpy as np
import pytest
from llm_helpers import docs

from campuspulse.llm import fill_in_middle as fim

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\s]*[\s]|[^\s]+", "sentence": r"[^.!?\n]*[.!?\n]|[^.!?\n]+"}


def brute(doc_id, text, how):
    text = text or ""
    h = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i: 8 * i + 8], 16) for i in range(4))
    units = re.findall(UNIT[how.unit], text, re.A)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= how.rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < how.spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\nb", "a\r\nb\n", "é\n中文\n😀 x. y! z?\n" * 7, "with <P> inside", "tail <", "<S\n>M>\n<", "x" * 100_000,
    "line of words. And more?\n" * 20_000, "no end", " ", "<M>", "a.b.c\x0bd\x0ce",
]


@pytest.mark.parametrize("how", [fim.Transform(), fim.Transform("word", 1, 70, 20), fim.Transform("sentence", 2, 100, 100)])
def test_outputs_equal_brute_force_and_restore(spark, how):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "null id\nhere\n"), (5, "a\nb"), (5, "a\nb")]
    out = fim.fill_in_middle(docs(spark, rows), how)
    got = out.withColumn("back", fim.restored(out.output, out.form)).collect()
    want = sorted((str(i), *map(str, brute(i, t, how)), t or "") for i, t in rows)
    assert sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.back) for r in got) == want
    assert {r.form for r in got} >= ({"plain", "spm"} if how.spm == 100 else {"plain", "spm", "psm"})


def test_empty_table_and_columns(spark):
    out = fim.fill_in_middle(docs(spark, [(1, "a")]).limit(0))
    assert out.count() == 0 and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs(spark, []), fim.Transform("page"))


def test_ranks_equal_counts():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 5000):
        symbols = rng.integers(0, 5, size).astype(np.uint8)
        matrix = fim.WaveletMatrix(symbols)
        at = np.arange(size + 1)
        for s in range(5):
            assert (matrix.rank(s, at) == np.concatenate([[0], np.cumsum(symbols == s)])).all()
        both = np.concatenate([[0], np.cumsum(np.isin(symbols, (1, 3)))])
        k = np.arange(both[-1] + 2)
        want = [int(np.searchsorted(both, i)) if i <= both[-1] else size for i in k]
        assert matrix.after((1, 3), k, np.zeros_like(k), np.full_like(k, size)).tolist() == want
