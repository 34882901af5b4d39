"""Exact, near, line and span dedup, and decontamination: edge cases and brute-force versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import docs, jaccard_components, shingles
from pyspark.sql import functions as F

from campuspulse.llm import components, decontaminate, exact_dedup, jaccard_join, line_dedup, span_dedup

EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, "a  b"), (None, "ab"), (6, "a  b"), (7, "é" * 40_000 + " x")]


def test_minimal_perfect_hash_has_one_slot_per_key_and_rejects_foreign_keys_by_bytes():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    sizes, bits = exact_dedup.build_hash(keys)
    slots = exact_dedup.slots_of(keys, sizes, bits)
    assert sorted(slots) == list(range(5000)) and bits.sum() == 5000
    foreign = rng.integers(0, 2**63, (1000, 4), dtype=np.uint64)
    at = exact_dedup.slots_of(foreign, sizes, bits)
    table = np.zeros_like(keys)
    table[slots] = keys
    assert not any((table[s] == k).all() for s, k in zip(at, foreign) if s >= 0)


@pytest.mark.parametrize("history", [True, False, None])
def test_exact_dedup_edges(spark, history):
    rule = None if history is None else F.lit(history)
    rows = exact_dedup.exact_dedup(docs(spark, EDGES), rule).collect()
    assert len(rows) == len(EDGES) and sum(r.kept for r in rows) == 3  # blank, "ab", the long one
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {by[i][0].keep_id for i in (1, 2, 3)} == {3} and by[1][0].group_size == 3  # the most code points stay
    assert by[5][0].keep_id == 6 and by[None][0].keep_id == 6 and [r.kept for r in by[6]].count(True) == 1
    assert by[7][0].kept and by[7][0].group_size == 1


def test_drop_repeats_keeps_columns_and_one_row(spark):
    d = docs(spark, EDGES)
    out = exact_dedup.drop_repeats(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [3, 6, 7]
    assert exact_dedup.drop_repeats(d.limit(0)).count() == 0 and exact_dedup.exact_dedup(d.limit(0)).count() == 0


def _variants(seed, base_words, copies, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(base_words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**9)}"
        out.append(" ".join(w))
    return out


def test_jaccard_components_equal_brute_force(spark):
    texts = _variants(1, 60, 40, 5) + _variants(2, 120, 40, 8) + _variants(3, 9, 10, 1) + _variants(4, 4, 4, 1)
    texts += [texts[0].upper(), texts[0].replace(" ", "\n"), None, "", "one", "ONE", "one two"]
    # Passages shared by otherwise different documents must not link them.
    passage = texts[45]
    texts += [passage + " " + " ".join(f"u{i}_{j}" for j in range(200)) for i in range(20)]
    rows = list(enumerate(texts, start=10))
    got = {r.doc_id: r for r in jaccard_join.components_of(docs(spark, rows)).collect()}
    want = jaccard_components(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingles(t)) for i, t in rows)
    assert len(set(want.values())) < len(rows)


def test_jaccard_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, "A b c d e f"), (3, "other text of this row here")]
    got = jaccard_join.components_of(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (3, 3), (None, None), (4, 3)}
    d = docs(spark, rows)
    kept = jaccard_join.drop_near_copies(d)
    assert kept.columns == d.columns and 4 not in {r.doc_id for r in kept.collect()}
    assert jaccard_join.components_of(d.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(None, 3), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)}


def test_line_dedup_removes_repeated_chunks_only_after_the_first(spark):
    rng = random.Random(5)
    shared = [f"shared line {i} {rng.random()}" for i in range(30)]
    rows = [(i, "\n".join([f"own {i} {j} {rng.random()}" for j in range(i)] + shared + [f"end {i} {rng.random()}"])) for i in range(1, 6)]
    rows += [(6, None), (7, ""), (8, "\n\n"), (None, "x\ny"), (9, "single")]
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert len(out) == len(rows) and out[1].n_removed == 0 and out[1].text == rows[0][1]
    for i in (2, 3, 4, 5):
        assert out[i].n_removed >= 20  # all but the chunks at the passage's ends
        kept = out[i].text.split("\n")
        assert len(kept) == out[i].n_lines - out[i].n_removed and kept[: i] == rows[i - 1][1].split("\n")[: i]
    assert out[6].text == "" and out[8].text == "\n\n" and out[9].n_lines == 1
    assert line_dedup.line_dedup(docs(spark, rows).limit(0)).count() == 0


def _chunks_by_hand(lines):
    """(start, end) of chunks that close from their second line on; a last line alone takes the one before it in."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        closes = (h[i] + (131 * h[i - 1] if i else 0)) % 3 == 0 and i > start
        if closes or i == len(lines) - 1:
            out.append((start - 1 if start == i > 0 else start, i + 1))
            start = i + 1
    return out


def test_line_dedup_leaves_no_line_of_copies_and_no_run_of_one_line(spark):
    rng = random.Random(3)
    texts = ["\n".join(f"line {i} {j} {rng.random()}" for j in range(rng.randint(2, 30))) for i in range(60)]
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(texts)]
    rows += [(299, "same\nsame\nsame"), (300, "\n".join(["same"] * 9)), (301, "\n".join(["same"] * 12)), (302, "alone"), (303, "alone"), (304, None)]
    rows += [(400 + i, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for i in range(60)]
    seen, want = {}, {}
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = set()
        for a, b in _chunks_by_hand(lines):
            body = tuple(lines[a:b])
            doc, end = seen.setdefault(body, (i, b))
            if len(body) > 1 and (doc != i or end <= a):
                gone |= set(range(a, b))
        want[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got == want
    assert all(got[100 + i][2] == "" for i in range(60)) and got[299][1] == 0 and got[300][1] == 9 and got[301][1] == 12


def test_line_dedup_runs_without_python(spark, sf):
    plan = line_dedup.chunk_rows(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_span_dedup_removes_later_copies_inside_and_across_documents(spark):
    passage = "One sentence of six words here. Another sentence has seven words in it. The third one ends this passage after ten more words."
    rows = [
        (1, f"Start one. {passage} End one alone."), (2, f"Begin two!\n{passage}\nEnd two alone."), (3, f"{passage} Middle part of three. {passage}"),
        (4, "Short. Short. Short."), (5, None), (6, ""), (None, passage), (7, "No repeat at all in this text, which has only one long sentence that nobody else has written."),
    ]
    out = {r.doc_id: r for r in span_dedup.span_dedup(docs(spark, rows)).collect()}
    assert set(out) == {2, 3, None}
    assert out[2].text == "Begin two!\nEnd two alone." and out[2].first_docs == [1] and out[2].n_removed == 3
    assert out[3].text == "Middle part of three. " and out[None].text == ""
    assert span_dedup.span_dedup(docs(spark, rows).limit(0)).count() == 0


def test_span_dedup_removes_short_last_sentences_of_copies(spark):
    rng = random.Random(8)
    copy = " ".join(" ".join(f"w{rng.random()}" for _ in range(n)) + "." for n in (12, 9, 14, 8, 4))
    rows = [(1, copy), (2, copy), (3, f"An own start here.\n{copy} An own end."), (4, "Too short. To go."), (5, "Too short. To go.")]
    out = {r.doc_id: r for r in span_dedup.span_dedup(docs(spark, rows)).collect()}
    assert set(out) == {2, 3} and out[2].text == "" and out[2].n_removed == 5
    assert out[3].text == "An own start here.\nAn own end." and out[3].n_removed == 5


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"b{i}_{j}" for j in range(rng.choice([3, 5, 8, 40, 90])))) for i in range(12)] + [(20, None), (21, ""), (None, "b0_0 b0_1")]
    rows = []
    for i in range(60):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([0, 20, 3000]))]
        item = items[i % 12][1].split(" ")
        part = item[: max(1, int(len(item) * rng.choice([0.5, 0.8, 0.9, 1])))]
        at = rng.randint(0, len(words))
        rows.append((i, " ".join(words[:at] + part + words[at:])))
    rows += [(100, None), (101, items[3][1].upper()), (101, items[3][1]), (None, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.matches(docs(spark, rows), bench).collect()), key=str)
    want = []
    for d, t in rows:
        for i, x in items:
            s, few = shingles(x), len((x or "").split()) < 5
            if s and (f" {x} " in f" {' '.join((t or '').lower().split())} " if few else len(s & shingles(t)) >= 0.75 * len(s)):
                want.append((d, i))
    assert got == sorted(want, key=str) and len(want) > 10
    d = docs(spark, rows)
    clean = decontaminate.drop_contaminated(d, bench)
    assert clean.columns == d.columns and clean.count() == len(rows) - len({(k, r[0]) for k, r in enumerate(rows) if r[0] in {w[0] for w in want}})
    assert decontaminate.matches(d, bench.limit(0)).count() == 0 and decontaminate.matches(d.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(d, bench.limit(0)).count() == len(rows)


def test_items_of_one_to_four_words_inside_long_texts(spark):
    items = [(1, "quick brown fox"), (2, "Zebra"), (3, "a b"), (4, "one two three four"), (5, "brown fox jumps over it"), (6, "fox quick")]
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, f"{long} the QUICK\nbrown  fox jumps {long}"), (2, "quick brown"), (3, "zebra"), (4, f"{long} zebras a bb a b"), (5, "one two three four"), (6, "fox jumps over"), (7, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_found) for r in decontaminate.matches(docs(spark, rows), bench).collect())
    assert got == [(1, 1, 1, 1), (3, 2, 1, 1), (4, 3, 1, 1), (5, 4, 1, 1)]
    assert decontaminate.drop_contaminated(docs(spark, rows), bench).count() == 3


def test_partitions_skip_documents_that_are_too_small():
    block = decontaminate.Block([(1, " ".join(f"a{i}" for i in range(10))), (2, " ".join(f"b{i}" for i in range(100)))], 0.75)
    assert [p.least for p in block.partitions] == [5, 72] and [len(p.keys) for p in block.partitions] == [2, 25]


def test_a_sketch_meets_every_set_that_reaches_the_threshold():
    for n in range(1, 200):
        least = -(-75 * n // 100)
        assert decontaminate.sketch_size(n) == n - least + 1


def _with_header(n):
    """Texts of their own words behind one common header, and for every tenth one a near copy."""
    rng = random.Random(n)
    rows = []
    for i in range(n):
        own = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        rows.append((i, "all rights reserved by the same owner " + " ".join(own)))
        if i % 10 == 0:
            rows.append((n + i, "all rights reserved by the same owner " + " ".join(own[:-2])))
    return rows


@pytest.mark.parametrize("tasks", [1, 40])
def test_pairs_of_a_common_header_grow_in_line(spark, tasks):
    made = []
    for n in (200, 400):
        d = docs(spark, _with_header(n)).repartition(tasks)
        frequent = jaccard_join.frequent_shingles(d)
        prefixed = jaccard_join.prefixes(d, frequent)
        entities = prefixed.where("n > 0").groupBy("entity", "grp", "n").agg(F.min("doc_id").alias("doc_id"))
        lists = jaccard_join.lists_of(prefixed, entities)
        longest = lists.groupBy("list").count().agg(F.max("count")).first()[0]
        roots = spark.createDataFrame([], "node long, root long")
        made.append(jaccard_join.open_pairs(lists, roots).count())
        assert longest <= 4
    assert made[1] <= 2 * made[0] + 10


def test_a_pair_is_made_in_its_first_common_list(spark):
    # Entities 1 and 2 share lists 10, 11 and 12, 2 and 3 share 12 only; 4 is in the component of 1.
    rows = [(l, e, 100, i, e * 100) for e, ls in {1: [10, 11, 12], 2: [10, 11, 12], 3: [5, 12], 4: [10]}.items() for i, l in enumerate(ls)]
    lists = spark.createDataFrame(rows, "list long, entity long, n long, i int, grp long")
    roots = spark.createDataFrame([(1, 1), (4, 1)], "node long, root long")
    pairs = sorted(tuple(r) for r in jaccard_join.open_pairs(lists, roots).collect())
    assert pairs == [(1, 2), (1, 3), (2, 3), (2, 4)]
    plan = jaccard_join.open_pairs(lists, roots)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" in plan


def test_shingle_counts_are_those_of_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 4, rng.integers(1, 40))) for _ in range(300)] + [None, "", "same words in every text " * 2]
    monkeypatch.setattr(jaccard_join, "COUNTED_AT_ONCE", 200)
    got = jaccard_join.shingle_counts(docs(spark, list(enumerate(texts))).repartition(3)).toPandas()
    assert got.shingle.is_unique and got.n.min() > 1
    sets = []
    for text in texts:
        words = (text or "").split()
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    counts = Counter(s for one in sets for s in one)
    assert sorted(got.n) == sorted(n for n in counts.values() if n > 1)


def test_frequent_shingles_are_counted_over_all_documents(spark):
    texts = [f"one{i // 2} two three four five{i // 2}" for i in range(60)] + [f"alone{i} two three four five" for i in range(10)]
    frequent = jaccard_join.frequent_shingles(docs(spark, list(enumerate(texts))))
    assert len(frequent) == len(set(frequent)) == 30
