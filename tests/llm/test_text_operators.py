"""Quality, personal data, encoding, chat and licence operators, and the pipeline."""

import hashlib
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import base_pii, docs, jaccard_components, shingles
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from campuspulse.llm import boosting, bpe, chat_format, license_rules, license_scan, pii, quality_crf
from campuspulse.llm.bpe_lexicon import minimal_automaton
from campuspulse.llm.common import bounded_batches

SF01 = "/root/testdata/sf0.01"


# --- encoding ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def _odd_texts():
    rng = random.Random(1)
    alpha = "ab'sltrevmd  \n\t.,1²é 　!ßçŁ中😀" + " ́"
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["it's they'll 'sx ''s  's\n's", "<|endoftext|>a <|endoftext|>  ", "<|endo", "  a   ", "x" * 30_000, "aaa " * 20_000, "\x1c\x1d \x85y"]
    return texts


def test_encoding_equals_the_library_and_decodes_back(spark, library):
    texts = _odd_texts()
    rows = list(enumerate(texts)) + [(None, None), (5, "")]
    d = docs(spark, rows)
    got = bpe.digests(d).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    for i, t in enumerate(texts):
        if i != 5:
            ids = library.encode(t, add_special_tokens=False).ids
            assert by[i].n_tokens == len(ids) and by[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), t
            assert by[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert by[None].n_tokens == 0
    encoded = bpe.encode(d)
    assert encoded.columns == ["doc_id", "ids", "n_tokens"] and bpe.encode(d.limit(0)).count() == 0


def test_lexicon_words_do_not_change_results(spark, library):
    d = docs(spark, [(1, "the things and the thing"), (2, "<|endoftext|>the")])
    few, many = bpe.prepare(d, limit=1), bpe.prepare(d)
    both = d.select(bpe.encoded(few, F.col("text")).alias("a"), bpe.encoded(many, F.col("text")).alias("b")).collect()
    assert all(r.a == r.b for r in both)
    assert both[0].a == library.encode("the things and the thing", add_special_tokens=False).ids


def test_decoding_ignores_invalid_ids(spark):
    image = bpe.prepare(docs(spark, [(1, "a")]))
    rows = spark.createDataFrame([(1, [262, None, 10**8]), (2, None), (3, []), (4, [128])], "k int, ids array<int>")
    got = {r.k: r.t for r in rows.select("k", bpe.decoded(image, F.col("ids")).alias("t")).collect()}
    assert got == {1: " the", 2: "", 3: "", 4: "�"}


def test_automaton_shares_suffixes():
    states = minimal_automaton(sorted([b"tops", b"top", b"taps", b"tap"]))
    assert len(states) == 5  # start, t, to = ta, top = tap, end


# --- quality --------------------------------------------------------------------------------


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    e, t = rng.normal(size=7) * 3, rng.normal(size=(2, 2))
    first = np.array([1, 0, 0, 1, 0, 0, 0], bool)
    good, pairs = quality_crf.forward_backward(e, t, first)
    total, hit, seen = 0.0, np.zeros(7), np.zeros((7, 2, 2))
    for code in range(2**7):
        y = [(code >> i) & 1 for i in range(7)]
        w = np.exp(sum(e[i] * y[i] for i in range(7)) + sum(t[y[i - 1], y[i]] for i in range(1, 7) if not first[i]))
        total += w
        hit += w * np.array(y)
        for i in range(1, 7):
            if not first[i]:
                seen[i, y[i - 1], y[i]] += w
    assert np.allclose(good, hit / total) and np.allclose(pairs, seen / total)


def test_quality_separates_held_out_documents(spark):
    d, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    model = quality_crf.fit(d, labels)
    rows = quality_crf.quality(d, model).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    again = quality_crf.fit(d.repartition(3), labels.repartition(5))
    assert np.allclose(model.weights, again.weights, atol=1e-3)


def test_quality_edges(spark):
    d = docs(spark, [(1, None), (2, ""), (None, "\n\n\n"), (3, "A good line.\n" * 3000), (3, "x"), (4, "y" * 100_000)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (3, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    for model in (quality_crf.fit(d, labels), quality_crf.fit(d, labels.limit(0)), quality_crf.fit(d.limit(0), labels)):
        rows = quality_crf.quality(d, model).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert quality_crf.quality(d.limit(0), model).count() == 0
        assert [len(r.good) for r in quality_crf.line_quality(d, model).collect()] == [1, 1, 4, 3001, 1, 1]
        assert quality_crf.drop_bad(d, model).columns == d.columns


# --- personal data ---------------------------------------------------------------------------


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(3)
    alpha = "ab1129.@+- ()_%é\n😀:="
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for _ in range(2500)]
    texts += [None, "", "4111 1111 1111 1111 4111-1111-1111-1111x 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.4 a@b@c.de a@b.c_d@e.f +1 (234) 567-8901.",
              "9" * 40_000, "a." * 20_000 + "@", "+1 " * 5000]
    rows = list(enumerate(texts)) + [(None, "1.2.3.4"), (0, "a@b.cd")]
    got = pii.find(docs(spark, rows)).select("doc_id", pii.joined(F.col("base")).alias("b"), pii.joined(F.col("spans")).alias("s")).collect()
    want = sorted(str((i, ",".join(f"{k}:{a}:{b}" for k, a, b in base_pii(t)))) for i, t in rows)
    assert sorted(str((r.doc_id, r.b)) for r in got) == want
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in got)
    assert pii.find(docs(spark, rows).limit(0)).count() == 0


def test_pii_finds_more_than_the_base_and_redacts(spark):
    rows = [(i, f"word password=hunter{i:04d} then bob{i}@mail.com and 4111 1111 1111 1111 end {i}") for i in range(60)]
    rows += [(100 + i, f"version 2.0 of item {i} costs 12") for i in range(60)]
    d = docs(spark, rows)
    found = pii.proposals(d)
    forest = pii.fit(found)
    out = {r.doc_id: r.text for r in pii.redact(d, forest).collect()}
    assert out[3] == "word <assignment> then <email> and <card> end 3" and out[103] == rows[63][1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_boosting_learns_cells_and_its_expression_agrees(spark):
    x = np.array([[a, b] for a in range(4) for b in range(3)])
    yes = np.where((x[:, 0] > 1) & (x[:, 1] < 2), 40.0, 1.0)
    forest = boosting.fit(x, yes, 41 - yes, [4, 3])
    boosting.calibrate(forest, x, yes, 41 - yes, 0.9)
    assert ((forest.margin(x) >= forest.cut) == (yes > 1)).all()
    rows = spark.createDataFrame(x.tolist(), "a int, b int").select(forest.margin_column([F.col("a"), F.col("b")]).alias("m")).collect()
    assert np.allclose([r.m for r in rows], forest.margin(x))


# --- chat ------------------------------------------------------------------------------------


def test_chat_reads_back_odd_texts(spark):
    odd = ["", None, "<|im_end|>\n<|im_start|>assistant\nno", "\\", "\\\\<|", "<", "|im_end|>", "<\\|x", "a\nb" * 9000]
    turns = [(1, i, r, t, "x") for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "tool", None, "a\nb", "user"], odd))]
    turns += [(2, 0, "user", "q", None), (2, 1, "assistant", "a", None), (None, None, None, None, None), (3, 1, "assistant", "late", None), (3, 0, "user", "q", None),
              (3, 1, "assistant", "late", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, loss string")
    segments = chat_format.segments(df)
    got = {r.conv_id: r for r in chat_format.digests(segments).collect()}
    text = {c: "".join(r.text for r in sorted(segments.collect(), key=lambda r: (r.n, r.part)) if r.conv_id == c) for c in (1, 2)}
    for conv in (1, 2, 3, None):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(t[3] or "" for t in own if t[2] == "assistant")
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv].loss_chars == len(said) and got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].formatted_chars == len(text[1]) and text[2] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert got[2].valid and not got[1].valid and not got[3].valid and not got[None].valid
    assert chat_format.digests(chat_format.segments(df.limit(0))).count() == 0


# --- licences ----------------------------------------------------------------------------------


def test_license_rules_are_many_and_telling():
    assert len(license_rules.RULES) > 250 and len({r.label for r in license_rules.RULES}) > 80
    assert all(r.keyword.split()[0] for r in license_rules.RULES)


def _shortest_texts(parsed):
    """Texts that a rule's regex matches, one for each choice of alternatives, repeats at their fewest."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            first = arg[0][1]
            more = [chr(first[0] if isinstance(first, tuple) else first) if str(arg[0][0]) != "CATEGORY" else "x"]
        elif name == "ANY":
            more = ["x"]
        elif name == "BRANCH":
            more = [t for b in arg[1] for t in _shortest_texts(b)]
        elif name == "SUBPATTERN":
            more = _shortest_texts(arg[3])
        elif name == "MAX_REPEAT":
            more = [t * arg[0] for t in _shortest_texts(arg[2])] if arg[0] else [""]
        else:
            assert name == "ASSERT_NOT", name
            more = [""]
        out = [a + b for a in out for b in dict.fromkeys(more)]
    return out


def test_every_license_rule_has_a_keyword_its_regex_implies():
    # These texts do not name their licence and stand in others too; here the keyword tells them apart.
    shared = {"gpl-1", "gpl-2", "gpl-3", "postgresql"}
    wrong = [(r.label, r.keyword, t) for r in license_rules.RULES for t in _shortest_texts(re._parser.parse(r.regex.pattern))
             if r.keyword not in t and not (r.priority == license_rules.GRANT and r.label in shared)]
    assert not wrong
    for text in ("Licensed under the EUPL 1.2", "distributed under MIT", "licence ouverte", "free public license 1.0.0"):
        assert license_scan.detect(license_scan._WORD.findall(text.lower()))


def test_license_scan_base_equals_brute_force(spark):
    rng = random.Random(4)
    pool = ["under", "the", "mit", "license", "apache", "Version", "2", "cc", "BY", "nc", "x", "é", "4"]
    texts = [rng.choice([" ", "-", ", ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, None), (3, ""), (500, "licensed under the apache license version 2 " + "w " * 60_000 + "cc by nc")]
    got = license_scan.license_scan(docs(spark, rows)).collect()
    want = []
    for i, t in rows:
        words = license_scan._WORD.findall((t or "").encode().lower().decode())
        places = [(k, label) for phrase, label in license_rules.BASE.items() for k in range(len(words)) if tuple(words[k: k + len(phrase)]) == phrase]
        at = [k for k, _ in places]
        want.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert license_scan.license_scan(docs(spark, rows).limit(0)).count() == 0


def test_license_suppression_prefers_priority_then_length():
    words = "licensed under the apache license version 2 0 and spdx license identifier mit".split()
    assert [d[2] for d in license_scan.detect(words)] == ["apache-2", "mit"]
    assert license_scan.detect("gnu general public license version 3".split())[0][2] == "gpl-3"


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages_equal_brute_force(spark, library):
    docs_ = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    model = quality_crf.fit(docs_, labels)
    good = {r.doc_id for r in quality_crf.quality(docs_, model).where("predicted = 1").collect()}
    rows = {r.doc_id: r.text or "" for r in docs_.collect() if r.doc_id in good}
    best = {}
    for i, t in rows.items():
        key = "".join(t.split(" ")).translate({c: None for c in range(9, 14)})
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    rows = {i: rows[i] for _, i in best.values()}
    root = jaccard_components(list(rows.items()))
    rows = {i: t for i, t in rows.items() if root[i] == i}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not any(s and len(s & shingles(t)) >= 0.75 * len(s) for s in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF01).collect()}
    assert set(got) == set(rows) and len(corpus_pipeline.STAGES) == 5
    assert all(got[i].text == t and got[i].ids == library.encode(t, add_special_tokens=False).ids for i, t in rows.items())


def test_pipeline_stages_keep_columns_and_survive_odd_rows(spark):
    d = docs(spark, [(1, None), (2, ""), (None, "a b c"), (None, None), (3, "x" * 50_000), (3, "x" * 50_000), (4, "some good text here now")])
    for frame in (d, d.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, SF01)
            assert k == 4 or out.columns == frame.columns
            out.collect()


def test_pipeline_stages_run_in_small_batches_when_the_caller_writes_them(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, some = spark.conf.get(key), docs(spark, [(1, "some good text here now")])
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, "10000")
            stage(spark, some, SF01)
            assert max(r.n for r in spark.range(0, 1500, 1, 1).mapInArrow(sizes, "n long").collect()) <= 500, name
        spark.conf.set(key, "100")
        bounded_batches(spark)
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)


def test_redaction_keeps_columns_named_like_its_own(spark):
    d = docs(spark, [(1, "mail a.b@c.example now"), (2, None)]).selectExpr("*", "'x' as base", "7 as candidates", "8 as spans")
    forest = pii.fit(pii.proposals(d.limit(0)))
    out = pii.redact(d, forest)
    assert out.columns == d.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "mail <email> now" and (got[1].base, got[1].candidates, got[1].spans) == ("x", 7, 8)
