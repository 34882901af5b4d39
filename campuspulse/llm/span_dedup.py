"""Substring dedup by sliding sentence spans.

A text is cut into sentences; from every sentence starts a run: the fewest consecutive sentences, two at
least, that hold ``RUN_WORDS`` words, and with every sentence ends one by the same measure, so that the first and the last
sentences of a passage are covered alike. All runs are hashed and joined globally. Of equal runs the first (smallest
doc_id, null last, then the smallest start) stays; sentences that any other copy covers are removed, with the blanks after them.

Runs are (96-bit hash, doc_id, number of places) rows, one per document and distinct run; counting reduces before its shuffle, and the rows of a repeated run
meet its one count in a join whose large side can be split. What is gathered per document is bounded by the document.

Edge cases: null text is empty and has no runs; texts with fewer words have none either. Rows that share a doc_id
(or have none) are one document in several rows: of their common runs the ones at the smallest start stay, and a row loses a run only where
its own text has it. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campuspulse.llm.common import ids_and_text, table, written
from campuspulse.llm.textbytes import mix, slices, span_hashes, spans

RUN_WORDS = 20
MIN_SENTENCES = 2
_STEP = 0xC2B2AE3D27D4EB4F
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def sentences(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, end with the blanks after it, words, sentences per text), all as byte positions.

    A sentence ends at blanks that follow ``.``, ``!`` or ``?``, or that hold a line end.
    """
    words_start, words_end, per_text = spans(raw, offs)
    n = len(words_start)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(len(offs) - 1, np.int64)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    text_end = offs[1:][owner]
    # The blanks after a word run to the next word, or to the end of its text.
    after = np.minimum(np.append(words_start[1:], len(raw)), text_end)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    last = _STOP[raw[words_end - 1]] & (after > words_end) | (lines[after] > lines[words_end]) | (after == text_end)
    # A word that ends a text always ends its sentence.
    final = np.flatnonzero(last)
    first = np.append(0, final[:-1] + 1)
    counts = np.bincount(owner[final], minlength=len(per_text))
    return words_start[first], words_end[final], after[final], final - first + 1, counts


def runs(raw: np.ndarray, offs: np.ndarray, ends: bool = True) -> tuple[dict[str, np.ndarray], tuple]:
    """Runs as columns text, start, n, h1, h2 (start is the sentence's number in its text), and the sentences.

    In order of text and start; ``ends`` adds the runs that end with each sentence.
    """
    cut = sentences(raw, offs)
    start, end, _, words, counts = cut
    base = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.concatenate([[0], np.cumsum(words)])
    i = np.arange(len(start))
    # End (exclusive) of each run: enough words and sentences, inside the text.
    stop = np.maximum(np.searchsorted(total, total[:-1] + RUN_WORDS, "left"), i + MIN_SENTENCES)
    ok = stop <= base[owner + 1]
    i, stop = i[ok], stop[ok]
    if ends:
        to = np.arange(1, len(start) + 1)
        since = np.minimum(np.searchsorted(total, total[1:] - RUN_WORDS, "right") - 1, to - MIN_SENTENCES)
        ok = since >= base[owner]
        both = np.append(i, since[ok]) << 32 | np.append(stop, to[ok])
        both = np.unique(both)
        i, stop = both >> 32, both & 0xFFFFFFFF
    sentence = span_hashes(raw, start, end)
    return {
        "text": owner[i], "start": (i - base[owner[i]]).astype(np.int32), "n": (stop - i).astype(np.int32),
        "h1": _sequence_hash(sentence, i, stop, _STEP).view(np.int64),
        "h2": (_sequence_hash(mix(sentence), i, stop, _STEP ^ 0x5A5A5A5A5A5A5A5A) >> np.uint64(32)).astype(np.uint32).view(np.int32),
    }, cut


def _sequence_hash(symbols: np.ndarray, start: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    step |= 1
    powers = np.full(len(symbols) + 1, step, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    down = np.full(len(symbols) + 1, pow(step, -1, 1 << 64), np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * powers[:-1])])
    return mix((total[stop] - total[start]) * down[start] ^ (stop - start).astype(np.uint64))


_RUNS = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("times", pa.int32())])


def _emit_runs(batches: Iterator[pa.RecordBatch], ends: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, raw, offs in slices(batch["text"]):
            r, _ = runs(raw, offs, ends)
            order = np.lexsort((r["h2"], r["h1"], r["text"]))
            text, h1, h2 = (r[c][order] for c in ("text", "h1", "h2"))
            new = np.append(True, (text[1:] != text[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[: len(text)]
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(text))).astype(np.int32)
            ids = batch["doc_id"].take(pa.array(text[first] + a))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h1[first]), pa.array(h2[first]), pa.array(times)], schema=_RUNS)


def run_rows(docs: DataFrame, ends: bool = True) -> DataFrame:
    """(doc_id, h1, h2, times): one row per document and distinct run, with the number of its places there."""
    return ids_and_text(docs).mapInArrow(partial(_emit_runs, ends=ends), "doc_id long, h1 long, h2 int, times int")


def repeated_runs(docs: DataFrame, ends: bool = True) -> DataFrame:
    """(doc_id, runs: array of h1, h2, first, own) of documents that lose sentences.

    ``first`` keeps the run; in that document itself (``own``) the run stays at its first place.
    """
    rows = written(run_rows(docs, ends), "sentence-runs")
    counts = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.sum("times").alias("c")).where("c > 1").drop("c")
    met = rows.join(counts, ["h1", "h2"])
    own = F.col("doc_id").eqNullSafe(F.col("first"))
    by_doc = met.withColumn("own", own).groupBy("doc_id").agg(
        F.collect_set(F.struct("h1", "h2", "first", "own")).alias("runs"), F.bool_or(~F.col("own") | (F.col("times") > 1)).alias("loses"))
    # A document that only keeps its runs, each at one place, loses nothing.
    return by_doc.where("loses").select("doc_id", "runs")


_CLEAN = pa.schema([
    ("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("first_docs", pa.list_(pa.int64())), ("text", pa.string()),
])


def _remove(batches: Iterator[pa.RecordBatch], ends: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed = batch["runs"]
        for a, b, raw, offs in slices(batch["text"]):
            r, (start, _, after, _, counts) = runs(raw, offs, ends)
            base = np.concatenate([[0], np.cumsum(counts)])
            edges = np.searchsorted(r["text"], np.arange(b - a + 1))
            rows = []
            for i in range(b - a):
                lo, hi = edges[i], edges[i + 1]
                places: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for h1, h2, s, n in zip(*(r[c][lo:hi].tolist() for c in ("h1", "h2", "start", "n"))):
                    places.setdefault((h1, h2), []).append((s, n))
                gone, first = np.zeros(counts[i], bool), set()
                for run in removed[a + i].as_py():
                    # In the document that keeps a run, its first place stays.
                    for s, n in places.get((run["h1"], run["h2"]), [])[1 if run["own"] else 0:]:
                        gone[s: s + n] = True
                        first.add(run["first"])
                if not gone.any():
                    continue
                keep = np.ones(offs[i + 1] - offs[i], bool)
                for j in np.flatnonzero(gone):
                    keep[start[base[i] + j] - offs[i]: after[base[i] + j] - offs[i]] = False
                text = raw[offs[i]: offs[i + 1]][keep].tobytes().decode()
                rows.append((batch["doc_id"][a + i].as_py(), int(counts[i]), int(gone.sum()), sorted(x for x in first if x is not None), text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _CLEAN)], schema=_CLEAN)


def span_dedup(docs: DataFrame, ends: bool = True) -> DataFrame:
    """Documents that lose sentences: doc_id, n_sentences, n_removed, first_docs (that keep the removed runs), text (what is left).

    Documents that are not listed stay as they are.
    """
    gone = written(repeated_runs(docs, ends), "sentence-removals").withColumnRenamed("doc_id", "id")
    rows = ids_and_text(docs)
    joined = rows.join(gone, rows.doc_id.eqNullSafe(gone.id)).select("doc_id", "text", "runs")
    return joined.mapInArrow(partial(_remove, ends=ends), "doc_id long, n_sentences long, n_removed long, first_docs array<long>, text string")


# --- registered query ----------------------------------------------------------


def _listed(found):
    """The operator's rows, with the smallest of the documents that keep the removed runs."""
    return found.select("doc_id", F.array_min("first_docs").alias("first_doc"), "n_sentences", "n_removed", "text")


def op4_span_dedup(spark, sf_dir):
    """The operator's own rule: the runs that start at each sentence and those that end with it."""
    return _listed(span_dedup(table(spark, sf_dir, "documents")))


def op4_span_dedup_starts(spark, sf_dir):
    """With the runs that start at each sentence only."""
    return _listed(span_dedup(table(spark, sf_dir, "documents"), ends=False))


_PIECE = r"(?s).*?(?:[.!?][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*|\z)"
QUERIES = {"op4_span_dedup": op4_span_dedup, "op4_span_dedup_starts": op4_span_dedup_starts}
ORACLES = {"op4_span_dedup_starts": rf"""
    WITH d AS (SELECT doc_id, ltrim(coalesce(text, ''), E' \t\n\x0B\f\r') AS body, coalesce(text, '') AS whole FROM documents),
    p AS (SELECT doc_id, list_filter(regexp_extract_all(body, '{_PIECE}'), lambda x: x <> '') AS pieces,
                 substr(whole, 1, length(whole) - length(body)) AS head FROM d),
    s AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM p),
    w AS (SELECT doc_id, i, piece, rtrim(piece, E' \t\n\x0B\f\r') AS sent,
                 len(list_filter(regexp_split_to_array(piece, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM s),
    c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
    lists AS (SELECT doc_id, list(sent ORDER BY i) AS sents FROM w GROUP BY doc_id),
    goal AS (SELECT *, greatest(upto - n + {RUN_WORDS}, upto + 1) AS target FROM c),
    r AS (SELECT g.doc_id, g.i, e.i AS j, array_to_string(sents[g.i + 1 : e.i + 1], chr(1)) AS run
          FROM goal g ASOF JOIN c e ON g.doc_id = e.doc_id AND g.target <= e.upto JOIN lists l ON l.doc_id = g.doc_id),
    f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth, min(doc_id) OVER (PARTITION BY run) AS first FROM r),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE nth > 1),
    firsts AS (SELECT doc_id, min(first) AS first_doc FROM f WHERE nth > 1 GROUP BY doc_id)
    SELECT w.doc_id, count(*) AS n_sentences, count(gone.i) AS n_removed, any_value(first_doc) AS first_doc,
           any_value(head) || coalesce(string_agg(piece, '' ORDER BY w.i) FILTER (gone.i IS NULL), '') AS text
    FROM w JOIN firsts USING (doc_id) JOIN p USING (doc_id) LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY w.doc_id""", "op4_span_dedup": rf"""
    WITH d AS (SELECT doc_id, ltrim(coalesce(text, ''), E' \t\n\x0B\f\r') AS body, coalesce(text, '') AS whole FROM documents),
    p AS (SELECT doc_id, list_filter(regexp_extract_all(body, '{_PIECE}'), lambda x: x <> '') AS pieces,
                 substr(whole, 1, length(whole) - length(body)) AS head FROM d),
    s AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM p),
    w AS (SELECT doc_id, i, piece, rtrim(piece, E' \t\n\x0B\f\r') AS sent,
                 len(list_filter(regexp_split_to_array(piece, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM s),
    c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
    lists AS (SELECT doc_id, list(sent ORDER BY i) AS sents FROM w GROUP BY doc_id),
    goal AS (SELECT *, greatest(upto - n + {RUN_WORDS}, upto + 1) AS target FROM c),
    -- A run that ends with j starts at the last sentence with enough words from there on, j - 1 at the latest.
    back AS (SELECT doc_id, i AS j, least(upto - {RUN_WORDS}, lag(upto - n) OVER (PARTITION BY doc_id ORDER BY i)) AS target FROM c QUALIFY i > 0),
    starts AS (SELECT doc_id, i, upto - n AS before FROM c),
    places AS (SELECT g.doc_id, g.i, e.i AS j FROM goal g ASOF JOIN c e ON g.doc_id = e.doc_id AND g.target <= e.upto
               UNION SELECT b.doc_id, e.i, b.j FROM back b ASOF JOIN starts e ON b.doc_id = e.doc_id AND b.target >= e.before),
    r AS (SELECT doc_id, i, j, array_to_string(sents[i + 1 : j + 1], chr(1)) AS run FROM places JOIN lists USING (doc_id)),
    f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth, min(doc_id) OVER (PARTITION BY run) AS first FROM r),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE nth > 1),
    firsts AS (SELECT doc_id, min(first) AS first_doc FROM f WHERE nth > 1 GROUP BY doc_id)
    SELECT w.doc_id, count(*) AS n_sentences, count(gone.i) AS n_removed, any_value(first_doc) AS first_doc,
           any_value(head) || coalesce(string_agg(piece, '' ORDER BY w.i) FILTER (gone.i IS NULL), '') AS text
    FROM w JOIN firsts USING (doc_id) JOIN p USING (doc_id) LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY w.doc_id"""}
