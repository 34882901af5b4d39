"""Licence scan: ordered signature rules, keyword prefilter, suppression of contained detections.

Words are runs of ``[0-9a-z]`` and characters outside ASCII after lower-casing A-Z. A text is
matched against a rule only if it contains the rule's keyword. Of two detections,
one inside the other's interval is suppressed when the other has the higher priority, or
the same and a longer interval or (on equal intervals) an earlier rule.

Edge cases: null or empty text has no words and no detections, score 0 and null positions. Repeated
rows are scanned each. An empty table gives an empty result. Extra columns are ignored.
Every document is scanned whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from campuspulse.llm.common import ids_and_text, table
from campuspulse.llm.license_rules import BASE, RULES
from campuspulse.llm.textbytes import alnum_spans, lowered, slices

_DETECTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("priority", pa.int32())])
_RESULT = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_DETECTION)]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
# The longest word of each base phrase and rule keyword: a text with none of them can match nothing.
_GATE = re.compile("|".join(sorted({max(k, key=len) for k in [*BASE, *(r.keyword.split() for r in RULES)]})).encode())
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a base phrase's words stand one after another."""
    joined = f" {' '.join(words)} "
    starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    places = []
    for phrase, label in BASE.items():
        needle = f" {' '.join(phrase)} "
        at = joined.find(needle)
        while at >= 0:
            places.append((bisect_left(starts, at), label))
            at = joined.find(needle, at + 1)
    return sorted(places)


def detect(words: list[str]) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) that remain, by word numbers, end exclusive."""
    text = " ".join(words)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    found = []
    for rule in RULES:
        if rule.keyword in text:
            for m in rule.regex.finditer(text):
                first = bisect_left(starts, m.start())
                found.append((first, first + m[0].count(" ") + 1, rule))
    # Stronger first; equal intervals keep the strongest rule. A detection stays unless a stronger one holds it.
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[2].order))
    kept: list[tuple] = []
    for start, end, rule in found:
        if not any(a <= start and end <= b for a, b, _ in kept):
            kept.append((start, end, rule))
    return sorted((s, e, r.label, r.priority) for s, e, r in kept)


_WEIGHTS = {r.priority: r.weight for r in RULES}


def _scan_text(raw: bytes):
    text = raw.lower().decode()
    words = _WORD.findall(text)
    places, detections = base_places(words), detect(words)
    doubt = 1.0
    for *_, priority in detections:
        doubt *= 1 - _WEIGHTS[priority]
    if places:
        doubt *= 0.05
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(d[2] for d in detections)})
    first, last = (places[0][0], max(p for p, _ in places)) if places else (None, None)
    fields = [dict(zip(("start", "end", "label", "priority"), d)) for d in detections]
    return len(places), first, last, ",".join(base), ",".join(labels), round(1 - doubt, 6), fields


@arrow_udf(from_arrow_type(pa.struct(list(zip(_NAMES, _RESULT)))))
def scan_text(texts: pa.Array) -> pa.Array:
    rows = []
    for _, _, raw, offs in slices(texts):
        counts = alnum_spans(lowered(raw), offs)[2].tolist()
        data, edges = raw.tobytes(), offs.tolist()
        for i, n in enumerate(counts):
            piece = data[edges[i]: edges[i + 1]]
            rest = _scan_text(piece) if _GATE.search(piece.lower()) else (0, None, None, "", "", 0.0, [])
            rows.append((n, *rest))
    columns = zip(*rows) if rows else [[] for _ in _NAMES]
    return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(map(list, columns), _RESULT)], names=_NAMES)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document with the scan's columns; ``detections`` are the intervals that remain."""
    return ids_and_text(docs).select("doc_id", scan_text("text").alias("s")).select("doc_id", "s.*")


def op9_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES: dict[str, str] = {}
