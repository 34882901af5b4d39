"""Personal data: spans by fixed patterns, and further spans chosen by gradient boosting among high-recall candidates.

Fixed patterns (``BASE``) give e-mail addresses, IP addresses, card and phone numbers; spans that fail their check are dropped and nothing
is tried again inside them. They always stay. Generators then propose overlapping candidates: numbers, tokens, assignments, written-out
addresses. Each candidate becomes a few binned features of its format and context. Labelling rules (the base checks, telling prefixes)
mark the candidates of all documents; boosted trees are fitted on the counts per bin combination of one half of the documents, by
id hash, calibrated on the other half, and accepted from a calibrated probability of ``TARGET`` on. An accepted candidate becomes a
span where no base span and no better candidate overlaps it.

All steps are column expressions. Positions come from the lengths of the pieces between matches; no document is moved or gathered.
The only rows that reach the driver are counts per bin combination, of which there are at most ``CELLS``.

Edge cases: null text is empty and has no spans. Positions count code points, ends are exclusive. Rows are independent, so null ids, repeated
rows and ties need no rule; equal scores prefer the earlier start, then the earlier kind. An empty table gives an empty result and no
model. Extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campuspulse.llm import boosting
from campuspulse.llm.common import ids_and_text, table, written

# Kinds and patterns of the base contract: fixed values, in forms that never backtrack into a run.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "number": r"[+(]?[0-9](?:[\x20().-]?[0-9]){6,}+",
    "token": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
    "assignment": r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\x20?[=:]\x20?[^\x20\x09-\x0D]{4,}+",
    "contact": r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++",
}
# A cheap test that a text must pass before a pattern is tried on it.
_GATES = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": "[+][0-9]", "number": "[0-9]", "token": "[0-9]",
    "assignment": "[=:]", "contact": r"(?i)at[\])]",
}
KINDS = (*BASE, *GENERATORS)
_CONTEXT = r"(?i)(?:tel|phone|call|fax|mobile|card|visa|account|iban|mail|contact|login|user|pass|secret|token|key|addr|ssn|passport)[^\x0A]{0,12}$"
_TELLING = r"^(?:AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|eyJ)"

# Features with the number of their bins; a cell is one combination.
FEATURES = {"generator": 4, "digits": 6, "separators": 4, "letters": 3, "context": 2, "before": 4, "after": 3, "capitals": 2}
CELLS = math.prod(FEATURES.values())
TARGET = 0.9
_SPAN = "array<struct<kind:int,start:int,end:int>>"


# --- spans of a pattern -------------------------------------------------------------------


def _matches(text: Column, kind: str, regex: str) -> Column:
    """array of (start, end, m, before, after): leftmost non-overlapping matches with up to 24 characters before and one after."""
    pieces, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    rows = F.zip_with(pieces, found, lambda p, m: F.struct(F.char_length(p).alias("gap"), F.right(p, F.lit(24)).alias("before"), m.alias("m")))
    rows = F.filter(F.zip_with(rows, F.slice(pieces, 2, 2**30), lambda r, p: F.struct(
        r["gap"].alias("gap"), r["before"].alias("before"), r["m"].alias("m"), F.left(p, F.lit(1)).alias("after"))), lambda r: r["m"].isNotNull())
    kind_of_row = "struct<start:int,end:int,m:string,before:string,after:string>"
    none = F.array().cast(f"array<{kind_of_row}>")

    def step(acc, r):
        start = acc["at"] + r["gap"]
        end = start + F.char_length(r["m"])
        return F.struct(end.alias("at"), F.array_append(acc["rows"], F.struct(
            start.alias("start"), end.alias("end"), r["m"].alias("m"), r["before"].alias("before"), r["after"].alias("after"))).alias("rows"))

    start = F.struct(F.lit(0).alias("at"), none.alias("rows"))
    return F.when(text.rlike(_GATES[kind]), F.aggregate(rows, start, step, lambda acc: acc["rows"])).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))
    doubled = F.transform(F.split(digits, ""), lambda d, i: d.cast("int") * (1 + i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0))
    return total % 10 == 0


def _small_parts(m: Column) -> Column:
    plain = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))


_CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": _small_parts,
    "card": lambda m: F.when(F.length(_digits(m)).between(16, 19), _luhn(m)).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed, then start."""

    def spans(number: int, kind: str) -> Column:
        good = F.filter(_matches(text, kind, BASE[kind]), lambda r: _CHECKS[kind](r["m"]))
        return F.transform(good, lambda r: F.struct(F.lit(number).alias("kind"), r["start"].alias("start"), r["end"].alias("end")))

    return F.concat(*(spans(number, kind) for number, kind in enumerate(BASE)))


# --- candidates -----------------------------------------------------------------------------


def _bin(value: Column, edges: list[int]) -> Column:
    """How many edges the value reaches."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _cell(generator: int, r: Column) -> Column:
    m, digits = r["m"], F.length(_digits(r["m"]))
    letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    last, first = F.right(r["before"], F.lit(1)), r["after"]
    bins = {
        "generator": F.lit(generator),
        "digits": _bin(digits, [7, 10, 13, 16, 20]),
        "separators": _bin(F.char_length(m) - digits - letters, [1, 2, 3]),
        "letters": F.when(letters == 0, 0).when(2 * letters < F.char_length(m), 1).otherwise(2),
        "context": F.when(r["before"].rlike(_CONTEXT), 1).otherwise(0),
        "before": F.when(last.rlike(r"^\s*$"), 0).when(last.rlike(r"[+(]"), 1).when(last.rlike("[A-Za-z0-9]"), 3).otherwise(2),
        "after": F.when(first.rlike(r"^\s*$"), 0).when(first.rlike("[.,;:!?]"), 1).otherwise(2),
        "capitals": F.when(m.rlike("[A-Z]") & (digits > 0), 1).otherwise(0),
    }
    cell = F.lit(0)
    for name, size in FEATURES.items():
        cell = cell * size + bins[name]
    return cell


def _candidates(text: Column) -> Column:
    """array of (kind, start, end, cell, telling) from all generators."""

    def proposed(number: int, kind: str) -> Column:
        rows = _matches(text, kind, GENERATORS[kind])
        if kind == "token":
            rows = F.filter(rows, lambda r: r["m"].rlike("[0-9]") & r["m"].rlike("[A-Za-z]"))
        telling = {"number": lambda m: F.lit(False), "token": lambda m: m.rlike(_TELLING)}.get(kind, lambda m: F.lit(True))
        return F.transform(rows, lambda r: F.struct(
            F.lit(len(BASE) + number).alias("kind"), r["start"].alias("start"), r["end"].alias("end"),
            _cell(number, r).alias("cell"), telling(r["m"]).alias("telling")))

    return F.concat(*(proposed(number, kind) for number, kind in enumerate(GENERATORS)))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def proposals(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates) of every document, written: the texts are read once."""
    return written(ids_and_text(docs).select("doc_id", base_spans(F.col("text")).alias("base"), _candidates(F.col("text")).alias("candidates")), "spans")


# --- the model --------------------------------------------------------------------------------


def _bins_of(cells: np.ndarray) -> np.ndarray:
    out, rest = [], cells
    for size in reversed(FEATURES.values()):
        out.append(rest % size)
        rest = rest // size
    return np.column_stack(out[::-1]).astype(int) if len(cells) else np.zeros((0, len(FEATURES)), int)


def fit(found: DataFrame, target: float = TARGET) -> boosting.Forest:
    """Trees from the counts of all candidates: fitted on one half of the documents, calibrated on the other."""
    one = found.select(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0)).alias("half"), "base", F.explode_outer("candidates").alias("c"))
    label = F.col("c.telling") | F.exists("base", lambda b: _overlap(b, F.col("c")))
    rows = one.where("c is not null").groupBy("half", F.col("c.cell").alias("cell")).agg(
        F.sum(F.when(label, 1).otherwise(0)).alias("yes"), F.count("*").alias("n")).collect()
    halves = []
    for half in (0, 1):
        own = [r for r in rows if r.half == half]
        yes, n = np.array([r.yes for r in own], float), np.array([r.n for r in own], float)
        halves.append((_bins_of(np.array([r.cell for r in own], int)), yes, n - yes))
    forest = boosting.fit(*halves[0], list(FEATURES.values()))
    boosting.calibrate(forest, *halves[1], target)
    return forest


def _features(cell: Column) -> list[Column]:
    out, base = [], CELLS
    for size in FEATURES.values():
        base //= size
        out.append(F.floor(cell / base).cast("int") % size)
    return out


def chosen(forest: boosting.Forest, base: str = "base", candidates: str = "candidates") -> Column:
    """Accepted candidates that no base span and no better candidate overlaps, from the columns ``base`` and ``candidates``."""
    if math.isinf(forest.cut):
        return F.array().cast(_SPAN)
    scored = F.transform(candidates, lambda c: F.struct(
        forest.margin_column(_features(c["cell"])).alias("margin"), (-c["start"]).alias("early"), (-c["kind"]).alias("first"),
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    good = F.filter(scored, lambda c: c["margin"] >= forest.cut)
    # Best first; what overlaps something already taken goes. (margin, early, first) has no ties between different candidates.
    none = F.array().cast(_SPAN)

    def take(acc, c):
        taken = F.exists(acc, lambda t: _overlap(t, c)) | F.exists(base, lambda b: _overlap(b, c))
        return F.when(taken, acc).otherwise(F.array_append(acc, F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))

    return F.array_sort(F.aggregate(F.reverse(F.array_sort(good)), none, take))


def find(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind number in ``KINDS``, start, end), sorted by kind and start."""
    found = proposals(docs)
    return found.select("doc_id", "base", F.concat("base", chosen(fit(found, target))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, forest: boosting.Forest) -> DataFrame:
    """All columns, with every span of ``text`` replaced by ``<kind>``; overlapping spans are replaced once, under the first's kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("__pii_base", base_spans(text)).withColumn("__pii_candidates", _candidates(text))
    spans = F.array_sort(F.transform(F.concat("__pii_base", chosen(forest, "__pii_base", "__pii_candidates")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def step(acc, s):
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        piece = F.concat(acc["out"], between, F.get(names, s["kind"]))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(piece).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    kept = [done.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*kept)


# --- registered query ----------------------------------------------------------------------------


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op3_pii(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents"))
    counts = [_count("base", i).alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op3_pii": op3_pii}
ORACLES: dict[str, str] = {}
