"""Fill-in-middle: texts are cut at two unit ends and their parts reordered behind sentinels.

A wavelet matrix over the character classes of a slice of texts (plain, line end, space, sentence end, continuation
byte of UTF-8) answers rank queries. Ranks of the classes that end a unit add up to a boundary count, bisection on that count finds
the place after any number of units, and the rank of continuation bytes turns places into code points. Units are lines, words (up to and with
one space or line end) or sentences (up to and with one mark of ``.!?`` or line end); what follows the last unit end is a unit of its own.

Cuts and form come from a hash of seed and doc_id, so every run gives the same result. The prefix ends after ``min`` and the middle after
``max`` of two hash values modulo units + 1. Forms: ``psm`` is prefix, suffix, middle; ``spm`` is suffix, prefix, middle; ``plain`` is the text.

Edge cases: null text is empty. Empty texts and texts that contain a sentinel stay plain, with null part lengths; so do texts whose hash
lies beyond ``rate``. A null doc_id hashes like an empty one. Repeated rows give the same output each. An empty table gives an empty result;
extra columns are ignored. Texts are worked on whole, in slices of whole texts, where they are read: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from campuspulse.llm.common import ids_and_text, table
from campuspulse.llm.textbytes import slices

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = tuple(s.encode() for s in (PREFIX, SUFFIX, MIDDLE))

PLAIN_CHAR, LINE_END, SPACE, SENTENCE_END, CONTINUATION = range(5)
CLASS_BITS = 3
UNITS = {"line": (LINE_END,), "word": (LINE_END, SPACE), "sentence": (LINE_END, SENTENCE_END)}
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x0A] = LINE_END
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
_CLASS[[ord(c) for c in ".!?"]] = SENTENCE_END
_CLASS[0x80:0xC0] = CONTINUATION


@dataclass(frozen=True)
class Transform:
    """``rate`` and ``spm`` are percentages: of texts that are cut, and of cut texts in the form ``spm``."""

    unit: str = "line"
    seed: int = 7
    rate: int = 100
    spm: int = 50


# --- ranks --------------------------------------------------------------------------------


class RankBits:
    """A bit vector in words of 64 bits with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Symbols of ``bits`` bits, one bit vector a level from the highest bit; each level sorts the next one stably by its bit."""

    def __init__(self, symbols: np.ndarray, bits: int = CLASS_BITS):
        self.size, self.levels = len(symbols), []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1 > 0
            zeros = symbols[~bit]
            self.levels.append((level, RankBits(bit), len(zeros)))
            symbols = np.concatenate([zeros, symbols[bit]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands among the first ``at`` places."""
        first, end = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for level, ones, zeros in self.levels:
            a, b = ones.ones(first), ones.ones(end)
            first, end = (zeros + a, zeros + b) if symbol >> level & 1 else (first - a, end - b)
        return end - first

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` places hold one of the symbols."""
        return sum(self.rank(s, at) for s in symbols)

    def after(self, symbols: tuple[int, ...], k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least place in [low, high] with ``k`` of the symbols before it; ``high`` where there is none."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.count(symbols, middle) >= k
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return high


# --- texts --------------------------------------------------------------------------------


def hash_groups(seed: int, ids: list) -> np.ndarray:
    """(rows x 4): the first four groups of eight hex digits of the SHA-256 of ``seed:doc_id``."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


def cut(raw: np.ndarray, offs: np.ndarray, hashes: np.ndarray, how: Transform):
    """(units, form, prefix end, middle end, prefix code points, middle code points) of each text; ends are byte places in ``raw``."""
    ends = UNITS[how.unit]
    matrix = WaveletMatrix(_CLASS[raw])
    start, stop = offs[:-1], offs[1:]
    filled = stop > start
    before = matrix.count(ends, start)
    closed = matrix.count(ends, stop) - before
    is_end = np.isin(_CLASS[raw], ends)
    open_end = np.zeros(len(start), bool)
    open_end[filled] = ~is_end[stop[filled] - 1]
    units = closed + open_end
    picks = hashes[:, :2] % (units + 1)[:, None]
    places = []
    for k in (picks.min(axis=1), picks.max(axis=1)):
        places.append(matrix.after(ends, before + k, start, stop))
    body = raw.tobytes()
    held = np.array([any(s in body[a:b] for s in SENTINELS) for a, b in zip(start.tolist(), stop.tolist())], bool)
    plain = ~filled | held | (hashes[:, 2] % 100 >= how.rate)
    form = np.where(plain, "plain", np.where(hashes[:, 3] % 100 < how.spm, "spm", "psm"))

    def points(at: np.ndarray) -> np.ndarray:
        return at - matrix.rank(CONTINUATION, at)

    first, second = places
    return units, form, first, second, points(first) - points(start), points(second) - points(first)


_RESULT = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
_NAMES = ["n", "form", "prefix_chars", "middle_chars", "output"]


def _transformed(how: Transform):
    @arrow_udf(from_arrow_type(pa.struct(list(zip(_NAMES, _RESULT)))))
    def transform(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [[] for _ in _NAMES]
        hashes = hash_groups(how.seed, ids.to_pylist())
        p, s, m = SENTINELS
        for a, b, raw, offs in slices(texts):
            units, form, first, second, prefix, middle = cut(raw, offs, hashes[a:b], how)
            body = raw.tobytes()
            for i, (x, f, y, z) in enumerate(zip(offs.tolist(), form.tolist(), first.tolist(), second.tolist())):
                end = int(offs[i + 1])
                if f == "plain":
                    rows[4].append(body[x:end])
                elif f == "psm":
                    rows[4].append(b"".join((p, body[x:y], s, body[z:end], m, body[y:z])))
                else:
                    rows[4].append(b"".join((s, body[z:end], p, body[x:y], m, body[y:z])))
            rows[0] += units.tolist()
            rows[1] += form.tolist()
            whole = form == "plain"
            rows[2] += np.where(whole, None, prefix).tolist()
            rows[3] += np.where(whole, None, middle).tolist()
        columns = [pa.array(r, pa.binary()).cast(t) if t == pa.string() and n == "output" else pa.array(r, t) for r, n, t in zip(rows, _NAMES, _RESULT)]
        return pa.StructArray.from_arrays(columns, names=_NAMES)

    return transform


def fill_in_middle(docs: DataFrame, how: Transform = Transform()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output: one row per document."""
    if how.unit not in UNITS:
        raise ValueError(how.unit)
    rows = ids_and_text(docs)
    return rows.select("doc_id", _transformed(how)("doc_id", "text").alias("f")).select("doc_id", "f.*")


def restored(output: Column, form: Column) -> Column:
    """The text of an output: parts between sentinels in their old order. No part holds a sentinel, and none arises where parts meet."""
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    middle = F.substring(output, m + 3, F.char_length(output))
    psm = F.concat(F.substring(output, F.lit(4), s - 4), middle, F.substring(output, s + 3, m - s - 3))
    spm = F.concat(F.substring(output, p + 3, m - p - 3), middle, F.substring(output, F.lit(4), p - 4))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark, sf_dir):
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op13_fill_in_middle": r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS g FROM t),
    c AS (SELECT *, len(units) AS n, least(g[1] % (len(units) + 1), g[2] % (len(units) + 1)) AS a, greatest(g[1] % (len(units) + 1), g[2] % (len(units) + 1)) AS b,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 100 THEN 'plain'
                      WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p"""}
