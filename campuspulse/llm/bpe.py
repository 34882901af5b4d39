"""Byte-level BPE encoding and decoding with a lexicon automaton.

Words (pre-tokens) are cut by character class. The most frequent words of the whole corpus are compiled, with their token ids, into
a minimal acyclic transducer; each task maps the image and looks up the distinct words of a slice of texts at once.
Words that are not in the lexicon are merged exactly. The lexicon changes speed only, never a result.

``LEXICON_WORDS`` bounds the image (a few MB); counts behind it cover all documents and are reduced per task before the shuffle.

Edge cases: null text is empty and has no tokens. The strings of the vocabulary's special tokens become their ids, as the library
does by default. Invalid ids are ignored in decoding; ids whose bytes are not UTF-8 decode with replacement characters.
Repeated rows are encoded each; an empty table gives an empty result; extra columns are ignored by ``encode`` and ``digests``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from campuspulse.llm.bpe_lexicon import LETTER, OTHER, SPACE, Lexicon, char_classes, compile_image, lexicon, ragged
from campuspulse.llm.common import ids_and_text, most_frequent, table, text_of
from campuspulse.llm.textbytes import slices, span_hashes

LEXICON_WORDS = 30_000
COUNT_WORDS = 300_000
DECODE_IDS = 1_000_000
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


# --- words ----------------------------------------------------------------------------


def word_starts(points: np.ndarray, kind: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point; ``heads`` marks the first of each text."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    tail = np.append(heads[1:], True)
    blank, space = kind == SPACE, points == 0x20
    before = np.append(OTHER + 1, kind[:-1]).astype(np.uint8)
    change = heads | (before != kind)
    space_before = np.append(False, space[:-1]) & ~heads
    start = np.where(blank, change, change & ~space_before)
    # The last blank before a word stands alone, or is the space that belongs to it.
    last_blank = blank & ~tail & np.append(~blank[1:], False)
    start |= last_blank
    # 's 't 'm 'd 're 've 'll, unless a space or another sign stands before them.
    quote = np.flatnonzero((points == 0x27) & start & ~tail)
    if len(quote):
        ahead = np.append(points, [0, 0]).astype(np.int64)
        one, two = ahead[quote + 1], ahead[quote + 2]
        inside = ~np.append(heads, [True, True])[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = inside & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for at, size in ((quote[short], 2), (quote[long], 3)):
            for j in range(1, size):
                start[at + j] = False
            rest = at + size
            rest = rest[rest < n]
            start[rest[(kind[rest] == LETTER) & ~heads[rest]]] = True
    return start


def words(raw: np.ndarray, offs: np.ndarray, classes: np.ndarray, special: list[tuple[bytes, int]]):
    """(start, end, special id or -1, words per text) of all words, as byte spans."""
    cuts = offs
    fixed = {}
    data = raw.tobytes()
    present = [s for s in special if s[0] in data]
    if present:
        ids = dict(present)
        for m in re.finditer(b"|".join(re.escape(s) for s, _ in present), data):
            owner = np.searchsorted(offs, m.start(), "right") - 1
            if m.end() <= offs[owner + 1]:
                fixed[m.start()] = (m.end(), ids[m[0]])
        cuts = np.unique(np.concatenate([offs, np.array([p for a, (b, _) in fixed.items() for p in (a, b)], np.int64)]))
    points = np.frombuffer(data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    position = np.concatenate([[0], np.cumsum(width)])
    heads = np.zeros(len(points) + 1, bool)
    heads[np.searchsorted(position, cuts)] = True
    start = position[:-1][word_starts(points, classes[points], heads[:-1])]
    special_id = np.full(len(start), -1, np.int64)
    if fixed:
        inside = np.zeros(len(raw) + 1, bool)
        for a, (b, _) in fixed.items():
            inside[a + 1: b] = True
        keep = ~inside[start]
        start, special_id = start[keep], special_id[keep]
        at = np.searchsorted(start, sorted(fixed))
        special_id[at] = [fixed[a][1] for a in sorted(fixed)]
    end = np.append(start[1:], len(raw))
    return start, end, special_id, np.diff(np.searchsorted(start, offs))


# --- encoding and decoding --------------------------------------------------------------


def encode_slice(lex: Lexicon, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all texts, offsets of each text into them)"""
    start, end, special_id, per_text = words(raw, offs, lex.classes, lex.special)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
    _, first, back = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
    s, e = start[first], end[first]
    slot = lex.slots(raw, s, e)
    known, other = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
    ids, counts = lex.merged(raw, s[other], e[other])
    # The ids of distinct words: those of the lexicon, then the merged ones.
    size = np.zeros(len(s), np.int64)
    size[known] = lex.slot_offs[slot[known] + 1] - lex.slot_offs[slot[known]]
    size[other] = counts
    at = np.zeros(len(s), np.int64)
    at[known] = lex.slot_offs[slot[known]]
    at[other] = len(lex.slot_ids) + np.cumsum(counts) - counts
    pool = np.concatenate([lex.slot_ids, ids])
    at, size = at[back], size[back]
    if (special_id >= 0).any():
        which = np.flatnonzero(special_id >= 0)
        at[which], size[which] = len(pool) + np.arange(len(which)), 1
        pool = np.concatenate([pool, special_id[which].astype(np.int32)])
    upto = np.concatenate([[0], np.cumsum(size)])
    return pool[ragged(at, size)], upto[np.concatenate([[0], np.cumsum(per_text)])]


def decode_slice(lex: Lexicon, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text into them)"""
    ok = (ids >= 0) & (ids < len(lex.token_offs) - 1)
    safe = np.where(ok, ids, 0)
    size = np.where(ok, lex.token_offs[safe + 1] - lex.token_offs[safe], 0)
    upto = np.concatenate([[0], np.cumsum(size)])
    return lex.token_bytes[ragged(lex.token_offs[safe], size)], upto[offs]


def _encoder(image: str):
    @arrow_udf(from_arrow_type(pa.list_(pa.int32())))
    def encode_texts(texts: pa.Array) -> pa.Array:
        lex, parts = lexicon(image), []
        for _, _, raw, offs in slices(texts):
            ids, edges = encode_slice(lex, raw, offs)
            parts.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode_texts


def _decoder(image: str):
    @arrow_udf(from_arrow_type(pa.string()))
    def decode_ids(lists: pa.Array) -> pa.Array:
        lex, out = lexicon(image), []
        offs, values = lists.offsets.to_numpy(), pc.fill_null(lists.values, -1).to_numpy().astype(np.int64)
        at = 0
        while at < len(lists):
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + DECODE_IDS, "right")) - 1)
            raw, ends = decode_slice(lex, values[offs[at]: offs[end]], offs[at: end + 1] - offs[at])
            data, ends = raw.tobytes(), ends.tolist()
            out += [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            at = end
        return pa.array(out, pa.string())

    return decode_ids


_DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digester(image: str):
    """Digests of the ids and of the text decoded from them, without moving the ids out of the task."""

    @arrow_udf(from_arrow_type(_DIGEST))
    def digest_texts(texts: pa.Array) -> pa.Array:
        lex, rows = lexicon(image), []
        for _, _, raw, offs in slices(texts):
            ids, edges = encode_slice(lex, raw, offs)
            back, ends = decode_slice(lex, ids.astype(np.int64), edges)
            data, text, edges, ends = ids.astype("<u4").tobytes(), back.tobytes(), edges.tolist(), ends.tolist()
            for i in range(len(offs) - 1):
                decoded = text[ends[i]: ends[i + 1]].decode("utf-8", "replace").encode()
                rows.append((edges[i + 1] - edges[i], hashlib.sha256(data[4 * edges[i]: 4 * edges[i + 1]]).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        columns = zip(*rows) if rows else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _DIGEST)], fields=list(_DIGEST))

    return digest_texts


# --- the lexicon's words ----------------------------------------------------------------


_classes: list[np.ndarray] = []


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _classes:
        _classes.append(char_classes())
    seen: dict[bytes, int] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for _, _, raw, offs in slices(batch["text"]):
            start, end, _, _ = words(raw, offs, _classes[0], [])
            _, first, n = np.unique(span_hashes(raw, start, end), return_index=True, return_counts=True)
            data = raw.tobytes()
            for a, b, k in zip(start[first].tolist(), end[first].tolist(), n.tolist()):
                word = data[a:b]
                seen[word] = seen.get(word, 0) + k
            if len(seen) >= COUNT_WORDS:
                yield flush()
    if seen:
        yield flush()


def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all documents; their number, hence what the driver gets, is bounded by ``limit``."""
    counts = ids_and_text(docs).select("text").mapInArrow(_count_words, "word binary, n long")
    top = most_frequent(counts.groupBy("word").agg(F.sum("n").alias("n")), limit, "word-counts")
    return sorted(bytes(r.word) for r in top.select("word").collect())


def prepare(docs: DataFrame, vocabulary: str | None = None, limit: int = LEXICON_WORDS) -> str:
    """Compile the lexicon of a corpus and hand it to the executors; returns the image's name."""
    spark = docs.sparkSession
    image = compile_image(vocabulary or vocabulary_path(), frequent_words(docs, limit))
    spark.sparkContext.addFile(f"{SparkFiles.getRootDirectory()}/{image}")
    return image


def encoded(image: str, text: Column) -> Column:
    return _encoder(image)(text)


def decoded(image: str, ids: Column) -> Column:
    return _decoder(image)(ids)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens), one row per document."""
    image = prepare(docs, vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), encoded(image, text_of()).alias("ids"))
    return rows.withColumn("n_tokens", F.size("ids").cast("long"))


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, one row per document."""
    image = prepare(docs, vocabulary)
    return ids_and_text(docs).select("doc_id", _digester(image)("text").alias("d")).select("doc_id", "d.*")


def op5_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {}
