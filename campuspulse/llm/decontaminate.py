"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Items are short and documents long, so similarity of whole sets says nothing;
what counts is how much of an item a document contains. Hashing every shingle once and keeping the
smallest values gives a MinHash sketch of an item. Items are partitioned by the number of their
shingles; each partition has its own sketch length, set by its largest item: so many that some shingle of the sketch must
occur in any document that contains the threshold's share of an item (``n - ceil(t * n) + 1``), so the search loses nothing.
Documents are probed partition by partition, except by those whose items are too large for the document to contain; each hit is verified by
counting the item's distinct shingles, as word sequences, in the document. Items with fewer words than a shingle have partitions of their own, one for
each number of words: documents are probed with runs of that many words and contain such an item where its words stand one after another.

The benchmark is a query set: it is read in blocks of at most ``BLOCK_SHINGLES`` shingles, and a block's sketches and
items go to the executors, so what is sent is bounded at any size of benchmark or corpus. Documents are never shuffled.

Edge cases: null text or item is empty and matches nothing. An item with fewer words than a shingle counts as one
shingle, its whole sequence. Items repeated under several ids match under each;
items with a null id are matched and reported with a null id. Repeated rows are reported each. An empty
table on either side gives no matches. Extra columns of documents are kept by ``drop_contaminated`` and ignored by ``matches``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from campuspulse.llm.common import ids_and_text, table
from campuspulse.llm.textbytes import SHINGLE_WORDS, lowered, shingle_sets, slices, spans

THRESHOLD = 0.75
BLOCK_SHINGLES = 200_000
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int32()), ("n_found", pa.int32())]))


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """Shingles of an item's sketch: any set with ``threshold`` of the item's ``n`` holds at least one of them."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def words_of(raw: bytes) -> list[bytes]:
    low = lowered(np.frombuffer(raw, np.uint8))
    start, end, _ = spans(low, np.array([0, len(low)]))
    data = low.tobytes()
    return [data[a:b] for a, b in zip(start.tolist(), end.tolist())]


def word_shingles(words: list[bytes], k: int = SHINGLE_WORDS) -> set[bytes]:
    """Distinct runs of ``k`` words; words hold no blanks, so joining by one keeps sequences apart."""
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i: i + k]) for i in range(len(words) - k + 1)}


class Partition:
    """Sketch values of items of similar size, with the least number of shingles of a document that can contain one."""

    def __init__(self, sketches: list[np.ndarray], items: list[int], least: int):
        keys, owner = np.concatenate(sketches), np.repeat(items, [len(s) for s in sketches])
        order = np.argsort(keys, kind="stable")
        self.keys, self.items, self.least = keys[order], owner[order], least
        self.gate = np.zeros(1 << 16, bool)
        self.gate[keys >> np.uint64(48)] = True

    def hits(self, hashes: np.ndarray, owners: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        pairs: set[tuple[int, int]] = set()
        near = np.flatnonzero(self.gate[hashes >> np.uint64(48)] & (sizes[owners] >= self.least))
        low, high = (np.searchsorted(self.keys, hashes[near], side) for side in ("left", "right"))
        for at in np.flatnonzero(high > low):
            pairs.update((int(owners[near[at]]), int(j)) for j in self.items[low[at]: high[at]])
        return pairs


class Block:
    """Sketches and shingles of a bounded number of items."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float):
        self.threshold = threshold
        words = [words_of((t or "").encode()) for _, t in items]
        self.items = [(i, word_shingles(w)) for (i, _), w in zip(items, words)]
        self.short = [b" " + b" ".join(w) + b" " if 0 < len(w) < SHINGLE_WORDS else None for w in words]
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        groups: dict[int, list[tuple[np.ndarray, int]]] = {}
        runs: dict[int, list[tuple[np.ndarray, int]]] = {}
        at = 0
        for first, end, raw, offs in slices(texts):
            hashes, owners, _ = shingle_sets(raw, offs)
            for i in range(end - first):
                own = hashes[owners == i]
                if len(own) and not self.short[at + i]:
                    groups.setdefault(len(own).bit_length(), []).append((own, at + i))
            for k in sorted({len(w) for w in words[at: at + end - first] if 0 < len(w) < SHINGLE_WORDS}):
                hashes, owners, counts = shingle_sets(raw, offs, k)
                for h, i in zip(hashes, owners):
                    if counts[i] == k:
                        runs.setdefault(k, []).append((np.array([h]), at + int(i)))
            at += end - first
        self.partitions = []
        for size in sorted(groups):
            held = groups[size]
            length = sketch_size(max(len(h) for h, _ in held), threshold)
            least = math.ceil(threshold * min(len(h) for h, _ in held) - 1e-9)
            # shingle_sets sorts by hash, so the sketch is the first part of a set
            self.partitions.append(Partition([h[:length] for h, _ in held], [i for _, i in held], least))
        self.runs = {k: Partition([h for h, _ in held], [i for _, i in held], 1) for k, held in runs.items()}

    def candidates(self, raw: np.ndarray, offs: np.ndarray) -> set[tuple[int, int]]:
        """(text number, item number) pairs that share a sketch value."""
        pairs: set[tuple[int, int]] = set()
        for words, partitions in [(SHINGLE_WORDS, self.partitions), *((k, [p]) for k, p in self.runs.items())]:
            if partitions:
                hashes, owners, _ = shingle_sets(raw, offs, words)
                sizes = np.bincount(owners, minlength=len(offs) - 1)
                for p in partitions:
                    pairs |= p.hits(hashes, owners, sizes)
        return pairs

    def verified(self, raw: bytes, items: list[int]) -> list[dict]:
        words = words_of(raw)
        own = word_shingles(words)
        joined = b" " + b" ".join(words) + b" "
        found = []
        for j in items:
            item_id, wanted = self.items[j]
            n = int(self.short[j] in joined) if self.short[j] else len(wanted & own)
            if n and n >= self.threshold * len(wanted) - 1e-9:
                found.append({"item_id": item_id, "n_item": len(wanted), "n_found": n})
        return found


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of bounded size; the driver holds one at a time."""
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t) // 2 + 1
        if size >= BLOCK_SHINGLES:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches_in(spark, items: list[tuple[int | None, str]], threshold: float = THRESHOLD):
    """A column function: the items of one block that a text contains."""
    shared = spark.sparkContext.broadcast(Block(items, threshold))

    @arrow_udf(from_arrow_type(_MATCH))
    def find(texts: pa.Array) -> pa.Array:
        block, out = shared.value, []
        for first, end, raw, offs in slices(texts):
            wanted: dict[int, list[int]] = {}
            for i, j in sorted(block.candidates(raw, offs)):
                wanted.setdefault(i, []).append(j)
            data = raw.tobytes() if wanted else b""
            out += [block.verified(data[offs[i]: offs[i + 1]], wanted[i]) if i in wanted else [] for i in range(end - first)]
        return pa.array(out, _MATCH)

    return find


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_found): one row per document and item it contains by ``threshold`` or more."""
    spark, rows, found = docs.sparkSession, ids_and_text(docs), None
    for block in blocks(items):
        part = rows.select("doc_id", F.explode(matches_in(spark, block, threshold)("text")).alias("m")).select("doc_id", "m.*")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, item_id long, n_item int, n_found int")
    return found


def is_contaminated(spark, items: DataFrame, text: Column, threshold: float = THRESHOLD) -> Column:
    """Whether a text contains any item."""
    hit = F.lit(False)
    for block in blocks(items):
        hit = hit | (F.size(matches_in(spark, block, threshold)(text)) > 0)
    return hit


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that contain no item, with all their columns, filtered where they are."""
    return docs.where(~is_contaminated(docs.sparkSession, items, F.coalesce(F.col("text"), F.lit("")), threshold))


# --- registered query ----------------------------------------------------------


def op10_decontaminate(spark, sf_dir):
    """Contaminated documents and the items they contain; documents not listed are clean."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SETS = r"""
    {name}_words AS (
        SELECT {id} AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {name}),
    {name}_sets AS (
        SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM {name}_words)"""
ORACLES = {"op10_decontaminate": f"""
    WITH {_SETS.format(name='documents', id='doc_id')}, {_SETS.format(name='benchmark', id='item_id')},
    sizes AS (SELECT id, count(*) AS n FROM benchmark_sets GROUP BY id),
    short AS (SELECT id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM benchmark_words WHERE len(w) BETWEEN 1 AND 4)
    SELECT d.id AS doc_id, b.id AS item_id, 1 AS n_item, 1 AS n_found FROM documents_words d JOIN short b ON contains(' ' || array_to_string(d.w, ' ') || ' ', b.s)
    UNION ALL SELECT d.id AS doc_id, b.id AS item_id, CAST(any_value(n) AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_found
    FROM documents_sets d JOIN benchmark_sets b USING (s) JOIN sizes ON sizes.id = b.id
    WHERE b.id NOT IN (SELECT id FROM short WHERE id IS NOT NULL)
    GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * any_value(n)"""}
QUERIES = {"op10_decontaminate": op10_decontaminate}
