"""Exact duplicates by lookups in a minimal perfect hash over known digests.

The known (historical) distinct digests are dealt into shards by their own
bits. Each shard is one row of a Parquet table: the bit levels of a minimal
perfect hash, and slots with the full digest, the locator of the winning row
and the group size. A lookup hashes a digest to its slot and compares all 32
bytes; equal bytes mean a repeat, which joins that group. Digests without an
equal slot form groups among themselves.

Edge cases: null text is empty text; empty texts are equal to each other. Of
equal texts the one with the most code points stays, then the smallest doc_id
(null ids last), then the row read first, so of repeated rows exactly one stays.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campuspulse.llm.common import ids_and_text, table, written
from campuspulse.llm.textbytes import mix

SHARD_KEYS = 50_000
LEVEL_SLACK = 1.6
GROUPS = "shard int, digest binary, keep_id long, keep_row long, group_size long"
INDEX = "shard int, sizes array<int>, bits binary, digests binary, ids array<long>, rows array<long>, lengths array<long>, counts array<long>"
_BLANKS = r"[\x20\x09-\x0D]+"


# --- the hash of one shard -------------------------------------------------


def _words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 4)


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = np.uint64((level + 1) * 0xD1B54A32D192ED03 % 2**64)
    for j in range(4):
        h = mix(keys[:, j] ^ h)
    return (h % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(size of each level, bits of all levels): a key owns the first level's bit that no other key of that level hits."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = max(8, int(len(left) * LEVEL_SLACK))
        pos = _positions(left, len(sizes), size)
        alone = np.bincount(pos, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[pos]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots_of(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where every level says no. A foreign key may get any slot: compare its bytes."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    slot = np.full(len(keys), -1, np.int64)
    left, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + _positions(keys[left], level, size)
        hit = bits[at]
        slot[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return slot


# --- shards as table rows ---------------------------------------------------


def _shard_row(group: pa.Table) -> pa.Table:
    digests = b"".join(group["digest"].to_pylist())
    keys = _words(digests)
    sizes, bits = build_hash(keys)
    at = np.argsort(slots_of(keys, sizes, bits))
    take = pa.array(at)
    cols = {
        "shard": [group["shard"][0].as_py()], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()],
        "digests": [keys[at].tobytes()],
    }
    for name, source in (("ids", "doc_id"), ("rows", "row_id"), ("lengths", "n_chars"), ("counts", "n")):
        cols[name] = [group[source].combine_chunks().take(take).to_pylist()]
    kinds = {"shard": pa.int32(), "sizes": pa.list_(pa.int32()), "bits": pa.binary(), "digests": pa.binary()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.list_(pa.int64()))) for k, v in cols.items()})


def _merge(known: pa.Table, batch: pa.Table) -> pa.Table:
    """All groups of one shard: known slots, updated by the batch digests that match byte for byte, and the rest."""
    shard = (known if known.num_rows else batch)["shard"][0].as_py()
    fields = ("doc_id", "row_id", "n_chars", "n")
    new = {f: batch[f].to_pylist() for f in fields}
    digests = batch["digest"].to_pylist()
    slot, member = np.full(len(digests), -1), np.zeros(len(digests), bool)
    old = {f: [] for f in fields}
    kept: list[bytes] = []
    if known.num_rows:
        row = {c: known[c][0].as_py() for c in known.column_names}
        own = _words(row["digests"])
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["sizes"])].astype(bool)
        keys = _words(b"".join(digests))
        slot = slots_of(keys, row["sizes"], bits)
        member = slot >= 0
        member[member] = (own[slot[member]] == keys[member]).all(axis=1)
        old = {"doc_id": row["ids"], "row_id": row["rows"], "n_chars": row["lengths"], "n": row["counts"]}
        kept = [row["digests"][i: i + 32] for i in range(0, len(row["digests"]), 32)]
    for i in range(len(digests)):
        if not member[i]:
            kept.append(digests[i])
            for f in fields:
                old[f].append(new[f][i])
            continue
        s = slot[i]
        old["n"][s] += new["n"][i]
        rank = [(-x["n_chars"][j], x["doc_id"][j] is None, x["doc_id"][j] or 0, x["row_id"][j]) for x, j in ((old, s), (new, i))]
        if rank[1] < rank[0]:
            for f in fields[:3]:
                old[f][s] = new[f][i]
    return pa.table({
        "shard": pa.array([shard] * len(kept), pa.int32()), "digest": pa.array(kept, pa.binary()),
        "keep_id": pa.array(old["doc_id"], pa.int64()), "keep_row": pa.array(old["row_id"], pa.int64()),
        "group_size": pa.array(old["n"], pa.int64()),
    })


# --- the operator -------------------------------------------------------------


def digest_rows(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, n_chars, digest): one row per document, texts left behind. Written, so row_id is fixed."""
    plain = F.regexp_replace(F.col("text"), _BLANKS, "")
    rows = ids_and_text(docs).select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"),
    )
    return written(rows, "digests")


def distinct_digests(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest with its winning row and count, reduced before the shuffle."""
    best = F.min(F.struct(
        (-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id", "n_chars"))
    return rows.groupBy("digest").agg(best.alias("b"), F.count("*").alias("n")).select(
        F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", "b.doc_id", "b.row_id", "b.n_chars", "n")


def build_index(distinct: DataFrame) -> DataFrame:
    """The historical index: one row per shard, written to the shared folder."""
    return written(distinct.groupBy("shard").applyInArrow(_shard_row, INDEX), "digest-index")


def dedup_rows(rows: DataFrame, is_history: Column) -> DataFrame:
    """Each digest row with the winner of its group: (doc_id, digest, row_id, keep_id, keep_row, group_size, kept)."""
    shards = -(-rows.count() // SHARD_KEYS) or 1
    index = build_index(distinct_digests(rows.where(is_history), shards))
    batch = distinct_digests(rows.where(~is_history), shards)
    groups = index.groupBy("shard").cogroup(batch.groupBy("shard")).applyInArrow(_merge, GROUPS).drop("shard")
    return rows.join(groups, "digest").select(
        "doc_id", "digest", "row_id", "keep_id", "keep_row", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"))


def in_history() -> Column:
    """Documents of the earlier delivery: half of them, by a hash of the id. The rest is the new batch; both are returned."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0


def exact_dedup(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    done = dedup_rows(digest_rows(docs), in_history() if is_history is None else is_history)
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows are found again by (doc_id, digest). Where several rows share both,
    they differ at most in blanks and other columns; the one with most code points stays,
    then one of the equals.
    """
    digest = F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), _BLANKS, "").cast("binary"), 256))
    done = dedup_rows(digest_rows(docs), in_history())
    # Of rows with one id and text, those on either side of the winner count together.
    keys = done.where("kept").select(F.col("doc_id").alias("__key_id"), F.col("digest").alias("__key_digest"))
    multiple = done.groupBy("doc_id", "digest").count().where("count > 1").select(
        F.col("doc_id").alias("__key_id"), F.col("digest").alias("__key_digest"))
    on = F.col("__key_id").eqNullSafe(F.col("doc_id")) & (F.col("__key_digest") == F.col("__digest"))
    kept = docs.withColumn("__digest", digest).join(keys, on, "left_semi")
    keys_multiple = written(multiple, "repeated-rows")
    if keys_multiple.isEmpty():
        return kept.drop("__digest")
    single = kept.join(keys_multiple, on, "left_anti").drop("__digest")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    longest = F.max_by(whole, F.char_length(F.coalesce(F.col("text"), F.lit(""))))
    many = kept.join(keys_multiple, on, "left_semi").groupBy("doc_id", "__digest").agg(longest.alias("w"))
    return single.unionByName(many.select("w.*"))


# --- registered query ----------------------------------------------------------


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLES = {"op1_exact_dedup": r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain
        FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, sha256(plain) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY plain ORDER BY n DESC, doc_id NULLS LAST)"""}
