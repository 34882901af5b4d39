"""N-gram Jaccard join: a grouped prefix join on distinct word shingles.

1. Every document becomes the set of its distinct shingles. Equal sets are one *entity*.
2. Shingles have one global order: first all those that are not known to be frequent, by hash, then the frequent ones by
   count. Two sets of similarity ``t`` share a shingle among the first ``n - ceil(t * n) + 1`` of each: the prefix.
3. Entities with the same prefix and size form one *group*. Groups meet in the lists of their prefix shingles.
4. In each list all entities are first paired with one pivot (star), filtered by size and by position in the order,
   by the number of common prefix shingles, and verified on whole sets. Links join entities to components. Lists that lie within one component have nothing left to find; in
   the others, the pairs of different components that pass the same filters are verified as well.

A list of near copies so costs one pair per member, and no link is lost. The order changes cost only: it holds a bounded
number of frequent shingles (``FREQUENT``), counted over all documents. Lists of shingles that are not frequent are short; the frequent ones
are reduced before their shuffle and joined, so that a hot one can be split.

Edge cases: null text and texts without words have no shingles and link with nothing, not even each other. Texts with fewer words
than a shingle have one, the whole sequence. Equal sets link (similarity 1). Rows without doc_id link nothing and have a
null component. Rows that share a doc_id each have the component of their own text; repeated rows agree. Empty tables give
empty results; extra columns are ignored by ``components_of`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campuspulse.llm.common import ids_and_text, most_frequent, small_batches, table, written
from campuspulse.llm.components import components
from campuspulse.llm.textbytes import mix, shingle_sets, slices

PERCENT = 75
FREQUENT = 200_000
BEFORE = 8
SENT_IDS = 500_000
COUNTED_AT_ONCE = 1 << 21


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n + (-PERCENT * n) // 100 + 1


def is_linked(common: Column, a: Column, b: Column) -> Column:
    return 100 * common >= PERCENT * (a + b - common)


# --- frequent shingles -----------------------------------------------------------------


def _counted(buckets: int):
    """Per bucket of hashes the distinct shingles of a run of texts: those seen once, and the others with their counts.

    A run is what a task counts at a time, so that a hot shingle leaves it once.
    """
    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        edges = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - buckets.bit_length() + 1))
        parts = [(i, k[c == 1].tobytes(), k[c > 1].tobytes(), c[c > 1].astype(np.int64).tobytes())
                 for i, (k, c) in enumerate(zip(np.split(keys, edges), np.split(n, edges))) if len(k)]
        columns = zip(*parts)
        return pa.RecordBatch.from_arrays([pa.array(next(columns), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "once", "more", "n"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, raw, offs in slices(batch["text"]):
                hashes, _, _ = shingle_sets(raw, offs)
                held.append(hashes)
                size += len(hashes)
                if size >= COUNTED_AT_ONCE:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return emit


def _totals(part: pa.Table) -> pa.Table:
    """(shingle, n) of the shingles of a bucket that more than one text has."""
    once, more, n = (np.frombuffer(b"".join(part[c].to_pylist()), kind) for c, kind in (("once", np.uint64), ("more", np.uint64), ("n", np.int64)))
    once = np.sort(once)
    first = np.flatnonzero(np.append(True, once[1:] != once[:-1])) if len(once) else np.zeros(0, np.int64)
    keys, count = once[first], np.diff(np.append(first, len(once)))
    known, at = np.unique(more, return_inverse=True)
    total = np.bincount(at, n, len(known)).astype(np.int64)
    if len(keys) and len(known):
        place = np.minimum(np.searchsorted(keys, known), len(keys) - 1)
        both = keys[place] == known
        total[both] += count[place[both]]
        count[place[both]] = 0
    return pa.table({"shingle": np.concatenate([known, keys[count > 1]]).view(np.int64), "n": np.concatenate([total, count[count > 1]])})


def shingle_counts(docs: DataFrame) -> DataFrame:
    """(shingle, n) of all shingles that more than one document has, counted over all documents.

    Nearly all shingles are seen once, so they travel in arrays by bucket of their hash and not as a row each. A bucket's share is bounded
    by the number of buckets, which grows with the documents.
    """
    texts = ids_and_text(docs).select("text")
    buckets = 1 << max(6, min(13, (docs.count() // 1024).bit_length()))
    return texts.mapInArrow(_counted(buckets), "bucket int, once binary, more binary, n binary").groupBy("bucket").applyInArrow(_totals, "shingle long, n long")


def frequent_shingles(docs: DataFrame, limit: int = FREQUENT) -> np.ndarray:
    """The most frequent shingles, rarest first; at most ``limit``, which bounds what is collected and broadcast.

    Counts are exact over all documents. They order prefixes and decide no result.
    """
    top = most_frequent(shingle_counts(docs), limit, "shingle-counts").toArrow()
    order = np.lexsort((top["shingle"].to_numpy(), top["n"].to_numpy()))
    return top["shingle"].to_numpy()[order].view(np.uint64)


# --- prefixes ------------------------------------------------------------------------------


_PREFIX = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("entity", pa.int64()), ("grp", pa.int64()), ("rare", pa.list_(pa.int64())), ("common", pa.list_(pa.int64())),
])
_PREFIX_DDL = "doc_id long, n long, entity long, grp long, rare array<long>, common array<long>"


def entity_hashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each set from its sorted shingles; 0 stands for the empty set."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    edge = np.concatenate([[0], np.cumsum(counts)])
    return np.where(counts > 0, mix(upto[edge[1:]] - upto[edge[:-1]] + counts.astype(np.uint64)), np.uint64(0))


def _prefixes(shared):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        by_hash = np.argsort(frequent)
        keys = frequent[by_hash]
        gate = np.zeros(1 << 20, bool)
        gate[keys >> np.uint64(44)] = True
        for batch in batches:
            for a, b, raw, offs in slices(batch["text"]):
                hashes, owner, _ = shingle_sets(raw, offs)
                n = np.bincount(owner, minlength=b - a)
                entity = entity_hashes(hashes, n)
                rank = np.zeros(len(hashes), np.int64)  # 0: not frequent
                maybe = np.flatnonzero(gate[hashes >> np.uint64(44)])
                if len(keys) and len(maybe):
                    at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
                    hit = keys[at] == hashes[maybe]
                    rank[maybe[hit]] = by_hash[at[hit]] + 1
                # Sorted by hash within a text already; a stable sort keeps that among the rare ones.
                order = np.lexsort((rank, owner))
                first = np.concatenate([[0], np.cumsum(n)])
                place = np.arange(len(hashes)) - first[owner]
                keep = place < np.where(n > 0, prefix_length(n), 0)[owner]
                token, who, rank = hashes[order][keep], owner[keep], rank[order][keep]
                size = np.bincount(who, minlength=b - a)
                grp = mix(entity_hashes(token, size) + n.astype(np.uint64))
                lists = []
                for want in (rank == 0, rank > 0):
                    edges = np.concatenate([[0], np.cumsum(np.bincount(who[want], minlength=b - a))])
                    lists.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(token[want].view(np.int64))))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(n), pa.array(entity.view(np.int64)), pa.array(grp.view(np.int64)), *lists], schema=_PREFIX)

    return emit


def prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """One row per document: set size, entity, group, and the prefix, its frequent shingles apart and last."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    return ids_and_text(docs).mapInArrow(_prefixes(shared), _PREFIX_DDL)


# --- lists and pairs -------------------------------------------------------------------------


def lists_of(prefixed: DataFrame, entities: DataFrame) -> DataFrame:
    """(list, entity, n, i, grp): entities that meet others in a list, with the shingle's position in the entity's order."""
    named = prefixed.where("doc_id is not null and n > 0")
    rare = named.select(F.posexplode("rare").alias("i", "list"), "grp", "n")
    # Lists of rare shingles are short: a window over each needs one shuffle.
    over = Window.partitionBy("list")
    rare = rare.withColumn("lo", F.min("grp").over(over)).withColumn("hi", F.max("grp").over(over)).where("lo <> hi").drop("lo", "hi").distinct()
    common = named.select(F.posexplode("common").alias("k", "list"), "grp", "n", F.size("rare").alias("before"))
    common = common.select((F.col("k") + F.col("before")).alias("i"), "list", "grp", "n").distinct()
    shared = common.groupBy("list").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("list")
    common = common.join(shared, "list")
    met = rare.unionByName(common).join(entities.select("grp", "entity"), "grp").select("list", "entity", "n", "i", "grp")
    # Entities of one group share its whole prefix: the group is a list of its own.
    own = entities.groupBy("grp").agg(F.count("*").alias("c")).where("c > 1").join(entities, "grp")
    return met.unionByName(own.select(F.col("grp").alias("list"), "entity", "n", F.lit(0).alias("i"), "grp"))


def _may_link(a: str, b: str) -> Column:
    """Size filter, and the overlap still possible from the first common shingle on (a list where it is not the first
    one may refuse a pair that another list lets pass)."""
    na, nb, ra, rb = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}n") - F.col(f"{a}i"), F.col(f"{b}n") - F.col(f"{b}i")
    return (100 * na >= PERCENT * nb) & (100 * nb >= PERCENT * na) & (PERCENT * (na + nb) <= (100 + PERCENT) * F.least(ra, rb))


def star_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): each entity with its list's pivot, the one with the least rare shingles before the list's."""
    best = F.min_by(F.struct(F.col("entity").alias("p"), F.col("n").alias("pn"), F.col("i").alias("pi")),
                    F.struct("i", "entity"))
    pivots = lists.groupBy("list").agg(best.alias("q")).select("list", "q.*")
    pairs = lists.join(pivots, "list").where(F.col("entity") != F.col("p")).where(_may_link("", "p"))
    return pairs.select(F.least("entity", "p").alias("a"), F.greatest("entity", "p").alias("b")).distinct()


def open_pairs(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that share a list and pass the filters.

    A pair is made in the first list that both have. Each entity carries the ``BEFORE`` lists ahead of the present one in its order: two entities that
    share one of those met there or earlier. Beyond that reach a pair can be made again, which ``distinct`` mends.
    """
    labelled = lists.join(roots.withColumnRenamed("node", "entity"), "entity", "left").withColumn("root", F.coalesce("root", "entity"))
    open_lists = labelled.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("list")
    # An entity has at most as many lists as its prefix is long; the list of its group comes before all others.
    ahead = Window.partitionBy("entity").orderBy("i", F.col("list") != F.col("grp"), "list").rowsBetween(-BEFORE, -1)
    rows = labelled.join(open_lists, "list").withColumn("before", F.collect_list("list").over(ahead)).select("list", "entity", "n", "i", "root", "before")
    other = rows.select("list", *(F.col(c).alias(f"o{c}") for c in ("entity", "n", "i", "root", "before")))
    new = (F.col("entity") < F.col("oentity")) & (F.col("root") != F.col("oroot")) & ~F.arrays_overlap("before", "obefore")
    pairs = rows.join(other, "list").where(new).where(_may_link("", "o"))
    return pairs.select(F.col("entity").alias("a"), F.col("oentity").alias("b")).distinct()


def profiles(lists: DataFrame) -> DataFrame:
    """(entity, n, grp, lists): each entity with its lists, of which it has at most as many as its prefix is long."""
    return lists.groupBy("entity").agg(F.first("n").alias("n"), F.first("grp").alias("grp"), F.collect_set("list").alias("lists"))


def plausible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose common prefix shingles leave the similarity possible.

    Of two prefixes one ends first. Common shingles up to that end are in both prefixes, hence counted here; later ones
    are in that one's rest. So the overlap is at most the count plus the longer rest. Within a group prefixes are equal.
    """
    x = known.select(*(F.col(c).alias(f"x{c}") for c in known.columns))
    y = known.select(*(F.col(c).alias(f"y{c}") for c in known.columns))
    met = pairs.join(x, F.col("a") == F.col("xentity")).join(y, F.col("b") == F.col("yentity"))
    rest = F.ceil(PERCENT * F.greatest("xn", "yn") / 100) - 1
    bound = F.size(F.array_intersect("xlists", "ylists")) + rest
    return met.where((F.col("xgrp") == F.col("ygrp")) | ((100 + PERCENT) * bound >= PERCENT * (F.col("xn") + F.col("yn")))).select("a", "b")


# --- verification ----------------------------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offs in slices(batch["text"]):
            hashes, owner, _ = shingle_sets(raw, offs)
            n = np.bincount(owner, minlength=b - a)
            edges = (8 * np.concatenate([[0], np.cumsum(n)])).astype(np.int64)
            body = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(edges), pa.py_buffer(hashes.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch["want"].slice(a, b - a), pa.array(entity_hashes(hashes, n).view(np.int64)), body.cast(pa.binary())], names=["want", "entity", "shingles"])


def sets_of(docs: DataFrame, pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, shingles) of the entities in pairs: texts are read again and only theirs are worked on.

    Up to ``SENT_IDS`` ids go to the texts; more than that, and texts and ids meet by id.
    """
    ends = pairs.select(F.col("a").alias("entity")).unionByName(pairs.select(F.col("b").alias("entity"))).distinct()
    want = entities.join(ends, "entity", "left_semi").select(F.col("entity").alias("want"), F.col("doc_id").alias("id"))
    want = written(want, "wanted-texts")
    if want.count() <= SENT_IDS:
        want = F.broadcast(want)
    rows = ids_and_text(docs).join(want, F.col("doc_id") == F.col("id")).select("want", "text")
    # Of rows that share an id, those of the wanted text count.
    return rows.mapInArrow(_sets, "want long, entity long, shingles binary").where("want = entity").select("entity", "shingles")


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch["x"], batch["y"]):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            both = int((x[at] == y).sum())
            out.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(out, pa.bool_())], names=["a", "b", "linked"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    x = sets.select(F.col("entity").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("entity").alias("b"), F.col("shingles").alias("y"))
    met = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
    return met.mapInArrow(_intersect, "a long, b long, linked boolean").where("linked").select("a", "b")


# --- the operator -------------------------------------------------------------------------------------


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, entity, component_id: one row per document; component_id is the smallest doc_id reachable by links."""
    # A long document's set can be large, and a batch of pairs holds two sets a row.
    with small_batches(docs.sparkSession):
        return _components_of(docs)


def _components_of(docs: DataFrame) -> DataFrame:
    frequent = frequent_shingles(docs)
    prefixed = prefixes(docs, frequent)
    sizes = written(prefixed.select("doc_id", "n", "entity", "grp"), "shingle-sizes")
    entities = written(sizes.where("doc_id is not null and n > 0").groupBy("entity", "grp", "n").agg(F.min("doc_id").alias("doc_id")), "entities")
    lists = written(lists_of(prefixed, entities), "prefix-lists")
    known = written(profiles(lists), "list-profiles")
    first = written(plausible(star_pairs(lists), known), "star-pairs")
    links = written(verified(first, written(sets_of(docs, first, entities), "shingle-sets")), "links")
    roots = written(components(links), "roots")
    more = written(plausible(open_pairs(lists, roots), known).join(first, ["a", "b"], "left_anti"), "open-pairs")
    if not more.isEmpty():
        late = written(verified(more, written(sets_of(docs, more, entities), "shingle-sets")), "links")
        roots = written(components(links.unionByName(late)), "roots")
    rooted = sizes.join(roots.withColumnRenamed("node", "entity"), "entity", "left").withColumn("root", F.coalesce("root", "entity"))
    lowest = rooted.where("doc_id is not null and n > 0").groupBy("root").agg(F.min("doc_id").alias("low"))
    named = rooted.join(lowest, "root", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "entity", component.alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id, with all its columns; documents without id stay."""
    gone = components_of(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")


def op6_jaccard_join(spark, sf_dir):
    return components_of(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLES = {"op6_jaccard_join": r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    reach AS (SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id WHERE r.low < l.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(low) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON id = d.doc_id GROUP BY d.doc_id, n.n"""}
