"""Connected components of an edge table, by alternating stars over joins and reduced aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campuspulse.llm.common import written


def _lowest(sym: DataFrame) -> DataFrame:
    """(u, v, m): every edge from ``u`` with the smallest node among ``u`` and its neighbours."""
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.join(low, "u")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of an edge table (a, b); root is the smallest node reachable.

    In the large step a node hangs its larger neighbours on its smallest one, in the small step itself and its smaller
    ones; the edges turn into stars in a number of rounds that grows with the logarithm of the longest path. No neighbourhood is gathered
    in one place: minima are reduced before the shuffle, and edges meet them in a join that can be split. Null ends are ignored.
    """
    edges = edges.dropna().where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, label)
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = _lowest(large)  # every edge of ``large`` goes from the larger node to the smaller
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), label)
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
