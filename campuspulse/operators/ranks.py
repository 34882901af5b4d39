"""Exact ranks, positions and quantiles without sorting a group in one task.

A plain ``rank() over (partition by course order by score)`` puts a whole course in
one task. Here values are first reduced to counts per distinct value (map-side
combine makes heavy ties cheap), every group is cut into slices of the value
range, running totals over the few slices give each slice its offset, and only
the inside of a slice is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


OVERSAMPLE = 4


def _slices(spark) -> int:
    """Slices per group: about the shuffle width, at most 250 (1,000 sampled values)."""
    return max(8, min(250, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def slice_edges(counts: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, _edges): values that cut the group's distinct values into even slices.

    The sample is the distinct values with the smallest hashes, so it depends on
    the data alone: every branch and every retried task sees the same edges. The
    row_number filter keeps at most a thousand rows per group and task before the
    shuffle.
    """
    steps = _slices(counts.sparkSession)
    w = Window.partitionBy(*group).orderBy(F.xxhash64(value), value)
    return (
        counts.select(*group, value)
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= steps * OVERSAMPLE)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(value)).alias("_sample"))
        .select(*group, F.filter("_sample", lambda v, i: i % OVERSAMPLE == OVERSAMPLE - 1).alias("_edges"))
    )


def value_counts(df: DataFrame, keys: list[str], value: str, weight: Column | None = None, **extra) -> DataFrame:
    """(keys, value, n, ...extra) with nulls left out."""
    n = F.count("*") if weight is None else F.sum(weight)
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(n.alias("n"), *[agg.alias(name) for name, agg in extra.items()])
    )


def prefix_totals(
    counts: DataFrame,
    keys: list[str],
    value: str,
    measures: dict[str, str],
    coarse: Column | None = None,
) -> DataFrame:
    """Exclusive running totals by ascending value within ``keys``.

    ``measures`` maps a count column to the name of its running total; the group
    total comes along as ``<name>_all``. ``coarse`` is an order-preserving coarsening
    of the value with a bounded number of steps per group; without it the edges come
    from ``slice_edges``. Totals are exact for any edges, they only balance the work.
    """
    group = keys or ["_g"]
    if not keys:
        counts = counts.withColumn("_g", F.lit(0))
    if coarse is None:
        edges = slice_edges(counts, group, value)
        # Without keys the edges are one row, attached as a scalar: a join on a constant would be a cross join.
        met = counts.join(edges, group) if keys else attach_row(counts, edges.select("_edges"))
        sliced = met.withColumn(
            "_slice", F.size(F.filter("_edges", lambda e: e < F.col(value)))
        ).drop("_edges")
    else:
        sliced = counts.withColumn("_slice", coarse)
    per_slice = sliced.groupBy(*group, "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = per_slice.select(
        *group, "_slice",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"{name}_all") for m, name in measures.items()],
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = sliced.join(offsets, [*group, "_slice"])
    for m, name in measures.items():
        out = out.withColumn(name, F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0)))
    return out.drop("_slice", *[f"_off_{m}" for m in measures], *([] if keys else ["_g"]))


def count_below(df: DataFrame, keys: list[str], value: str, coarse: Column | None = None) -> DataFrame:
    """(keys, value, n, n_below, n_below_all): rows at, below, and in the whole group."""
    return prefix_totals(value_counts(df, keys, value), keys, value, {"n": "n_below"}, coarse)


def midranks(df: DataFrame, keys: list[str], value: str, coarse: Column | None = None) -> DataFrame:
    """(keys, value, midrank): average rank of ties, as Spearman and rank-sum tests need."""
    below = count_below(df, keys, value, coarse)
    return below.select(*keys, value, "n", (F.col("n_below") + (F.col("n") + 1) / 2).alias("midrank"))


def positions(df: DataFrame, keys: list[str], order: list[str], coarse: list[Column | None] | None = None) -> DataFrame:
    """Unique 1-based position within ``keys`` by two order columns.

    Ties in the first column are placed by the second in a second pass keyed by
    the tied value, so that a tie of any size is sliced too. (keys, order) must be unique.
    """
    first, second = order
    coarse = coarse or [None, None]
    above = count_below(df, keys, first, coarse[0]).select(*keys, first, F.col("n_below").alias("_outer"))
    tied = count_below(df, [*keys, first], second, coarse[1]).select(
        *keys, first, second, F.col("n_below").alias("_inner")
    )
    return (
        tied.join(above, [*keys, first])
        .withColumn("position", F.col("_outer") + F.col("_inner") + 1)
        .drop("_outer", "_inner")
    )


def percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], coarse: Column | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per group, one column per name."""
    below = count_below(df, keys, value, coarse)
    last = F.col("n_below_all") - 1

    def at(index: Column) -> Column:
        hit = (F.col("n_below") <= index) & (index < F.col("n_below") + F.col("n"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    columns = []
    for name, p in probs.items():
        pos = last * F.lit(float(p))
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        part = F.max(pos - F.floor(pos))
        columns.append((low + (high - low) * part).alias(name))
    return below.groupBy(*keys).agg(*columns)


def lag_in_chunks(df: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column, name: str) -> DataFrame:
    """``lag(value)`` within ``keys`` by ``order``, computed chunk by chunk.

    ``chunk`` must grow with the first order column. The window runs inside (keys,
    chunk); the first row of a chunk takes the last value of the chunk before it,
    so no single key has to fit in one task.
    """
    marked = df.withColumn("_chunk", chunk)
    final = F.max_by(F.struct(value), F.struct(*order)) if value != order[0] else F.struct(F.max(value).alias(value))
    last = marked.groupBy(*keys, "_chunk").agg(final.alias("_last"))
    per_key = Window.partitionBy(*keys).orderBy("_chunk")
    edges = last.select(*keys, "_chunk", F.lag("_last").over(per_key).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    previous = F.coalesce(F.lag(F.struct(value)).over(inside), F.col("_before"))
    # Null-safe: rows without a first order value form a chunk of their own, before all others.
    named = edges.select(*[F.col(c).alias(f"_e_{c}") for c in (*keys, "_chunk")], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in (*keys, "_chunk")]
    return marked.join(named, same).withColumn(name, previous[value]).drop("_chunk", "_before", *[f"_e_{c}" for c in (*keys, "_chunk")])


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate as scalar subqueries, without a join."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_row")).scalar()
    return df.withColumn("_row", packed).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in one_row.columns])


def sliced_row_number(df: DataFrame, keys: list[str], order: list[str], coarse: Column, name: str) -> DataFrame:
    """1-based row_number within ``keys``, ordered inside slices of a bounded coarse key.

    ``coarse`` must be an order-preserving coarsening of the first order column.
    """
    sliced = df.withColumn("_slice", coarse)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.join(offsets, [*keys, "_slice"])
        .withColumn(name, F.col("_off") + F.row_number().over(inside))
        .drop("_slice", "_off")
    )
