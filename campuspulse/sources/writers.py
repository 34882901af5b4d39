"""Sinks. Every writer leaves the number of files to the plan's partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campuspulse.session import materialise


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def course_slots(df: DataFrame, rows_per_file: int) -> tuple[DataFrame, int]:
    """``df`` with ``_slot``, the task that writes the row, and the number of slots.

    A course of ``rows_per_file`` rows or more gets as many slots of its own as its count fills, to the nearest whole; its rows are dealt to them
    by ranges of a row hash, so a retried task sends every row to the same place. Smaller courses share slots, in
    order of their id, and have one file each.
    """
    counts = df.groupBy("course_id").agg(F.count("*").alias("_n"))
    files = F.when(F.col("_n") >= rows_per_file, F.round(F.col("_n") / rows_per_file).cast("long")).otherwise(0)
    small = F.when(files == 0, F.col("_n")).otherwise(0)
    # One row per course.
    before = Window.orderBy(F.col("course_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(
        F.col("course_id").alias("_course"), files.alias("_files"), F.coalesce(F.sum(files).over(before), F.lit(0)).alias("_first"),
        F.floor(F.coalesce(F.sum(small).over(before), F.lit(0)) / rows_per_file).alias("_shared"))
    placed = materialise(placed)
    size = placed.agg(F.coalesce(F.sum("_files"), F.lit(0)).alias("own"), F.max(F.when(F.col("_files") == 0, F.col("_shared"))).alias("last")).first()
    hashable = [c for c, kind in df.dtypes if "map<" not in kind]
    share = F.pmod(F.xxhash64(*hashable), F.lit(1 << 30)) / F.lit(float(1 << 30))
    slot = F.when(F.col("_files") > 0, F.col("_first") + F.floor(share * F.col("_files"))).otherwise(F.col("_shared") + size.own)
    met = df.join(placed, df["course_id"].eqNullSafe(placed["_course"]))
    return met.select(*df.columns, slot.cast("int").alias("_slot")), int(size.own + (0 if size.last is None else size.last + 1))


def write_by_course(df: DataFrame, path: str, rows_per_file: int = 1_000_000, mode: str = "errorifexists") -> None:
    """Parquet partitioned by course, in files of about ``rows_per_file`` rows (between two thirds and one and a half of that for larger courses).

    Equal rows stay together, as nothing tells them apart.
    """
    if rows_per_file < 1:
        raise ValueError(rows_per_file)
    slotted, slots = course_slots(df, rows_per_file)
    slotted.repartitionById(max(1, slots), F.col("_slot")).drop("_slot").write.mode(mode).partitionBy("course_id").parquet(path)
