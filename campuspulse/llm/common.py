"""Helpers the text operators share: tables, intermediate Parquet, safe column names."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campuspulse.session import run_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared run folder.

    Cuts the lineage without losing column pruning; the table is readable from
    every executor, so a lost one costs a task and not the step.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ids_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null text read as empty; other columns are left behind, so none can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Fewer rows per Arrow batch for what runs inside, where single rows can be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """At most so many rows per Arrow batch from here on; a smaller setting stays.

    For a job whose frames run when its caller writes them, after a ``with small_batches`` would have ended. A batch of whole texts is held
    several times at once, by the JVM outside its heap and by the Python worker, and both keep what they once took.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def most_frequent(counts: DataFrame, limit: int, label: str) -> DataFrame:
    """Rows of a table of distinct keys with a count ``n`` that are among the ``limit`` most frequent, ties in or out together.

    A histogram of counts in steps of an eighth of a power of two (some hundred rows) gives the least count, so
    that never more than ``limit`` rows leave the executors, however many tasks hold them.
    """
    counts = written(counts, label)
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r.step, r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, None
    for at, size in sizes:
        total += size
        if total > limit:
            break
        least = at
    return counts.where(step >= least if least is not None else F.lit(False))
