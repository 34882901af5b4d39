"""From raw documents to token ids: quality, exact and near copies, benchmark passages, encoding.

Every stage is (spark, docs, sf_dir) → DataFrame and works on all documents that the one before kept; all but the last return the
columns they got. ``run`` writes each stage's result as Parquet in the shared run folder and reads it for the next one. Every stage bounds the
rows of the session's Arrow batches, since its frame runs when the caller writes it; the setting stays and changes no result.

Null or empty texts, repeated rows, ties and extra columns are handled as each operator's module says; documents without an id pass the
near-copy stage, which cannot name them. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campuspulse.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality_crf
from campuspulse.llm.common import bounded_batches, table, text_of, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the line model rejects. It is fitted on the labelled documents of the whole table."""
    bounded_batches(spark)
    model = quality_crf.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_crf.drop_bad(docs, model)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    bounded_batches(spark)
    return exact_dedup.drop_repeats(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by shingle similarity."""
    bounded_batches(spark)
    return jaccard_join.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain an item of the benchmark."""
    bounded_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): token ids and the text decoded from them.

    A batch holds texts, their ids and the decoded texts at once.
    """
    bounded_batches(spark)
    image = bpe.prepare(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bpe.encoded(image, text_of()).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", bpe.decoded(image, F.col("ids")).alias("text"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_exact_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", token_ids),
]

# A fitted model and a tokenizer have no SQL twin; the tests run the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
