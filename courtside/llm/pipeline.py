"""A corpus pipeline of five stages over ``documents``; each stage works on all that the stage before it kept.

What every stage does with odd rows: null texts count as empty; empty texts are kept until the copies among them go;
texts of any length are read whole; ids may be null or repeat, since rows are told apart by id and text; of rows that
repeat each other wholly, and of ties, one stays from the second stage on; an empty table gives an empty one with the
same columns; further columns, whatever their names, go through unchanged up to the last stage.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from courtside.llm.frames import one_row_each, quoted
from courtside.plans.storage import remove, shared_folder

#: SQL for the rows of :func:`run`: none, as it can express neither the trained model nor the tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model does not reject: those with a score below ``toxicity.THRESHOLD``.

    Each row is judged by its own text; null and empty ones get the score of the prior alone.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = "__toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, toxicity.fit(docs, labels), docs.columns, name=name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: the longest, then the smallest id.

    Even ids stand for the stored snapshot, odd ones and rows without an id for the new batch. Null and empty texts, and
    those of white space only, are copies of each other.
    """
    groups = exact_dedup.exact_dedup(docs, F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0, 0))
    decided = groups.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")).agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    return one_row_each(docs, "doc_id", F.sha2(exact_dedup.normalised(F.col("text")), 256), decided, F.char_length(F.coalesce("text", F.lit(""))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group whose sets of five-word shingles a chain of similarities of 0.8 or more joins.

    Texts without words are copies of each other; a text of fewer than five words is one shingle.
    """
    return simhash.near_dedup(docs).select(*quoted(docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark; rows with a null id are searched like any other."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*quoted(docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each document that is left; null and empty texts have no tokens."""
    return bpe.round_trip_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("bpe encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; between two stages the rows are written as Parquet in the shared folder and read again.

    Only the last of these folders is left when it returns, as the rows that it returns are read from there.
    """
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")  # nothing reads it any more
    return docs
