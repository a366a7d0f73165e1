"""A corpus pipeline over ``documents``: quality, toxicity, exact duplicates, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of documents. The classifiers are fitted on the labelled rows of the table itself (a bounded sample).

Defined results: null texts count as empty ones everywhere. Empty texts are scored like others, are copies of one another, and are near duplicates of nothing.
Rows with null or repeated ids are rows like others: duplicates are told by id and text, so unrelated rows that share an id all stay. Very long texts are
read whole. Without labels of both classes the classifiers reject nothing. An empty table passes every stage as one. Further columns go
through unchanged whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ballotbox.llm import exact_dedup, ngram_join, packing, quality, toxicity
from ballotbox.llm._common import stage
from ballotbox.llm.queries import table


#: Texts that a Python worker gets at once, texts that a reader decodes at once, and bytes of a row group in what stages write, which its
#: writer and its reader hold whole, each task one: the memory of workers and heap, not the result, depends on them.
BATCH, DECODED, ROW_GROUP = 1000, 512, 16 << 20
#: Units that a worker's encoder keeps: it shares the executor with what four stages have left in the JVM.
TABLE = 150_000


def small_batches(spark: SparkSession) -> None:
    """Bounds for the session, as a stage's rows are read and written after its function has ended; smaller ones stay as they are."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH, "spark.sql.parquet.columnarReaderBatchSize": DECODED, "parquet.block.size": ROW_GROUP}
    for name, most in bounds.items():
        if not 0 < int(spark.conf.get(name, "0")) <= most:
            spark.conf.set(name, str(most))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    small_batches(spark)
    return quality.keep_good(docs, quality.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier finds toxic."""
    small_batches(spark)
    return toxicity.keep_civil(docs, toxicity.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    small_batches(spark)
    return exact_dedup.keep_one(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component linked by a Jaccard index of 0.8 or more of five-word shingles."""
    small_batches(spark)
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), table=TABLE)


STAGES = [("quality", good), ("toxicity", civil), ("exact dedup", distinct), ("n-gram join", unlike), ("packing", packed)]

#: The classifiers and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{i}")
    return docs
