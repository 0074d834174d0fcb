"""A training corpus from raw documents: five stages, each a function from documents to documents, packing at the end.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before has kept, and is written as Parquet
before the next one reads it.  Null and empty texts pass the filters and become one end token each; an empty table gives
empty results; columns beyond those of ``documents`` pass through up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import documents, scratch_path, table
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.line_dedup import keep_deduplicated
from tidemark.llm.ngram_join import keep_one_per_group
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import held_out, tokenizer_path
from tidemark.llm.toxicity import fit_toxicity, keep_clean, labelled


# Documents are long rows: so many of them, not Spark's ten thousand, go to a Python worker at once.
BATCH_ROWS = 1_000


def _bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon, fitted on the labelled rows among them, calls toxic."""
    _bounded_batches(spark)
    train = labelled(docs, table(spark, sf_dir, "labels"), "toxic", held_out(5, 0))
    return keep_clean(docs, fit_toxicity(train))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without chunks of lines that stand earlier in the corpus, as in op1; documents that lose every line go."""
    return keep_deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by a Jaccard similarity of five-word shingles of 0.75 or more."""
    _bounded_batches(spark)
    return keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of ten-word windows of the benchmark; documents that are nothing else go."""
    _bounded_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the tokenised documents with their places in sequences of 4096 tokens."""
    _bounded_batches(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]

# A fitted lexicon and a tokenizer's ids are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each one keeps is written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
