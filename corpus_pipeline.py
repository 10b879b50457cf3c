"""From raw documents to packed sequences: five stages, each by one corpus operator.

Every stage takes what its predecessor kept, written as Parquet and read again, and all but the last
return the columns of ``documents`` unchanged. Null and empty texts have no language and leave at
the first stage; an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm import block_naming, decontaminate, language_id, near_copies, swap_packing
from scoreframe.llm.common import stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a classifier tells with a calibrated probability of half or more."""
    model = language_id.train(docs, ~language_id.held_out(F.col("doc_id")))
    return language_id.keep_known(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id."""
    return block_naming.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by SimHash fingerprints of at most two differing bits, or by
    links of five-word Jaccard similarity 0.8 or more."""
    return near_copies.drop_simhash_and_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: its place in a sequence of at most 1024 tokens."""
    return swap_packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: SQL can express neither the classifier nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
