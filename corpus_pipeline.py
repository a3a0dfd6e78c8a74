"""From raw documents to a training mix: five stages of the operators in lodestone.llm.

Every stage works on all rows that the one before it kept, and all but the last return the
columns of documents, whatever else these are; the last adds topic, n_tokens, prob and weight.

Defined cases: null and empty texts pass all stages but the last, which has nothing to
sample of them (the classifier judges an empty text like any other); rows with a null
doc_id keep their lines, have no near-duplicates and are sampled like others; repeated rows are one
document for counting and stay repeated; of rows of one doc_id with several texts near-dedup drops all
if one of them is a copy of a smaller doc_id's; ties go to the smallest doc_id (lines: to the
largest); long texts are read whole; without labels for either class nothing is dropped for
quality, without benchmark items nothing for contamination; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, jaccard_join, line_dedup, mixing, quality
from lodestone.llm.common import cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one of them only."""
    return line_dedup.dedup_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with tempered shares of sources, languages and topics."""
    return mixing.mix(docs)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: The classifier of the first stage isn't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
