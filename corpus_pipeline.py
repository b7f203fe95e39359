"""A corpus pipeline: quality rules, near-duplicates, leaks, mixture, token files.

Every stage takes the documents the one before it kept and returns documents with the
same columns; the last one writes the token files and returns what they hold.

* quality rules: rejected documents go;
* SimHash: of documents linked at four bits or fewer one stays;
* decontamination: documents with ten words of a benchmark item in a row go;
* mixing: documents are repeated or left out to meet the sources' weights;
* token files: ids in document order, read back from the files.

Cases, as the stages' operators define them: a missing text has no words, so quality
rules reject it, as they do an empty one (under ten words); rows with a missing key are
rows like others; of equal texts, however many rows repeat them, one row stays; ties are
broken by key; very long texts are read whole; further columns stay with their rows until
the token files; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketlens.llm import leaks, mixing, quality, simhash
from basketlens.llm.queries import table, token_files
from basketlens.session import durable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"), window=10, gram=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", tokens),
]

# fingerprints and token ids have no SQL; tests/llm holds a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each reading what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
