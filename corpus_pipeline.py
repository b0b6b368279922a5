"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents its predecessor kept, written as a table, and all
but the last hand on rows with the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyline.llm import decontaminate, packing, quality, simhash, substring_dedup
from tallyline.llm.shared import prepare, stage, table

VOCABULARY = "word_bpe_49k.json"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rule and the limits on repetition. Null, empty and short texts go."""
    prepare(spark)
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of SimHash near-duplicates the document with the smallest id."""
    prepare(spark)
    return simhash.one_of_each(docs, simhash.near_duplicates(docs, shingle=3, radius=3))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of 50 words and more that a document with a smaller id has too.

    ``n_chars`` is that of the new text; a document of repeats alone goes.
    """
    prepare(spark)
    return substring_dedup.without_repeats(docs, length_col="n_chars")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a word inside a benchmark window."""
    prepare(spark)
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in the sequences of 4096 tokens."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed_sequences", packed_sequences),
]

#: The suffix arrays, fingerprints and automata have no SQL; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
