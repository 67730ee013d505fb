"""The corpus pipeline: from documents to packed training sequences.

Each stage works on all rows that the stage before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from probefleet.llm.decontaminate import without_leaks
from probefleet.llm.jaccard_join import without_near_copies
from probefleet.llm.packing import pack_documents
from probefleet.llm.perplexity import without_low_quality
from probefleet.llm.substrings import without_repeats
from probefleet.llm.workspace import ready, settled, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted ones' language model is too high go."""
    # Workers of a long pipeline hold more memory than those of one query, so slices are smaller here.
    return without_low_quality(docs, table(ready(spark), sf_dir, "labels"), slice_bytes=1 << 20)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    ready(spark)
    return without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in a document with a smaller doc_id too are cut out."""
    ready(spark)
    return without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go."""
    return without_leaks(docs, table(ready(spark), sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences."""
    ready(spark)
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", sequences),
]

#: Several stages have no SQL form; tests hold run() against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
