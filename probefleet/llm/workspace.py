"""Shared folders, intermediate tables, and what Python workers need to import this package."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probefleet.llm import text as T
from probefleet.session import shared_folder

#: Stands for a null doc_id, which counts as larger than all others.
NO_ID = 2**63 - 1

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Let workers that start without this repository on their path find it."""
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once below ``spark.checkpoint.dir`` and read again.

    Cuts the lineage: a lost executor costs later stages only their own tasks.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What stages read or write of documents.
_STAGE_COLUMNS = ("doc_id", "text", "lang", "n_chars")


def keeping_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage over documents of any columns: those that stages do not know travel as one struct, whatever their names."""

    @functools.wraps(stage)
    def run(documents: DataFrame, *args, **options) -> DataFrame:
        names = documents.columns
        others = [c for c in names if c not in _STAGE_COLUMNS]
        rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("_others")] if others else []
        out = stage(documents.select(*(c for c in names if c in _STAGE_COLUMNS), *rest), *args, **options)
        return out.select(*(F.col("_others")[c].alias(c) if c in others else F.col(c) for c in names))

    return run


def keyed(documents: DataFrame) -> DataFrame:
    """id (doc_id, or NO_ID), key (a hash of id and text) and text."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return documents.select(doc_id.alias("id"), F.xxhash64(doc_id, "text").alias("key"), "text")


def packed_texts(rows: DataFrame) -> DataFrame:
    """The rows with the text compressed as `packed`, for shuffles of whole texts. Other columns are longs."""
    names = [c for c in rows.columns if c != "text"]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in T.text_slices(batches, "text"):
            raw = [None if x is None else packer.compress(x.encode()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(raw, pa.binary())], [*names, "packed"])

    return rows.select(*names, "text").mapInArrow(pack, ", ".join([*(f"{c} long" for c in names), "packed binary"]))


def unpacked_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with text in place of packed, some rows at a time."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index("packed")
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            raw = [None if x is None else unpacker.decompress(x).decode() for x in part.column(at).to_pylist()]
            yield part.set_column(at, "text", pa.array(raw, pa.large_string()))
