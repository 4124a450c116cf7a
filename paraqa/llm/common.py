"""What the operators share: the word rule, the shared scratch folder, helpers for Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir, staged  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_bytes(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns and the text as UTF-8 bytes, null texts as empty ones."""
    return docs.select(*columns, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the given schema from lists or arrays by name."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
