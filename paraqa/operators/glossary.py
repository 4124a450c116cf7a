"""Glossary merging and the terms that may stay English."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def merge(rows: DataFrame) -> DataFrame:
    """rows: file_no, row_no, source, target. The first target of a source counts, earlier files first; blank ones go; sorted."""
    rows = rows.withColumns({"source": T.strip(F.col("source")), "target": T.strip(F.col("target"))}).where("source <> '' AND target <> ''")
    return rows.groupBy("source").agg(F.min_by("target", F.struct("file_no", "row_no")).alias("target")).orderBy("source")


def for_engine(glossary: DataFrame, engine: str) -> DataFrame:
    """Only a language model is given a glossary."""
    return glossary if engine == "llm" else glossary.limit(0)


def for_batch(entries: DataFrame, batch: int) -> DataFrame:
    """source, target: the terms that a batch is given, those that earlier batches gave. The first target of a source counts.
    entries: batch, row_no, source, target."""
    return merge(entries.where(F.col("batch") < batch).withColumnRenamed("batch", "file_no"))


def keep_terms(glossary: DataFrame) -> DataFrame:
    """One row, keep: the targets in lower case. A glossary is written by hand; its terms are one array for the checks."""
    return glossary.agg(F.array_sort(F.collect_set(F.lower("target"))).alias("keep"))
