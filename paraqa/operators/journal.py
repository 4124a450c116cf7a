"""Paragraph journals, notes and corrections: last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def latest(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """One row for each key: the values of its last write, `first_seq` of its first, by which journals are ordered.

    An aggregation, so a key that is written often is combined where it is read.
    """
    rest = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(F.min(seq).alias("first_seq"), F.max_by(F.struct(*rest), seq).alias("_last")).select(key, "first_seq", "_last.*")


def upsert(table: DataFrame, changes: DataFrame, key: str = "k") -> DataFrame:
    """table with changes (with a seq) laid over it."""
    old = table.withColumn("seq", F.lit(-1).cast("long"))
    return latest(old.unionByName(changes.withColumn("seq", F.col("seq").cast("long"))), key).drop("first_seq")


def delete(table: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def new_sources(batch: DataFrame, journal: DataFrame) -> DataFrame:
    """Records of a batch whose source wasn't in the journal before; the journal's key isn't stripped."""
    return batch.join(journal.select("source").distinct(), "source", "left_anti")


def with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k", T.key(F.col("source")))
