"""From documents to shards: quality rules, near-duplicates, benchmark leaks, mixture, shards. Part of paraqa.llm.

Each stage is an operator with its production parameters over all that its predecessor kept, whole texts. Nulls: a row
without a text fails the base quality rules and goes; a null language or source is a group of its own, a null doc_id a value
like any other. Repeated rows and near copies leave one row, ties are settled by doc_id and hash of the text. The mixture
may repeat rows. An empty table gives an empty result. Columns besides those that the stages read pass through, whatever
their names; where one has the name of a column that the last stage adds, the added one's name gets `reshard_` in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paraqa.llm import decontam, mixing, quality, sharding, similar
from paraqa.llm.common import documents, staged

#: Each stage gets what its predecessor kept, written as Parquet and read again.
STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", similar.stage),
    ("decontamination", decontam.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: Sketched thresholds, hashing by masks, pivotal rounding and flows aren't SQL; see tests/llm for brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
