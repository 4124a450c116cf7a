"""Work in batches that can be stopped and taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from ..functions.ranges import batch_of


def signature(*inputs: Column) -> Column:
    """A stable hash of all that decides a result; parts made under another one aren't reused."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(inputs))), {"ignoreNullFields": "false"}), 256)


def batches(pages: DataFrame, by: str) -> DataFrame:
    """pages (by, page) with batch and the batch's key: the pages in it, so a part is never taken for other pages'."""
    rows = pages.withColumn("batch", batch_of(F.row_number().over(Window.partitionBy(by).orderBy("page")) - 1))
    keys = rows.groupBy(by, "batch").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("page")), ","), 256).alias("batch_key"))  # a batch has 30 pages at most
    return rows.join(keys, [by, "batch"])


def todo(batched: DataFrame, done: DataFrame, by: str) -> DataFrame:
    """Pages of batches that aren't done yet under their key. Where both have a signature, a part that was made under another
    one (another file, other settings) isn't done either."""
    keys = [by, "batch_key", *(["signature"] if "signature" in batched.columns and "signature" in done.columns else [])]
    return batched.join(done.select(*keys).distinct(), keys, "left_anti")


def run(spark: SparkSession, source: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None], files: int = 1) -> StreamingQuery:
    """Hands the files that are new since the last run to `each`, some at a time. stop() ends it between batches; the next
    run goes on from the checkpoint."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
