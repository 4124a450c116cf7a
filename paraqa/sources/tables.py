"""Reading and writing glossaries, reports, notes and ordered parts."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import report
from ..operators.journal import delete, upsert

ITEM = "kind string, page int, source string, translation string, notes array<string>, draft string"


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """source, target of a CSV with a header, a byte order mark or none; stripped, blank rows dropped."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns)).select("source", "target")
    return rows.select(T.strip(F.col("source")).alias("source"), T.strip(F.col("target")).alias("target")).where("source <> '' AND target <> ''")


def write_glossary(glossary: DataFrame, path: str) -> None:
    glossary.orderBy("source").write.mode("overwrite").csv(path, header=True)


def write_report(items: DataFrame, paragraphs: int, path: str) -> None:
    """The report as one JSON object, items in report order: a report is read by people. items: as of report.build()."""
    order = (report.rank().alias("_rank"), F.coalesce("page", F.lit(report.NO_PAGE)).alias("_page"), F.col("seq").alias("_seq"))
    rows = F.array_sort(F.collect_list(F.struct(*order, "kind", "page", "source", "translation", "notes", "draft")))
    fields = ("kind", "page", "source", "translation", "notes", "draft")
    body = items.agg(F.transform(rows, lambda r: F.struct(*(r[f].alias(f) for f in fields))).alias("items"))
    body.select(F.to_json(F.struct(F.lit(paragraphs).alias("paragraphs"), "items")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Items of a report, with the number of paragraphs."""
    return spark.read.schema(f"paragraphs long, items array<struct<{ITEM.replace(' string', ': string').replace(' int', ': int').replace(' array', ': array')}>>").json(path, multiLine=True).select("paragraphs", F.inline("items"))


#: A paragraph as a batch keeps it.
PARAGRAPH = "source string, final string, draft string, problems array<string>, issues array<string>, layout string, corrected boolean, overridden boolean"


def write_notes(paragraphs: DataFrame, path: str) -> None:
    """Records of a batch as JSON, a line each."""
    paragraphs.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Records of a batch, from lines or from one array; fields that aren't there are null, a path that isn't there has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], PARAGRAPH)
    return spark.read.schema(PARAGRAPH).json(path, multiLine=True) if path.endswith(".json") else spark.read.schema(PARAGRAPH).json(path)


def blocks(pages: DataFrame) -> DataFrame:
    """page, i, text: the lines of each page, counted from 0. pages: page, text."""
    return pages.select("page", F.posexplode(F.split("text", "\n")).alias("i", "text"))


def moved(spark: SparkSession, path: str, to: str) -> str | None:
    """Puts a finished file or folder in its place at once, over what is there; None where there is nothing to move."""
    if not _exists(spark, path):
        return None
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"can't move {path} to {to}")
    return to


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_keyed(spark: SparkSession, path: str, changes: DataFrame, schema: str) -> DataFrame:
    """Upserts changes (with k and seq) into a keyed table, as a new version beside the old one; returns the table."""
    return _next(spark, path, lambda old: upsert(old, changes), schema)


def delete_keyed(spark: SparkSession, path: str, keys: DataFrame, schema: str) -> DataFrame:
    return _next(spark, path, lambda old: delete(old, keys), schema)


def read_keyed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    version = _version(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v={version}") if version else spark.createDataFrame([], schema)


def _version(spark: SparkSession, path: str) -> int:
    """The last version that was committed whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max(done, default=0)


def _next(spark: SparkSession, path: str, change, schema: str) -> DataFrame:
    version = _version(spark, path) + 1
    change(read_keyed(spark, path, schema)).write.mode("overwrite").parquet(f"{path}/v={version}")
    return spark.read.schema(schema).parquet(f"{path}/v={version}")


def ordered_concat(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Parts in a row, with the number of the part."""
    numbered = [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered).orderBy("part", *order)


def labelled_union(results: dict[str, DataFrame], current: str) -> DataFrame:
    """Earlier results by engine, the current engine's last."""
    order = sorted(results, key=lambda k: (k == current, k))
    return reduce(DataFrame.unionByName, [results[k].withColumns({"label": F.lit(k), "label_no": F.lit(n)}) for n, k in enumerate(order)])


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where the input has fewer parts than twice the cores: a small file may be one row group, which one
    task would read and work on alone. Larger inputs stay as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


def output_names(path: str, folder: str = "", engine: str = "") -> dict[str, str]:
    """Names of the results of a document."""
    p = PurePosixPath(path)
    base = f"{folder or p.parent}/{p.stem}.zh-CN{'.' + engine if engine else ''}"
    return {"mono": f"{base}.pdf", "dual": f"{base}.dual.pdf", "report": f"{base}.report.json", "glossary": f"{base}.glossary.csv"}
