"""Pages on screen and side by side: prefix sums, offsets, comparisons, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def page_tops(pages: DataFrame, by: str, zoom: float, gap: int) -> DataFrame:
    """pages (by, page, height) with top: the heights of the pages before, rounded, and the gaps."""
    before = Window.partitionBy(by).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    step = F.round(F.col("height") * zoom).cast("long") + gap
    return pages.withColumn("top", F.coalesce(F.sum(step).over(before), F.lit(0)))


def page_widths(pages: DataFrame, by: str) -> DataFrame:
    """by, width: the widest page of each document, 1 where no width is known."""
    return pages.groupBy(by).agg(F.coalesce(F.max("width"), F.lit(1.0)).alias("width"))


def totals(batches: DataFrame, by: str) -> DataFrame:
    """by, tokens, seconds, pages, pace: sums over the batches that were translated, and seconds a page."""
    rows = batches.groupBy(by).agg(F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"), F.sum("pages").alias("pages"))
    return rows.withColumn("pace", F.when(F.col("pages") > 0, F.col("seconds") / F.col("pages")).otherwise(0.0))


def progress(events: DataFrame, by: str) -> DataFrame:
    """by, stage, overall: of each job's last event (seq, stage, done, percent, total), its stage and percent of the whole job."""
    last = events.groupBy(by).agg(F.max_by(F.struct("stage", "done", "percent", "total"), "seq").alias("e"))
    return last.select(by, T.progress_text(F.col("e.stage")).alias("stage"), T.overall_progress(F.col("e.done"), F.col("e.percent"), F.col("e.total")).alias("overall"))


def page_at(tops: DataFrame, offsets: DataFrame, by: str) -> DataFrame:
    """by, y, page: the last page that starts at the offset or above; the first one where none does.

    Offsets and tops are merged in one ordered pass, so no offset meets all tops.
    """
    marks = tops.select(by, F.col("top").alias("y"), F.lit(0).alias("kind"), "page").unionByName(offsets.select(by, "y", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("page")))
    order = Window.partitionBy(by).orderBy("y", "kind", "page")
    first = F.min("page").over(Window.partitionBy(by))
    return marks.withColumn("page", F.coalesce(F.last("page", ignorenulls=True).over(order), first)).where("kind = 1").select(by, "y", "page")


def changes(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def compare(originals: DataFrame, found: DataFrame, running: DataFrame) -> DataFrame:
    """label, page, state: an engine's page is there, is being made, or is outside its range."""
    hit = found.select("label", "page").distinct().withColumn("_found", F.lit("found"))
    run = running.select("label", "page").distinct().withColumn("_running", F.lit("running"))
    state: Column = F.coalesce("_found", "_running", F.lit("outside"))
    return originals.join(hit, ["label", "page"], "left").join(run, ["label", "page"], "left").select("label", "page", state.alias("state"))


def original_page(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """label, serial, place, page: the first original page of a page in a translated part."""
    return wanted.join(index.groupBy("label", "serial", "place").agg(F.min("page").alias("page")), ["label", "serial", "place"])


def pending(wanted: DataFrame, done: DataFrame, *by: str) -> DataFrame:
    """Wanted pages that aren't done, each once."""
    return wanted.select(*by).distinct().join(done.select(*by), list(by), "left_anti")
