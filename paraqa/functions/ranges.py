"""Page ranges: parsing, formatting, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import strip

#: Pages of the first batches, and of all later ones.
FIRST_BATCHES, LATER = (3, 10, 20), 30


def clean_spec(spec: Column) -> Column:
    """A range as typed into a field: what is still unfinished at its ends goes, so "5-" is page 5 there."""
    return F.trim(strip(spec), F.lit(",，-"))


def page_error(spec: Column, pages: Column, encrypted: Column) -> Column:
    """Why a document can't be translated: encrypted, bad_range, no_pages; null if it can."""
    found = parse_pages(spec, pages, strict=False)
    return F.when(encrypted, "encrypted").when(found.isNull(), "bad_range").when(F.size(found) == 0, "no_pages")


def pages_to_translate(spec: Column, pages: Column, encrypted: Column) -> Column:
    """The pages; an error where there is a reason against it."""
    why = page_error(spec, pages, encrypted)
    return F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("can't translate: "), why)).cast("array<int>")).otherwise(parse_pages(spec, pages, strict=False))


def contained_pages(spec: Column, own: Column, pages: Column) -> Column:
    """Original pages in a translated file of `own` pages (null if it can't be read): all of them if there are as many, else
    those of the range; all too if the range is wrong."""
    every = F.when(pages > 0, F.sequence(F.lit(0), pages - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(own.eqNullSafe(pages), every).otherwise(F.coalesce(parse_pages(spec, pages, strict=False), every))


def parse_pages(spec: Column, pages: Column, strict: bool = True) -> Column:
    """ "1-3,7" as sorted zero-based pages; open ends, a full-width comma, empty for all; past the end is cut off. A start
    below 1, an end before its start or what is no number is an error; null if not strict."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(strip(spec), "，", ","), ","), strip), lambda p: p != "")

    def ends(part: Column) -> Column:
        cut = F.split(part, "-", 2)
        first, last = F.trim(cut[0]), F.when(F.size(cut) > 1, F.trim(cut[1])).otherwise(F.trim(cut[0]))
        start = F.when((first == "") & (F.size(cut) > 1), 1).otherwise(first.try_cast("int"))
        end = F.when((last == "") & (F.size(cut) > 1), pages).otherwise(last.try_cast("int"))
        return F.struct(start.alias("start"), end.alias("end"), part.alias("part"))

    def pages_of(r: Column) -> Column:
        wrong = F.coalesce((r.start < 1) | (r.end < r.start), F.lit(True))
        end = F.least(r.end, pages)
        return F.when(wrong, F.raise_error(F.concat(F.lit("bad page range: "), r.part)).cast("array<int>") if strict else F.lit(None).cast("array<int>")).when(r.start > end, F.array().cast("array<int>")).otherwise(F.sequence(r.start - 1, end - 1))

    some = F.array_sort(F.array_distinct(F.flatten(F.transform(F.transform(parts, ends), pages_of))))
    every = F.when(pages > 0, F.sequence(F.lit(0), pages - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(strip(spec) == "", every).otherwise(some)


def format_pages(pages: DataFrame, *by: str) -> DataFrame:
    """by, spec: zero-based pages as "1-3,6"."""
    run = F.col("page") - F.row_number().over(Window.partitionBy(*by).orderBy("page"))
    runs = pages.select(*by, "page").distinct().withColumn("run", run).groupBy(*by, "run").agg(F.min("page").alias("a"), F.max("page").alias("z"))
    one = F.when(F.col("a") == F.col("z"), (F.col("a") + 1).cast("string")).otherwise(F.concat_ws("-", F.col("a") + 1, F.col("z") + 1))
    return runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("a", one.alias("s")))).alias("parts")).select(*by, F.array_join(F.transform("parts", lambda p: p.s), ",").alias("spec"))


def batch_of(ordinal: Column) -> Column:
    """Batch of a zero-based ordinal: small ones first, for early results."""
    out, at = None, 0
    for k, n in enumerate(FIRST_BATCHES):
        at += n
        out = F.when(ordinal < at, k) if out is None else out.when(ordinal < at, k)
    return out.otherwise(len(FIRST_BATCHES) + F.floor((ordinal - at) / LATER)).cast("int")
