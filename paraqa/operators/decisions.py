"""Choosing a final text among draft, review, second draft, note and correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as T

#: Fixed value: the shortest paragraph that is translated.
LEAST_LENGTH = 3
#: Codes of the notes that a refused fix leaves.
BREAKS, WORSE = "kept_draft:markup", "kept_draft:issues"


def choose(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """rows (source, draft, verdict, output, problems; nulls without a review) with final and problems.

    A fix is taken if it says so, isn't blank, breaks no markup that the draft had right and has no more issues.
    """
    fix, draft = checks.check(F.col("source"), F.col("output"), keep), checks.check(F.col("source"), F.col("draft"), keep)
    rows = rows.withColumns({"_fix": fix, "_draft": draft, "problems": F.coalesce("problems", F.array().cast("array<string>"))})
    offered = F.col("verdict").eqNullSafe("fixed") & (T.strip(F.coalesce("output", F.lit(""))) != "")
    breaks = checks.broken_markup(F.col("_fix")) & ~checks.broken_markup(F.col("_draft"))
    worse = F.size("_fix") > F.size("_draft")
    final = F.when(offered & ~breaks & ~worse, T.strip(F.col("output"))).otherwise(F.col("draft"))
    noted = F.when(offered & breaks, F.concat("problems", F.array(F.lit(BREAKS)))).when(offered & worse, F.concat("problems", F.array(F.lit(WORSE)))).otherwise(F.col("problems"))
    return rows.withColumns({"final": final, "problems": noted}).drop("_fix", "_draft")


def retranslated(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """rows (source, draft, again) with final and problems: the second draft only where it has strictly fewer issues."""
    rows = checks.checked(rows, "draft", keep).withColumn("_again", checks.check(F.col("source"), F.col("again"), keep))
    better = (F.size("issues") > 0) & F.col("again").isNotNull() & (F.size("_again") < F.size("issues"))
    return rows.withColumns({"final": F.when(better, F.col("again")).otherwise(F.col("draft")), "problems": F.when(better, F.col("issues")).otherwise(F.array().cast("array<string>"))}).drop("_again", "issues")


def improve(rows: DataFrame, mode: str, reviews: DataFrame | None = None, replied: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """rows (batch, id, source, draft, and `again` where a second draft can be had) with final and problems.

    mode `full`: a batch whose review could be read is decided by it, rows that it doesn't name keep their draft; where the
    review failed, and in mode `rules`, a second draft counts if it has strictly fewer issues. mode `off`: drafts as they
    are. reviews: batch, id, verdict, problems, output. replied: the batches whose reply could be read, if not just those
    of reviews.
    """
    none = F.array().cast("array<string>")
    if mode == "off":
        return rows.withColumns({"final": F.col("draft"), "problems": none})
    if mode not in ("full", "rules"):
        raise ValueError(f"no such mode: {mode}")
    if "again" not in rows.columns:
        rows = rows.withColumn("again", F.lit(None).cast("string"))
    if mode == "rules" or reviews is None:
        return retranslated(rows, keep)
    read = (reviews if replied is None else replied).select("batch").distinct().withColumn("_read", F.lit(True))
    found = rows.join(reviews.select("batch", "id", "verdict", "output", F.col("problems").alias("_said")), ["batch", "id"], "left").join(read, "batch", "left")
    first, second = found.where("_read"), found.where("_read IS NULL")
    chosen = choose(first.withColumnRenamed("_said", "problems"), keep).drop("verdict", "output", "_read")
    return chosen.unionByName(retranslated(second.drop("verdict", "output", "_read", "_said"), keep))


def notes_of(improved: DataFrame, seq: Column | None = None) -> DataFrame:
    """k, source, draft, final, problems (and seq, the order of writing) of what improve() gave, to be upserted; it is saved
    whatever was decided."""
    order = [] if seq is None else [seq.alias("seq")]
    return improved.select(T.key(F.col("source")).alias("k"), "source", "draft", "final", "problems", *order)


def translatable(rows: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """Rows whose source is long enough to be translated."""
    return rows.where(F.length("source") >= least)


def finish(rows: DataFrame, overrides: DataFrame, notes: DataFrame, keep: Column | None = None) -> DataFrame:
    """rows (source, text) as paragraphs: a correction by hand wins and isn't checked; a note gives draft and problems.

    overrides: k, translation. notes: k, draft, final, problems. Both have a row for each key; Spark broadcasts them if small.
    """
    found = rows.withColumn("k", T.key(F.col("source"))).join(overrides.select("k", "translation"), "k", "left").join(notes.select("k", "draft", F.col("final").alias("_noted"), "problems"), "k", "left")
    over = F.coalesce("translation", F.lit("")) != ""
    found = found.withColumns({"overridden": over, "final": F.when(over, F.col("translation")).otherwise(F.col("text")), "draft": F.coalesce("draft", F.lit("")), "problems": F.coalesce("problems", F.array().cast("array<string>"))})
    corrected = (F.col("draft") != "") & (T.strip(F.col("draft")) != T.strip(F.coalesce("_noted", F.lit(""))))
    issues = F.when(F.col("overridden"), F.array().cast("array<string>")).otherwise(checks.check(F.col("source"), F.col("final"), keep))
    return found.withColumns({"corrected": corrected, "issues": issues}).drop("k", "translation", "_noted", "text")


def needing_translation(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows without a correction by hand: only these go to a translator."""
    return rows.withColumn("k", T.key(F.col("source"))).join(overrides.where("translation <> ''").select("k"), "k", "left_anti").drop("k")


def drafts_with_sources(sources: DataFrame, drafts: DataFrame, *by: str) -> DataFrame:
    """Sources that have a draft."""
    return sources.join(drafts, list(by), "inner")
