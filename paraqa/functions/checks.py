"""The rules that a translation is checked by. Issues are stable codes, in the order of the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Shares of target to source length that are too short and too long, for sources of this length at least;
#: English words from which a source is prose; how many leftovers are named.
SHORT, LONG, MEASURED, PROSE, NAMED = 0.18, 1.3, 40, 4, 3


def check(source: Column, output: Column, keep: Column | None = None) -> Column:
    """ARRAY<STRING> of issues; null texts are empty. keep: lower-case terms that may stay English.

    Each text is stripped, freed of placeholders and searched once, see text.let.
    """
    keep = F.array().cast("array<string>") if keep is None else keep
    text = lambda c: T.strip(F.coalesce(c, F.lit("")))
    texts = F.struct(text(source).alias("src"), text(output).alias("out"), keep.alias("keep"))
    return T.let(texts, lambda t: F.when(F.length(t.out) == 0, F.array(F.lit("empty"))).otherwise(_rules(t.src, t.out, t.keep)))


def _rules(src: Column, out: Column, keep: Column) -> Column:
    """Issues of an output that isn't empty."""
    bare = F.struct(T.plain(src).alias("src"), T.plain(out).alias("out"))
    return T.let(bare, lambda b: F.array_compact(F.concat(F.array(_markup(src, out), _numbers(b)), _of_prose(src, out, b, keep))))


def _markup(src: Column, out: Column) -> Column:
    return F.when(F.sort_array(T.placeholders(src)) != F.sort_array(T.placeholders(out)), F.lit("markup"))


def _numbers(bare: Column) -> Column:
    named = lambda m: F.when(F.size(m) > 0, F.concat(F.lit("numbers:"), F.array_join(m, "|")))
    both = F.struct(T.numbers_in(bare.src).alias("src"), T.numbers_in(bare.out).alias("out"))
    return T.let(both, lambda b: F.when(b.src != b.out, T.let(T.surplus(b.src, b.out), named)))


def _of_prose(src: Column, out: Column, bare: Column, keep: Column) -> Column:
    """The rules that hold for sources of some English words."""
    long_enough = lambda m: m.src >= MEASURED
    ratio = lambda m: m.out / F.greatest(m.src, F.lit(1))
    measures = F.struct(T.count_cjk(out).alias("cjk"), F.length(T.without_space(bare.src)).alias("src"), F.length(T.without_space(bare.out)).alias("out"))
    length = T.let(
        measures,
        lambda m: F.when(m.cjk == 0, F.lit("no_cjk")).when(long_enough(m) & (ratio(m) < SHORT), F.lit("short")).when(long_enough(m) & (ratio(m) > LONG), F.lit("long")),
    )
    among = lambda runs: T.let(F.lower(src), lambda low: F.filter(runs, lambda r: F.contains(low, F.lower(r)) & ~F.array_contains(keep, F.lower(r))))
    left = T.let(T.english_runs_in(bare.out, PROSE), lambda runs: F.when(F.size(runs) > 0, among(runs)).otherwise(runs))
    leftover = T.let(left, lambda rs: F.when(F.size(rs) > 0, F.concat(F.lit("leftover:"), F.array_join(F.slice(rs, 1, NAMED), "|"))))
    return F.when(T.has_words(bare.src, PROSE), F.array(leftover, length)).otherwise(F.array().cast("array<string>"))


def ok(issues: Column) -> Column:
    return F.size(issues) == 0


def broken_markup(issues: Column) -> Column:
    return F.array_contains(issues, "markup")


def checked(pairs: DataFrame, output: str = "draft", keep: Column | None = None) -> DataFrame:
    """pairs (source and an output column) with issues."""
    return pairs.withColumn("issues", check(F.col("source"), F.col(output), keep))
