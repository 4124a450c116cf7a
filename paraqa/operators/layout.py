"""Lists of entries with detached numbers: printed lines, words, entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Numbers of pages and of sections, gaps before and after them and between words (ems), how far a new line
# starts to the left and below (ems), and when a block is a list.
PAGE_NUMBER, SECTION_NUMBER = r"\d{1,4}|[ivxlcdm]{1,7}|[IVXLCDM]{1,7}", r"\d{1,3}(\.\d{1,3}){0,4}\.?"
PAGE_GAP, SECTION_GAP, WORD_GAP, LEFT, BELOW, LEAST_MARKED, MARKED_SHARE, SAME_START = 2.0, 1.0, 0.3, 0.5, 0.6, 3, 0.4, 0.5


def font_sizes(chars: DataFrame) -> DataFrame:
    """line, size: the upper median of the sizes of a line's characters."""
    return chars.groupBy("line").agg(F.array_sort(F.collect_list("size")).alias("s")).select("line", F.expr("element_at(s, cast(size(s) div 2 + 1 as int))").alias("size"))


def printed_lines(chars: DataFrame) -> DataFrame:
    """chars (line, i, c, x, x2, y, y2, size) with `printed`: the number of the printed line in the line. A line starts where
    the text goes back to the left and moves down. Blanks belong to the line they are in, and aren't compared."""
    chars = chars.join(font_sizes(chars).withColumnRenamed("size", "em"), "line")
    ink = Window.partitionBy("line", F.trim("c") != "").orderBy("i")
    middle = (F.col("y") + F.col("y2")) / 2
    turns = (F.trim("c") != "") & (F.col("x") < F.lag("x").over(ink) - LEFT * F.col("em")) & (F.abs(middle - F.lag(middle).over(ink)) > BELOW * F.col("em"))
    return chars.withColumn("turn", F.coalesce(turns, F.lit(False)).cast("int")).withColumn("printed", F.sum("turn").over(Window.partitionBy("line").orderBy("i"))).drop("turn")


def words(chars: DataFrame) -> DataFrame:
    """line, printed, word, text, x, x2, start, em: words end at blanks and at gaps of more than 0.3 em."""
    by = ["line", "printed"]
    order = Window.partitionBy(*by).orderBy("i")
    ink = Window.partitionBy(*by, F.trim("c") != "").orderBy("i")
    new = (F.trim("c") != "") & ((F.trim(F.lag("c", 1, " ").over(order)) == "") | (F.col("x") - F.lag("x2").over(ink) > WORD_GAP * F.col("em")))
    marked = chars.withColumn("new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("word", F.sum("new").over(order)).where(F.trim("c") != "")
    return marked.groupBy(*by, "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s.c), "").alias("text"), F.min("x").alias("x"), F.max("x2").alias("x2"), F.min("i").alias("start"), F.max("em").alias("em"))


def marks(lines: DataFrame) -> DataFrame:
    """line, printed, x, lead_x, trail, em: where the title after a detached section number starts, and the detached page
    number at the end, if there are any."""
    got = words(lines).groupBy("line", "printed").agg(F.array_sort(F.collect_list(F.struct("word", "text", "x", "x2", "em"))).alias("w"))
    n = F.size("w")
    first, second, last, before = F.col("w")[0], F.try_element_at("w", F.lit(2)), F.element_at("w", -1), F.try_element_at("w", F.lit(-2))
    letters = lambda ws: F.exists(ws, lambda w: w.text.rlike("[A-Za-z]"))
    em = first.em
    trail = (n >= 2) & last.text.rlike(f"^(?:{PAGE_NUMBER})$") & letters(F.slice("w", 1, F.greatest(n - 1, F.lit(1)))) & ((last.x - before.x2) / em >= PAGE_GAP)
    lead = (n >= 2) & first.text.rlike(f"^(?:{SECTION_NUMBER})$") & letters(F.slice("w", 2, F.greatest(n, F.lit(1)))) & ((second.x - first.x2) / em >= SECTION_GAP)
    return got.select("line", "printed", first.x.alias("x"), F.when(lead, second.x).alias("lead_x"), F.when(trail, last.text).alias("trail"), em.alias("em"), F.array_join(F.transform("w", lambda w: w.text), " ").alias("text"))


def is_list(lines: DataFrame, by: str = "block") -> DataFrame:
    """by, n, marked, is_list: at least three lines and 40 % with a number, or all of them."""
    marked = F.count_if(F.col("lead_x").isNotNull() | F.col("trail").isNotNull())
    rows = lines.groupBy(by).agg(F.count("*").alias("n"), marked.alias("marked"))
    return rows.withColumn("is_list", ((F.col("marked") >= LEAST_MARKED) & (F.col("marked") >= MARKED_SHARE * F.col("n"))) | (F.col("marked") >= F.col("n")))


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        entry, text_x, closed, out = -1, None, False, []
        for lead, trail, x, em in zip(f.lead_x, f.trail, f.x, f.em, strict=True):
            lead = None if pd.isna(lead) else lead
            goes_on = entry >= 0 and lead is None and not closed and text_x is not None and abs(x - text_x) < SAME_START * em
            if not goes_on:
                entry, text_x, closed = entry + 1, lead, False
            closed = closed or isinstance(trail, str)
            out.append(entry)
        yield f.assign(entry=out)


def entries(lines: DataFrame) -> DataFrame:
    """lines of lists (block, seq, x, lead_x, trail, em, text) with `entry`. A line goes on an entry that has no page number
    yet and whose title starts at the same place. Each line depends on the state before it, and a block is a page's part."""
    ddl = "block string, seq int, x double, lead_x double, trail string, em double, text string, entry int"
    return lines.groupBy("block").applyInPandas(lambda f: next(_entries(iter([f.sort_values("seq")]))), ddl)


def entry_boxes(boxes: DataFrame, chars: DataFrame) -> DataFrame:
    """boxes (line, y, y2) with the height of their characters' font boxes: the least y and the greatest y2 of both, blanks
    left out. chars: line, c, y, y2."""
    reach = chars.where(F.trim(F.coalesce("c", F.lit(""))) != "").groupBy("line").agg(F.min("y").alias("_low"), F.max("y2").alias("_high"))
    return boxes.join(reach, "line", "left").withColumns({"y": F.least("y", "_low"), "y2": F.greatest("y2", "_high")}).drop("_low", "_high")
