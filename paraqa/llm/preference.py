"""Preference formatting of paired conversations, with DataFrame functions only.

The chosen and the rejected conversation of a pair are laid side by side, turn by turn. Their longest common prefix of
turns (equal role and text) is rendered once, as the prompt; what follows on each side is rendered as that side's
completion. A row is a rendered turn: conversations of any length stay spread over tasks. The turns of a part, in order of
position, are its string; start and end are places in the side's whole string (prompt and completion), in characters.
In completions, what an assistant wrote is to be learned: mask_start and mask_end bound it, end mark included; all else,
and all of the prompt, is masked and has null there.

Positions are ranks within a conversation, by turn, role, text, nulls first; so ties and repeated rows have an order, and
gaps in the numbering don't matter. Nulls: a null role or text is rendered as empty, but equals only a null. Rows without
a pair number form the pair null. A pair with one side has no prompt; two equal conversations are all prompt. Empty tables
give empty results. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ChatML marks, fixed values; in a text, `<|im_` is broken up by a space so that a text can't forge a turn. The space stays:
#: a text that holds such a mark can't be had back from its rendering.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Turns are ranked in chunks of so many turn numbers, and chunks by their counts, so a long conversation is spread.
CHUNK = 256


def preference_rows(turns: DataFrame) -> DataFrame:
    """turns: pair_id long, side ('chosen' or 'rejected'), turn long, role, text."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    role = safe(F.col("role"))
    rows = turns.select("pair_id", "side", "turn", "role", "text", F.floor(F.col("turn") / CHUNK).alias("chunk"), F.concat(F.lit(BEGIN), role, F.lit("\n")).alias("head"))
    rows = rows.withColumn("rendered", F.concat("head", safe(F.col("text")), F.lit(END)))
    inside = Window.partitionBy("pair_id", "side", "chunk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumns({"rank": F.row_number().over(inside), "done": F.sum(F.length("rendered")).over(inside.rowsBetween(Window.unboundedPreceding, 0))})

    chunks = rows.groupBy("pair_id", "side", "chunk").agg(F.count("*").alias("n"), F.sum(F.length("rendered")).alias("chars"))
    before = Window.partitionBy("pair_id", "side").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("pair_id", "side", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("pair_id", "side", "chunk")]
    rows = rows.alias("r").join(chunks.alias("c"), same).select("r.*", (F.col("n_before") + F.col("rank")).alias("position"), (F.col("chars_before") + F.col("done")).alias("end"))

    said = F.struct("role", "text")
    places = rows.groupBy("pair_id", "position").agg(F.count("*").alias("n"), F.min(said).alias("a"), F.max(said).alias("b"))
    equal = (F.col("n") == 2) & F.col("a").eqNullSafe(F.col("b"))
    ends = places.groupBy("pair_id").agg(F.coalesce(F.min(F.when(~equal, F.col("position"))) - 1, F.max("position")).alias("prefix"))
    rows = rows.alias("r").join(ends.alias("e"), F.col("r.pair_id").eqNullSafe(F.col("e.pair_id"))).select("r.*", "prefix")

    shared = F.col("position") <= F.col("prefix")
    learned = ~shared & F.col("role").eqNullSafe(F.lit("assistant"))
    start = F.col("end") - F.length("rendered")
    return rows.where(~shared | (F.col("side") == "chosen")).select(
        "pair_id",
        F.when(shared, F.lit("prompt")).otherwise(F.col("side")).alias("part"),
        F.col("position").cast("long").alias("position"),
        "role",
        "rendered",
        start.cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        F.when(learned, start + F.length("head")).cast("long").alias("mask_start"),
        F.when(learned, F.col("end")).cast("long").alias("mask_end"),
    )


def assembled(rows: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected, and the places in each completion that are to be learned (start, end), from the rows
    of preference_rows(). A row holds a pair's turns, so it is as long as two conversations."""
    of = lambda p, x: F.array_sort(F.collect_list(F.when(F.col("part") == p, x)))
    text = lambda p: F.array_join(F.transform(of(p, F.struct("position", "rendered")), lambda x: x.rendered), "")
    learned = lambda p: of(p, F.when(F.col("mask_start").isNotNull(), F.struct(F.col("mask_start").alias("start"), F.col("mask_end").alias("end"))))
    found = rows.groupBy("pair_id").agg(*(text(p).alias(p) for p in ("prompt", "chosen", "rejected")), *(learned(p).alias(f"{p}_mask") for p in ("chosen", "rejected")))
    shift = lambda c: F.transform(c, lambda m: F.struct((m.start - F.length("prompt")).alias("start"), (m.end - F.length("prompt")).alias("end")))
    return found.withColumns({f"{p}_mask": shift(f"{p}_mask") for p in ("chosen", "rejected")})


def paired(conversations: DataFrame) -> DataFrame:
    """Conversations 2 k and 2 k + 1 as the chosen and the rejected one of pair k."""
    number = F.col("conv_id").cast("long")
    side = F.when(number.bitwiseAND(F.lit(1)) == 1, "rejected").otherwise("chosen")
    return conversations.select(F.shiftright(number, 1).alias("pair_id"), side.alias("side"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_rows(paired(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: DuckDB: plain windows over each conversation.
SQL = r"""
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, CASE WHEN conv_id & 1 = 1 THEN 'rejected' ELSE 'chosen' END AS side, turn, role, text,
         '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<| im_') || chr(10) AS head,
         '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<| im_') || chr(10) || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS rendered
  FROM conversations),
r AS (
  SELECT *, row_number() OVER w AS position, sum(length(rendered)) OVER (w ROWS UNBOUNDED PRECEDING) AS done
  FROM t WINDOW w AS (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
p AS (
  SELECT pair_id, position, count(*) = 2 AND count(DISTINCT (role, text)) = 1 AS equal FROM r GROUP BY ALL),
e AS (
  SELECT pair_id, coalesce(min(position) FILTER (NOT equal) - 1, max(position)) AS prefix FROM p GROUP BY pair_id)
SELECT r.pair_id, CASE WHEN position <= prefix THEN 'prompt' ELSE side END AS part, position::BIGINT AS position, role, rendered,
       (done - length(rendered))::BIGINT AS start, done::BIGINT AS "end",
       CASE WHEN position > prefix AND role = 'assistant' THEN (done - length(rendered) + length(head))::BIGINT END AS mask_start,
       CASE WHEN position > prefix AND role = 'assistant' THEN done::BIGINT END AS mask_end
FROM r JOIN e ON r.pair_id IS NOT DISTINCT FROM e.pair_id
WHERE position > prefix OR side = 'chosen'
"""
