"""Quality rules with adaptive thresholds.

Each text's signals are counted in one pass. Their distributions in every language and source are kept as log-linear
quantile sketches: bins of whole numbers, 16 to an octave, hence within 6 % of the true quantile, and sketches merge by
adding counts. The sketches of a source and language are merged from those of all tasks; a group is judged by its own
sketch, whatever its size. A limit is a rate: the fence above (or below) the middle half of the group's own distribution.
There is no cutoff that all groups share. A document's count may differ from what the limit makes of its length by what
chance makes of a count: so many standard deviations of events that come at that rate (see inside()), which matters in short
documents and in groups that have next to no events. A document is kept if no signal is beyond and the base rules hold.

Nulls: a null text has no words and fails the base rules; null lang and source are groups of their own. Repeated rows are
counted as they come, an empty table gives an empty result, other columns pass through filter_documents() untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import as_bytes, batch, documents, staged

#: Base rules, fixed values: least words, and the most percent of words in repeated five-word windows.
LEAST_WORDS, WINDOW, MOST_REPEAT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"

#: Signals by count: the column, what it is counted in, and the size of one event (a repeated window is found twice, so it
#: makes at least 2 * WINDOW words). Signals by the mean length of words: the side that is fenced.
COUNTED = {"symbols": ("n_symbols", "n_words", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 2 * WINDOW)}
LENGTHS = {"long_words": "high", "short_words": "low"}
SIGNALS = (*COUNTED, *LENGTHS)
#: A fence stands so many times the distance between the quartiles beyond the quartile; standard deviations that chance gets.
FENCE, DEVIATIONS = 3, 6

COUNTS = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_lines", pa.int64())])


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows found twice or more, the first included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    # windows are numbered exactly: pairs of numbers are numbered in turn, so no hash can collide
    at = ids
    for k in range(1, window):
        _, at = np.unique(at[:n] * (len(ids) + 1) + ids[k : k + n], return_inverse=True)
    again = np.bincount(at)[at] > 1
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    edges[:n] += again
    edges[window : window + n] -= again
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def signals(raw: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a text in UTF-8."""
    words = raw.split()
    chars = sum(map(len, words))
    if not raw.isascii():  # bytes that go on a character
        chars -= int(np.count_nonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) == 0x80))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    numbers: dict[bytes, int] = {}
    repeats = 0
    if len(words) > WINDOW:
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
        if len(numbers) < len(words):
            repeats = repeat_words(ids)
    return len(words), chars, sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), len(lines) - len(set(lines)), repeats, len(lines)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [signals(x.as_py()) for x in b.column("text")]
        found = batch(COUNTS, **dict(zip(COUNTS.names, zip(*rows, strict=True) if rows else [[]] * 6, strict=True)))
        rest = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), *found.columns], names=[*rest, *COUNTS.names])


def count_signals(docs: DataFrame) -> DataFrame:
    """key (doc_id as long), lang, source and the counted signals for each row."""
    rows = as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(_count, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in COUNTS.names))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))


def scaled() -> dict[str, Column]:
    """The signals as whole numbers: parts per thousand of words or lines, word lengths in thousandths."""
    per = lambda a, b: F.expr(f"(1000 * {a}) div greatest({b}, 1)")
    return {k: per(a, b) for k, (a, b, _) in COUNTED.items()} | {"length": per("word_chars", "n_words")}


def bin_of(value: Column) -> Column:
    """Bin of a whole number from 0: itself below 32, then 16 to an octave. Integer arithmetic only."""
    octave = (F.length(F.bin(value)) - 5).cast("int")
    return F.when(value < 32, value).otherwise(octave * 16 + F.call_function("shiftright", value, octave)).cast("int")


def bin_low(number: Column) -> Column:
    """The least value of a bin."""
    octave = (F.floor(number / 16) - 1).cast("int")
    return F.when(number < 32, number.cast("long")).otherwise(F.call_function("shiftleft", (number - octave * 16).cast("long"), octave))


def sketch(rows: DataFrame, *by: str) -> DataFrame:
    """by, signal, bin, n: counts are summed in each task first, so a hot group costs no more than its bins."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), bin_of(v).alias("bin")) for k, v in scaled().items())))
    return rows.select(*by, cells.alias("c")).groupBy(*by, "c.signal", "c.bin").agg(F.count("*").alias("n"))


def quantiles(cells: DataFrame, *by: str) -> DataFrame:
    """by, signal, docs, q1, q3. A group's cells are bounded by the bins: collected, sorted and walked as an array."""
    rows = cells.groupBy(*by, "signal").agg(F.sum("n").alias("docs"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("cells"))
    walk = "aggregate(cells, named_struct('seen', 0L, 'at', -1), (s, x) -> named_struct('seen', s.seen + x.n, 'at', if(s.at < 0 and {k} * (s.seen + x.n) >= {m} * docs, x.bin, s.at))).at"
    return rows.select(*by, "signal", "docs", bin_low(F.expr(walk.format(k=4, m=1))).alias("q1"), bin_low(F.expr(walk.format(k=4, m=3))).alias("q3"))


def limits(rows: DataFrame) -> DataFrame:
    """lang, source, and a limit for each signal (thousandths) from the group's own sketch, and the third quartile of the mean
    word length. rows are those the base rules kept."""
    rows = quantiles(staged(sketch(rows, "lang", "source"), "quality-sketch"), "lang", "source")
    spread = FENCE * (F.col("q3") - F.col("q1"))
    end = lambda signal, value, name: F.max(F.when(F.col("signal") == signal, value)).alias(name)
    high, low = F.col("q3") + spread, F.col("q1") - spread
    ends = [end(k, high, f"limit_{k}") for k in COUNTED] + [end("length", high if side == "high" else low, f"limit_{k}") for k, side in LENGTHS.items()]
    return rows.groupBy("lang", "source").agg(*ends, end("length", F.col("q3"), "typical_length"))


def inside() -> Column:
    """Whether all signals are within the limits and what chance adds.

    Events of size u at a limit's rate make a count of e on the average, with a deviation of sqrt(u * e); DEVIATIONS of these
    and as many events are chance. Lengths of words deviate by about half their mean, means of n words by that over sqrt(n).
    """
    within = F.lit(True)
    for k, (count, of, event) in COUNTED.items():
        expected = F.col(f"limit_{k}") * F.col(of) / 1000
        within &= F.col(count) <= expected + DEVIATIONS * (F.sqrt(event * expected) + event)
    chance = DEVIATIONS * F.col("typical_length") / 2 / F.sqrt(F.greatest("n_words", F.lit(1)))
    for k, side in LENGTHS.items():
        length = scaled()["length"]
        within &= length <= F.col(f"limit_{k}") + chance if side == "high" else length >= F.col(f"limit_{k}") - chance
    return within


def judge(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, lang, source, counts, base_failed, the limits that held, and kept."""
    rows = staged(count_signals(docs).withColumn("base_failed", base_failed()), "quality-signals")
    fences = limits(rows.where("not base_failed"))
    met = rows.alias("d").join(fences.alias("f"), F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    return met.select("d.*", *(F.col(f"f.limit_{k}") for k in SIGNALS), (~F.col("base_failed") & F.coalesce(inside(), F.lit(True))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source")


def _sql() -> str:
    """DuckDB: the same counts by lists and windows, exact ranks of the sketch's bins, the same limits."""
    counted = "\n".join(f"  UNION ALL SELECT lang, source, '{k}', 1000 * {c} // greatest({of}, 1) FROM s WHERE NOT base_failed" for k, (c, of, _) in COUNTED.items())
    ends = ", ".join(f"max(q3 + {FENCE} * (q3 - q1)) FILTER (signal = '{k}') AS limit_{k}" for k in COUNTED)
    within = " AND ".join(f"{c} <= limit_{k} * {of} / 1000 + {DEVIATIONS} * (sqrt({event} * (limit_{k} * {of} / 1000)) + {event})" for k, (c, of, event) in COUNTED.items())
    chance = f"{DEVIATIONS} * typical / 2 / sqrt(greatest(n_words, 1))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS n FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(i)),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM g, unnest(range(i, i + {WINDOW})) AS u(j) WHERE n > 1 GROUP BY rid),
c AS (SELECT d.rid, doc_id, lang, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)),
s AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT} * n_words AS base_failed FROM c),
v AS (SELECT lang, source, 'length' AS signal, 1000 * word_chars // greatest(n_words, 1) AS v FROM s WHERE NOT base_failed
{counted}),
b AS (SELECT lang, source, signal, CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 5)) << (length(bin(v)) - 5) END AS low FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, signal ORDER BY low) AS rk, count(*) OVER (PARTITION BY lang, source, signal) AS n FROM b),
q AS (SELECT lang, source, signal, min(low) FILTER (4 * rk >= n) AS q1, min(low) FILTER (4 * rk >= 3 * n) AS q3 FROM k GROUP BY lang, source, signal),
f AS (SELECT lang, source, {ends}, max(q3 + {FENCE} * (q3 - q1)) FILTER (signal = 'length') AS most_length, max(q1 - {FENCE} * (q3 - q1)) FILTER (signal = 'length') AS least_length, max(q3) FILTER (signal = 'length') AS typical
  FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({within} AND 1000 * word_chars // greatest(n_words, 1) <= most_length + {chance} AND 1000 * word_chars // greatest(n_words, 1) >= least_length - {chance}, true) AS kept,
  s.lang, s.source
FROM s LEFT JOIN f ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source
"""


SQL = _sql()


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns. The rows are carried as one column beside the signals, so
    their names can't clash; their texts are read a second time, after the limits are known, and not shuffled before the
    join with the limits, which are a row for each language and source."""
    fences = staged(limits(count_signals(docs).withColumn("base_failed", base_failed()).where("not base_failed")), "quality-limits")
    whole = F.struct("*").alias("row")
    rows = as_bytes(docs, whole, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    schema = StructType([StructField("row", docs.schema), StructField("lang", StringType()), StructField("source", StringType()), *(StructField(n, LongType()) for n in COUNTS.names)])
    counted = rows.mapInArrow(_count, schema).where(~base_failed())
    met = counted.alias("d").join(fences.alias("f"), F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    return met.where(F.coalesce(inside(), F.lit(True))).select("d.row.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_documents(docs)
