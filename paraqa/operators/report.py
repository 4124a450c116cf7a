"""The quality report: classify, find the page, add what is still English, sort."""

from __future__ import annotations

from collections.abc import Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..sources.scratch import staged

#: Kinds in their order; length of probes and of the shortest; words, run and CJK share of an English block;
#: length that sources and blocks are compared by; page rank of rows without a page;
#: characters of a row that a list shows.
KINDS = ("check", "english", "fixed", "manual")
PROBE, LEAST_PROBE, BLOCK_WORDS, BLOCK_RUN, BLOCK_CJK, SAME, NO_PAGE, SNIPPET = 12, 4, 12, 6, 0.1, 40, 1_000_000, 80

#: Bits of the filter that strings of pages pass before they are compared with probes; strings that a task remembers.
BITS, HELD = 1 << 25, 1 << 18
#: What parts of a string are multiplied by in its hash.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def probes_of(text: Column) -> Column:
    """The probes of a text: PROBE characters at its start and from its middle."""
    return T.let(T.squash(text), lambda s: F.array(F.substring(s, 1, PROBE), F.substring(s, F.floor(F.length(s) / 2).cast("int") + 1, F.lit(PROBE))))


def _codes(s: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text, and at each place three of them in one number."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return c, c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]


def _hashes(c: np.ndarray, threes: np.ndarray, length: int) -> np.ndarray:
    """At each place, the hash of the PROBE or LEAST_PROBE characters there."""
    n = len(c) - length + 1
    parts = [threes[k : k + n] for k in range(0, length - 2, 3)] + [c[k : k + n] for k in range(length - length % 3, length)]
    h = sum((p * m for p, m in zip(parts, ODD)), np.zeros(n, np.uint64))
    return (h ^ h >> np.uint64(32)) * ODD[-1]


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def _bits(batches):
    """Maps batches of probe to b: the bits of probes, and of the first characters of those that are shorter than PROBE."""
    for batch in batches:
        found = set()
        for s in batch.column("probe").to_pylist():
            c, threes = _codes(s if len(s) == PROBE else s[:LEAST_PROBE])
            found.update(_bit(_hashes(c, threes, len(c))).tolist() + [crc32(s.encode()) % BITS] * (len(s) < PROBE))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["b"])


def _filter(probes: DataFrame) -> bytes:
    """Bits of probes, of a fixed size whatever their number; where bits meet by chance, strings pass that the join with the
    probes drops."""
    bits = probes.select("probe").distinct().mapInArrow(_bits, "b long")
    found = bits.groupBy(F.expr("shiftright(b, 3)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, CAST(b % 8 AS INT))")).alias("byte")).toArrow()
    out = np.zeros(BITS // 8, np.uint8)
    out[found["at"].to_numpy()] = found["byte"].to_numpy()
    return out.tobytes()


def _strings(bits: bytes, short: bool):
    """Maps batches of page, s to gram, page: the strings of PROBE characters (and the shorter ones, if there are such probes) that
    pass the filter, with the first page of those that a task has seen since it last forgot."""
    table = np.frombuffer(bits, np.uint8)

    def passing(hashes: np.ndarray) -> np.ndarray:
        bit = _bit(hashes)
        return np.flatnonzero(table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)

    def whole(s: str, ends: np.ndarray, c: np.ndarray, threes: np.ndarray) -> dict[str, int]:
        hashes = _hashes(c, threes, PROBE)
        at = passing(hashes)
        at = at[at + PROBE <= ends[np.searchsorted(ends, at, "right")]]
        if not len(at):
            return {}
        at = at[np.argsort(hashes[at])]
        # neighbours in this order that are one string are a group; they are compared by their characters
        new = np.ones(len(at), bool)
        new[1:] = False
        for k in range(0, PROBE, 3):
            part = threes[at + k]
            new[1:] |= part[1:] != part[:-1]
        firsts = np.sort(np.minimum.reduceat(at, np.flatnonzero(new)))[::-1].tolist()
        return {s[i : i + PROBE]: i for i in firsts}

    def parts(s: str, ends: np.ndarray, c: np.ndarray, threes: np.ndarray) -> dict[str, int]:
        at = passing(_hashes(c, threes, LEAST_PROBE))[::-1]
        most = ends[np.searchsorted(ends, at, "right")]
        near = {s[i : min(i + PROBE - 1, e)]: i for i, e in zip(at.tolist(), most.tolist()) if i + LEAST_PROBE <= e}
        found = {}
        for g, i in near.items():
            for n in range(LEAST_PROBE, len(g) + 1):
                found[g[:n]] = min(i, found.get(g[:n], i))
        return {g: i for g, i in found.items() if bits[(b := crc32(g.encode()) % BITS) >> 3] >> (b & 7) & 1}

    def listed(pages: pa.Array, of: list[int], texts: list[str], seen: set[str]):
        """Strings of some pages in their order, worked on as one text in which none goes across a border."""
        s, ends = "".join(texts), np.cumsum([len(t) for t in texts])
        c, threes = _codes(s)
        places = (whole(s, ends, c, threes) if len(s) >= PROBE else {}) | (parts(s, ends, c, threes) if short else {})
        new = {g: i for g, i in places.items() if g not in seen}
        seen |= new.keys()
        if len(seen) > HELD:
            seen.clear()
        at = np.array(of)[np.searchsorted(ends, np.fromiter(new.values(), np.int64, len(new)), "right")]
        return pa.RecordBatch.from_arrays([pa.array(list(new), pa.string()), pages.take(pa.array(at))], names=["gram", "page"])

    def found(batches):
        for batch in batches:
            pages, column, seen = batch.column("page"), batch.column("s"), set()
            of, texts, size = [], [], 0
            for k in pc.sort_indices(pages, null_placement="at_end").to_pylist():
                text = column[k].as_py()
                for a in range(0, len(text) - LEAST_PROBE + 1, HELD):
                    piece = text[a : a + HELD + PROBE - 1]
                    of.append(k)
                    texts.append(piece)
                    size += len(piece)
                    if size >= HELD:
                        yield listed(pages, of, texts, seen)
                        of, texts, size = [], [], 0
            if texts:
                yield listed(pages, of, texts, seen)

    return found


def _located(probes: DataFrame, pages: DataFrame) -> DataFrame:
    """item, page: the lowest page with the item's first probe, else with its second. probes: item, n, probe; read twice."""
    full = probes.where(F.length("probe") >= LEAST_PROBE)
    texts = pages.select("page", T.squash(F.col("text")).alias("s")).where(F.length("s") >= LEAST_PROBE)
    grams = texts.mapInArrow(_strings(_filter(full), bool(full.where(F.length("probe") < PROBE).take(1))), StructType([StructField("gram", StringType()), texts.schema["page"]]))
    lowest = grams.groupBy("gram").agg(F.min("page").alias("page"))
    return full.join(lowest, F.col("probe") == F.col("gram")).groupBy("item").agg(F.min_by("page", F.struct("n", "page")).alias("page"))


def find_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """item, page: the lowest page with the item's first probe, else with its second. items: item, text. pages: page, text.

    Probes are 12 characters at the start and from the middle, or less (labels of 4 to 11 characters). A probe's page doesn't
    depend on the item, so the pages' strings meet the distinct probes in one equi-join, and the work grows with the pages'
    text, not with pages times items. A filter of fixed size drops most strings that are no probe where pages are read; each
    task lists a string once, however often and on however many of its pages it stands.
    """
    return _located(items.select("item", F.posexplode(probes_of(F.col("text"))).alias("n", "probe")), pages)


def is_english(text: Column) -> Column:
    """Of a text, white space at its ends or not. What is cheap to tell comes first; words have two letters at least."""
    few = (F.octet_length(text) == F.length(text)) | (T.count_cjk(text) < BLOCK_CJK * F.length(T.strip(text)))
    return (F.length(text) >= 3 * BLOCK_WORDS - 1) & T.has_words(text, BLOCK_WORDS) & T.has_run(text, BLOCK_RUN) & few


def english_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (page, block_no, text) that are still long English passages, white space collapsed."""
    return blocks.where(is_english(F.col("text"))).withColumn("text", T.collapse(T.strip(F.col("text"))))


def _start(column: str) -> Column:
    return T.squashed_start(F.col(column), SAME)


def unreported(blocks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Blocks whose first 40 squashed characters aren't those of a paragraph's source."""
    return blocks.withColumn("_start", _start("text")).join(paragraphs.select(_start("source").alias("_start")).distinct(), "_start", "left_anti").drop("_start")


def kind() -> Column:
    """Of a paragraph; null if there is nothing to report."""
    return F.when(F.col("overridden"), "manual").when(F.size("issues") > 0, "check").when(F.col("corrected"), "fixed")


def notes() -> Column:
    reviewed = F.transform("problems", lambda p: F.concat(F.lit("review:"), p))
    return F.when(F.col("overridden"), F.array(F.lit("manual"))).when(F.size("issues") > 0, F.concat("issues", reviewed)).when(F.size("problems") > 0, F.col("problems")).otherwise(F.array(F.lit("corrected")))


def snippet() -> Column:
    """What a list shows of an item: its notes, and the start of the translation, or of the source without one."""
    text = F.when(F.coalesce("translation", F.lit("")) != "", F.col("translation")).otherwise(F.col("source"))
    return F.concat(F.array_join("notes", "; "), F.lit(" | "), F.substring(F.coalesce(text, F.lit("")), 1, SNIPPET))


def rank(column: str = "kind") -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col(column))


#: What an item shows.
SHOWN = ("source", "translation", "notes", "draft")


def _reported(paragraphs: DataFrame) -> DataFrame:
    """seq, kind and SHOWN of all paragraphs, kind null where there is nothing to report. The kind is made by a generator, so that
    no filter on it repeats the checks."""
    judged = paragraphs.select("*", F.explode(F.array(kind())).alias("kind"))
    return judged.select("seq", "kind", "source", F.col("final").alias("translation"), notes().alias("notes"), "draft")


def _english(blocks: DataFrame) -> DataFrame:
    none = F.lit("")
    return english_blocks(blocks).select(F.col("block_no").cast("long").alias("seq"), F.lit("english").alias("kind"), F.col("text").alias("source"), none.alias("translation"), F.array(F.lit("english")).alias("notes"), none.alias("draft"), "page")


def build(paragraphs: DataFrame, pages: DataFrame, blocks: DataFrame, shown: Sequence[str | Column] = SHOWN) -> DataFrame:
    """Items in report order: seq, kind, shown, page. paragraphs: seq, source, final, draft, problems, issues, corrected,
    overridden. shown: columns, or what is made of them, made before anything is dealt out.

    Checks and blocks are worked on once and written with the strings that items are found and compared by; what follows reads
    that table.
    """
    at = lambda c: F.when(F.col("kind").isNotNull(), c)
    reported, english = _reported(paragraphs), _english(blocks)
    kept = reported.select("seq", "kind", *shown).columns[2:]
    named = lambda wrap: [wrap(F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(shown, kept)]
    items = reported.select("seq", "kind", *named(at), at(probes_of(F.col("translation"))).alias("_probes"), _start("source").alias("_start"))
    rows = staged(items.unionByName(english.select("seq", "kind", *named(lambda c: c), _start("source").alias("_start"), "page"), allowMissingColumns=True), "report")
    told = rows.where("kind <> 'english'").drop("page", "_start")
    where = _located(told.select(F.col("seq").alias("item"), F.posexplode("_probes").alias("n", "probe")), pages)
    found = told.join(where, F.col("seq") == F.col("item"), "left").select("seq", "kind", *kept, "page")
    starts = rows.where("kind IS NULL OR kind <> 'english'").select("_start").distinct()
    left = rows.where("kind = 'english'").join(starts, "_start", "left_anti").select("seq", "kind", *kept, "page")
    return found.unionByName(left).orderBy(rank(), F.coalesce("page", F.lit(NO_PAGE)), "seq")


def english_items(paragraphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The items of the report that are still English, in any order."""
    return unreported(_english(blocks).withColumnRenamed("source", "text"), paragraphs).withColumnRenamed("text", "source")


def summary(paragraphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: number of paragraphs and of items of each kind. Counts need no page and no order."""
    told = paragraphs.select(F.explode(F.array(kind())).alias("kind"), F.lit(1).alias("n"))
    rows = told.union(english_items(paragraphs, blocks).select("kind", F.lit(0)))
    return rows.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS), F.coalesce(F.sum("n"), F.lit(0)).alias("paragraphs"))
