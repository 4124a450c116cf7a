"""Benchmark decontamination by spaced-seed hashing.

Words (runs of letters, digits and underscores, lower case; each character by itself in scripts without blanks) of a text and of every benchmark item are hashed under two masks
in items of LEAST words and more: 1111 and 1110111. A run of 13 words or more with a share of 0.8 equal words has four equal
words in a row, or is three equal words and a substituted one in turn, so every such run has an equal hash at the same place.
Shorter items are cut into one piece more than they may have substituted words, so one piece is whole. Equal hashes of test
and training texts are joined; at each place where one was met the two texts are laid side by side, and the longest run with
a share of SIMILARITY equal words that touches a hit's window is measured. A text is contaminated by an item if the run has
LEAST words, or if it holds all words of a shorter item with that share equal. Items of fewer words than `shortest` (5
unless given) match nothing: they stand in clean texts by chance.

The benchmark is the query set: it is taken in blocks of about BLOCK_WORDS words, each broadcast by itself, so the driver holds
one at a time. The corpus is read once, without a shuffle: a batch's texts are hashed once and meet one block after the
other, and a worker that has several holds one at a time too.

Nulls: null and empty texts and items match nothing; a null doc_id or item_id is passed through. Repeated documents keep
their own rows, items of equal texts each get a row. Empty tables give empty results. clean() passes all columns through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Chinese, Japanese, Thai, Lao, Khmer and Burmese are written without blanks.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORD = re.compile(rf"[^\W{UNSPACED}]+|[{UNSPACED}]")
#: Places of the words that count under each mask.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4, 5, 6))
SIMILARITY, LEAST = 0.8, 13
SHORTEST = 5
#: Words in a block of the benchmark, about; a block has len(MASKS) hashes of 8 bytes for each, and their places.
BLOCK_WORDS = 200_000
#: Odd multipliers of the positions of a window.
FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % k, 7) | 1 for k in range(LEAST)], dtype=np.uint64)
#: Places of a text and an item that are compared at once.
MOST_PLACES = 4096
#: Distinct words whose hashes a task keeps at hand; beyond, it starts anew.
MOST_WORDS = 1_000_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Hasher(dict):
    """Hashes of words; new ones are found when they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        return h

    def __call__(self, found: list[str]) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def window_hashes(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of each window, of the words that count under the mask."""
    n = max(0, len(h) - mask[-1])
    out = np.full(n, 1000 * len(mask) + mask[-1], np.uint64)
    for k in mask:
        out += h[k : k + n] * FACTORS[k]
    return mixed(out)


def pieces(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item of n words, less than LEAST: one more than words that may differ."""
    parts = n - needed(n) + 1
    edges = [n * k // parts for k in range(parts + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:], strict=False)]


def needed(n: int) -> int:
    """The least number of equal words among n."""
    return -(-n * round(10 * SIMILARITY) // 10)


def item_hashes(h: np.ndarray, shortest: int = SHORTEST) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """(mask, hashes, their places) of an item."""
    if len(h) >= LEAST:
        for mask in MASKS:
            x = window_hashes(h, mask)
            yield mask, x, np.arange(len(x), dtype=np.int32)
    elif len(h) >= max(1, shortest):
        for start, n in pieces(len(h)):
            yield tuple(range(n)), window_hashes(h[start : start + n], tuple(range(n))), np.array([start], np.int32)


class Block:
    """Hashes of some items, sorted, with the item and the place of each; and a bit table that most hashes miss."""

    def __init__(self, items: list[tuple[list, str]], shortest: int = SHORTEST):
        hasher = Hasher()
        self.ids = [ids for ids, _ in items]
        self.tokens = [hasher(words(text)) for _, text in items]
        self.words = np.concatenate([np.zeros(0, np.uint64), *self.tokens])
        self.sizes = np.array([len(h) for h in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        got = [(k, *x) for k, h in enumerate(self.tokens) for x in item_hashes(h, shortest)]
        self.masks = sorted({mask for _, mask, _, _ in got})
        hashes = np.concatenate([np.zeros(0, np.uint64), *(x for _, _, x, _ in got)])
        item = np.concatenate([np.zeros(0, np.int32), *(np.full(len(x), k, np.int32) for k, _, x, _ in got)])
        place = np.concatenate([np.zeros(0, np.int32), *(x for _, _, _, x in got)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.shift = np.uint64(64 - min(26, max(10, (32 * len(hashes)).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.table[self.hashes >> self.shift] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Rows of (item, diagonal, first word, end) for every equal hash; each once."""
        found = []
        for mask in self.masks:
            x = window_hashes(h, mask)
            at = np.flatnonzero(self.table[x >> self.shift])
            if not len(at):
                continue
            low, high = np.searchsorted(self.hashes, x[at], "left"), np.searchsorted(self.hashes, x[at], "right")
            n = high - low
            if not n.any():
                continue
            at, low, n = np.repeat(at, n), np.repeat(low, n), n[n > 0]
            k = low + np.arange(len(low)) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack((self.item[k].astype(np.int64), at - self.place[k], at, at + mask[-1] + 1)))
        if not found:
            return np.zeros((0, 4), np.int64)
        rows = np.concatenate(found, axis=1)
        return rows[:, np.lexsort(rows[::-1])].T

    def enough(self, h: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Whether so many words are equal, wherever they stand, that a run can count."""
        out = []
        for k in range(0, len(item), MOST_PLACES):
            i, d = item[k : k + MOST_PLACES], diagonal[k : k + MOST_PLACES]
            sizes = self.sizes[i]
            a, z = np.maximum(0, d), np.minimum(len(h), d + sizes)
            first = np.cumsum(z - a) - (z - a)
            at = np.arange((z - a).sum()) - np.repeat(first, z - a) + np.repeat(a, z - a)
            equal = h[at] == self.words[at - np.repeat(d - self.starts[i], z - a)]
            out.append(np.add.reduceat(equal, first, dtype=np.int64) >= NEEDED[np.minimum(sizes, LEAST)])
        return np.concatenate(out)

    def matches(self, h: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        """item: (words, equal words, first word in the text, first word in the item) of the longest run that counts."""
        best: dict[int, tuple[int, int, int, int]] = {}
        rows = self.hits(h)
        if not len(rows):
            return best
        cuts = np.concatenate(([0], np.flatnonzero(np.any(np.diff(rows[:, :2], axis=0), axis=1)) + 1, [len(rows)]))
        for n in np.flatnonzero(self.enough(h, rows[cuts[:-1], 0], rows[cuts[:-1], 1])):
            part = rows[cuts[n] : cuts[n + 1]]
            item, diagonal = int(part[0, 0]), int(part[0, 1])
            t = self.tokens[item]
            a, z = max(0, diagonal), min(len(h), diagonal + len(t))
            equal = h[a:z] == t[a - diagonal : z - diagonal]
            if len(t) < LEAST:  # all of it, its first and last word equal or not
                run = (0, len(t)) if len(equal) == len(t) else None
            else:
                run = longest(equal, part[:, 2] - a, part[:, 3] - a)
            if run and run[1] - run[0] >= min(LEAST, len(t)):
                size = run[1] - run[0]
                new = (size, int(equal[run[0] : run[1]].sum()), a + run[0], a + run[0] - diagonal)
                best[item] = max(best.get(item, new), new, key=lambda x: (x[0], x[1], -x[2]))
        return best


NEEDED = np.array([needed(n) for n in range(LEAST + 1)])


def longest(equal: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int] | None:
    """The longest stretch with a share of SIMILARITY equal words, from an equal word to an equal word, that shares a word
    with one of the windows (starts, ends)."""
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, 0) - SIMILARITY)))
    total = np.round(total * 10).astype(np.int64)  # tenths are whole
    firsts = np.flatnonzero(equal)
    if not len(firsts):
        return None
    # for each first word, the last end whose total is not below the one at the start: totals from the right, running most
    most = np.maximum.accumulate(total[::-1])[::-1]
    best = None
    for s in firsts:
        e = int(np.searchsorted(-most, -total[s], "right")) - 1
        if e > s and (best is None or e - s > best[1] - best[0]):
            while not equal[e - 1]:
                e -= 1
            if (best is None or e - s > best[1] - best[0]) and np.any((starts < e) & (ends > s)):
                best = (int(s), e)
    return best


def blocks(benchmark: DataFrame, size: int = BLOCK_WORDS, shortest: int = SHORTEST) -> Iterator[Block]:
    """The benchmark in blocks, dealt by a hash of the text; items of equal texts are one, with all their ids."""
    items = benchmark.where("text IS NOT NULL").groupBy("text").agg(F.collect_list(F.struct(F.col("item_id").cast("long"))).alias("ids"))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-total // size)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()  # about `size` words
        yield Block([([x[0] for x in r.ids], r.text) for r in sorted(part, key=lambda r: r.text)], shortest)


def _shared(docs: DataFrame, benchmark: DataFrame, size: int, shortest: int) -> list[Broadcast]:
    return [docs.sparkSession.sparkContext.broadcast(b) for b in blocks(benchmark, size, shortest)]


def _each(shared: list[Broadcast]) -> Iterator[Block]:
    """One block after the other; of several, a worker lets each go before it loads the next."""
    for one in shared:
        yield one.value
        if len(shared) > 1:
            one.__dict__.pop("_value", None)


def _find(shared: list[Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            ids, out = b.column("doc_id").to_pylist(), []
            texts = [hasher(words(t.as_py())) for t in b.column("text")]
            for block in _each(shared):
                for doc_id, h in zip(ids, texts, strict=True):
                    for item, found in sorted(block.matches(h).items()):
                        out += [(doc_id, item_id, *found) for item_id in block.ids[item]]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            names = ("doc_id", "item_id", "n_words", "n_equal", "doc_word", "item_word")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, n_words and n_equal of the longest run, and where it begins in the text and the item (words)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ddl = "doc_id long, item_id long, n_words long, n_equal long, doc_word long, item_word long"
    return rows.mapInArrow(_find(_shared(docs, benchmark, size, shortest)), ddl)


def _clean(shared: list[Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            texts = [hasher(words(t.as_py())) for t in b.column("text")]
            keep = np.ones(len(texts), bool)
            for block in _each(shared):
                for k in np.flatnonzero(keep):
                    keep[k] = not block.matches(texts[k])
            yield b.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    return docs.mapInArrow(_clean(_shared(docs, benchmark, size, shortest)), docs.schema)


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), _benchmark(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, _benchmark(spark, sf_dir))


#: What Python counts as a letter of a word, for RE2.
_LETTERS = "[\\p{L}\\p{N}_]"


def _sql() -> str:
    """DuckDB: equal words by diagonal of every text and item, and the longest run of those that count, without any hashing."""
    unspaced = "".join(f"\\x{{{ord(c):X}}}" if c != "-" else "-" for c in UNSPACED)
    words = f"regexp_extract_all(regexp_replace(lower(text), '([{unspaced}])', ' \\1 ', 'g'), '{_LETTERS}+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS iid, item_id, {words} AS ws FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT rid, p - 1 AS p, ws[p] AS w FROM d, unnest(range(1, len(ws) + 1)) AS u(p)),
bw AS (SELECT iid, q - 1 AS q, ws[q] AS w, len(ws) AS n FROM b, unnest(range(1, len(ws) + 1)) AS u(q) WHERE len(ws) >= {SHORTEST}),
g AS (SELECT rid, iid, p - q AS diag, n, list(p ORDER BY p) AS ps FROM dw JOIN bw USING (w) GROUP BY rid, iid, p - q, n HAVING 10 * count(*) >= 8 * least(n, {LEAST})),
r AS (SELECT rid, iid, diag, ps[a] AS s, ps[z] - ps[a] + 1 AS size, z - a + 1 AS equal FROM g, unnest(range(1, len(ps) + 1)) AS u(a), unnest(range(1, len(ps) + 1)) AS v(z)
    WHERE n >= {LEAST} AND ps[z] - ps[a] + 1 >= {LEAST} AND 10 * (z - a + 1) >= 8 * (ps[z] - ps[a] + 1)
  UNION ALL SELECT rid, iid, diag, diag, n, len(ps) FROM g JOIN d USING (rid) WHERE n < {LEAST} AND diag >= 0 AND diag + n <= len(ws)),
o AS (SELECT *, row_number() OVER (PARTITION BY rid, iid, diag ORDER BY size DESC, s) AS k FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY rid, iid ORDER BY size DESC, equal DESC, s, diag) AS best FROM o WHERE k = 1)
SELECT doc_id, item_id, size AS n_words, equal AS n_equal, s AS doc_word, s - diag AS item_word FROM f JOIN d USING (rid) JOIN b USING (iid) WHERE best = 1
"""


SQL = _sql()
