"""Removal of repeated byte strings over all documents, by a column-wise Burrows-Wheeler transform of the collection.

A byte goes if a string of LENGTH bytes that covers it starts earlier too: in a document of smaller doc_id, or before in
the same one. All windows of LENGTH bytes are judged on the input.

1. Windows are dealt out by content: the least hash of the KGRAM-byte strings in a window is its anchor, equal windows have
   equal anchors, and neighbours mostly share theirs. A run of windows with one anchor is a piece, known so far by the
   hashes of its anchor and of its bytes. A task keeps the first of equal pieces and marks the others.
2. Pieces meet by anchor. Again only the first of equal ones stays, and anchors with one piece only are done.
3. The bytes of the pieces that are left are cut from their texts and dealt out by anchor.
4. There the transform of a slab of pieces is built, one symbol of each piece a round, from the last to the first. The
   pieces' columns, the transform and the lengths of common prefixes lie in files that every round reads from start to end
   and writes anew. Windows with a common prefix of LENGTH in a row are equal; all but the first are marked.
5. Each document's marks are laid over its text.

Anchors with very many pieces (a common line between different neighbours) are dealt out with the bytes left or right of
the anchor as well, of which any window has enough on one side.

Nulls: a null text is empty. Null doc_ids come before others. Rows of equal doc_id come in the order of their texts'
hashes, repeated rows in any order; each counts as a document. An empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, staged

LENGTH, KGRAM = 100, 32
#: Anchors are the least of so many hashes; a piece has at most so many windows.
SPREAD = LENGTH - KGRAM + 1
MOST_WINDOWS = SPREAD
#: Bytes beside an anchor that part its pieces: a window has so many on the left of it, or else on the right.
BESIDE = SPREAD // 2
#: Bytes of text that a task looks at together (few enough for a core's cache), pieces it compares before it puts them out,
#: and bytes of a slab.
AT_ONCE, PIECES, SLAB = 1 << 18, 1 << 20, 1 << 19
#: An anchor with more different pieces is dealt out with its neighbours' bytes.
CROWD = 2000

_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = [pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64) for k in range(12)]


def kgram_hashes(data: np.ndarray, k: int = KGRAM) -> np.ndarray:
    """A hash of the k bytes from each place; k is a power of two. Pairs of halves are joined until k is reached."""
    h = _BYTE[data]
    for step in range(k.bit_length() - 1):
        h = h[: len(h) - (1 << step)] * np.uint64(_FACTOR[step]) + h[1 << step :]
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def least_of(h: np.ndarray, n: int, least: np.ufunc = np.minimum) -> np.ndarray:
    """The least (or greatest) of each n values in a row."""
    size = 1
    while 2 * size <= n:
        h = least(h[: len(h) - size], h[size:])
        size *= 2
    return least(h[: len(h) - (n - size)], h[n - size :]) if n > size else h


def pieces_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """anchor, hash, number of the text, start, windows of each piece, and whether its anchor is in it twice: only then
    can windows of one piece be equal."""
    joined = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    if len(joined) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool))
    kgrams = kgram_hashes(np.frombuffer(joined, np.uint8))
    anchors = least_of(kgrams, SPREAD)
    # windows that end within their text
    inside = np.zeros(len(anchors) + 1, np.int32)
    starts = ends - sizes
    fits = sizes >= LENGTH
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    first = np.ones(len(anchors), bool)
    first[1:] = anchors[1:] != anchors[:-1]
    first[starts[fits]] = True
    first[1:] |= ~inside[:-1]
    first &= inside
    at = np.flatnonzero(first)
    text = np.searchsorted(ends, at, "right")
    n = np.minimum(np.append(at[1:], len(anchors)), ends[text] - LENGTH + 1) - at
    cuts = (n + MOST_WINDOWS - 1) // MOST_WINDOWS  # long runs, as in a repeated byte, are cut
    if (cuts > 1).any():
        turn = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        n = np.minimum(np.repeat(n, cuts) - turn * MOST_WINDOWS, MOST_WINDOWS)
        at, text = np.repeat(at, cuts) + turn * MOST_WINDOWS, np.repeat(text, cuts)
    digest, view = xxhash.xxh3_64_intdigest, memoryview(joined)
    hashes = np.fromiter((digest(view[a:z]) for a, z in zip(at.tolist(), (at + n + LENGTH - 1).tolist(), strict=True)), np.uint64, len(at))
    # places of anchors: their hash is the greatest of the leasts of the windows around
    around = least_of(np.concatenate((np.zeros(SPREAD - 1, np.uint64), anchors, np.zeros(SPREAD - 1, np.uint64))), SPREAD, np.maximum)
    spots = np.flatnonzero(kgrams == around)
    low, high = np.searchsorted(spots, at), np.searchsorted(spots, at + n + SPREAD - 1)
    of = np.repeat(np.arange(len(at)), high - low)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[of]
    twice = np.bincount(of[kgrams[spots[inner]] == anchors[at][of]], minlength=len(at)) > 1
    return anchors[at], hashes, text, at - starts[text], n, twice


ROW = pa.schema([("anchor", pa.int64()), ("piece", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("mark", pa.bool_()), ("crowd", pa.bool_())])
ROW_DDL = "anchor long, piece long, rid long, start int, n int, mark boolean, crowd boolean"


def _row_batch(anchor, piece, rid, start, n, mark: bool, crowd: bool | np.ndarray = False) -> pa.RecordBatch:
    """mark: windows to remove; else pieces to compare. crowd: in what _find puts out, whether the anchor is there twice."""
    return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(rid), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.full(len(rid), mark)), pa.array(np.broadcast_to(crowd, len(rid)))], schema=ROW)


def _joined(rid: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks in order, those that touch as one."""
    order = np.lexsort((start, rid))
    rid, start, n = rid[order], start[order], n[order]
    if not len(rid):
        return rid, start, n
    end = start + n
    reach = np.zeros(len(rid), bool)
    reach[1:] = (rid[1:] == rid[:-1]) & (start[1:] <= end[:-1])
    first = np.flatnonzero(~reach)
    return rid[first], start[first], np.maximum.reduceat(end, first) - start[first]


def _marks(rid: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    rid, start, n = _joined(rid, start, n)
    # marks go with the pieces through the next shuffle; a hash of the document in the anchor's place spreads them
    spread = rid.astype(np.int64) * np.int64(0x1E3779B97F4A7C15)
    return _row_batch(spread, spread, rid, start, n, True)


def _firsts(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The first by rid and start of equal pieces, and the others."""
    order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
    anchor, piece, *rest = (c[order] for c in columns)
    first = np.ones(len(anchor), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    return [c[first] for c in (anchor, piece, *rest)], [c[~first] for c in rest]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts: list[bytes] = []
    rids: list[int] = []
    held: list[list[np.ndarray]] = []
    size = count = 0

    def look() -> None:
        nonlocal size, count
        anchor, piece, text, start, n, twice = pieces_of(texts)
        held.append([anchor, piece, np.array(rids, np.int64)[text], start, n, twice])
        count += len(n)
        texts.clear(), rids.clear()
        size = 0

    def put() -> Iterator[pa.RecordBatch]:
        nonlocal count
        first, again = _firsts([np.concatenate(c) for c in zip(*held, strict=True)])
        yield _row_batch(*first[:5], False, first[5])
        yield _marks(*again[:3])
        held.clear()
        count = 0

    for b in batches:
        for rid, text in zip(b.column("rid").to_pylist(), b.column("text"), strict=True):
            texts.append(text.as_py()), rids.append(rid)
            size += len(texts[-1])
            if size >= AT_ONCE:
                look()
                if count >= PIECES:
                    yield from put()
    if texts:
        look()
    if held:
        yield from put()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in the order of anchor, piece, rid, start: marks for all but the first of equal pieces, and the first ones
    where an anchor has more than one, or is twice in one. CROWD rows of an anchor at most are held; beyond, it is a crowd
    and its rows pass. Marks that were made before pass too."""
    names = ("anchor", "piece", "rid", "start", "n", "crowd")
    held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32, bool)]  # firsts of the last anchor
    last, crowd = None, None  # anchor and piece of the last row; the last anchor, if it is a crowd

    def closed(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Whole anchors."""
        bounds = np.flatnonzero(np.append(True, c[0][1:] != c[0][:-1])) if len(c[0]) else np.zeros(0, np.int64)
        sizes = np.repeat(np.diff(bounds, append=len(c[0])), np.diff(bounds, append=len(c[0])))
        for many in (False, True):
            if (take := ((sizes > 1) | c[5]) & ((sizes > CROWD) == many)).any():
                yield _row_batch(*(x[take] for x in c[:5]), False, many)

    for b in batches:
        mark = b.column("mark").to_numpy(zero_copy_only=False)
        if mark.any():
            yield b.filter(pa.array(mark))
        c = [b.column(k).to_numpy(zero_copy_only=False)[~mark] for k in names]
        if not len(c[0]):
            continue
        first = np.append(last != (c[0][0], c[1][0]), (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]))
        last = (c[0][-1], c[1][-1])
        if not first.all():
            yield _marks(*(x[~first] for x in c[2:5]))
        c = [x[first] for x in c]
        if crowd is not None:
            more = c[0] == crowd
            yield _row_batch(*(x[more] for x in c[:5]), False, True)
            c = [x[~more] for x in c]
            if last[0] != crowd:
                crowd = None
        c = [np.concatenate(x) for x in zip(held, c, strict=True)]
        tail = int(np.searchsorted(c[0], last[0])) if crowd is None else len(c[0])
        yield from closed([x[:tail] for x in c])
        held = [x[tail:] for x in c]
        if len(held[0]) > CROWD:
            crowd = last[0]
            yield _row_batch(*held[:5], False, True)
            held = [x[:0] for x in held]
    yield from closed(held)


CUT = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("bytes", pa.binary())])
CUT_DDL = "key long, rid long, start int, bytes binary"


def beside(piece: bytes, anchor: int) -> Iterator[tuple[int, int, int]]:
    """key, first window, end: a crowd's piece in parts by the bytes left of the anchor, or right of it.

    A window's anchor is the first in it with the piece's hash, so equal windows fall in parts of equal keys.
    """
    hashes = kgram_hashes(np.frombuffer(piece, np.uint8))
    spots = np.flatnonzero(hashes == np.uint64(anchor % (1 << 64)))
    at, n = 0, len(piece) - LENGTH + 1
    for spot in spots.tolist():
        z = min(n, spot + 1)  # windows up to here have this as their first
        left = min(z, max(at, spot - BESIDE + 1))
        if at < left:
            yield xxhash.xxh3_64_intdigest(piece[spot - BESIDE : spot], anchor % (1 << 64)), at, left
        if left < z:
            yield xxhash.xxh3_64_intdigest(b"r" + piece[spot + KGRAM : spot + KGRAM + BESIDE], anchor % (1 << 64)), left, z
        at = max(at, z)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple[int, int, int, bytes]] = []
        size = 0
        for rid, text, wanted in zip(b.column("rid").to_pylist(), b.column("text"), b.column("wanted"), strict=True):
            text = text.as_py()
            for w in wanted.as_py():
                piece = text[w["start"] : w["start"] + w["n"] + LENGTH - 1]
                if not w["crowd"]:
                    out.append((w["anchor"], rid, w["start"], piece))
                else:
                    for key, a, z in beside(piece, w["anchor"]):
                        out.append((key - (1 << 64) if key >> 63 else key, rid, w["start"] + a, piece[a : z + LENGTH - 1]))
            size += len(text)
            if size >= 16 * AT_ONCE:
                yield _cut_batch(out)
                out, size = [], 0
        if out:
            yield _cut_batch(out)


def _cut_batch(out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, CUT, strict=True)], schema=CUT)


class Rounds:
    """The transform and the common prefixes of a collection of pieces, in files.

    Round j has put the suffixes of up to j bytes of all pieces in order, the empty ones first, in the order of the pieces.
    For each suffix the transform file has the byte before it (0 where there is none, bytes count from 1), the prefix file
    the length of the prefix it shares with the suffix before it (up to 255; pieces are shorter).
    """

    def __init__(self, pieces: list[bytes], folder: str):
        self.m = len(pieces)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        #: one byte for a symbol: UTF-8 has no byte 255; two where a text isn't UTF-8
        self.symbol = np.dtype(np.uint8 if not (data == 255).any() else np.uint16)
        ends = np.cumsum(self.sizes)
        #: file of columns: for each round the symbols of the pieces that are that long, from their last byte on
        self.columns = []
        self.file = open(f"{folder}/columns", "w+b")  # noqa: SIM115
        for j in range(int(self.sizes.max(initial=0))):
            long = np.flatnonzero(self.sizes > j)
            self.columns.append(len(long))
            (data[ends[long] - 1 - j].astype(self.symbol) + self.symbol.type(1)).tofile(self.file)
        self.file.seek(0)
        # two files by turns: a round reads one from its start to its end and writes the other, over what was there
        self.turns = [open(f"{folder}/{k}", "w+b") for k in range(2)]  # noqa: SIM115
        self.n = 0

    def close(self) -> None:
        for f in (self.file, *self.turns):
            f.close()

    def _write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        self.turns.reverse()
        self.turns[0].seek(0)
        bwt.tofile(self.turns[0])
        lcp.tofile(self.turns[0])
        self.turns[0].flush()
        self.n = len(bwt)

    def _read(self) -> tuple[np.ndarray, np.ndarray]:
        self.turns[0].seek(0)
        return np.fromfile(self.turns[0], self.symbol, self.n), np.fromfile(self.turns[0], np.uint8, self.n)

    def _symbols(self, j: int) -> np.ndarray:
        """Of each piece, the symbol before its suffix of j bytes; 0 if it has no more."""
        out = np.zeros(self.m, self.symbol)
        if j < len(self.columns):
            out[self.sizes > j] = np.fromfile(self.file, self.symbol, self.columns[j])
        return out

    @staticmethod
    def _steps(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Places in the order of symbol and place; the rank of each place in it; number of places without a symbol."""
        order = np.argsort(bwt, kind="stable").astype(np.int32)
        rank = np.empty(len(bwt), np.int32)
        rank[order] = np.arange(len(bwt), dtype=np.int32)
        return order, rank, int(np.count_nonzero(bwt == 0))

    def build(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs all rounds: the last transform and prefixes."""
        self._write(self._symbols(0), np.zeros(self.m, np.uint8))
        who, at = np.arange(self.m), np.arange(self.m)  # pieces in the order of their longest suffixes, and the places of these
        for j in range(len(self.columns)):
            bwt, lcp = self._read()
            order, rank, none = self._steps(bwt)
            grows = self.sizes[who] > j  # each of these suffixes gets its byte in front
            who, at = who[grows], at[grows]
            r, symbol = rank[at], bwt[at]
            # with the suffix before and after among those of the same byte
            before, after = np.maximum(r - 1, 0), np.minimum(r + 1, len(bwt) - 1)
            has_before, has_after = (r > none) & (bwt[order[before]] == symbol), (r + 1 < len(bwt)) & (bwt[order[after]] == symbol)
            low = np.where(has_before, 1 + self._least(lcp, order[before] + 1, at + 1, has_before), 0)
            high = np.where(has_after, 1 + self._least(lcp, at + 1, order[after] + 1, has_after), 0)
            turn = np.argsort(symbol, kind="stable")  # places go up by symbol, then as before
            who, place, low, high = who[turn], (self.m + r - none)[turn], low[turn], high[turn]
            total = len(bwt) + len(at)
            old = np.ones(total, bool)
            old[place] = False
            new_bwt, new_lcp = np.empty(total, self.symbol), np.empty(total, np.uint8)
            new_bwt[old], new_lcp[old] = bwt, lcp
            follows = place + 1 < total
            new_lcp[place[follows] + 1] = high[follows]
            new_lcp[place] = low
            new_bwt[place] = self._symbols(j + 1)[who]
            at = place
            self._write(new_bwt, new_lcp)
        return self._read()

    @staticmethod
    def _least(lcp: np.ndarray, start: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The least prefix in each range that is wanted; ranges go up, so what lies between them is passed over once."""
        out = np.zeros(len(start), np.int64)
        k = np.flatnonzero(wanted)
        if len(k):
            pairs = np.empty(2 * len(k), np.int64)
            pairs[0::2], pairs[1::2] = start[k], end[k]
            out[k] = np.minimum.reduceat(np.append(lcp, np.uint8(0)), pairs)[0::2]
        return out

    def equal_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """piece, offset, class of every window: windows of a class are the same LENGTH bytes."""
        bwt, lcp = self.build()
        _, rank, none = self._steps(bwt)
        classes = np.cumsum(lcp < LENGTH)
        place, piece = np.arange(self.m), np.arange(self.m)
        found = []
        for j in range(len(self.columns) + 1):
            if j >= LENGTH:
                found.append((piece, self.sizes[piece] - j, classes[place]))
            more = self.sizes[piece] > j
            place, piece = self.m + rank[place[more]] - none, piece[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def repeated(pieces: list[bytes], rid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rid and start of the windows that are the same as an earlier one in some of the pieces."""
    with tempfile.TemporaryDirectory(prefix="bwt-") as folder:
        rounds = Rounds(pieces, folder)
        piece, offset, group = rounds.equal_windows()
        rounds.close()
    rids, starts = rid[piece], start[piece] + offset
    order = np.lexsort((starts, rids, group))
    again = np.zeros(len(order), bool)
    again[1:] = group[order][1:] == group[order][:-1]
    return rids[order][again], starts[order][again]


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in the order of key: slabs of whole keys."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def slab(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        rid, start = repeated([r[3] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
        return _marks(rid, start, np.ones(len(rid), np.int64))

    for b in batches:
        for row in zip(b.column("key").to_pylist(), b.column("rid").to_pylist(), b.column("start").to_pylist(), b.column("bytes").to_pylist(), strict=True):
            if size >= SLAB and row[0] != held[-1][0]:
                yield slab(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield slab(held)


def numbered(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text as bytes: rid is unique and in the order of documents. It is doc_id itself where that will do."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    n = rows.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n[0] == n[1] == n[2]:
        return rows.select(F.col("doc_id").alias("rid"), "doc_id", "text")
    # ranks over ranges: a range's rows are numbered by themselves, after the rows of the ranges before
    spark = docs.sparkSession
    keys = staged(rows.select("doc_id", F.xxhash64("text").alias("tie")).groupBy("doc_id", "tie").agg(F.count("*").alias("copies")), "repeats-keys")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(keys.repartitionByRange(parts, "doc_id", "tie").withColumn("range", F.spark_partition_id()), "repeats-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.sum("copies").alias("copies")).select("range", F.coalesce(F.sum("copies").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    based = ranged.withColumn("in_range", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(starts, "range").select(F.col("doc_id").alias("k_id"), F.col("tie").alias("k_tie"), (F.col("base") + F.col("in_range")).alias("at"))
    tied = rows.withColumn("tie", F.xxhash64("text")).withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy(F.lit(1))) - 1)
    met = tied.join(based, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("tie") == F.col("k_tie")))
    return staged(met.select((F.col("at") + F.col("copy")).alias("rid"), "doc_id", "text"), "repeats-rows")


KEPT_DDL = "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _keep(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, spans, digest, kept = [], [], [], [], []
            for text, marks in zip(b.column("text"), b.column("marks"), strict=True):
                text = text.as_py()
                gone = runs([(m["start"], m["start"] + m["n"] + LENGTH - 1) for m in marks.as_py() or ()])
                edges = [0, *chain.from_iterable(gone), len(text)]
                rest = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                size.append(len(text)), removed.append(len(text) - len(rest)), spans.append(len(gone))
                digest.append(hashlib.sha256(rest).hexdigest()), kept.append(rest if with_bytes else None)
            numbers = [pa.array(x, pa.int64()) for x in (size, removed, spans)]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), *numbers, pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def runs(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(marks):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def repeats_removed(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the bytes that stay, for each row of docs."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(docs)
    found = rows.select("rid", "text").mapInArrow(_find, ROW_DDL)
    met = found.repartition(parts, "anchor").sortWithinPartitions("anchor", "piece", "rid", "start")
    met = staged(met.mapInArrow(_meet, ROW_DDL), "repeats-met")
    wanted = met.where("not mark").groupBy("rid").agg(F.collect_list(F.struct("anchor", "start", "n", "crowd")).alias("wanted"))  # bounded by the document's length
    cut = rows.select("rid", "text").join(wanted, "rid").mapInArrow(_cut, CUT_DDL)
    same = staged(cut.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_transform, ROW_DDL), "repeats-same")
    marks = met.where("mark").select("rid", "start", "n").union(same.select("rid", "start", "n"))
    marks = marks.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    return rows.join(marks, "rid", "left").mapInArrow(_keep(with_bytes), KEPT_DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(documents(spark, sf_dir), with_bytes=False).drop("rid", "kept")


#: DuckDB: all windows as hexadecimal strings (cut from pieces of 256 windows), their ranks, and what no window that came before covers.
SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rid, doc_id, hex(coalesce(text, '')) AS h FROM documents),
c AS (SELECT rid, 256 * j AS base, substr(h, 512 * j + 1, {512 + 2 * LENGTH - 2}) AS h FROM d, unnest(range(0, length(h) // 512 + 1)) AS u(j)),
w AS (SELECT rid, base + i AS i, row_number() OVER (PARTITION BY substr(h, 2 * i + 1, {2 * LENGTH}) ORDER BY rid, base + i) AS n FROM c, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS u(i)),
m AS (SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + {LENGTH}, true)::INT AS new FROM w WHERE n > 1),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM m),
s AS (SELECT rid, run, min(i) AS a, max(i) + {LENGTH} AS z FROM g GROUP BY rid, run),
p AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS after FROM s),
k AS (SELECT rid, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS rest FROM p JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
