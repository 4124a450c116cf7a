"""Near-duplicates by the similarity of word shingles, by the deletion variants of wide SimHash fingerprints.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of SIMILARITY or more; groups are the
components of the links, and of each group one document stays. Fingerprints of 64 bits and four differing ones miss most
such pairs, so these fingerprints are wider and made of two-word shingles, of which a replaced word spoils two and not
five. They are cut into lanes of so many bits that chance seldom makes two of them alike, whatever the number of documents,
and so many lanes that a pair at SIMILARITY with scattered words replaced has with a probability of RECALL a lane that
differs by one bit at most. (Where one passage is replaced instead, more bits differ and fewer such pairs are found.)

1. Each distinct text is indexed under every lane with one bit taken out. Keys that only one text has go.
2. Texts with an equal key whose whole fingerprints are near enough are candidates, all of them; a group's candidates are kept as
   a spanning forest. Groups over BLOCK texts are compared in pairs of blocks, all of them.
3. Within a component of candidates the shingles of the texts are compared, nearest fingerprints first, and pairs that are
   linked already by others aren't compared again. Components over VERIFIED texts are dealt out in pairs of blocks.
4. Components of the verified links are the groups.

Texts are lower-cased (A-Z), words are what stands between ASCII white space; a text of fewer words is one shingle, and
texts of equal words are one text. Nulls: a null text is empty, empty texts are alike; a null doc_id is the last to stay.
Repeated rows are one. Of a group the least doc_id stays, of the least hash of the text where several have it. An empty
table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, staged
from .components import components
from .simhash import stars

SHINGLE, SIMILARITY = 5, 0.8
#: Shingles of the fingerprints; share of their bits that differ at SIMILARITY, and that may differ in candidates; share of the
#: pairs at SIMILARITY that the lanes are to find.
INDEXED, DIFFERING, FAR, RECALL = 2, 0.095, 0.2, 0.97
#: A lane has so many bits more than the logarithm of the number of documents, and 24 to 32 of them.
SPARE, LEAST_WIDTH, HALF = 6, 24, 32
BLOCK, VERIFIED = 4096, 512

#: A word's hash is that of its bytes' numbers times the powers of BASE: sums over the text's prefixes give all of them at
#: once. Texts are hashed in pieces of so many bytes, cut between words.
BASE, PIECE = 0x9E3779B97F4A7C15, 1 << 20
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([k]), 12) | 1 for k in range(256)], np.uint64)
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % k, 11) | 1 for k in range(64)], np.uint64)


def lanes(n: int) -> tuple[int, int]:
    """Width and number of lanes for n documents."""
    width = min(HALF, max(LEAST_WIDTH, n.bit_length() + SPARE))
    hit = (1 - DIFFERING) ** width + width * DIFFERING * (1 - DIFFERING) ** (width - 1)
    return width, math.ceil(math.log(1 - RECALL) / math.log(1 - hit))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of BASE and of its inverse, as many as the longest piece so far has needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            step, back = pow(BASE, size, 1 << 64), pow(BASE, -size, 1 << 64)
            self.up = np.concatenate((self.up, self.up * np.uint64(step)))
            self.down = np.concatenate((self.down, self.down * np.uint64(back)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def pieces(text: bytes) -> Iterator[bytes]:
    """text in pieces of at most PIECE bytes that end after a blank; one without a blank is longer."""
    while len(text) > PIECE:
        cut = 1 + max(text.rfind(c, 0, PIECE) for c in (b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r"))
        if not cut:
            break
        yield text[:cut]
        text = text[cut:]
    yield text


def word_hashes(text: bytes) -> np.ndarray:
    """Of the words of a text, lower-cased."""
    found = [np.zeros(0, np.uint64)]
    for piece in pieces(text.lower()):
        data = np.frombuffer(piece, np.uint8)
        blank = np.concatenate(([True], _BLANK[data], [True]))
        edges = np.flatnonzero(blank[1:] != blank[:-1])  # where words begin and end, in turn
        starts, ends = edges[0::2], edges[1::2]
        up, down = _POWERS.get(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)))
        found.append(_mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(found)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words with these hashes. (np.unique takes four times as long here.)"""
    size = min(size, len(h))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += h[k : k + n] * _FACTORS[k]
    out = np.sort(_mixed(out))
    return out[np.append(True, out[1:] != out[:-1])]


_ONES, _BYTES = np.uint64(0x0101010101010101), 255


def fingerprint(h: np.ndarray, n_words: int) -> np.ndarray:
    """64 bits for each of n_words: those that are set in over half of the hashes h, mixed anew for each. Eight bits at a time
    are counted in the bytes of a word."""
    if not len(h):
        return np.zeros(n_words, np.int64)
    x = _mixed(h * _FACTORS[:n_words, None] + np.arange(n_words, dtype=np.uint64)[:, None])
    ones, starts = np.zeros((n_words, 8, 8), np.int64), np.arange(0, len(h), _BYTES)
    for shift in range(8):
        sums = np.add.reduceat((x >> np.uint64(shift)) & _ONES, starts, axis=1)
        ones[:, :, shift] = np.ascontiguousarray(sums).view(np.uint8).reshape(n_words, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones.reshape(n_words, 64) > len(h), axis=1, bitorder="little").view("<i8").reshape(n_words)


def _fingerprints(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, found = [], []
            for text in b.column("text"):
                words = word_hashes(text.as_py())
                nodes.append(xxhash.xxh3_64_intdigest(words.tobytes()))
                found.append(fingerprint(shingles(words, INDEXED), n_words))
            flat = np.concatenate([np.zeros(0, np.int64), *found])
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * n_words), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(np.array(nodes, np.uint64).view(np.int64)), fps], names=["doc_id", "tie", "node", "fp"])

    return run


def _tie() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))


def variants(width: int, count: int) -> Column:
    """The keys of a fingerprint: the number of the bit taken out, and the rest of its lane."""

    def key(i: Column) -> Column:
        lane, bit = F.floor(i / width).cast("int"), (i % width).cast("int")
        word = F.element_at("fp", (F.floor(lane / 2) + 1).cast("int"))
        part = F.call_function("shiftrightunsigned", word, (lane % 2 * HALF).cast("int")).bitwiseAND(F.lit((1 << width) - 1))
        rest = part - part.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        return F.call_function("shiftleft", i.cast("long"), F.lit(HALF)) + rest

    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(width * count - 1)), key))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, node) sorted by key: those whose key another row has too."""
    last, out = None, False  # the last row, and whether it was put out
    for b in batches:
        key, node = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node"))
        if not len(key):
            continue
        if last is not None:
            key, node = np.append(last[0], key), np.append(last[1], node)
        same = key[1:] == key[:-1]
        keep = np.append(same, False)
        keep[1:] |= same
        put, last = keep.copy(), (key[-1], node[-1])
        if out:
            put[0] = False
        out = bool(keep[-1]) or (out and len(key) == 1)
        yield pa.RecordBatch.from_arrays([pa.array(key[put]), pa.array(node[put])], names=["key", "node"])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing bits of rows of words."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)  # of signed ones it counts those of the absolute value


def forest(key: np.ndarray, node: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates within equal keys (sorted), as a star for each of their components."""
    nodes, at = np.unique(node, return_inverse=True)
    i, shift, ends = np.arange(len(key)), 1, np.zeros((2, 0), np.int64)
    while len(i := i[i + shift < len(key)]) and len(i := i[key[i + shift] == key[i]]):
        close = i[near(fp[i + shift], fp[i]) <= most]
        ends = np.concatenate((ends, np.stack((at[close], at[close + shift]))), axis=1)
        shift += 1
        if ends.shape[1] > 1 << 20:
            ends = stars(ends, len(nodes))
    ends = stars(ends, len(nodes))
    return nodes[ends[0]], nodes[ends[1]]


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], rows: int = 1 << 16) -> Iterator[list[np.ndarray | list]]:
    """Whole groups of equal keys, many at a time, of rows that are sorted by the first column, key."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy(zero_copy_only=False)
        whole = int(np.searchsorted(key, key[-1]))  # the last group may go on
        if size + whole >= rows and (whole or last != key[0]):
            yield [_column([*held, b.slice(0, whole)], c) for c in columns]
            held, size, b = [], 0, b.slice(whole)
        held.append(b)
        size += b.num_rows
        last = key[-1]
    if held:
        yield [_column(held, c) for c in columns]


def _column(batches: list[pa.RecordBatch], name: str) -> np.ndarray | list:
    if pa.types.is_list(batches[0].schema.field(name).type):
        parts = [b.column(name) for b in batches]
        return [np.asarray(x.values) for part in parts for x in part]
    return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in batches])


EDGES = "a long, b long"


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _candidates(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, fp in _groups(batches, ("key", "node", "fp")):
            yield _edges(*forest(key, node, np.array(fp, np.int64).reshape(len(key), -1), most))

    return run


def _blocked(rows: DataFrame, by: str, size: int, most: int) -> DataFrame:
    """rows with a key for each place where they are compared: the group's own, or, in groups over `most` rows, one for each
    pair of blocks of about `size` with the row's block. groups are sized where they are read."""
    counts = staged(rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > most), "similar-large")
    met = rows.join(counts, by, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / size), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.xxhash64(by, F.least("own", "other"), F.greatest("own", "other"))
    return met.withColumn("key", F.when(F.col("blocks") == 1, F.col(by)).otherwise(place)).drop("n", "blocks", "own", "other")


def candidates(distinct: DataFrame, width: int, count: int, block: int = BLOCK) -> DataFrame:
    """a, b: a spanning forest of the candidates among distinct texts (node, fp)."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.select(variants(width, count).alias("key"), "node").repartition(parts, "key").sortWithinPartitions("key")
    shared = staged(keyed.mapInArrow(_shared, "key long, node long"), "similar-shared")
    placed = _blocked(shared.withColumnRenamed("key", "own_key"), "own_key", block // 2, block).select("key", "node")
    met = placed.join(distinct.select("node", "fp"), "node")
    most = int(FAR * 64 * ((count + 1) // 2))
    return met.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_candidates(most), EDGES)


def links(node: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], most: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join all that is similar: pairs are compared by nearness, if they aren't joined by then."""
    root = list(range(len(node)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    found, sizes = [], np.array([len(x) for x in sets], np.int64)
    pairs = []
    for k in range(1, len(node)):
        bits = near(fp[:k], fp[k])
        # sets of sizes n and m can't be more alike than their sizes
        fits = (bits <= most) & (np.minimum(sizes[:k], sizes[k]) >= similarity * np.maximum(sizes[:k], sizes[k]))
        at = np.flatnonzero(fits)
        pairs.append(np.stack((bits[at], np.full(len(at), k), at)))
    if not pairs:
        return found
    pairs = np.concatenate(pairs, axis=1)
    for _, a, b in pairs[:, np.argsort(pairs[0], kind="stable")].T.tolist():
        x, y = top(a), top(b)
        if x != y:
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            union = len(sets[a]) + len(sets[b]) - both
            if both >= similarity * union:
                root[max(x, y)] = min(x, y)
                found.append((int(node[a]), int(node[b])))
    return found


def _verify(most: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, fp, sets in _groups(batches, ("key", "node", "fp", "sets"), 2048):
            out = []
            bounds = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for a, z in zip(bounds.tolist(), [*bounds[1:].tolist(), len(key)], strict=True):
                _, first = np.unique(node[a:z], return_index=True)
                those = (first + a).tolist()
                out += links(node[those], np.array([fp[k] for k in those], np.int64).reshape(len(those), -1), [sets[k] for k in those], most, similarity)
            yield _edges(*(np.array(x, np.int64) for x in zip(*out, strict=True))) if out else _edges(np.zeros(0, np.int64), np.zeros(0, np.int64))

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(word_hashes(t.as_py()), size).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("node"), b.column("fp"), pa.array(found, pa.list_(pa.int64()))], names=["root", "node", "fp", "sets"])

    return run


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK, verified: int = VERIFIED) -> DataFrame:
    """doc_id, tie (hash of the text), first (its group's: none, doc_id, tie) for each row of docs."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width, count = lanes(docs.count())
    most = int(FAR * 64 * ((count + 1) // 2))
    doc_id = F.col("doc_id").cast("long")
    rows = as_bytes(docs, doc_id.alias("doc_id"), _tie().alias("tie")).mapInArrow(_fingerprints((count + 1) // 2), "doc_id long, tie long, node long, fp array<long>")
    rows = staged(rows, "similar-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    distinct = staged(rows.groupBy("node").agg(first, F.any_value("fp").alias("fp")), "similar-distinct")
    near_ones = staged(components(staged(candidates(distinct, width, count, block), "similar-candidates")), "similar-components")
    chosen = staged(distinct.join(near_ones, "node").select("node", "root", "fp", F.col("first.doc_id").alias("c_id"), F.col("first.tie").alias("c_tie")), "similar-chosen")
    texts = as_bytes(docs, doc_id.alias("doc_id"), _tie().alias("tie"))
    met = texts.join(chosen, texts.doc_id.eqNullSafe(chosen.c_id) & (texts.tie == chosen.c_tie)).select("root", "node", "fp", "text")
    sets = staged(met.mapInArrow(_sets(shingle), "root long, node long, fp array<long>, sets array<long>"), "similar-sets")
    dealt = _blocked(sets, "root", verified // 2, verified).select("key", "node", "fp", "sets")
    edges = dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_verify(most, similarity), EDGES)
    roots = staged(components(staged(edges, "similar-links")), "similar-groups")
    placed = staged(distinct.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "similar-placed")
    firsts = staged(placed.groupBy("root").agg(F.min("first").alias("first")), "similar-firsts")
    return rows.join(placed.select("node", "root"), "node").join(firsts, "root").select("doc_id", "tie", "first")


def near_duplicates_removed(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK, verified: int = VERIFIED) -> DataFrame:
    """One row of docs for each group. Rows that go are named by doc_id and hash of the text; their number decides whether
    Spark sends their names to the texts or shuffles both."""
    found = groups(docs, shingle, similarity, block, verified).select("doc_id", "tie", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))).alias("stays"))
    named = staged(found.groupBy("doc_id", "tie").agg(F.count("*").alias("rows"), F.max("stays").alias("stays")), "similar-named")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _tie().alias("tie")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.tie") == F.col("n.tie"))
    rest = whole.join(named.where("not stays or rows > 1").alias("n"), same, "left_anti")
    repeated = whole.join(named.where("stays and rows > 1").alias("n"), same, "left_semi").dropDuplicates(["doc_id", "tie"])
    return rest.union(repeated).select("row.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates_removed(docs)
