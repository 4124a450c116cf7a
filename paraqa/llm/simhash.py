"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints have 64 bits and link at 4 differing bits or fewer. Cut into three segments, two linked fingerprints differ
by at most one bit in one of them. So each distinct fingerprint is indexed under its segments with one bit taken out, one
variant for each of the 64 bits; linked ones meet under an equal variant, and a meeting counts only after the whole
fingerprints have been compared. What is put out of a variant's group is a spanning forest of its links, not its pairs.

Nulls: a null text has no words and fingerprint zero; a null doc_id takes part, but isn't a component's number unless
no member has another (then it is null). Repeated rows keep a row each; an empty table gives an empty result. Only doc_id
and text are read. Links by the similarity of shingles, which such fingerprints miss, are in similar.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, staged
from .components import components

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: First bit and width of the segments: MOST_BITS differing bits over three segments leave one with one at most.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: A variant's group of more fingerprints is compared in pairs of blocks of this size, each pair in a place of its own.
BLOCK = 4096


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text in UTF-8, as a signed 64-bit integer."""
    words = raw.lower().split()  # bytes: A-Z only, and white space is x20 and x09 to x0D
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, at, starts, ends = b" ".join(words), 0, [], []
        for w in words:
            starts.append(at)
            ends.append(at + len(w))
            at += len(w) + 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:z], SEED) for a, z in zip(starts, ends[shingle - 1 :], strict=False)]
    data, ones = np.array(hashes, dtype="<u8"), np.zeros(64, dtype=np.int64)
    for k in range(0, len(data), 1 << 16):
        ones += np.unpackbits(data[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(data), bitorder="little").view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py(), shingle) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(found, pa.int64())], names=["doc_id", "tie", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tie (a hash of the text), fp for each row of docs."""
    rows = as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, tie long, fp long")


def variants(fp: Column) -> Column:
    """The 64 keys of a fingerprint: the number of the bit taken out, and the rest of that bit's segment."""
    keys = []
    for first, width in SEGMENTS:
        part = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        keys += [part.bitwiseAND(F.lit(~(1 << k))) + F.lit((first + k) << 22) for k in range(width)]
    return F.explode(F.array(*keys))


def forest(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal keys (sorted), reduced to one edge from each linked fingerprint to the first of its tree."""
    nodes, at = np.unique(fp, return_inverse=True)
    i, shift, ends = np.arange(len(key)), 1, []
    while len(i := i[i + shift < len(key)]) and len(i := i[key[i + shift] == key[i]]):
        near = i[np.bitwise_count(fp[i + shift].view(np.uint64) ^ fp[i].view(np.uint64)) <= MOST_BITS]
        ends.append(np.stack((at[near], at[near + shift])))
        shift += 1
        if sum(x.shape[1] for x in ends) > 1 << 20:
            ends = [stars(np.concatenate(ends, axis=1), len(nodes))]
    if not ends:
        return fp[:0], fp[:0]
    tree = stars(np.concatenate(ends, axis=1), len(nodes))
    return nodes[tree[0]], nodes[tree[1]]


def stars(ends: np.ndarray, n: int) -> np.ndarray:
    """A star for each component of the edges over nodes 0 to n - 1."""
    root = np.arange(n)
    while True:
        a, b = root[ends[0]], root[ends[1]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while not (root[root] == root).all():
            root = root[root]
    linked = np.flatnonzero(root != np.arange(n))
    return np.stack((linked, root[linked]))


LINKS = "a long, b long, key long, block int"


def _compare(most: int | None):
    """Over rows sorted by key: edges (a, b), and the rows (a, key, block) of groups with more than `most` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, large, passed = np.zeros(0, np.int64), np.zeros(0, np.int64), None, 0

        def edges(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = forest(k, f)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())], names=["a", "b", "key", "block"])

        def members(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(f), pa.nulls(len(f), pa.int64()), pa.array(k), pa.array(((passed + np.arange(len(f))) // most).astype(np.int32))], names=["a", "b", "key", "block"])

        for batch in batches:
            key = np.concatenate((key, batch.column("key").to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, batch.column("fp").to_numpy(zero_copy_only=False)))
            if large is not None:  # the large group goes on
                n = int(np.searchsorted(key, large, "right"))
                yield members(key[:n], fp[:n])
                passed += n
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                large = None
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
            if cut:
                bounds = np.flatnonzero(np.diff(key[:cut], prepend=key[0] - 1))
                sizes = np.diff(bounds, append=cut)
                if most and (sizes > most).any():
                    big = np.repeat(sizes > most, sizes)
                    for s, z in zip(bounds[sizes > most], sizes[sizes > most], strict=True):
                        passed = 0
                        yield members(key[s : s + z], fp[s : s + z])
                    yield edges(key[:cut][~big], fp[:cut][~big])
                else:
                    yield edges(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
            if most and len(key) > most:
                large, passed = key[0], 0
                yield members(key, fp)
                passed, key, fp = len(key), key[:0], fp[:0]
        if len(key):
            yield edges(key, fp)

    return run


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: a spanning forest of the links among distinct fingerprints (column fp)."""
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.select(variants(F.col("fp")).alias("key"), "fp")
    found = staged(keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compare(block), LINKS), "simhash-links")
    edges = found.where("key IS NULL").select("a", "b")
    large = found.where("key IS NOT NULL")
    if large.isEmpty():
        return edges
    # every pair of blocks of a large group meets at (key, i, j)
    counts = large.groupBy("key").agg(F.max("block").alias("last"))
    pairs = large.join(counts, "key").select("key", "block", "a", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    met = pairs.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), F.col("a").alias("fp"))
    more = met.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compare(None), LINKS)
    return edges.union(more.select("a", "b"))


def groups(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """fp, and of its component: first, the least (doc_id is null, doc_id, tie). rows: doc_id, tie, fp.

    A component's first comes from a table of its own, so that Spark can split the join with a component of many members.
    """
    distinct = staged(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")), "simhash-distinct")
    roots = staged(components(links(distinct, block)), "simhash-roots")
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = staged(placed, "simhash-placed")
    firsts = staged(placed.groupBy("root").agg(F.min("first").alias("first")), "simhash-firsts")
    return placed.drop("first").join(firsts, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for each row of docs."""
    rows = staged(fingerprints(docs, shingle), "simhash-rows")
    return rows.join(groups(rows, block), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


