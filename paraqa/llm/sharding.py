"""Resharding by minimum-cost flow.

Old shards hold bytes, new shards have capacities. A flow from old to new shards at the least number of moved bytes
says how many bytes of each old shard go where; documents follow in the fixed order of their blocks, and the files of
shards that change are written anew.

Rows are numbered by their ids and sizes alone. Blocks are cut by a hash, hence even in any shard; their number follows from
the shard's bytes, so a block's rows are few enough for a task at any size. What reaches the driver are the blocks' sums.
Texts are shuffled once: a block's place says where its file is, and its rows are numbered again there, in the same order.

Nulls: a null text has no bytes (size 1), a null doc_id is a value like any other. Repeated rows and ties keep separate
slots. An empty table gives an empty result. Other columns, whatever their names, are passed through by reshard(); where
one has the name of a column that it adds (see ADDED), the added one's name gets `reshard_` in front.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, scratch_dir, staged

#: Columns that reshard() adds.
ADDED = ("size", "text_crc32", "old_shard", "shard", "slot")
#: Bytes of a block, about, and blocks of an old shard at least; bytes of a file, and files of a new shard at least.
BLOCK_BYTES, LEAST_BLOCKS = 1 << 28, 64
FILE_BYTES, LEAST_FILES = 1 << 28, 4
NEW_SHARDS = 16
#: Where the corpus lies before the query: shards by source, so that a hot source overfills one of them.
OLD_SHARDS = 12


def min_cost_flow(supply: list[int], capacity: list[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Bytes to send from each old to each new shard, all supply at the least total cost (successive shortest paths with potentials).

    The graph has a node for each shard only, so its size doesn't depend on the data.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold the old ones")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # edges: to, room, cost, index of the reverse edge

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
        for j in range(m):
            edge(i, n + j, x, cost(i, j))
    for j, x in enumerate(capacity):
        edge(n + j, sink, x, 0)
    potential, left = [0] * len(graph), sum(supply)
    while left:
        far, via, todo = [float("inf")] * len(graph), [None] * len(graph), [(0, source)]
        far[source] = 0
        while todo:
            d, a = heapq.heappop(todo)
            if d > far[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and (at := d + price + potential[a] - potential[b]) < far[b]:
                    far[b], via[b] = at, (a, k)
                    heapq.heappush(todo, (at, b))
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, far, strict=True)]
        push, b = left, sink
        while b != source:
            a, k = via[b]
            push, b = min(push, graph[a][k][1]), a
        b = sink
        while b != source:
            a, k = via[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
        left -= push
    return {(i, b - n): graph[b][back][1] for i in range(n) for b, _, _, back in graph[i] if n <= b < n + m and graph[b][back][1]}


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total // shards + (k < total % shards) for k in range(shards)]


@dataclass
class Plan:
    """blocks: for each old shard the number of its blocks. cuts: old_shard, cuts (lo, hi, shard), a row for each old shard.
    starts: old_shard, block, start, place, a row for each block. offsets: shard, old_shard, block, shift, a row for each
    block and cut. placed: rows (doc_id, size, text_crc32, old_shard, block, rn, shard). moved: bytes from shard to shard."""

    blocks: list[int]
    cuts: DataFrame
    starts: DataFrame
    offsets: DataFrame
    placed: DataFrame
    moved: dict[tuple[int, int], int]
    places: int


def _measured(docs: DataFrame, old_shard: Column) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old_shard.cast("int").alias("old_shard")]


def _blocked(rows: DataFrame, blocks: list[int]) -> DataFrame:
    n = F.element_at(F.array(*map(F.lit, blocks)), F.col("old_shard") + 1)
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), n).cast("int"))


def _numbered(rows: DataFrame, *by: str) -> DataFrame:
    """rn and before: the rows and bytes of the block up to here. Rows alike in the order are of one size: any order will do."""
    order = Window.partitionBy(*by).orderBy("doc_id", "text_crc32", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("rn", F.row_number().over(order)).withColumn("before", before)


def _to_shards(rows: DataFrame, plan_cuts: DataFrame, plan_starts: DataFrame) -> DataFrame:
    """rows with the shard where the first byte of each falls."""
    if "start" not in rows.columns:
        rows = rows.join(F.broadcast(plan_starts), ["old_shard", "block"])  # as many rows as blocks
    at = F.col("start") + F.col("before")
    met = rows.join(F.broadcast(plan_cuts), "old_shard")  # a row for each old shard
    return met.withColumn("shard", F.filter("cuts", lambda c: (c.lo <= at) & (at < c.hi))[0].shard).drop("cuts", "start", "before")


def solved(docs: DataFrame, old_shard: Column, old_shards: int, capacities: Callable[[int], list[int]], block_bytes: int = BLOCK_BYTES) -> Plan:
    """The flow and where it puts each row. old_shard: int column, 0 to old_shards - 1. capacities: from the bytes of all
    rows, those of each new shard."""
    spark = docs.sparkSession
    ids = staged(docs.select(*_measured(docs, old_shard)), "reshard-ids")
    held = dict(ids.groupBy("old_shard").agg(F.sum("size")).collect())  # old_shards rows
    blocks = [max(LEAST_BLOCKS, -(-held.get(i, 0) // block_bytes)) for i in range(old_shards)]
    rows = staged(_numbered(_blocked(ids, blocks), "old_shard", "block"), "reshard-rows")
    sums = {(r[0], r[1]): r[2] for r in rows.groupBy("old_shard", "block").agg(F.sum("size")).collect()}  # as many rows as blocks
    supply = [held.get(i, 0) for i in range(old_shards)]
    room = capacities(sum(supply))
    flow = min_cost_flow(supply, room, lambda i, j: int(i != j))
    file_bytes = min(FILE_BYTES, max(1, -(-max(room) // LEAST_FILES)))
    cuts, starts, filled = [], [], [0] * len(room)
    for i in range(old_shards):
        at, mine = 0, []
        for j in sorted(range(len(room)), key=lambda j: (j != i, j)):
            if x := flow.get((i, j), 0):
                mine.append((at, at + x, j))
                at += x
        cuts += [(i, *c) for c in mine]
        at = turn = 0
        for b in range(blocks[i]):
            if (i, b) in sums:
                while at >= mine[turn][1]:
                    turn += 1
                j = mine[turn][2]
                starts.append((i, b, at, (j, filled[j] // file_bytes)))
                filled[j] += sums[i, b]
                at += sums[i, b]
    per_old = spark.createDataFrame(cuts, "old_shard int, lo long, hi long, shard int").groupBy("old_shard").agg(F.collect_list(F.struct("lo", "hi", "shard")).alias("cuts"))
    files = {place: k for k, place in enumerate(sorted({s[3] for s in starts}))}
    begin = spark.createDataFrame([(*s[:3], files[s[3]]) for s in starts], "old_shard int, block int, start long, place int")
    placed = _to_shards(rows, per_old, begin)
    parts = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"), F.min("rn").alias("first")).collect()  # a row for each block and cut
    offsets, slots = [], [0] * len(room)
    for r in sorted(parts):
        offsets.append((r.shard, r.old_shard, r.block, slots[r.shard] - r.first))
        slots[r.shard] += r.n
    shifts = spark.createDataFrame(offsets, "shard int, old_shard int, block int, shift long")
    return Plan(blocks, per_old, begin, shifts, placed, flow, len(files))


def _slotted(rows: DataFrame, plan: Plan) -> DataFrame:
    met = rows.join(F.broadcast(plan.offsets), ["shard", "old_shard", "block"])  # a row for each block and cut
    return met.withColumn("slot", F.col("shift") + F.col("rn"))


def added_names(columns: list[str]) -> dict[str, str]:
    """The names of the columns that reshard() adds to these."""
    taken, out = {c.lower() for c in columns}, {}
    for name in ADDED:
        new = name
        while new in taken:
            new = f"reshard_{new}"
        out[name] = new
    return out


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, capacities: Callable[[int], list[int]], block_bytes: int = BLOCK_BYTES, plan: Plan | None = None) -> DataFrame:
    """docs with a shard and a slot for each row, in partitions of whole files, in the order of slots.

    A row goes where its first byte falls in its old shard's flow; so a shard differs from its capacity by less than
    the sizes of the rows at its few cuts.
    """
    plan = plan or solved(docs, old_shard, old_shards, capacities, block_bytes)
    rows = _blocked(docs.select(F.struct("*").alias("row"), *_measured(docs, old_shard)), plan.blocks)
    rows = rows.join(F.broadcast(plan.starts), ["old_shard", "block"])  # as many rows as blocks
    # a partition for each place, so a window over its blocks shuffles nothing
    rows = _numbered(rows.repartitionById(max(1, plan.places), "place"), "place", "old_shard", "block")
    names = added_names(docs.columns)
    rows = _slotted(_to_shards(rows, plan.cuts, plan.starts), plan)
    return rows.select("row.*", *(F.col(name).alias(new) for name, new in names.items()))


def rewrite(docs: DataFrame, old_shard: Column, old_shards: int, capacities: Callable[[int], list[int]], out: str, drop: tuple[str, ...] = ()) -> list[int]:
    """Writes the shards that gain or lose a row under out/shard=N/, each in some files, with a column slot that says the
    order; the files of others may stay as they are. Returns the shards that were written. drop: columns of docs that aren't
    to be written."""
    plan = solved(docs, old_shard, old_shards, capacities)
    moved = plan.placed.groupBy("old_shard", "shard").agg(F.count("*")).collect()  # old_shards * shards at most
    before, after = {r.old_shard for r in moved}, {r.shard for r in moved}
    touched = {k for r in moved if r.old_shard != r.shard for k in (r.old_shard, r.shard)} & (before | after) & after
    names = added_names(docs.columns)
    todo = reshard(docs, old_shard, old_shards, capacities, plan=plan).where(F.col(names["shard"]).isin(sorted(touched)))
    gone = {*drop, names["size"], names["text_crc32"], names["old_shard"]}
    kept = [c for c in todo.columns if c not in gone]
    todo.select(*(F.col(c).alias("shard" if c == names["shard"] else c) for c in kept)).write.partitionBy("shard").parquet(out)
    return sorted(touched)


def by_source(shards: int = OLD_SHARDS) -> Column:
    return F.pmod(F.xxhash64("source"), F.lit(shards)).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all shards that change, which the shards by source all do, and reads sizes, hashes and order from their files."""
    docs, out = documents(spark, sf_dir), f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    old = docs.select("doc_id", "text", "source").withColumn("old_shard", by_source())
    rewrite(old, F.col("old_shard"), OLD_SHARDS, lambda total: even(total, NEW_SHARDS), out, drop=("source",))
    text = F.coalesce("text", F.lit(""))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rows = spark.read.schema(f"doc_id {kinds['doc_id']}, text {kinds['text']}, old_shard int, slot long, shard int").parquet(out)
    return rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reshard(docs, by_source(), OLD_SHARDS, lambda total: even(total, NEW_SHARDS))
