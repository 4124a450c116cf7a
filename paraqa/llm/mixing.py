"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words. A document of a source stands for target / source size copies; the whole part is
taken, the fractions are rounded in pairs: mass moves between the two of a pair until one of them is integral, at odds that
keep each expectation, and the other one goes on. In a block of documents, which all have the same fraction, a document is
paired with the smaller ones of its block as one partner, the largest document first: mass moves between the two until the
document is integral or the partner is as a whole. So the block's smallest document is what is left of it, unless one
outweighs all the others, and not a large one, as pairing two by two would have it. These residuals meet in blocks of the
next level, where pairs are two of them, and so on: a reduction tree. Mass is counted in words, so that the words taken
differ from the target by less than the size of the one document left at a source's root, which gets whole by a coin. Each
document's expected copies are its source's target / size, in sources of any size.

DataFrame functions only. Nulls: a null text has size 0, a null source is a source (the last), a null doc_id is a value.
Documents of size 0 are taken 0 times. Rows alike in doc_id, source and size are counted first and then numbered, so each
has a coin of its own and a place in some block, however many there are. An empty table gives an empty result. Columns
other than doc_id, text and source aren't read; taken() passes them on, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, n_words, staged

WEIGHTS = (1, 2, 3)
#: A target is at most so many times its source's size.
MOST = 3
#: Mean number of documents in a block, and of residuals in a block of the next levels.
BLOCK = 128
SEED = 20240


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n, target from rows of (source, size). Integer arithmetic up to the last division.

    Sources in the order of size by weight stop at their limit until one doesn't: from there on all share by weight.
    The windows hold one row for each source.
    """
    least = math.lcm(*weights)
    by_name, in_all = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    stops = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")).withColumn("weight", weight)
    rows = rows.withColumn("ratio", F.col("source_size") * F.expr(f"{least} div weight")).withColumns(
        {
            "stop": F.col("source_size") * most,
            "at": F.row_number().over(stops),
            "rest": F.sum("source_size").over(in_all) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)),
            "shares": F.sum("weight").over(in_all) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    open_ = F.col("stop") * F.col("shares") > F.col("weight") * F.col("rest")
    rows = rows.withColumn("first", F.min(F.when(open_, F.struct("at", "rest", "shares"))).over(in_all))
    shared = (F.col("weight") * F.col("first.rest")).cast("double") / F.col("first.shares")
    return rows.select("source", "source_size", "n", F.when(F.col("at") >= F.col("first.at"), shared).otherwise(F.col("stop").cast("double")).alias("target"))


_ROW, _BIT = "struct<size: bigint, h: bigint, id: bigint, mass: double>", "struct<id: bigint, size: bigint, extra: int>"
_COIN = "(xxhash64({seed}, {ids}) & 9007199254740991) / 9007199254740992D"

#: In a block of documents, all of the same fraction f: each document in turn, the largest first, is paired with the pool
#: of the smaller ones (r: their words). Mass moves from the pool (up) or into it, at odds of the other move's length,
#: until the document is integral or else the whole pool is. The last document, the smallest, is left with its mass.
_POOL = f"""aggregate(xs, named_struct('f', f, 'r', aggregate(xs, 0L, (a, x) -> a + x.size), 'last', cast(null as {_ROW}), 'done', cast(array() as array<{_BIT}>)),
  (s, x) -> aggregate(array(named_struct('m', s.f * x.size, 'r', s.r - x.size, 'up', coalesce({_COIN.replace("{ids}", "x.h")}
        < least(s.f * x.size, (1 - s.f) * (s.r - x.size)) / nullif(least(s.f * x.size, (1 - s.f) * (s.r - x.size)) + least((1 - s.f) * x.size, s.f * (s.r - x.size)), 0D), false))), s,
    (z, y) -> case
      when s.f <= 0D or s.f >= 1D then named_struct('f', s.f, 'r', y.r, 'last', s.last, 'done', s.done || array(named_struct('id', x.id, 'size', x.size, 'extra', if(s.f >= 1D, 1, 0))))
      when y.r = 0 then named_struct('f', s.f, 'r', y.r, 'last', named_struct('size', x.size, 'h', x.h, 'id', x.id, 'mass', y.m), 'done', s.done)
      when y.up and x.size - y.m <= s.f * y.r then named_struct('f', greatest(0D, s.f - (x.size - y.m) / y.r), 'r', y.r, 'last', s.last, 'done', s.done || array(named_struct('id', x.id, 'size', x.size, 'extra', 1)))
      when y.up then named_struct('f', 0D, 'r', y.r, 'last', named_struct('size', x.size, 'h', x.h, 'id', x.id, 'mass', y.m + s.f * y.r), 'done', s.done)
      when y.m <= (1 - s.f) * y.r then named_struct('f', least(1D, s.f + y.m / y.r), 'r', y.r, 'last', s.last, 'done', s.done || array(named_struct('id', x.id, 'size', x.size, 'extra', 0)))
      else named_struct('f', 1D, 'r', y.r, 'last', named_struct('size', x.size, 'h', x.h, 'id', x.id, 'mass', y.m - (1 - s.f) * y.r), 'done', s.done) end))"""

#: Among residuals, whose fractions differ: s.last is the residual so far, x the next one; one of the two becomes integral.
_PAIR = f"""aggregate(xs, named_struct('last', cast(null as {_ROW}), 'done', cast(array() as array<{_BIT}>)),
  (s, x) -> if(s.last is null, named_struct('last', x, 'done', s.done),
   aggregate(array(named_struct('t', s.last.mass + x.mass, 'up', coalesce({_COIN.replace("{ids}", "s.last.h, x.h")}
        < least(s.last.mass, x.size - x.mass) / nullif(least(s.last.size - s.last.mass, x.mass) + least(s.last.mass, x.size - x.mass), 0D), false))), s,
    (z, y) -> case
      when y.up and y.t >= s.last.size then named_struct('last', named_struct('size', x.size, 'h', x.h, 'id', x.id, 'mass', y.t - s.last.size), 'done', s.done || array(named_struct('id', s.last.id, 'size', s.last.size, 'extra', 1)))
      when y.up then named_struct('last', named_struct('size', s.last.size, 'h', s.last.h, 'id', s.last.id, 'mass', y.t), 'done', s.done || array(named_struct('id', x.id, 'size', x.size, 'extra', 0)))
      when y.t <= x.size then named_struct('last', named_struct('size', x.size, 'h', x.h, 'id', x.id, 'mass', y.t), 'done', s.done || array(named_struct('id', s.last.id, 'size', s.last.size, 'extra', 0)))
      else named_struct('last', named_struct('size', s.last.size, 'h', s.last.h, 'id', s.last.id, 'mass', y.t - x.size), 'done', s.done || array(named_struct('id', x.id, 'size', x.size, 'extra', 1))) end)))"""


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs. doc_id must be a long."""
    keys = ["source", "source_size", "n", "target"]
    sizes = staged(docs.select(F.col("doc_id").cast("long").alias("id"), "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    goal = staged(targets(sizes, weights, most), "mix-targets")
    rows = sizes.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("id", "size", *(f"g.{k}" for k in keys))
    # rows that are alike become a count where they are read, and a number each; h tells them apart
    alike = rows.where("size > 0").groupBy("id", "size", *keys).agg(F.count("*").cast("int").alias("rows"))
    alike = alike.select("id", "size", *keys, F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("k"))
    share = F.col("target") / F.col("source_size")
    nothing = rows.where("size = 0").select("id", "size", *keys, F.lit(0).alias("extra"))
    # a block's number at a level: the hash at first, then the number itself, modulo the number of blocks left
    level = alike.select(*keys, F.xxhash64(F.lit(seed), "id", "size", "k").alias("h"), "id", "size", ((share - F.floor(share)) * F.col("size")).alias("mass"), F.xxhash64("id", "size", "k").alias("spot"))
    most_rows, decided, k = goal.agg(F.max("n")).first()[0] or 0, [nothing], 0
    while most_rows > 0:
        k += 1
        most_rows = -(-most_rows // block) if most_rows > 1 else 0
        blocks = F.ceil(F.col("n") / float(block**k)).cast("long")
        grouped = level.withColumn("spot", F.pmod("spot", blocks)).groupBy(*keys, "spot").agg(F.sort_array(F.collect_list(F.struct("size", "h", "id", "mass")), asc=False).alias("xs"))
        # largest first: what is left of a block, and in the end of a source, is a small document
        grouped = grouped.withColumn("f", share - F.floor(share))
        grouped = staged(grouped.select(*keys, "spot", F.expr((_POOL if k == 1 else _PAIR).replace("{seed}", str(seed + k))).alias("s")), "mix-level")
        decided.append(grouped.select(*keys, F.explode("s.done").alias("x")).select("x.id", "x.size", *keys, "x.extra"))
        level = grouped.where("s.last is not null").select(*keys, "s.last.h", "s.last.id", "s.last.size", "s.last.mass", "spot")
        if most_rows <= 1:
            most_rows = 0
    root = (F.xxhash64(F.lit(seed - 1), "h").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) < F.col("mass") / F.col("size")
    decided.append(level.select("id", "size", *keys, F.when(root, 1).otherwise(0).alias("extra")))
    copies = F.when(F.col("size") > 0, F.floor(share) + F.col("extra")).otherwise(0).cast("int")
    return reduce(DataFrame.union, decided).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def taken(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as mix() says. Rows alike in doc_id, source and size pool their copies.

    A row is carried as one column, so its names can't clash. Only rows that aren't alone under their keys are numbered;
    mostly there are none, and texts are shuffled once, to meet their number.
    """
    keys = ["id", "source", "size"]
    kept = mixed.groupBy(F.col("doc_id").alias("id"), "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    kept = staged(kept.where("copies > 0"), "mix-copies")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), "source", n_words(F.col("text")).alias("size"))

    def met(some: DataFrame) -> DataFrame:
        same = [F.col(f"d.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
        return rows.alias("d").join(some.alias("m"), same).select("d.row", *(F.col(f"d.{k}").alias(k) for k in keys), "m.copies", "m.rows")

    single = met(kept.where("rows = 1")).select("row", F.col("copies").alias("each"))
    several = met(kept.where("rows > 1")).withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row"))))
    # the copies of rows that can't be told apart by the keys go round among them
    several = several.select("row", F.expr("copies div rows + if(at <= copies % rows, 1, 0)").alias("each"))
    return single.union(several).where("each > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("each").cast("int"))).alias("k")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return taken(docs, mix(docs))
