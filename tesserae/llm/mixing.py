"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a seeded hash of doc_id, and blocks are drawn
in a seeded order: whole passes over a source first, then blocks up to its target, the last
of them document by document.  The blocks drawn are dealt to output shards by a splitting
tree: at each node the exact block quotas of all sources are split in two by a multivariate
hypergeometric draw, down to one shard, so every shard's quota is exact and the quotas add
up.  Each shard then draws that many of a source's permuted blocks, disjoint from other
shards', and shuffles its documents locally by a seeded hash.

The tree is cut by task: one splits the root down to `SUBTREES` nodes, and a task for each of
these goes on from there, so that neither the driver nor a task holds sources times shards.
The numbers of blocks and shards grow with the size of the whole.

A document's size is the number of its words `[^\\x20\\x09-\\x0D]+`, 0 for a null text.  Targets
share `share` times all sizes by weight; none exceeds `passes` times its source's size, and
the excess is shared again by weight.  Sources are ordered by code point, null last; a null
source is a source.  Documents of size 0 are never taken.  Rows repeated with one doc_id
and source must have one text; they are drawn alike, and a null doc_id is drawn like any
other.  Draws depend on the seed and the documents only, not on partitioning.  An empty table
gives an empty result.  Columns other than doc_id, source and text are ignored or, by
mix_rows(), carried along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Workspace, numbered, require

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, PASSES = 1.5, 2
#: Blocks of a source at least; a block's documents are ordered in one task.
BLOCKS = 1024
#: Shards at least, and words of a shard from which there are more.
SHARDS, SHARD_WORDS = 64, 20_000_000
#: Blocks of a source for each shard beyond BLOCKS.
SHARD_BLOCKS = 4
#: Nodes of the splitting tree that one task deals out.
SUBTREES = 1024
SEED = 20_240_229


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def split(quotas: np.ndarray, lo: int, hi: int, span: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, quotas) of the tree's nodes of at most `span` shards below the node lo:hi, from left to right.

    At each node a multivariate hypergeometric draw of its own seed splits the quotas in
    two, the sums of the halves in proportion to their shards.
    """
    if hi - lo <= span:
        yield lo, hi, quotas
        return
    mid = (lo + hi) // 2
    n = int(quotas.sum()) * (mid - lo) // (hi - lo)
    there = np.flatnonzero(quotas)
    left = np.zeros_like(quotas)
    if len(there):
        left[there] = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(quotas[there], n, method="marginals")
    yield from split(left, lo, mid, span, seed)
    yield from split(quotas - left, mid, hi, span, seed)


def split_tree(quotas: DataFrame, shards: int, seed: int = SEED, subtrees: int = SUBTREES) -> DataFrame:
    """(number, shard, quota) of the shards that get any: how many of a source's draws each takes.

    quotas: (number, quota), a row a source, numbered from 1.
    """
    span = -(-shards // subtrees)
    kinds = "lo int, hi int, number long, quota long"

    def below(table, lo: int, hi: int, least: int):
        number, quota = (table.column(c).to_numpy() for c in ("number", "quota"))
        by = np.argsort(number)
        out = [(a, b, number[by][at], q[at]) for a, b, q in split(quota[by], lo, hi, least, seed) for at in [np.flatnonzero(q)]]
        columns = [np.concatenate([np.full(len(n), x, np.int32) for x, _, n, _ in out]), np.concatenate([np.full(len(n), x, np.int32) for _, x, n, _ in out]), np.concatenate([n for _, _, n, _ in out]), np.concatenate([q for _, _, _, q in out])]
        return pa.table(dict(zip(("lo", "hi", "number", "quota"), columns, strict=True)))

    nodes = quotas.groupBy().applyInArrow(lambda table: below(table, 0, shards, span), kinds)
    if span > 1:
        nodes = nodes.groupBy("lo", "hi").applyInArrow(lambda key, table: below(table, key[0].as_py(), key[1].as_py(), 1), kinds)
    return nodes.select("number", F.col("lo").alias("shard"), "quota")


def targets_of(ws: Workspace, rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """source, number, source_size, target: one row per source, written once.

    Every source that stays under its bound gets its weight times one level, the others
    their bound; the level rises until no source is above, an aggregate a time.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = numbered(ws, ws.save(sizes, "sources"), [F.asc_nulls_last("source")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    held = ws.save(placed.withColumn("weight", weight).withColumn("most", (F.col("source_size") * passes).cast("double")), "weights")
    total = share * (held.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        over = F.col("weight") * level > F.col("most")
        bound, free = held.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        risen = (total - bound) / free if free else level
        if risen <= level * (1 + 1e-12):  # sums differ in their last bits
            break
        level = risen
    return held.select("source", "number", "source_size", F.least(F.col("weight") * level, "most").alias("target"))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, draw: the place of a document in the seeded order."""
    rows = require(docs, "doc_id", "source", "text").select("doc_id", "source", words(F.col("text")).alias("size"))
    return rows.withColumn("draw", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-(2**62)))))


def shards_for(n_words: int, share: float = SHARE) -> int:
    return max(SHARDS, -(-int(share * n_words) // SHARD_WORDS))


def draw(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED, shards: int | None = None, blocks: int | None = None) -> tuple[DataFrame, int]:
    """doc_id, source, number, size, block, draw, source_size, target, copies of every row; and the number of shards.

    Documents are put in order only in the one block of a source that its target cuts.
    """
    # texts are read once; what is kept of each is a few numbers
    ws = Workspace(docs.sparkSession, "mixing")
    rows = ws.save(sized(docs, seed), "sized")
    shards = shards or shards_for(rows.agg(F.sum("size")).first()[0] or 0, share)
    blocks = blocks or max(BLOCKS, SHARD_BLOCKS * shards)
    rows = rows.withColumn("block", F.pmod(F.shiftrightunsigned("draw", 20), F.lit(blocks)).cast("int"))
    targets = targets_of(ws, rows, weights, share, passes).withColumnRenamed("source", "_s")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    sums = sums.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sums.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumn("before", F.coalesce(F.sum("block_size").over(order), F.lit(0)))
    inside = F.col("before") + F.col("block_size") <= F.col("rest")
    cut = ~inside & (F.col("before") < F.col("rest"))
    # `blocks` rows of a few numbers for each source
    plan = plan.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "number", "source_size", "target", "whole", inside.alias("inside"), cut.alias("cut"), (F.col("rest") - F.col("before")).alias("room"))
    met = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    kept = ["number", *rows.columns, "source_size", "target"]
    plain = met.where(~F.col("cut")).select(*kept, (F.col("whole") + F.col("inside").cast("long")).alias("copies"))
    # taken while the middle of the document lies before the target
    closer = F.sum("size").over(Window.partitionBy("number", "block").orderBy("draw", "doc_id")) - F.col("size") / 2 <= F.col("room")
    edge = met.where("cut").withColumn("extra", closer.cast("long")).select(*kept, (F.col("whole") + F.col("extra")).alias("copies"))
    return plain.unionByName(edge), shards


def deal(taken: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """shard, place, doc_id, source, copy of every document drawn; `place` is the order in the shard.

    taken: rows of draw().  Quotas are in block draws: a block and a pass over it.  A shard's
    draws of a source are the next of the source's permuted draws.
    """
    taken = taken.where("copies > 0 and size > 0")
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    draws = copies.select("number", "block", "copy").distinct()
    # blocks times passes rows a source, a few numbers each
    turn = Window.partitionBy("number").orderBy(F.xxhash64(F.lit(seed + 2), "block", "copy"), "block", "copy")
    turns = draws.withColumn("turn", F.row_number().over(turn).cast("long"))
    quotas = split_tree(turns.groupBy("number").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    last = F.sum("quota").over(Window.partitionBy("number").orderBy("shard"))
    spans = quotas.withColumn("last", last).select("number", "shard", F.explode(F.sequence(F.col("last") - F.col("quota") + 1, F.col("last"))).alias("turn"))
    dealt = turns.join(spans, ["number", "turn"]).select("number", "block", "copy", "shard")
    return copies.join(dealt, ["number", "block", "copy"]).select("shard", F.xxhash64(F.lit(seed + 3), "doc_id", "copy").alias("place"), "doc_id", "source", "copy")


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED, **how) -> DataFrame:
    """The mix itself: shard, place, doc_id, source, copy, each shard in its shuffled order."""
    drawn, shards = draw(docs, seed=seed, shards=shards, **how)
    return deal(drawn, shards, seed).repartition(F.col("shard")).sortWithinPartitions("shard", "place", "doc_id", "copy")


def mix_rows(docs: DataFrame, shards: int | None = None, seed: int = SEED, **how) -> DataFrame:
    """The rows of `docs`, with all their columns, once for each copy drawn, shard by shard in the shards' shuffled order."""
    drawn, shards = draw(docs, seed=seed, shards=shards, **how)
    # rows with one doc_id and source are drawn alike and mustn't multiply each other
    dealt = deal(drawn, shards, seed).groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s")).agg(F.collect_set(F.struct("shard", "place", "copy")).alias("dealt"))
    held = docs.select(F.col("doc_id"), F.col("source"), F.struct("*").alias("row"))  # no column of the row can clash
    met = held.join(dealt, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")))
    each = met.select("row", F.explode("dealt").alias("at"))
    return each.repartition(F.col("at.shard")).sortWithinPartitions("at.shard", "at.place").select("row.*")


def taken_words(docs: DataFrame, shards: int | None = None, seed: int = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: the words that the shards hold of it."""
    drawn, shards = draw(docs, seed=seed, shards=shards, **how)
    held = deal(drawn, shards, seed).groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s")).agg(F.count_distinct("copy").alias("times"))
    met = drawn.join(held, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    return met.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return taken_words(docs)
