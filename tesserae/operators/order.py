"""Places in a total order and exact quantiles, in one task up to a checked size and by ranges beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a window without partitions may put in order in one task, and rows of a table that may be broadcast.
ONE_TASK = BROADCAST_ROWS = 1_000_000
#: Used only where the session names no spark.checkpoint.dir and runs in this process, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/tesserae"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a session on a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_CHECKPOINTS
    return base.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once: a checkpoint in the shared folder, which lost executors don't take along."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a hint to broadcast it if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running(df: DataFrame, order: list[Column], weight: Column, out: str, one_task: int = ONE_TASK) -> DataFrame:
    """`df` with the sum of `weight` over all rows up to its own in a total order.

    Up to `one_task` rows are ordered in one task.  More are cut into ranges of the order, summed
    within each, and moved on by the sums of the ranges before.
    """
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if df.limit(one_task + 1).count() <= one_task:
        return df.withColumn(out, F.sum(weight).over(upto(Window.orderBy(*order))))
    ranged = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(weight).alias("_sum"))  # a row a partition
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    held = ranged.withColumn(out, F.sum(weight).over(upto(Window.partitionBy("_range").orderBy(*order))))
    return held.join(F.broadcast(starts), "_range").withColumn(out, F.col(out) + F.col("_start")).drop("_range", "_start")


def numbered(df: DataFrame, order: list[Column], out: str, one_task: int = ONE_TASK) -> DataFrame:
    """`df` with its place from 1 in a total order."""
    return running(df, order, F.lit(1), out, one_task)


def quantiles(df: DataFrame, value: str, shares: list[float], one_task: int = ONE_TASK) -> list[float | None]:
    """Exact quantiles with linear interpolation between ranks; nulls don't count, and none without values.

    Different values are counted first.  Up to `one_task` of them go to one aggregate; of
    more, only the few that hold a wanted rank leave the ranges.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    if counts.limit(one_task + 1).count() <= one_task:
        found = counts.agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in shares]), F.col("n")).alias("q")).first()[0]
        return list(found) if found is not None else [None] * len(shares)
    placed = settled(running(counts, [F.col("v")], F.col("n"), "upto", one_task))
    total = placed.agg(F.max("upto")).first()[0]
    at = [p * (total - 1) for p in shares]
    wanted = sorted({int(x) for x in at} | {min(int(x) + 1, total - 1) for x in at})
    holds = F.array(*[F.lit(k) for k in wanted])
    rows = placed.withColumn("rank", F.explode(F.filter(holds, lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n"))))).select("rank", "v").collect()
    held = {r.rank: float(r.v) for r in rows}  # two ranks for each share
    return [held[int(x)] + (x - int(x)) * (held[min(int(x) + 1, total - 1)] - held[int(x)]) for x in at]
