"""Shared pieces: scratch tables, documents, native bit filters and skew-safe lookups."""

from __future__ import annotations

import contextlib
import functools
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir and runs in this process, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/tesserae"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    A session on a cluster must name it; one in a single process gets a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_CHECKPOINTS
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/") if "://" in base or base.startswith("file:") else "file://" + base.rstrip("/")


class Workspace:
    """A folder of scratch tables below the shared folder.

    Tables are written by Spark's commit protocol, so a lost executor or a repeated
    task leaves no partial data.  Lazy results read them: drop() them once the result has
    been written, one folder here or with scratch() all that a block has opened.  What is
    left goes when the driver ends.
    """

    opened: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tesserae/{name}-{uuid.uuid4().hex}"
        path, fs = self._fs(self.path)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        Workspace.opened.append(self)

    def table(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write a table once and return a frame that reads it back."""
        df.write.options(**options).mode("errorifexists").parquet(self.table(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.table(name))

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, name: str | None = None) -> None:
        path, fs = self._fs(self.table(name) if name else self.path)
        fs.delete(path, True)
        if name is None and self in Workspace.opened:
            Workspace.opened.remove(self)


@contextlib.contextmanager
def scratch():
    """Drops, at its end, every workspace that was opened inside; results must be written by then."""
    before = list(Workspace.opened)
    try:
        yield
    finally:
        for ws in [w for w in Workspace.opened if w not in before]:
            ws.drop()


#: Rows that a window without partitions may put in order in one task.
ONE_TASK = 1_000_000


def numbered(ws: Workspace, df: DataFrame, order: list[Column], name: str = "number", one_task: int = ONE_TASK) -> DataFrame:
    """`df` with its place from 1 in a total order, as the column `name`.

    Up to `one_task` rows are numbered in one task; more are written by ranges of the order,
    numbered within each range and moved on by the sizes of the ranges before.
    """
    if df.count() <= one_task:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    ranged = ws.save(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), f"ranged_{name}")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = ranged.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")  # a row a partition


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch of whole texts; the default of 10000 may be a gigabyte of long ones.
BATCH_ROWS = 1000
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows where they are at the default: for queries that pass whole texts to Python."""
    if spark.conf.get(_RECORDS) == "10000":
        spark.conf.set(_RECORDS, str(BATCH_ROWS))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns can't clash."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size, from the sizes of its files: no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(files: DataFrame, n: int) -> DataFrame:
    """A table of files with one file a partition, of the `n` that there are.

    Files are numbered by a window over this table, a row a file; the number of partitions
    is explicit, so small partitions aren't put together.
    """
    at = (F.row_number().over(Window.orderBy("uri")) - 1).cast("int")
    return files.withColumn("_at", at).repartitionById(max(1, n), F.col("_at")).drop("_at")


BITS_PER_BLOCK = 32768
#: Bits of a filter for each key, and the most that a filter may have to be broadcast (128 MiB).
BITS_PER_KEY, MOST_BITS = 16, 1 << 30
#: Identifiers that are broadcast as they are.
FEW_KEYS = 1 << 19


def filter_bits(keys: DataFrame, key: str, most: int = MOST_BITS) -> int | None:
    """Bits of a filter for the keys, by their approximate number; None if that is more than may be broadcast."""
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    bits = max(1 << 20, 1 << (BITS_PER_KEY * n).bit_length())
    return bits if bits <= most else None


def bit_address(key: Column, bits: int) -> tuple[Column, Column]:
    """Block number and bit within it that a key sets in a filter of `bits` bits."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.floor(at / BITS_PER_BLOCK).cast("long"), (at % BITS_PER_BLOCK).cast("long")


def build_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One-hash Bloom filter as at most bits/32768 rows of 4 KiB: a proven bound."""
    block, bit = bit_address(F.col(key), bits)
    return keys.select(block.alias("_block"), bit.alias("_bit")).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def _is_set(bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def possible(rows: DataFrame, row_key: str, keys: DataFrame, key: str, most: int = MOST_BITS) -> DataFrame:
    """Rows whose key may be among `keys`; none that is gets lost.

    A broadcast bit filter, sized by the number of keys, is probed where the rows are read.
    Where it would be too large to broadcast, rows and keys meet in a shuffle.
    """
    bits = filter_bits(keys, key, most)
    if bits is None:
        return rows.join(keys.select(F.col(key).alias("_held")).distinct(), F.col(row_key) == F.col("_held"), "left_semi")
    block, bit = bit_address(F.col(row_key), bits)
    held = rows.withColumn("_block", block).join(F.broadcast(build_filter(keys, key, bits)), "_block")
    return held.where(_is_set(bit)).drop("_block", "_bits")


#: A key with more than 1/HEAVY of all rows is heavy: there are fewer than HEAVY such keys.
HEAVY = 8192


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join to a table with unique keys whose `weight` is the key's rows in `left`.

    Keys with at least total/HEAVY rows, of which there are HEAVY at most, are broadcast;
    the rest are shuffled, where no key has many rows.  Columns of `right` other than the
    key are added; they must not be in `left`.
    """
    values = [c for c in right.columns if c != key]
    least = max(2, -(-total // HEAVY))
    hot = right.where(F.col(weight) >= least).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    cold = right.where(F.col(weight) < least).withColumnRenamed(key, "_cold")
    met = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # rows that found a heavy key, and those without a key, go anywhere: by a hash of the whole row
    kind = dict(left.dtypes)[key]
    anywhere = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    anywhere = F.encode(anywhere.cast("string"), "utf-8") if kind == "binary" else anywhere.cast(kind)
    met = met.withColumn("_at", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(anywhere))
    out = met.join(cold, F.col("_at") == F.col("_cold"), "left")
    own = F.col(key) == F.col("_cold")  # anywhere may be a key by chance
    return out.select(*left.columns, *[F.coalesce(F.col(f"_hot_{c}"), F.when(own, F.col(c))).alias(c) for c in values])


def without(rows: DataFrame, dropped: DataFrame, key: str, most: int = MOST_BITS, few: int = FEW_KEYS) -> DataFrame:
    """`rows` whose key isn't among `dropped` (one column, `key`); rows with a null key stay.

    The keys are written once.  Up to `few` of them are broadcast themselves.  Of more, a
    broadcast bit filter, sized by their number, tells most rows apart where they are read;
    only rows that it may hold are shuffled to meet the keys.  Where the filter would be too
    large to broadcast, all rows are.
    """
    ws = Workspace(rows.sparkSession, "dropped")
    keys = ws.save(dropped.select(F.col(key).alias("key")).where("key is not null").distinct(), "keys")
    # the row goes along as one value, so that no column of it can clash
    held = rows.select(F.col(f"`{key}`").alias("key"), F.struct("*").alias("row"))
    if keys.count() <= few:
        return held.join(F.broadcast(keys), "key", "left_anti").select("row.*")
    bits = filter_bits(keys, "key", most)
    if bits is None:
        return held.join(keys, "key", "left_anti").select("row.*")
    built = build_filter(keys, "key", bits)
    block, bit = bit_address(F.col("key"), bits)
    flagged = held.withColumn("_at", block).join(F.broadcast(built.withColumnRenamed("_block", "_at")), "_at", "left")
    flagged = flagged.select("key", "row", F.coalesce(_is_set(bit), F.lit(False)).alias("may"))
    clear = flagged.where(~F.col("may")).select("row.*")
    doubtful = flagged.where("may").join(keys, "key", "left_anti").select("row.*")
    return clear.unionByName(doubtful)


def task_folder() -> str | None:
    """A folder of Spark's own scratch space for files that live no longer than a task; None where Spark names none, as in tests."""
    named = os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("SPARK_EXECUTOR_DIRS") or ""
    return next((d for d in named.replace(":", ",").split(",") if os.path.isdir(d)), None)


def slices(batches, rows: int = 512):
    """The same rows in smaller batches, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(run):
    """A task function that gives its memory back at its end: workers outlive tasks."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


#: Tables that modules keep within a task and can compute again.
KEPT_TABLES: list[dict] = []


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    for held in KEPT_TABLES:
        held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
