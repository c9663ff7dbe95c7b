"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Memtables: each task of the ingest sorts its rows by digest (Spark's sorter is the
memtable, spilling when full) and flushes files of at most `memtable_rows` rows, each a
sorted run of level 0 with Parquet Bloom filters and min/max statistics on the digest.
Compaction merges runs into one level sorted by digest; each digest keeps its smallest
and largest identifier and its count, combined within runs before the shuffle.
Hits (digests seen more than once) are verified byte by byte: a bit filter sized by their
number picks possible hits from the documents, so that only their texts are shuffled, and
these are grouped on (digest, whole text), again combined before the shuffle.  Point lookups
(find) push the digests down to the runs, whose Bloom filters and statistics skip the rest.

Null text counts as empty, and empty texts are equal to each other.  Rows repeated with
one doc_id share one decision.  A null doc_id never wins over another; a group with no
doc_id has keep_id null and stays.  An empty table gives an empty result.  Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import Workspace, lookup, possible, require

MEMTABLE_ROWS = 4_000_000


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


class LsmIndex:
    """Levels of sorted runs of (digest, doc_id) below one folder."""

    def __init__(self, spark: SparkSession, digest=sha256_digest, memtable_rows: int = MEMTABLE_ROWS):
        self.ws = Workspace(spark, "lsm")
        self.digest, self.memtable_rows = digest, memtable_rows
        self.runs: list[str] = []

    def _filters(self) -> dict:
        return {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(1 << 20)}

    def _keyed(self, docs: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("text"), F.lit(""))
        return require(docs, "doc_id", "text").select(self.digest(text).alias("digest"), "doc_id", text.alias("text"))

    def ingest(self, docs: DataFrame) -> None:
        """Flush a batch of documents as sorted runs of level 0."""
        name = f"level0_{len(self.runs)}"
        run = self._keyed(docs).select("digest", "doc_id").sortWithinPartitions("digest", "doc_id")
        self.ws.save(run, name, maxRecordsPerFile=self.memtable_rows, **self._filters())
        self.runs.append(name)

    def members(self) -> DataFrame:
        out = None
        for name in self.runs:
            run = self.ws.read(name)
            out = run if out is None else out.unionByName(run)
        return out

    def find(self, digests: list[str]) -> DataFrame:
        """Members of a few digests: pushed down as values, so runs' Bloom filters and statistics are probed."""
        return self.members().where(F.col("digest").isin(digests))

    def compact(self) -> DataFrame:
        """Merge all runs into level 1: one row per digest, sorted, with filters."""
        merged = self.members().groupBy("digest").agg(F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"), F.count(F.lit(1)).alias("n"))
        return self.ws.save(merged.sortWithinPartitions("digest"), "level1", **self._filters())

    def verify(self, docs: DataFrame, level1: DataFrame) -> DataFrame:
        """Hits whose bytes are equal: (digest, text, min_id, max_id, n), texts compared whole."""
        hits = level1.where("n > 1")
        texts = possible(self._keyed(docs), "digest", hits, "digest")
        return texts.groupBy("digest", "text").agg(F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"), F.count(F.lit(1)).alias("n"))


def exact_dedup(docs: DataFrame, keep: str = "max", digest=sha256_digest, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, digest, keep_id, group_size, kept.

    keep: "min" or "max", the identifier that stays of equal texts.
    """
    spark = docs.sparkSession
    index = LsmIndex(spark, digest, memtable_rows)
    index.ingest(docs)
    level1 = index.compact()
    groups = index.verify(docs, level1)
    kept = F.col(f"{keep}_id")
    summary = index.ws.save(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("variants"), F.max(kept).alias("keep_id"), F.max("n").alias("group_size")), "verified")
    # keep_id stays null for a group of null identifiers; `found` tells it from no group
    one = summary.where("variants = 1 and group_size > 1").select("digest", "keep_id", "group_size")
    members = index.members()
    total = members.count()
    collided = summary.where("variants > 1").select("digest")
    apart = None
    if not collided.isEmpty():  # equal digests, different bytes: decide on (digest, text)
        clash = index._keyed(docs).join(collided, "digest", "left_semi")
        own = clash.groupBy("digest", "text").agg(getattr(F, keep)("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = clash.join(own, ["digest", "text"]).select("digest", "doc_id", "keep_id", "group_size")
        members = members.join(collided, "digest", "left_anti")
    found = lookup(members, one, "digest", "group_size", total)
    single = F.col("group_size").isNull()
    out = found.select("digest", "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    if apart is not None:
        out = out.unionByName(apart)
    return out.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, keep="max").withColumnRenamed("digest", "text_sha256")


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
