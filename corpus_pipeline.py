"""From raw documents to a mixed, encoded corpus, in stages that are each written as Parquet.

Nulls: a null text is never toxic by its words, equals other empty texts, is near nothing, has
size 0 and so is not drawn into the mix.  Rows with a null doc_id can't be addressed and stay
in the deduplicating stages.  Rows repeated with one doc_id share their decisions.  Further
columns are carried along.  An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import byte_bpe, exact_dedup, minhash_forest, mixing, toxicity
from tesserae.llm.common import Workspace, scratch, small_batches, without


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return without(docs, exact_dedup.exact_dedup(docs, keep="max").where("not kept and doc_id is not null").select("doc_id"), "doc_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return without(docs, minhash_forest.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id"), "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn, once for each copy, shard by shard in the shards' shuffled order."""
    return mixing.mix_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and digests of the ids and of what they decode to."""
    import public_tokenizers

    small_batches(spark)
    # a cache that leaves room for heaps that earlier stages' shuffles have grown
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, cache=80_000)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: A trained classifier, MinHash and seeded draws have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read by the next, and its scratch tables go."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch():
            docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return docs
