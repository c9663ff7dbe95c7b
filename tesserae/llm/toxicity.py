"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed character n-grams of a whole lower-cased text.  From the
labelled sample come each feature's log-count ratio r = log(p/|p|) - log(q/|q|), with p and q
the smoothed numbers of toxic and clean texts that have it, and its significance; logistic
regression is fitted to the presence of the most significant features times r.

The sample is bounded in rows alone: `sample_rows` labelled rows of each class at most, those
with the least hash of doc_id (equal hashes by doc_id); their texts are learnt from whole, of
any length.  The class prior comes from all labelled rows.  Null and empty texts have no
features; their score is that of the bias.  Rows with a null label or doc_id aren't learnt
from.  A doc_id labelled twice, or with two texts, is learnt from twice.  Without labels of
both classes every score is the share of toxic labels (0 without labels).  All documents are
scored, whole; repeated documents have equal scores, and an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.char_ngrams import Grouped, TextBatch, portions
from tesserae.llm.common import release, require, slices, small_batches, tidy

ORDERS = (4, 5, 6)
BITS = 20
KEPT = 1 << 12
SAMPLE_ROWS = 2500


def pairs(texts: list[str | None], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (text, feature) pairs, some texts at a time; `wanted`: a place for each bucket, -1 to leave it."""
    for at, part in portions(texts):
        batch = TextBatch(part)
        owner = batch.owner()
        keys = []
        for order in ORDERS:
            f = batch.grams(order, BITS)
            place = f if wanted is None else wanted[f]
            ok = (owner >= 0) if wanted is None else (place >= 0) & (owner >= 0)
            keys.append(owner[ok].astype(np.int64) << 32 | place[ok])
        keys = np.unique(np.concatenate(keys))
        yield (keys >> 32) + at, keys & 0xFFFFFFFF


def present(texts: list[str | None], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int32)
    held = [(none, none), *((a.astype(np.int32), b.astype(np.int32)) for a, b in pairs(texts, wanted))]
    return np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])


class NbLinear:
    """Fitted model: `place` of each bucket among the kept features, their weights, the bias."""

    def __init__(self, place: np.ndarray, weights: np.ndarray, bias: float):
        self.place, self.weights, self.bias = place, weights, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        docs, feats = present(texts, self.place)
        margin = np.bincount(docs, self.weights[feats], len(texts)) + self.bias if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(texts: list[str | None], labels: np.ndarray, prior: float, rounds: int = 200, penalty: float = 1e-3) -> NbLinear:
    """prior: share of label 1 where the model is applied."""
    labels = np.asarray(labels, np.float64)
    if not 0 < prior < 1 or not 0 < labels.sum() < len(labels):
        bias = float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
        return NbLinear(np.full(1 << BITS, -1, np.int32), np.zeros(0), bias)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for docs, feats in pairs(texts):
        p += np.bincount(feats, labels[docs], 1 << BITS)
        q += np.bincount(feats, 1 - labels[docs], 1 << BITS)
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    share = (p + q) / (n1 + n0)
    z = np.abs(p / n1 - q / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    z[p + q < 3] = 0
    kept = np.argsort(-z, kind="stable")[:KEPT]
    kept = np.sort(kept[z[kept] > 4])
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    rows, cols = present(texts, place)
    r = ratio[kept]
    held = Grouped(rows, cols)
    weights, bias = np.zeros(len(kept)), 0.0
    slow, fast = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, rounds + 1):  # Adam over the whole sample; a feature that is there has its ratio as value
        margin = held.by_row((weights * r)[held.cols], len(labels)) + bias
        miss = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels
        grad = np.append(held.by_col(miss[held.rows_by_col], len(kept)) * r / len(labels) + penalty * weights, miss.mean())
        slow = 0.9 * slow + 0.1 * grad
        fast = 0.999 * fast + 0.001 * grad**2
        step = 0.05 * (slow / (1 - 0.9**t)) / (np.sqrt(fast / (1 - 0.999**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    bias += np.log(prior / (1 - prior)) - np.log(n1 / n0)
    return NbLinear(place, weights * r, float(bias))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> NbLinear:
    """Fit to the labelled rows of (doc_id, toxic) and the texts of (doc_id, text).

    The sample, of bounded size, is fitted in one task.
    """
    known = require(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    # at most 2 * sample_rows identifiers: a bounded broadcast
    chosen = None
    for toxic in (0, 1):
        part = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = require(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def run(table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or ""))
        model = pickle.dumps(fit([r[2] for r in rows], np.array([r[1] for r in rows]), prior))
        del rows
        release()
        return pa.table({"model": pa.array([model], pa.binary())})

    found = sample.groupBy().applyInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else fit([], np.zeros(0), prior)


def score(docs: DataFrame, model: NbLinear) -> DataFrame:
    """`docs` rows as doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of 2**BITS places

    @tidy
    def run(batches):
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array(shared.value.scores(texts), pa.float64())], names=["doc_id", "score"])

    return require(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **sample) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learnt only from rows that aren't held out."""
    learnt = labels.where(~held_out(F.col("doc_id")))
    out = score(docs, train(docs, learnt, **sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **sample) -> DataFrame:
    """`docs` with all its columns, less the rows whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(~held_out(F.col("doc_id"))), **sample))
    require(docs, "doc_id", "text")
    at = docs.columns.index("text")

    @tidy
    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.scores(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels)
