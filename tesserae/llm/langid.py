"""Language identification by hierarchical discrimination.

First a linear support vector machine for each family (one against the rest) picks the
family; then, within it, one-versus-one linear support vector machines separate the
closely related languages by votes, ties going to the larger sum of margins and then to
the smaller name.  Features are relative frequencies of hashed character n-grams of the
whole lower-cased text.

The learning sample is bounded in rows alone: `sample_rows` rows of each language, those with
the least hash of doc_id (equal hashes by doc_id) among texts that have a letter; the texts
are learnt from whole, of any length.  Rows with a null lang, doc_id or text aren't learnt
from.  A text that is null or has no letter is `und` with score 0; so is every text if no
language could be learnt.  A lang value outside FAMILIES is a family of its own.  Repeated
rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.char_ngrams import Grouped, TextBatch, portions
from tesserae.llm.common import release, require, slices, small_batches, tidy

ORDERS = (2, 3, 4)
BITS = 17
SAMPLE_ROWS = 800
#: A language with more than 1/HEAVY of all rows is thinned out by hash before its rows meet.
HEAVY = 1024
UNKNOWN = "und"

#: ISO 639-1 codes of closely related languages.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0] in members), lang)


def svm(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, sign: np.ndarray, rounds: int = 100, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighted equally; sign: 1 or -1 a row."""
    share = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1))
    used, place = np.unique(cols, return_inverse=True)
    held = Grouped(rows, place)
    by_col = values[held.order]
    weights, bias = np.zeros(len(used)), 0.0
    slow, fast = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        gap = np.maximum(0, 1 - sign * (held.by_row(weights[held.cols] * values, len(sign)) + bias))
        pull = -2 * share * sign * gap
        grad = np.append(held.by_col(pull[held.rows_by_col] * by_col, len(used)) + penalty * weights, pull.sum())
        slow = 0.9 * slow + 0.1 * grad
        fast = 0.999 * fast + 0.001 * grad**2
        step = 0.1 * (slow / (1 - 0.9**t)) / (np.sqrt(fast / (1 - 0.999**t)) + 1e-10)
        weights, bias = weights - step[:-1], bias - step[-1]
    out = np.zeros(1 << BITS, np.float32)
    out[used] = weights
    return out, float(bias)


def frequencies(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, percent of the text's characters) of every n-gram bucket."""
    rows, cols, values = [], [], []
    for at, part in portions(texts):
        batch = TextBatch(part)
        owner = batch.owner()
        ok = owner >= 0
        keys = np.concatenate([owner[ok].astype(np.int64) << 32 | batch.grams(n, BITS)[ok] for n in ORDERS])
        keys, counts = np.unique(keys, return_counts=True)
        own = keys >> 32
        rows.append(own + at)
        cols.append(keys & 0xFFFFFFFF)
        values.append(100 * counts / batch.sizes[own])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


class Hierarchy:
    """families: names in order; members: languages by family; pairs: (family, a, b) in the table's columns after the families'."""

    def __init__(self, families, members, pairs, table, biases):
        self.families, self.members, self.pairs, self.table, self.biases = families, members, pairs, table, biases

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], []
        for _, part in portions(texts):
            got, sure = self._predict(part)
            langs += got
            scores.append(sure)
        return langs, np.concatenate(scores) if scores else np.zeros(0)

    def _predict(self, texts):
        n = len(texts)
        known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        batch = TextBatch(texts)
        total = None
        for order in ORDERS:
            part = self.table[batch.grams(order, BITS)]
            total = part if total is None else total + part
        margins = 100 * batch.sums(total.astype(np.float64)) / np.maximum(batch.sizes, 1)[:, None] + self.biases
        nf = len(self.families)
        top = margins[:, :nf].argmax(axis=1)
        sure = 1 / (1 + np.exp(-np.clip(2 * margins[np.arange(n), top], -500, 500)))
        out = np.empty(n, object)
        for f, family in enumerate(self.families):
            at = np.flatnonzero(top == f)
            langs = self.members[family]
            votes, sums, least = np.zeros((len(at), len(langs))), np.zeros((len(at), len(langs))), np.full((len(at), len(langs)), np.inf)
            for k, (own, a, b) in enumerate(self.pairs):
                if own == family:
                    m = margins[at, nf + k]
                    for lang, signed in ((a, m), (b, -m)):
                        i = langs.index(lang)
                        votes[:, i] += signed > 0
                        sums[:, i] += signed
                        least[:, i] = np.minimum(least[:, i], signed)
            if len(langs) > 1:
                sums /= 1 + np.abs(sums).max(axis=1, initial=0)[:, None]
                best = (votes + sums / 2).argmax(axis=1)
                sure[at] *= 1 / (1 + np.exp(-np.clip(2 * least[np.arange(len(at)), best], -500, 500)))
            else:
                best = np.zeros(len(at), np.int64)
            out[at] = [langs[i] for i in best]
        out[~known] = UNKNOWN
        sure[~known] = 0
        return out.tolist(), sure


def fit(texts: list[str], langs: list[str]) -> Hierarchy:
    names = sorted(set(langs))
    members: dict[str, list[str]] = {}
    for lang in names:
        members.setdefault(family_of(lang), []).append(lang)
    families = sorted(members)
    pairs = [(f, a, b) for f in families for a, b in combinations(members[f], 2)]
    rows, cols, values = frequencies(texts)
    kind = np.array(langs, object)
    own = np.array([family_of(x) for x in langs], object)
    columns, biases = [], []
    for f in families:
        w, b = svm(rows, cols, values, np.where(own == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(1 << BITS, np.float32), 1.0)
        columns.append(w)
        biases.append(b)
    for _, a, b in pairs:
        at = np.flatnonzero((kind == a) | (kind == b))
        number = np.full(len(langs), -1)
        number[at] = np.arange(len(at))
        ok = number[rows] >= 0
        w, bias = svm(number[rows[ok]], cols[ok], values[ok], np.where(kind[at] == a, 1.0, -1.0))
        columns.append(w)
        biases.append(bias)
    table = np.ascontiguousarray(np.stack(columns, axis=1)) if columns else np.zeros((1 << BITS, 0), np.float32)
    return Hierarchy(families, members, pairs, table, np.array(biases))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def sample_ids(rows: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, lang): the `sample_rows` rows of least hash of each language.

    Of a heavy language, only rows whose hash is below a bound that all but surely leaves
    `sample_rows` of them meet in its task; there are fewer than HEAVY such languages.
    """
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    counts = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # eight standard deviations above what is wanted, as a share of the hashes' 2**64 values
    wanted = sample_rows + 8 * sample_rows**0.5 + 64
    heavy = counts.join(F.broadcast(total)).where((F.col("n") * HEAVY > F.col("total")) & (F.col("n") > 2 * wanted))
    bound = heavy.select("lang", ((wanted / F.col("n") - 0.5) * float(1 << 64)).cast("long").alias("bound"))
    few = hashed.join(F.broadcast(bound), "lang", "left").where(F.col("bound").isNull() | (F.col("h") < F.col("bound")))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    return few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_rows).select("doc_id", "lang").distinct()


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Hierarchy:
    """Fit to the texts and non-null lang of `docs`; the sample, of bounded size, is fitted in one task."""
    rows = require(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # ids first, so that texts of no more than the sample are shuffled
    sample = rows.join(F.broadcast(sample_ids(rows, sample_rows)), ["doc_id", "lang"])

    def run(table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("lang", "doc_id", "text")), strict=True))
        model = pickle.dumps(fit([r[2] for r in rows], [r[0] for r in rows]))
        del rows
        release()
        return pa.table({"model": pa.array([model], pa.binary())})

    found = sample.select("doc_id", "lang", "text").groupBy().applyInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else fit([], [])


def predict(docs: DataFrame, model: Hierarchy) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of a machine each

    @tidy
    def run(batches):
        for batch in slices(batches):
            langs, sure = shared.value.predict(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return require(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, **sample) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learnt only from rows that aren't held out."""
    learnt = docs.where(~held_out(F.col("doc_id")))
    return predict(docs, train(learnt, **sample)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
