"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components become integers floor(scale * x).  The index, a written table, cuts the candidates
into blocks; a block's postings (component number, row, value) lie in segments of equal
quantised impact, the bit length of |value|, from the largest down.  A search adds segments to
the scores of a block's rows in that order.  By Cauchy and Schwarz a row's missing part is at
most |query| * |row's components not yet added|; each time that the missing parts have halved,
rows that this bound rules out for all open queries are left out of what follows, and a query
stops once it proves that all but a few rows are below its k-th best lower bound.  Those that
may be members are rescored exactly, and the best k of every block are merged.  Nothing is
approximate.

Queries are cut into blocks of bounded size too, and every block of queries meets every block
of the index: a stated query set against all rows.  Queries of up to BROADCAST_BYTES are
broadcast to the tasks that hold index blocks; more are copied to a shuffle key of each index
block, so that the index is shuffled once and no key has more than a block or two of it.

A vector that is null, empty, or holds a null or non-finite component takes no part, nor
does a row with a null identifier.  Shorter vectors count as padded with zeros.  Rows with
the query's own identifier are not its candidates.  Of query rows with equal identifiers
the least vector (as an array) is the query; repeated candidates are each ranked.  Ties go to
the smaller identifier.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Workspace, require, small_batches, tidy

BLOCK_ROWS = 8192
#: Blocks in a file of the index.
FILE_BLOCKS = 4
BROADCAST_BYTES = 64 << 20
QUERY_ROWS = 1024
SCALE = 1024


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the rows that take part, as arrays of long."""
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    rows = require(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & fine)
    return rows.select("vec_id", F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def matrix(lists, dims: int | None = None) -> np.ndarray:
    dims = dims or max(map(len, lists), default=0)
    out = np.zeros((len(lists), dims), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


INDEX = "n_rows int, n_dims int, ids binary, segments binary, seg_dim binary, seg_row binary, seg_value binary"


def narrow(values: np.ndarray) -> bytes:
    """A byte that says the width, then the integers in it."""
    most = int(np.abs(values).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1)


def build_block(ids: np.ndarray, values: np.ndarray) -> dict:
    """Postings in segments by descending impact; `segments` has (impact, end) pairs."""
    row, dim = np.nonzero(values)
    value = values[row, dim]
    impact = np.ceil(np.log2(np.abs(value.astype(np.float64)) + 1)).astype(np.int64)
    order = np.lexsort((row, dim, -impact))
    impact = impact[order]
    ends = np.append(np.flatnonzero(impact[1:] != impact[:-1]) + 1, len(impact)) if len(impact) else np.zeros(0, np.int64)
    segments = np.stack([impact[ends - 1], ends], axis=1) if len(impact) else np.zeros((0, 2), np.int64)
    return {"n_rows": len(ids), "n_dims": values.shape[1], "ids": ids.astype("<i8").tobytes(), "segments": segments.astype("<i8").tobytes(), "seg_dim": narrow(dim[order]), "seg_row": narrow(row[order]), "seg_value": narrow(value[order])}


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of at most `block_rows` rows of (vec_id, v); a task holds one block."""

    @tidy
    def run(batches):
        ids, lists = [], []

        def block():
            held = build_block(np.array(ids, np.int64), matrix(lists))
            return pa.RecordBatch.from_pylist([held], schema=kinds)

        kinds = pa.schema([("n_rows", pa.int32()), ("n_dims", pa.int32()), *[(n, pa.binary()) for n in ("ids", "segments", "seg_dim", "seg_row", "seg_value")]])
        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(vec_id)
                lists.append(v)
                if len(ids) >= block_rows:
                    yield block()
                    ids, lists = [], []
        if ids:
            yield block()

    return rows.mapInArrow(run, INDEX)


def halvings(segments: np.ndarray, value: np.ndarray) -> list[int]:
    """Ends of segments after which the squares not yet added are at most half of those at the end before."""
    done = np.concatenate([[0.0], np.cumsum(value.astype(np.float64) ** 2)])
    ends, last = [], done[-1]
    for end in segments[:, 1].tolist():
        left = done[-1] - done[end]
        if left <= last / 2 or end == len(value):
            ends.append(end)
            last = left
    return ends


def search_block(block: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the block's best k for each query."""
    n, dims = block["n_rows"], max(block["n_dims"], queries.shape[1])
    ids = np.frombuffer(block["ids"], "<i8")
    segments = np.frombuffer(block["segments"], "<i8").reshape(-1, 2)
    dim, row, value = (widen(block[x]) for x in ("seg_dim", "seg_row", "seg_value"))
    queries = np.pad(queries, ((0, 0), (0, dims - queries.shape[1])))
    exact = np.zeros((n, dims), np.int64)
    exact[row, dim] = value
    most = float(np.abs(queries).sum(axis=1, dtype=np.float64).max(initial=0)) * float(np.abs(value.astype(np.int64)).max(initial=0))
    kind = np.float32 if most < 1 << 23 else np.float64  # sums are exact integers in it
    if most >= 1 << 52:
        raise OverflowError("components are too large for exact scores")
    wide = queries.astype(kind)
    norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    squares = value.astype(np.float64) ** 2
    left = np.bincount(row, squares, n)  # squared norm of what isn't added yet
    active, alive = np.arange(len(queries)), np.arange(n)  # queries without proof, rows that may be members of one
    scores = np.zeros((len(active), n), kind)  # of active queries and rows alive
    few = max(4 * k, n // 32)
    found: list[tuple[int, np.ndarray]] = []
    start = 0
    for end in halvings(segments, value):
        if len(alive) <= few or not len(active):
            break
        part = np.zeros((n, dims), kind)
        part[row[start:end], dim[start:end]] = value[start:end]
        left -= np.bincount(row[start:end], squares[start:end], n)
        start = end
        scores += wide[active] @ part[alive].T
        own = query_ids[active, None] == ids[None, alive]
        # a little over, for rounding of the square roots
        slack = norm[active, None] * np.sqrt(np.maximum(left[alive], 0))[None, :] * (1 + 1e-6) + 1e-3 * (end < len(value))
        low = np.where(own, -np.inf, scores - slack)
        kth = np.partition(low, len(alive) - k, axis=1)[:, len(alive) - k]
        may = (scores + slack >= kth[:, None]) & ~own
        proven = may.sum(axis=1) <= few
        for q, members in zip(active[proven], may[proven], strict=True):
            found.append((q, alive[members]))
        open_rows = may[~proven].any(axis=0)
        scores = scores[~proven][:, open_rows]
        active, alive = active[~proven], alive[open_rows]
    found += [(q, alive[ids[alive] != query_ids[q]]) for q in active]
    out_q, out_v, out_s = [], [], []
    for q, members in found:
        score = exact[members] @ queries[q]
        best = np.lexsort((ids[members], -score))[:k]
        out_q.append(np.full(len(best), query_ids[q]))
        out_v.append(ids[members][best])
        out_s.append(score[best])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(out_q), join(out_v), join(out_s)


def top_k(index: DataFrame, queries: DataFrame, k: int, query_rows: int = QUERY_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of a saved index."""
    once = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n, dims = once.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // query_rows))
    held = once.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    held = held.groupBy("query_block").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    if n * dims * 8 <= broadcast_bytes:
        met = index.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(F.broadcast(held), "query_block")
    else:
        salts = max(1, index.count())
        copies = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = index.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).join(copies, "salt")

    @tidy
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                asked = block["queries"]
                q, v, s = search_block(block, np.array([x["vec_id"] for x in asked], np.int64), matrix([x["v"] for x in asked]), k)
                yield pa.record_batch([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    columns = [x.split()[0] for x in INDEX.split(", ")]
    found = met.select(*columns, "queries").mapInArrow(run, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k best rows for each row of `vectors` (vec_id, embedding) that is a query."""
    rows = integers(vectors, scale)
    index = Workspace(vectors.sparkSession, "topk").save(build_index(rows, block_rows), "index", maxRecordsPerFile=FILE_BLOCKS)
    return top_k(index, rows.where(is_query), k, query_rows, broadcast_bytes)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP10_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
), r AS (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
