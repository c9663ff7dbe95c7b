"""Near-duplicate groups by an LSH forest over MinHash signatures.

A text's set is its distinct shingles of `width` words.  Texts of equal sets are one class,
of which the least doc_id stands for all.  The signature of a class is cut into `TREES`
orders of `DEPTH` values.  Each order is sorted, as a trie of prefixes, and a region is a
trie's node of adaptive depth: from `SHALLOW` values on, a prefix that more than `FULL`
classes share is gone into a value deeper, as far as `LEAST`; sparse places of an order keep
short prefixes and dense ones get long.  Candidates are a region's neighbours by longest
common prefix: all pairs in a region of at most `FULL` classes; in a larger one the pairs with
its first class, and, where the estimate leaves that open, with the neighbours in the order,
going a value deeper into each part of the region.  Candidates whose signatures' estimate
is clearly too low are left out; the rest are confirmed on full sets.

Confirmed links give components.  In a large region the pairs left out may link different
components, so these, and only these, are then compared, block by block, on full sets: no
partner is capped, and what comes out is only the links that join components.  Classes of a
region's largest component meet only the others, so sets travel once for each block of those.

Empty sets (null or empty text, or no words) are linked with nothing.  Texts of any length are
used whole.  Rows repeated with one doc_id must have one text; they are alike (of several texts
the least is the one compared).  Rows with a null doc_id count in no set and are their own
component, null.  An empty table gives an empty result; columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import FEW_KEYS, Workspace, lookup, possible, require, small_batches, tidy
from tesserae.llm.components import components
from tesserae.llm.shingles import meets, permutations, set_digest, shingle_sets, signatures

TREES, DEPTH = 16, 6
#: Values of a region's prefix: the fewest, and where regions of any size are left as they are.
SHALLOW, LEAST = 2, 4
FULL = 8
#: Below this share of agreeing values a pair isn't confirmed: four standard errors under 0.8.
OPEN = 0.64
#: From this share on the pair with the region's first class needs no other beside it.
SURE = 0.9
#: Classes of a region that a task holds; of a larger region, block meets block.
BLOCK = 20_000
PORTION = 1 << 20


def _portions(ids, texts):
    held_ids, held, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        b = (t.as_py() or "").encode("utf-8", "surrogatepass")
        held_ids.append(i)
        held.append(b)
        size += len(b)
        if size >= PORTION:
            yield held_ids, held
            held_ids, held, size = [], [], 0
    if held:
        yield held_ids, held


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), signature."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    @tidy
    def run(batches):
        perms = permutations(TREES * DEPTH)
        for batch in batches:
            for ids, texts in _portions(batch.column(0).to_pylist(), batch.column(1)):
                sets = list(shingle_sets(texts, width))
                signs = signatures(sets, perms)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([x.tobytes() for x in signs], pa.binary())], schema=kinds)

    return require(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), TREES * DEPTH)


def prefix_keys(classes: DataFrame) -> DataFrame:
    """(key<SHALLOW> .. key<LEAST>, node): hashes of each class's prefixes in each order; the low bits name the order."""
    depths = range(SHALLOW, LEAST + 1)

    @tidy
    def run(batches):
        salt = np.random.default_rng(5).integers(1, 2**62, (TREES, LEAST + 1), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        for batch in batches:
            signs = _matrix(batch.column(1)).astype(np.uint64)
            ids = batch.column(0).to_numpy()
            for t in range(TREES):
                h = np.full(len(ids), salt[t, LEAST], np.uint64)
                keys = []
                for j in range(LEAST):
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + signs[:, t * DEPTH + j] * salt[t, j]
                    if j + 1 >= SHALLOW:
                        k = ((h ^ (h >> np.uint64(32))) & ~np.uint64(TREES - 1)) | np.uint64(t)
                        keys.append(pa.array(k.astype(np.int64)))
                yield pa.record_batch([*keys, pa.array(ids)], names=[*[f"key{d}" for d in depths], "node"])

    return classes.select("node", "signature").mapInArrow(run, ", ".join(f"key{d} long" for d in depths) + ", node long")


def regions(ws: Workspace, classes: DataFrame) -> DataFrame:
    """(key, n, node): every region of two classes or more, with its number of classes.

    A prefix's classes are counted by combined sums, and rows learn the count by lookup: those
    of a common prefix never meet in a task.  Rows alone with their shortest prefix go first.
    """
    rows = prefix_keys(classes)
    for depth in range(SHALLOW, LEAST + 1):
        rows = ws.save(rows, f"keys{depth}")
        key, n = f"key{depth}", f"n{depth}"
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
        rows = lookup(rows, counts, key, n, rows.count())
        if depth == SHALLOW:
            rows = rows.where(F.col(n) > 1)
    deep = range(SHALLOW, LEAST)
    small = lambda d: F.coalesce(F.col(f"n{d}"), F.lit(1)) <= FULL
    pick = lambda c: F.coalesce(*[F.when(small(d), F.struct(F.col(f"key{d}").alias("key"), F.col(f"n{d}").alias("n"))) for d in deep], F.struct(F.col(f"key{c}").alias("key"), F.col(f"n{c}").alias("n")))
    found = ws.save(rows.select(pick(LEAST).alias("at"), "node").select("at.key", "at.n", "node").where("n > 1"), "regions")
    for depth in range(SHALLOW, LEAST + 1):
        ws.drop(f"keys{depth}")
    return found


def _runs(batches):
    """Columns of rows that share the first column, in batches sorted by it."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        keys = table.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last:
            yield table.slice(0, last).combine_chunks()
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _small(signs: np.ndarray) -> np.ndarray:
    """A byte of each value, enough to compare."""
    return ((signs * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def region_pairs(ids: np.ndarray, order: np.ndarray, small: np.ndarray, depth: int = LEAST) -> list[tuple[int, int]]:
    """Candidate pairs of one region, sorted by its order; `order` has the order's values."""
    m = len(ids)
    if m < 2:
        return []
    if m <= FULL:
        i, j = np.triu_indices(m, 1)
        ok = (small[i] == small[j]).mean(axis=1) >= OPEN
        return list(zip(ids[i[ok]].tolist(), ids[j[ok]].tolist(), strict=True))
    hub = int(np.argmin(ids))
    near = (small == small[hub]).mean(axis=1)
    near[hub] = 1
    out = [(int(ids[hub]), int(x)) for x in ids[(near >= OPEN) & (np.arange(m) != hub)]]
    unsure = np.flatnonzero(near < SURE)
    if len(unsure):
        before = unsure[unsure > 0]
        after = unsure[unsure < m - 1]
        a, b = np.concatenate([before, after]), np.concatenate([before - 1, after + 1])
        ok = (small[a] == small[b]).mean(axis=1) >= OPEN
        out += list(zip(ids[a[ok]].tolist(), ids[b[ok]].tolist(), strict=True))
        if depth < DEPTH:
            part = order[unsure, depth]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at = unsure[lo:hi]
                out += region_pairs(ids[at], order[at], small[at], depth + 1)
    return out


def cross_links(ids: np.ndarray, parts: np.ndarray, signs: np.ndarray, sets: list[np.ndarray], tree: int, percent: int) -> list[tuple[int, int]]:
    """Links of a large region between components that nothing joined so far.

    A pair is left to the first order in which its classes share a region.  Pairs are
    compared on full sets, and those that links found here have joined are passed over.
    """
    small = _small(signs)
    names, parts = np.unique(parts, return_inverse=True)
    counts = np.bincount(parts)
    out = []
    firsts = signs.reshape(len(ids), TREES, DEPTH)[:, :tree, :LEAST]
    for r in np.flatnonzero(parts != np.argmax(counts)):
        other = np.flatnonzero(parts != parts[r])
        other = other[(small[other] == small[r]).mean(axis=1) >= OPEN]
        other = other[~(firsts[other] == firsts[r]).all(axis=2).any(axis=1)]
        for x in other:
            if parts[x] != parts[r] and meets(sets[r], sets[x], percent):
                out.append((int(ids[r]), int(ids[x])))
                parts[parts == parts[x]] = parts[r]
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """`rows` (key, n, node) with `at`: large regions are cut into blocks of about BLOCK classes."""
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    return rows.select("key", "node", F.xxhash64("key", own).alias("at"))


def _block_pairs(ws: Workspace, rows: DataFrame, total: int) -> DataFrame:
    """(at, key, node) of mixed regions' `rows` (key, n, node, part): the pairs of blocks to compare.

    Of a region, classes outside its largest component are cut into blocks, and so are those
    inside; every two blocks meet in one `at` but for two of the inside.
    """
    sizes = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n_part"))
    mixed = sizes.groupBy("key").agg(F.max_by("part", F.struct("n_part", "part")).alias("most"), F.max("n_part").alias("inside"), F.sum("n_part").alias("n_all"))
    mixed = ws.save(mixed.where(F.col("inside") < F.col("n_all")), "mixed")
    if mixed.count() <= FEW_KEYS:
        met = rows.drop("n").join(F.broadcast(mixed), "key")
    else:
        met = lookup(rows.drop("n"), mixed, "key", "n_all", total).where("n_all is not null")
    minor = F.col("part") != F.col("most")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    n_in, n_out = blocks(F.col("inside")), blocks(F.col("n_all") - F.col("inside"))
    # blocks are numbered 0 .. n_out - 1 outside the largest component, then n_out .. inside
    own = F.when(minor, F.pmod(F.xxhash64("node"), n_out)).otherwise(n_out + F.pmod(F.xxhash64("node"), n_in)).cast("int")
    last = F.when(minor, n_out + n_in).otherwise(n_out).cast("int") - 1
    spread = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return spread.select("key", "node", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("at"))


def _region_rows(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("at", "key", "node")]
    return rows.select("at", "key", "node", *columns).repartition(F.col("at")).sortWithinPartitions("at", "node")


def _cuts(values: np.ndarray):
    edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _as_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    p = np.sort(np.array(pairs, np.int64), axis=1)
    return pa.record_batch([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])


def candidates(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the regions' `rows` (key, node)."""

    @tidy
    def run(batches):
        for table in _runs(batches):
            at, key, ids = (table.column(i).to_numpy() for i in range(3))
            signs = _matrix(table.column(3))
            small = _small(signs)
            pairs: list[tuple[int, int]] = []
            for lo, hi in _cuts(at):
                t = int(key[lo]) & (TREES - 1)
                order = signs[lo:hi, t * DEPTH : (t + 1) * DEPTH]
                place = np.lexsort(order.T[::-1])
                pairs += region_pairs(ids[lo:hi][place], order[place], small[lo:hi][place])
            if pairs:
                yield _as_batch(pairs)

    met = _blocks(rows).join(classes.select("node", "signature"), "node")
    return _region_rows(met).mapInArrow(run, "a long, b long").distinct()


def links_across(ws: Workspace, rows: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components (`parts`: node, signature, part) that meet in a large region."""

    @tidy
    def run(batches):
        for table in _runs(batches):
            at, key, ids, part = (table.column(i).to_numpy() for i in (0, 1, 2, 4))
            signs = _matrix(table.column(3))
            links: list[tuple[int, int]] = []
            for lo, hi in _cuts(at):
                sets = [np.frombuffer(x, np.uint64) for x in table.column(5).slice(lo, hi - lo).to_pylist()]
                links += cross_links(ids[lo:hi], part[lo:hi], signs[lo:hi], sets, int(key[lo]) & (TREES - 1), percent)
            if links:
                yield _as_batch(links)

    known = rows.where(F.col("n") > FULL).join(parts.select("node", "part"), "node")
    met = _block_pairs(ws, known, rows.count()).join(parts.select("node", "signature", "part"), "node").join(sets, "node")
    return _region_rows(met).mapInArrow(run, "a long, b long").distinct()


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, members): the full sets of the named documents, from their whole texts."""
    rows = possible(require(docs, "doc_id", "text"), "doc_id", nodes, "node")
    rows = rows.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    @tidy
    def run(batches):
        for batch in batches:
            for ids, texts in _portions(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())], names=["node", "members"])

    return rows.select("doc_id", "text").mapInArrow(run, "node long, members binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets meet the threshold."""
    size = F.octet_length("members")
    sizes = sets.select("node", size.alias("size"))
    # by sizes alone first, as sets are large
    fit = pairs.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("node").alias("b"), F.col("size").alias("sb")), "b")
    fit = fit.where(F.least("sa", "sb") * 100 >= F.greatest("sa", "sb") * percent).select("a", "b")
    met = fit.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")

    @tidy
    def run(batches):
        for batch in batches:
            a, b, ma, mb = batch.columns
            ok = [meets(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(ma, mb, strict=True)]
            held = pa.record_batch([a, b], names=["a", "b"])
            yield held.filter(pa.array(ok, pa.bool_()))

    return met.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    ws = Workspace(docs.sparkSession, "forest")
    known = ws.save(features(docs, width), "features")
    full = known.where("n_shingles > 0 and doc_id is not null")
    classes = ws.save(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"), F.first("signature").alias("signature")), "classes")
    rows = regions(ws, classes)
    pairs = ws.save(candidates(rows, classes), "pairs")
    nodes = ws.save(rows.select("node").distinct(), "nodes")
    sets = ws.save(sets_of(docs, nodes, width), "sets")
    links = ws.save(confirm(pairs, sets, percent), "links")
    labels = components(ws, links)
    # the rest: pairs left out between components that meet in a large region
    parts = classes.join(labels, "node", "left").select("node", "signature", F.coalesce("component", "node").alias("part"))
    more = ws.save(links_across(ws, rows, parts, sets, percent), "rest")
    if not more.isEmpty():
        labels = components(ws, links.union(more), "joined")
    ws.drop("sets")
    groups = classes.join(labels, "node", "left").where("n > 1 or component is not null")
    groups = groups.select("digest", F.coalesce("component", "node").alias("component"), "n")
    met = lookup(known.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")), groups, "digest", "n", known.count())
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    return met.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80)
