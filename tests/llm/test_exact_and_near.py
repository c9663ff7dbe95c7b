import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm.components import components
from tesserae.llm import bwt, minhash_forest
from tesserae.llm import suffix_dedup as suffix
from tesserae.llm.common import Workspace, filter_bits, lookup, numbered, possible, scratch, without
from tesserae.llm.exact_dedup import LsmIndex, exact_dedup
from tesserae.llm.minhash_forest import near_duplicates
from tesserae.llm.suffix_dedup import suffix_dedup

from .conftest import edge_rows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("digits", [64, 1])
def test_exact_dedup(docs, keep, digits):
    # one digit of digest: different texts collide and only their bytes tell them apart
    digest = lambda t: F.substring(F.sha2(t, 256), 1, digits)
    groups = {}
    for doc_id, text, *_ in edge_rows():
        groups.setdefault(text or "", []).append(doc_id)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        kept = (max(known) if keep == "max" else min(known)) if known else None
        want += [(i, hashlib.sha256(text.encode()).hexdigest()[:digits], kept, len(ids), i == kept) for i in ids]
    assert rows(exact_dedup(docs, keep, digest)) == sorted(want, key=repr)


def test_exact_dedup_of_nothing(no_docs):
    assert rows(exact_dedup(no_docs)) == []


def test_runs_and_levels(spark, copies_df):
    index = LsmIndex(spark, memtable_rows=10)
    index.ingest(copies_df.where("doc_id % 2 = 0"))
    index.ingest(copies_df.where("doc_id % 2 = 1"))
    level = index.compact()
    assert index.members().count() == copies_df.count()
    assert level.agg(F.sum("n")).first()[0] == copies_df.count()
    assert level.count() == copies_df.select("text").distinct().count()
    text = copies_df.first().text
    found = index.find([hashlib.sha256(text.encode()).hexdigest()])
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in copies_df.where(F.col("text") == text).collect()}
    assert any("Bloom" in str(v) or "bloom" in str(k) for k, v in index._filters().items())


def test_without(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("_bits")).union(spark.sql("select cast(null as long), 'y'"))
    dropped = spark.range(0, 1000, 3).select(F.col("id").alias("k"))
    for most, few in ((1 << 30, 1000), (1 << 30, 0), (0, 0)):  # keys broadcast, a filter broadcast, neither
        left = without(df, dropped, "k", most, few)
        assert left.columns == df.columns and left.count() == 1001 - 334
        assert {r.k for r in possible(df.select("k"), "k", dropped, "k", most).collect()} >= set(range(0, 1000, 3))
    assert filter_bits(dropped, "k") == 1 << 20 and filter_bits(spark.range(100_000), "id") > 1 << 20


@pytest.mark.parametrize("kind", ["bigint", "string", "binary"])
def test_lookup_of_heavy_and_null_keys(spark, kind):
    """Every row once, with its key's value; rows of heavy keys and without one spread over the tasks."""
    keys = [5] * 3000 + list(range(10, 60)) * 2 + [None] * 500
    cast = (lambda c: F.encode(c.cast("string"), "utf-8")) if kind == "binary" else (lambda c: c.cast(kind))
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").withColumn("k", cast(F.col("k"))).repartition(3)
    right = spark.createDataFrame([(5, 3000, 7), *((k, 2, k * 3) for k in range(10, 50))], "k long, n long, v long").withColumn("k", cast(F.col("k")))
    met = lookup(left, right, "k", "n", 10_000_000)
    assert sorted((r.i, r.v) for r in met.collect()) == [(i, {5: 7, **{k: k * 3 for k in range(10, 50)}}.get(k)) for i, k in enumerate(keys)]
    heavy = lookup(left, right, "k", "n", len(keys))
    assert sorted((r.i, r.v) for r in heavy.collect()) == sorted((r.i, r.v) for r in met.collect())


@pytest.mark.parametrize("one_task", [10**6, 5])
def test_numbered(spark, one_task):
    df = spark.createDataFrame([(w, i) for i, w in enumerate(["b", "a", None, "é", "Z", "c"] * 3)], "w string, i int").repartition(3)
    got = numbered(Workspace(spark, "test"), df, [F.asc_nulls_last("w"), F.col("i")], one_task=one_task).collect()
    want = sorted(df.collect(), key=lambda r: (r.w is None, (r.w or "").encode(), r.i))
    assert sorted((r.number, r.w, r.i) for r in got) == [(k + 1, r.w, r.i) for k, r in enumerate(want)]


def test_scratch_goes(spark):
    outer = Workspace(spark, "test")
    with scratch():
        inner = Workspace(spark, "test")
        inner.save(spark.range(3), "t")
    path, fs = inner._fs(inner.path)
    assert not fs.exists(path) and outer in Workspace.opened
    outer.drop()
    assert outer not in Workspace.opened


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) >= width:
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(copies_df, copies, width):
    sets = {d: shingles(t, width) for d, t in copies.items()}
    part = brute_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(copies_df, width).collect()}
    assert got == {d: (len(s), part[d], part[d] == d) for d, s in sets.items()}


def test_near_duplicates_by_small_blocks(copies_df, copies, monkeypatch):
    """Large regions cut into blocks, whose pairs are compared on full sets."""
    monkeypatch.setattr(minhash_forest, "BLOCK", 5)
    part = brute_components({d: shingles(t, 4) for d, t in copies.items()})
    assert {r.doc_id: r.component_id for r in near_duplicates(copies_df, 4).collect()} == part


def test_block_pairs(spark):
    """Classes outside the largest component meet all others of their region, in some block."""
    rows = [(1, 30, i, 0 if i < 20 else i % 3 + 1) for i in range(30)] + [(2, 10, i, 7) for i in range(10)]
    df = spark.createDataFrame(rows, "key long, n long, node long, part long")
    held = {}
    old, minhash_forest.BLOCK = minhash_forest.BLOCK, 4
    try:
        for r in minhash_forest._block_pairs(Workspace(spark, "test"), df, 40).collect():
            assert r.key == 1
            held.setdefault(r.at, set()).add(r.node)
    finally:
        minhash_forest.BLOCK = old
    met = {(a, b) for nodes in held.values() for a in nodes for b in nodes}
    parts = {i: p for k, _, i, p in rows if k == 1}
    assert all((a, b) in met for a in parts for b in parts if parts[a] != parts[b])
    assert sum(len(x) for x in held.values()) < 30 * 8  # fewer copies than if every block met every other


def test_recall_of_links(spark):
    """Links of pairs of 0.80 to 0.90, each pair by itself: the forest finds at least 0.99 of what all pairs give."""
    rng = random.Random(23)
    texts, linked = {}, []
    for i in range(400):
        a = [f"w{i}x{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        b = list(a)
        for _ in range(max(1, len(a) // rng.randint(40, 60))):
            b[rng.randrange(len(b))] = f"e{rng.randrange(10**9)}"
        texts[2 * i], texts[2 * i + 1] = " ".join(a), " ".join(b)
        x, y = shingles(texts[2 * i], 4), shingles(texts[2 * i + 1], 4)
        both = len(x & y)
        if 100 * both >= 80 * (len(x) + len(y) - both):
            linked.append(2 * i)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4).collect()}
    assert len(linked) > 150
    assert sum(got[i + 1] == i for i in linked) >= 0.99 * len(linked)
    assert sum(got[2 * i + 1] == 2 * i for i in range(400)) <= len(linked)


def test_near_duplicates_at_the_edges(docs):
    named = {i: t for i, t, *_ in edge_rows() if i is not None}
    part = brute_components({d: shingles(t, 5) for d, t in named.items()})
    got = near_duplicates(docs).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        want = None if r.doc_id is None else part[r.doc_id]
        assert (r.component_id, r.kept) == (want, want == r.doc_id)


def test_near_duplicates_of_nothing(no_docs):
    assert rows(near_duplicates(no_docs)) == []


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(200, 40)]
    got = dict(rows(components(Workspace(spark, "test"), spark.createDataFrame(links, "a long, b long"))))
    assert got == {i: 1 for i in [*range(1, 41), 200]} | {i: 100 for i in range(100, 150)}


def test_components_of_hubs(spark):
    """A node with a third of all links, and a label that most nodes have, are looked up by broadcast."""
    links = [(0, i) for i in range(1, 3000)] + [(i, i + 3000) for i in range(1, 3000)] + [(10_000 + i, 10_001 + i) for i in range(60)]
    got = dict(rows(components(Workspace(spark, "test"), spark.createDataFrame(links, "a long, b long"))))
    assert got == {i: 0 for i in range(6000) if i != 3000} | {10_000 + i: 10_000 for i in range(61)}


def brute_spans(texts, length):
    first = {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = []
    for d, t in texts.items():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(copies_df, copies):
    assert rows(suffix_dedup(copies_df)) == brute_spans(copies, 50)


def test_suffix_dedup_of_hot_anchors(copies_df, copies, monkeypatch):
    """Every anchor hot: equal pieces combined before the shuffle, results looked up."""
    monkeypatch.setattr(suffix, "HOT_LEAST", 2)
    monkeypatch.setattr(suffix, "HEAVY", 10**9)
    assert rows(suffix_dedup(copies_df)) == brute_spans(copies, 50)


@pytest.mark.parametrize("size", [1, 4, 7, 1000])
def test_collections_are_whole_anchors(monkeypatch, size):
    monkeypatch.setattr(suffix, "COLLECTION", size)
    rng = np.random.default_rng(2)
    key = rng.integers(0, 40, 300)
    key[100:160] = 7  # an anchor larger than a collection
    batches = [pa.record_batch([pa.array(key[a : a + 11]), pa.array(np.arange(a, min(a + 11, 300)))], names=["key", "row"]) for a in range(0, 300, 11)]
    tables = list(suffix.collections(iter(batches)))
    assert sorted(x for t in tables for x in t.column("row").to_pylist()) == list(range(300))
    assert all(key[r] == k for t in tables for k, r in zip(t.column("key").to_pylist(), t.column("row").to_pylist(), strict=True))
    whole = [set(t.column("key").to_pylist()) for t in tables]
    assert all(not a & b for i, a in enumerate(whole) for b in whole[:i])
    assert all(t.num_rows <= size or len(k) == 1 for t, k in zip(tables, whole, strict=True))
    assert list(suffix.collections(iter(b.slice(0, 0) for b in batches))) == []


def test_spans_of_hot_pieces_are_combined_by_document(copies_df, copies, monkeypatch):
    """A task makes no more rows than it has documents, however many pieces they share."""
    monkeypatch.setattr(suffix, "HOT_LEAST", 2)
    monkeypatch.setattr(suffix, "HEAVY", 10**9)
    seen, plain = [], suffix.hot_spans
    monkeypatch.setattr(suffix, "hot_spans", lambda *a: seen.append(plain(*a)) or seen[-1])
    assert rows(suffix_dedup(copies_df)) == brute_spans(copies, 50)
    made = seen[0].groupBy(F.spark_partition_id(), "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("spans")).alias("spans")).collect()
    assert made and {r.n for r in made} == {1}
    assert any(r.spans > 1 for r in made)


def test_spans_that_meet_are_one():
    draw = random.Random(8)
    each = [(draw.randrange(-3, 3), a := draw.randrange(300), a + draw.randrange(1, 20)) for _ in range(90)]
    want = {d: {i for x, a, b in each if x == d for i in range(a, b)} for d, _, _ in each}
    held = [pa.record_batch([pa.array(x) for x in zip(*part, strict=True)], names=["doc_id", "start", "end"]) for part in (each[:40], each[40:])]
    got = suffix.by_document(held).to_pydict()
    assert got["doc_id"] == sorted(want)
    for d, spans in zip(got["doc_id"], got["spans"], strict=True):
        assert {i for s in spans for i in range(s["start"], s["end"])} == want[d]
        assert all(a["end"] < b["start"] for a, b in zip(spans, spans[1:]))


def test_transform_like_sorted_suffixes():
    """The column-wise transform against suffixes that are sorted outright."""
    rng = np.random.default_rng(9)
    docs = [bytes(rng.integers(97, 100, rng.integers(0, 40)).astype(np.uint8)) for _ in range(50)]
    data, sizes = np.frombuffer(b"".join(docs), np.uint8), np.array([len(d) for d in docs])
    symbols, prefix = bwt.transform(data, np.cumsum(sizes) - sizes, sizes, 20)
    owner, length = bwt.places(symbols, sizes)
    # a suffix ends with its document's own mark, and marks are in the documents' order
    order = sorted(((d[len(d) - n :] , i) for i, d in enumerate(docs) for n in range(len(d) + 1)), key=lambda x: ([c + 1 for c in x[0]] + [0], x[1]))
    assert [(docs[i][len(docs[i]) - n :], i) for i, n in zip(owner.tolist(), length.tolist(), strict=True)] == order
    for a, b, shared in zip(order, order[1:], prefix[1:].tolist(), strict=False):
        same = next((k for k, (x, y) in enumerate(zip(a[0], b[0], strict=False)) if x != y), min(len(a[0]), len(b[0])))
        assert shared == min(same, 20)


def test_suffix_dedup_at_the_edges(docs, no_docs):
    named = {i: t for i, t, *_ in edge_rows() if i is not None}
    got = rows(suffix_dedup(docs))
    assert len(got) == len(edge_rows())
    assert sorted({r for r in got if r[0] is not None}, key=repr) == brute_spans(named, 50)
    assert all(r[2] == 0 for r in got if r[0] is None)
    assert rows(suffix_dedup(no_docs)) == []


@pytest.mark.parametrize("length", [50, 44, 23])
@pytest.mark.parametrize("letters", [2, 26, 200])
def test_earliest_with_symbols_of_several_bytes(length, letters):
    """Rounds are a symbol each, and every window finds the earliest document of its string."""
    rng = np.random.default_rng(length)
    whole = rng.integers(0, letters, 3000).astype(np.uint8)
    sizes = rng.integers(length, 85, 70)
    at = rng.integers(0, 400, 70)
    data = np.concatenate([whole[a : a + n] for a, n in zip(at, sizes, strict=True)])
    starts, docs = np.cumsum(sizes) - sizes, rng.integers(0, 1000, 70)
    least = {}
    for s, n, d in zip(starts, sizes, docs, strict=True):
        for p in range(s, s + n - length + 1):
            key = data[p : p + length].tobytes()
            least[key] = min(d, least.get(key, d))
    early, begins = suffix.earliest(data, starts, sizes, docs, length)
    for s, n, b in zip(starts, sizes, begins, strict=True):
        assert early[b : b + n - length + 1].tolist() == [least[data[p : p + length].tobytes()] for p in range(s, s + n - length + 1)]


def test_rounds_of_the_transform_follow_its_symbols(monkeypatch):
    rounds, plain = [], bwt._Files.read
    monkeypatch.setattr(bwt._Files, "read", lambda self: rounds.append(1) or plain(self))
    data = np.random.default_rng(1).integers(97, 123, 84 * 30).astype(np.uint8)
    suffix.earliest(data, np.arange(30) * 84, np.full(30, 84), np.arange(30), 50)
    assert len(rounds) <= 84 // 5 + 2


@pytest.mark.parametrize("greatest", [200, 60_000, 100_000])
def test_transform_of_wide_symbols(greatest):
    rng = np.random.default_rng(3)
    docs = [rng.choice([1, 2, 3, greatest - 1, greatest], rng.integers(0, 12)).tolist() for _ in range(60)]
    data = np.array([x for d in docs for x in d], np.uint8 if greatest < 255 else np.uint16 if greatest < 65535 else np.uint32)
    sizes = np.array([len(d) for d in docs])
    owner, length = bwt.places(bwt.transform(data, np.cumsum(sizes) - sizes, sizes, 20)[0], sizes)
    order = sorted(((d[len(d) - n :], i) for i, d in enumerate(docs) for n in range(len(d) + 1)), key=lambda x: ([*x[0], 0], x[1]))
    assert [(docs[i][len(docs[i]) - n :], i) for i, n in zip(owner.tolist(), length.tolist(), strict=True)] == order


class Lone:
    """A frame of which only the task function is wanted."""

    def repartition(self, _):
        return self

    def mapInArrow(self, run, _):
        return run


def test_packed_anchors_follow_the_text_and_not_its_batches(spark):
    """Rows are one for each bucket, not for each batch and bucket, and shared anchors go out together."""
    draw = random.Random(4)
    texts = ["".join(draw.choices("abcdefgh ", k=400)) for _ in range(60)]
    batches = [pa.record_batch([pa.array([i, i + 1000]), pa.array([t, t])], names=["doc_id", "text"]) for i, t in enumerate(texts)]
    packed = list(suffix.packed_anchors(Lone(), 16, 50, 16)(iter(batches)))
    assert sum(b.num_rows for b in packed) == 16
    shared = list(suffix.shared_anchors(Lone())(iter(packed)))
    assert len(shared) == 1 and set(shared[0].column("doc_id").to_pylist()) == {*range(60), *range(1000, 1060)}


def test_anchors_of_all_are_those_of_each_text(monkeypatch):
    monkeypatch.setattr(suffix, "CACHED_BYTES", 150)
    rng = np.random.default_rng(5)
    sizes = rng.choice([0, 20, 49, 50, 51, 90, 400], 60)
    data, ends = rng.integers(97, 100, sizes.sum()).astype(np.uint8), np.cumsum(sizes)
    found = zip(*(x.tolist() for x in suffix.anchors_of_all(data, ends - sizes, ends, 50, 16)), strict=True)
    want = []
    for a, n in zip((ends - sizes).tolist(), sizes.tolist(), strict=True):
        want += [(h, first + a, count) for h, first, count in zip(*(x.tolist() for x in suffix.anchors(data[a : a + n], np.zeros(1, np.int64), np.array([n]), 50, 16)), strict=True)]
    assert sorted(found) == sorted(want)
