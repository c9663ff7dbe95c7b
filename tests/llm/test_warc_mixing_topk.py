import base64
import hashlib
import io
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import exact_topk, mixing, warc
from tesserae.llm.common import Workspace

from .conftest import edge_rows


def pages():
    return [(1, "http://a", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "x\r\ny", None), (4, "u", ""), (5, "u", "é" * 50_000), (6, "u", "é" * 50_000), (6, "u", "é" * 50_000), (None, "n", "<p>same</p>"), (None, "n", "alone"), (None, "m", "alone")]


@pytest.mark.parametrize("least", [0, 12])
def test_archives(spark, least):
    df = spark.createDataFrame([(*p, "x") for p in pages()], "page_id long, url string, html string, same string").repartition(3)
    ws = Workspace(spark, "test")
    manifest = ws.save(warc.write_archives(df, ws.table("a"), min_bytes=least, archive_bytes=200), "m")
    got = warc.read_archives(manifest, payloads=True).collect()
    first = {}
    for i, _, html in pages():
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, url, html in pages():
        b = (html or "").encode()
        f = first.get(html or "") if len(b) >= least else i
        revisit = f is not None and f != i
        want.append((i, "".join(c for c in url or "" if c not in "\r\n"), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None, None if revisit else b))
    assert sorted(map(repr, want)) == sorted(repr((*tuple(r)[:6], None if r.payload is None else bytes(r.payload))) for r in got)


def test_no_pages(spark):
    ws = Workspace(spark, "test")
    manifest = ws.save(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), ws.table("a")), "m")
    assert warc.read_archives(manifest).collect() == []


class Sink(io.BytesIO):
    def close(self):
        self.done = self.getvalue()


def archive(records, dictionary=b""):
    sink = Sink()
    writer = warc.ArchiveWriter(sink, dictionary)
    for r in records:
        writer.add(r)
    writer.close()
    return sink.done


@pytest.mark.parametrize("dictionary", [b"", b"<html><body>" * 40])
@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_frames(dictionary, chunk):
    records = [warc.record(i, f"u{i}", b"<html><body>" * i, None, False) for i in range(5)]
    data = archive(records, dictionary)
    assert list(warc.read_frames(io.BytesIO(data), chunk)) == records
    assert data[:4] == (b"\x5d\x2a\x4d\x18" if dictionary else b"\x28\xb5\x2f\xfd")
    with pytest.raises(ValueError):
        list(warc.read_frames(io.BytesIO(data[:-3]), chunk))
    with pytest.raises(ValueError):
        list(warc.read_frames(io.BytesIO(data + b"junk"), chunk))


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 7\r\n\r\n", b"Content-Length: 8\r\n\r\n"), (b"payload", b"PAYLOAD"), (b"WARC-Date", b"WARC-Dote"), (b"response", b"nonsense")])
def test_bad_records(change):
    good = warc.record(1, "u", b"payload", None, False)
    assert warc.parse(good)["payload"] == b"payload" and change[0] in good
    with pytest.raises(ValueError):
        warc.parse(good.replace(*change, 1))
    with pytest.raises(ValueError):
        warc.parse(good + b"x")


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def levelled(sizes, weights, share=Fraction(3, 2), passes=2):
    """Targets by bisection for the level at which min(weight * level, passes * size) adds up: another way than the operator's."""
    total = share * sum(sizes)
    low, high = Fraction(0), Fraction(passes * sum(sizes) + 1)
    for _ in range(200):
        middle = (low + high) / 2
        if sum(min(w * middle, passes * n) for w, n in zip(weights, sizes, strict=True)) < total:
            low = middle
        else:
            high = middle
    return [float(min(w * low, passes * n)) for w, n in zip(weights, sizes, strict=True)]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [5, 1000, 3, 70, 0, 12, 999], [1], [0, 0]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = [r.target for r in mixing.targets_of(Workspace(spark, "test"), rows).orderBy("number").collect()]
    assert got == pytest.approx(levelled(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]), rel=1e-9, abs=1e-9)
    if sizes == [100, 100, 100]:
        assert got == pytest.approx([200, 500 / 3, 250 / 3])


@pytest.mark.parametrize("subtrees", [1024, 3])
def test_splitting_tree(spark, subtrees):
    quotas = {1: 1000, 2: 3, 3: 41}
    df = spark.createDataFrame(list(quotas.items()), "number long, quota long")
    got = mixing.split_tree(df, 7, subtrees=subtrees).collect()
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.quota > 0
        by_source[r.number] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == quotas and set(by_shard) == set(range(7)) and max(by_shard.values()) - min(by_shard.values()) <= 3
    # the tree is the same however it is cut into tasks
    assert sorted(got) == sorted(mixing.split_tree(df.repartition(3), 7).collect())
    assert mixing.split_tree(df.limit(0), 3).collect() == []


def test_shards_follow_the_size():
    assert mixing.shards_for(0) == mixing.SHARDS
    assert mixing.shards_for(10**13) == 15 * 10**12 // mixing.SHARD_WORDS


def test_mixing(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 3}" if i % 4 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken_words(df).collect()
    again = mixing.taken_words(df.repartition(7)).collect()
    assert sorted(got) == sorted(again) and len(got) == 2000
    source, sizes, taken, target = {i: s for i, _, s in rows}, defaultdict(int), defaultdict(int), {}
    for i, t, s in rows:
        sizes[s] += words(t)
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        assert r.source_size == sizes[s] and r.taken in (0, r.size, 2 * r.size)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(levelled([sizes[s] for s in order], [5, 2, 1, 5][: len(order)]))
    assert all(abs(taken[s] - target[s]) <= 41 for s in order)
    mixed = mixing.mix(df, shards=8).collect()
    counts = defaultdict(int)
    for r in mixed:
        counts[r.doc_id] += 1
    assert all(counts[r.doc_id] * r.size == r.taken for r in got)
    assert {r.shard for r in mixed} == set(range(8))
    for shard in range(8):
        places = [r.place for r in mixed if r.shard == shard]
        assert places == sorted(places)
    # whole blocks of a source: what a shard holds of a block and pass is all of it
    drawn, _ = mixing.draw(df, shards=8)
    block = {(r.source, r.doc_id): r.block for r in drawn.collect()}
    shard_of = defaultdict(set)
    for r in mixed:
        shard_of[r.source, block[r.source, r.doc_id], r.copy].add(r.shard)
    assert all(len(x) == 1 for x in shard_of.values())


def test_mixed_rows(spark, docs):
    """Whole rows, with repeated identifiers, null identifiers and clashing names, as often as they are taken."""
    rows = mixing.mix_rows(docs)
    assert rows.columns == docs.columns
    got, taken = defaultdict(int), defaultdict(int)
    for r in rows.collect():
        got[r.doc_id, r.source] += 1
    for r, d in zip(sorted(mixing.taken_words(docs).collect(), key=repr), sorted(docs.collect(), key=repr), strict=True):
        taken[r.doc_id] += r.taken // r.size if r.size else 0
    by_id = defaultdict(int)
    for (i, _), n in got.items():
        by_id[i] += n
    assert by_id == {i: n for i, n in taken.items() if n}


def test_mixing_at_the_edges(docs, no_docs):
    got = mixing.taken_words(docs).collect()
    assert len(got) == len(edge_rows())
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, words(t)) for i, t, *_ in edge_rows())
    assert mixing.taken_words(no_docs).collect() == []


def brute(rows, k):
    out = set()
    fine = [(i, np.array([int(np.floor(1024 * x)) for x in v])) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in fine:
        if q % 10 == 0:
            scored = sorted((-int((v * w).sum()), i) for i, w in fine if i != q)[:k]
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("shape", ["normal", "ties", "skewed"])
def test_exact_top_k(spark, shape):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 16)) if shape != "ties" else rng.integers(-1, 2, (400, 16)).astype(float)
    if shape == "skewed":
        v[:, 0] *= 40
        v[100:250] = v[100]
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    rows += [(400, None), (410, [None] * 16), (420, [float("nan")] * 16), (430, [float("inf")] * 16), (440, []), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string").repartition(3)
    for broadcast_bytes in (1 << 20, 0):
        got = exact_topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 7, block_rows=64, query_rows=16, broadcast_bytes=broadcast_bytes).collect()
        assert {tuple(r) for r in got} == brute(rows, 7) and len(got) == 7 * 40


def test_block_sheds_rows():
    """A block whose rows are far apart: most are ruled out before the last segments, and what is left is exact."""
    rng = np.random.default_rng(8)
    v = rng.integers(-3, 4, (500, 8)) * rng.choice([1, 1000], (500, 1), p=[0.9, 0.1])
    block = exact_topk.build_block(np.arange(500), v)
    assert len(exact_topk.halvings(np.frombuffer(block["segments"], "<i8").reshape(-1, 2), exact_topk.widen(block["seg_value"]))) > 1
    q, ids, score = exact_topk.search_block(block, np.arange(5), v[:5], 3)
    for i in range(5):
        want = sorted((-int(v[i] @ w), j) for j, w in enumerate(v) if j != i)[:3]
        assert [(-s, j) for s, j in zip(score[q == i].tolist(), ids[q == i].tolist(), strict=True)] == want


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], "vec_id long, embedding array<float>")
    got = exact_topk.exact_top_k(df, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2048 * 1024), (0, 2, 2, -3072 * 1024)]
    assert exact_topk.exact_top_k(df.limit(0), F.col("vec_id") == 0).collect() == []
