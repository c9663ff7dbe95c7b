"""The registered queries of this subpackage over the smallest tables, against other libraries, SQL and brute force."""

import hashlib
import math
import os
import re
import zlib

import duckdb
import pytest

from tesserae.llm import catalogue

from .test_exact_and_near import brute_components, brute_spans, shingles
from .test_warc_mixing_topk import levelled, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def engine():
    held = duckdb.connect()
    for f in os.listdir(SF):
        held.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return held


@pytest.fixture(scope="module")
def texts(engine):
    return dict(engine.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_like_the_oracle(spark, engine, name):
    found = engine.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op2(spark, engine, texts):
    got = QUERIES["op2_toxicity"](spark, SF).collect()
    truth = dict(engine.execute("SELECT doc_id, toxic FROM labels WHERE toxic IS NOT NULL").fetchall())
    assert {r.doc_id for r in got} == set(texts)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in judged) >= 0.9 * len(judged)


def test_op3(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    got = QUERIES["op3_token_sstable"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_op4(spark, texts):
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    part = brute_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op4_minhash_forest"](spark, SF).collect()}
    assert got == {i: (len(s), part[i], part[i] == i) for i, s in sets.items()}


def test_op5(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op5_byte_bpe"](spark, SF).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {i: t.encode_ordinary(x or "") for i, x in texts.items()}
    assert got == {i: (len(ids[i]), sha(",".join(map(str, ids[i])).encode()), sha((texts[i] or "").encode())) for i in texts}


def test_op7(spark, texts):
    got = QUERIES["op7_suffix_dedup"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_spans(texts, 50)


def test_op8(spark, engine):
    rows = engine.execute("SELECT doc_id, text, source FROM documents").fetchall()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, levelled([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    got = {r.doc_id: r for r in QUERIES["op8_mixing"](spark, SF).collect()}
    again = {r.doc_id: r for r in QUERIES["op8_mixing"](spark, SF).collect()}
    assert got == again and set(got) == {i for i, _, _ in rows}
    taken = dict.fromkeys(sizes, 0)
    longest = dict.fromkeys(sizes, 0)
    for i, t, s in rows:
        n = words(t)
        assert (got[i].size, got[i].source_size) == (n, sizes[s]) and math.isclose(got[i].target, target[s], rel_tol=1e-9)
        assert got[i].taken in (0, n, 2 * n)
        taken[s] += got[i].taken
        longest[s] = max(longest[s], n)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)


def test_op9(spark, engine, texts):
    langs = dict(engine.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = QUERIES["op9_langid"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        t = texts[r.doc_id]
        assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (t is None or not re.search(r"[^\W\d_]", t))
    judged = [r for r in got if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == langs[r.doc_id] for r in judged) >= 0.9 * len(judged)
