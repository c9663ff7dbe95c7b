import base64
import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from tesserae.llm import byte_bpe, token_sstable  # noqa: E402
from tesserae.llm.common import Workspace  # noqa: E402

from .conftest import edge_rows  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = st.lists(st.sampled_from(["a", "The", "'s", "'LL", "é", "ê", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "12", "!?", "日本", "́", "\r\n", "word,", "ß", "Σ", "<|endoftext|>"]), max_size=14).map("".join)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_byte_bpe_like_tiktoken(reference, text):
    bpe = byte_bpe.loaded(RANKS, public_tokenizers.PATTERN)
    ids, joined = bpe.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert joined == ",".join(map(str, ids))
    assert bpe.decode(ids) == text.encode()


def test_byte_bpe_of_one_long_match(reference):
    text = "ab" * 20_000
    assert byte_bpe.loaded(RANKS, public_tokenizers.PATTERN).encode(text)[0] == reference.encode_ordinary(text)


def test_byte_bpe_rows(docs, no_docs, reference):
    got = sorted((tuple(r) for r in byte_bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for doc_id, text, *_ in edge_rows():
        ids = reference.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert byte_bpe.round_trip_digests(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []
    full = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert all(r.n_tokens == len(r.ids) for r in full)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXTS, min_size=1, max_size=5))
def test_word_encoder_like_the_library(tokenizer, texts):
    got = [np.frombuffer(x, "<u2").tolist() for x in token_sstable.encoder(WORDS, 1).encode(pa.array(texts))]
    assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_shards_hold_all_in_order(spark, docs, tokenizer):
    ws = Workspace(spark, "test")
    manifest = ws.save(token_sstable.write_shards(docs, ws.table("shards"), WORDS, 1, 3, shard_bytes=20_000, block_bytes=500), "manifest")
    got = sorted(tuple(r) for r in token_sstable.read_shards(manifest).where("doc_id is not null").collect())
    want, at = [], 0
    for doc_id, text, *_ in sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        if doc_id is not None:
            want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert manifest.agg({"n_tokens": "sum"}).first()[0] == at


def test_no_documents_make_no_shards(spark, no_docs):
    ws = Workspace(spark, "test")
    manifest = ws.save(token_sstable.write_shards(no_docs, ws.table("shards"), WORDS, 1, 2), "manifest")
    assert token_sstable.read_shards(manifest).collect() == []


class Sink(io.BytesIO):
    def close(self):
        self.done = self.getvalue()
        super().close()


def shard(entries, block_bytes=64):
    sink = Sink()
    writer = token_sstable.TableWriter(sink, 2, block_bytes)
    for doc_id, ids in entries:
        writer.add(doc_id, np.array(ids, "<u2").tobytes())
    writer.close()
    return sink.done


def test_lookup_by_key():
    entries = [(None, [9]), *((i, list(range(i % 50 + 1))) for i in range(-500, 3000, 3)), (3000, [1]), (3000, [2]), *((3000, [k] * 40) for k in range(5))]
    table = token_sstable.TableReader(pa.BufferReader(shard(entries)))
    assert len(table.index) > 10
    assert [(d, x.tolist()) for d, x in table] == [(d, x) for d, x in entries]
    assert [x.tolist() for x in table.get(-500)] == [[0]]
    assert [x.tolist() for x in table.get(None)] == [[9]]
    assert [len(x) for x in table.get(3000)] == [1, 1, 40, 40, 40, 40, 40]
    assert table.get(-499) == [] and table.get(10**12) == []
    assert sum(table.may_have(i) for i in range(10_000, 20_000)) < 300


def test_damage_is_found():
    data = bytearray(shard([(1, [2, 3])]))
    data[-60] ^= 1
    with pytest.raises(ValueError):
        token_sstable.TableReader(pa.BufferReader(bytes(data)))
    with pytest.raises(ValueError):
        token_sstable.TableReader(pa.BufferReader(b"short"))
