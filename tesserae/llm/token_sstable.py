"""Token ids in sorted-string-table shards.

Documents are ranged on doc_id, sorted within each range and written in ascending order,
so that shard after shard is the whole table in order.  A shard file holds

    blocks | Bloom filter | block index | footer

A block holds entries up to `block_bytes`: key bytes shared with the entry before (varint),
further key bytes (varint), value bytes (varint), the key's rest, the value.  A key is one
zero byte for a null doc_id, or one and the identifier as 8 big-endian bytes with the sign
bit turned, so byte order is identifier order.  A value is token ids as little-endian
unsigned integers of the footer's width.  The block index has each block's first key,
offset and length and is searched by bisection; the Bloom filter takes ten bits a key.
The footer has fixed size and ends with a checksum and the magic bytes.

Null text counts as empty: its value is the end id alone.  Rows with equal doc_id are all
kept, in the order of their texts; a lookup returns all of them.  An empty table gives no
shards.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import files
from tesserae.llm.cache import Generations
from tesserae.llm.common import Workspace, plan_bytes, require, small_batches, spread, tidy

MAGIC = b"TSSTAB01"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
#: Bytes of the table's files in a range, which a task encodes.
RANGE_BYTES = 64 << 20
HASHES, BITS_PER_KEY = 7, 10
#: Marks that are tokens of their own after a letter or digit.
MARKS = ".,;:!?"
#: First letter beyond the Latin blocks whose letters all libraries agree on.
LATIN = "\u0250"
#: Entries in a generation of a worker's cache; longer chunks are not kept.
CACHE, LONGEST = 500_000, 64


def encode_key(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def decode_key(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def bloom_positions(key: bytes, bits: int):
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class TableWriter:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.at = self.n = self.tokens = 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = encode_key(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys are not in order")
        if not self.block:
            self.first, self.last = key, b""
        shared = 0
        for a, b in zip(key, self.last, strict=False):
            if a != b:
                break
            shared += 1
        put_varint(self.block, shared)
        put_varint(self.block, len(key) - shared)
        put_varint(self.block, len(value))
        self.block += key[shared:]
        self.block += value
        self.last = key
        self.keys.append(key)
        self.n += 1
        self.tokens += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.first, self.at, len(self.block)))
            self._write(bytes(self.block))
            self.block = bytearray()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush()
        bits = max(64, BITS_PER_KEY * self.n)
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in bloom_positions(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.at
        self._write(bytes(bloom))
        index_at, data = self.at, bytearray()
        for key, offset, length in self.index:
            put_varint(data, len(key))
            data += key
            put_varint(data, offset)
            put_varint(data, length)
        self._write(bytes(data))
        self._write(FOOTER.pack(bloom_at, bits, index_at, len(self.index), self.n, self.tokens, self.width, zlib.crc32(bytes(bloom) + bytes(data)), MAGIC))
        self.out.close()


class TableReader:
    """Reads one shard from a file that can seek."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if size < FOOTER.size:
            raise ValueError("no footer")
        source.seek(size - FOOTER.size)
        bloom_at, self.bits, index_at, blocks, self.n, self.tokens, self.width, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("bad magic bytes")
        if not bloom_at <= index_at <= size - FOOTER.size:
            raise ValueError("bad offsets")
        source.seek(bloom_at)
        data = source.read(size - FOOTER.size - bloom_at)
        if zlib.crc32(data) != crc:
            raise ValueError("bad checksum")
        self.bloom, at = data[: index_at - bloom_at], index_at - bloom_at
        self.index: list[tuple[bytes, int, int]] = []
        for _ in range(blocks):
            length, at = get_varint(data, at)
            key, at = bytes(data[at : at + length]), at + length
            offset, at = get_varint(data, at)
            n, at = get_varint(data, at)
            self.index.append((key, offset, n))
        self.firsts = [x[0] for x in self.index]

    def _entries(self, block: int):
        _, offset, length = self.index[block]
        self.source.seek(offset)
        data, at, key = self.source.read(length), 0, b""
        while at < length:
            shared, at = get_varint(data, at)
            more, at = get_varint(data, at)
            size, at = get_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, data[at : at + size]
            at += size

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def __iter__(self):
        for block in range(len(self.index)):
            for key, value in self._entries(block):
                yield decode_key(key), self.ids(value)

    def may_have(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_positions(encode_key(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """All documents of that identifier, by bisection of the block index."""
        if not self.index or not self.may_have(doc_id):
            return []
        key, found = encode_key(doc_id), []
        # equal keys may have begun in the block before the first that starts with the key
        for block in range(max(0, bisect_left(self.firsts, key) - 1), len(self.index)):
            if self.firsts[block] > key:
                break
            found += [self.ids(v) for k, v in self._entries(block) if k == key]
        return found


#: Normaliser and splitter under which no token spans white space.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def cuts_at_space(tokenizer) -> bool:
    """Whether the tokenizer's own description is the one that WordEncoder's chunks rest on."""
    held = json.loads(tokenizer.to_str())
    split = {"type": "Split", "pattern": {"Regex": SPLITTER}, "behavior": "Removed", "invert": True}
    pieces = (held.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    model = held["model"]
    return (
        (held.get("normalizer") or {}).get("normalizers") == NORMALISER
        and len(pieces) == 2
        and pieces[0] == split
        and pieces[1].get("type") == "ByteLevel"
        and not pieces[1].get("add_prefix_space")
        and not pieces[1].get("use_regex")
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and not held.get("truncation")
        and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in held["added_tokens"])
    )


class WordEncoder:
    """A tokenizer of the tokenizers library, by chunks where its file says that this is the same.

    If its tokens never span white space, texts are cut at spaces, tabs and line ends; each
    different chunk is encoded by the library once and kept, and texts are put together from
    the chunks' ids.  A mark of punctuation after a letter or digit is a token of its own, and
    chunks of small Latin letters in normal form are left alone by normaliser and splitter, so
    these go to the same model without them.  All this is read off the file's normaliser,
    splitter and model (cuts_at_space); a file that says anything else is given whole texts.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.chunked = cuts_at_space(self.tokenizer)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.final[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end = end_id.to_bytes(self.width, "little")
        self.known = Generations(CACHE)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text with the end id; a null text has the end id alone."""
        texts = pc.fill_null(texts, "")
        if not self.chunked:
            coded = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [np.asarray(e.ids, self.kind).tobytes() + self.end for e in coded]
        for mark in "\n\t\r":
            texts = pc.replace_substring(texts, mark, " ")
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        values = self._values(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.width
        starts = np.cumsum(sizes) - sizes
        counts = sizes[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(starts[at] - ends[:-1], counts)
        places += np.arange(len(places))
        ids = np.frombuffer(b"".join(values), self.kind)[places].tobytes()
        edges = (ends[np.asarray(cut.offsets) - cut.offsets[0].as_py()] * self.width).tolist()
        return [ids[a:b] + self.end for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _values(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk."""
        young, old = self.known.young, self.known.old_get
        values = [b"" if w == "" else young.get(w) or old(w) for w in chunks]
        new = [i for i, v in enumerate(values) if v is None]
        slow, fast = {}, {}
        split: list[tuple[str, str]] = []
        for i in new:
            w = chunks[i]
            core, mark = w, ""
            if w[-1] in MARKS and w[-2:-1].isalnum():
                core, mark = w[:-1], w[-1]
                if mark not in slow:
                    slow[mark] = b""
            low = core.lower() if core.isascii() else core
            if low.isalpha() and max(low) < LATIN and low == low.lower() and is_normalized("NFC", low):
                core = low
                fast[core] = b""
            else:
                slow[core] = b""
            split.append((core, mark))
        self._run_plain(fast)
        self._run(slow)
        for i, (core, mark) in zip(new, split, strict=True):
            value = fast.get(core) or slow[core]
            values[i] = value = value + slow[mark] if mark else value
            if value and len(chunks[i]) < LONGEST:
                self.known.put(chunks[i], value)
        return values

    def _run(self, wanted: dict[str, bytes]) -> None:
        words = list(wanted)
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                wanted[w] = np.asarray(e.ids, self.kind).tobytes()

    def _run_plain(self, wanted: dict[str, bytes]) -> None:
        """Many words in one call; a token that ends a word tells where the next begins."""
        words = list(wanted)
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            ids = np.asarray(self.plain.encode(" ".join(part), add_special_tokens=False).ids, self.kind)
            ends = (np.flatnonzero(self.final[ids]) + 1) * self.width
            if len(ends) != len(part) or ends[-1] != len(ids) * self.width:  # no such tokens: one by one
                self._run(apart := dict.fromkeys(part, b""))
                wanted.update(apart)
                continue
            packed, at = ids.tobytes(), 0
            for w, end in zip(part, ends.tolist(), strict=True):
                wanted[w] = packed[at:end]
                at = end


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def portions(batch: pa.RecordBatch, most: int = 8 << 20):
    """Slices of whole rows with about `most` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


MANIFEST = "shard_range int, shard_seq int, uri string, n_docs long, n_tokens long"


def ranges_of(docs: DataFrame) -> int:
    """Ranges to cut a table into: RANGE_BYTES of its files each, and no fewer than the session's shuffle partitions."""
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(docs) // RANGE_BYTES))


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, n_ranges: int | None = None, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write `docs` as shards below `folder`; returns the manifest, one row per file.

    The frame writes the files when it runs: save it once, and read the saved manifest.
    n_ranges: how many ranges the table is cut into, by its size if not given.
    """
    n_ranges = n_ranges or ranges_of(docs)
    ordered = require(docs, "doc_id", "text").repartitionByRange(n_ranges, F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    @tidy
    def run(batches):
        from pyspark import TaskContext

        words = encoder(path, end_id)
        at = TaskContext.get().partitionId()
        rows, table, uri = [], None, ""

        def done():
            table.close()
            rows.append((at, len(rows), uri, table.n, table.tokens))

        for batch in batches:
            for part in portions(batch):
                for doc_id, value in zip(part.column(0).to_pylist(), words.encode(part.column(1)), strict=True):
                    if table is None:
                        uri = files.unique_name(folder, f"shard-{at:06d}-{len(rows):04d}", ".sst")
                        table = TableWriter(files.create(uri), words.width, block_bytes)
                    table.add(doc_id, value)
                    if table.at >= shard_bytes:
                        done()
                        table = None
        if table is not None:
            done()
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["shard_range", "shard_seq", "uri", "n_docs", "n_tokens"])

    return ordered.mapInArrow(run, MANIFEST)


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry of a saved manifest, from the files, a shard a task.

    The window is over one row per shard file, not per document.
    """
    before = Window.orderBy("shard_range", "shard_seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("shard_range", "shard_seq", "uri", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    each = spread(starts.select("uri", "start"), manifest.count())

    @tidy
    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, starts, counts, sums = [], [], [], []
                with files.open_random(uri) as source:
                    for doc_id, tokens in TableReader(source):
                        ids.append(doc_id)
                        starts.append(start)
                        counts.append(len(tokens))
                        sums.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                        start += len(tokens)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids, starts, counts, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small_batches(spark)
    ws = Workspace(spark, "sstable")
    manifest = write_shards(docs, ws.table("shards"), public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_shards(ws.save(manifest, "manifest"))
