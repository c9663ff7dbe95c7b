"""Byte-level BPE: encoding by a segment tree of pair ranks, and decoding.

A text is cut by the vocabulary's pattern; each match is encoded by itself.  A segment
tree over the match's byte positions holds, for each live pair of neighbours, its rank
and position, so the root is the leftmost pair of least rank.  A merge updates three
leaves (the merged pair, the absorbed one and the left neighbour's), each in logarithmic
time, so a match of n bytes takes O(n log n).

Null text counts as empty: no ids.  Texts of any length are processed whole.  Repeated
rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.cache import Generations
from tesserae.llm.common import require, small_batches, tidy

#: White space of Unicode's White_Space property, spelt out as the libraries' \s differ.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Entries in a generation of a worker's caches, each some 300 bytes; longer keys are not kept.
CACHE, LONGEST = 400_000, 64
#: Rank of no pair; a leaf is rank * bytes + position, so leaves from here on are no pair either.
NONE = 1 << 59


def pair_ranks(ranks: dict[bytes, int]) -> list[int]:
    """Rank of each pair of bytes, by first * 256 + second."""
    return [ranks.get(bytes((a, b)), NONE) for a in range(256) for b in range(256)]


def merge_ranks(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    size = n  # a tree of any size: every leaf's ancestors end at the root, and least is symmetric
    tree = [NONE] * size
    tree += [pairs[a << 8 | b] * n + i for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False))]
    tree.append(NONE)
    rank = ranks.get
    for at in range(size - 1, 0, -1):
        a, b = tree[2 * at], tree[2 * at + 1]
        tree[at] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while tree[1] < NONE:
        i = tree[1] % n
        j = after[i]
        k = after[j]
        after[i] = k
        p = before[i]
        if k < n:
            before[k] = i
            r = rank(piece[i : after[k]])
        else:
            r = None
        changed = [(i, NONE if r is None else r * n + i), (j, NONE)]
        if p >= 0:
            r = rank(piece[p:k])
            changed.append((p, NONE if r is None else r * n + p))
        for leaf, value in changed:
            at = size + leaf
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class ByteBpe:
    """A rank file and its pattern."""

    #: White space before a space: there a match can span the space.
    _run = re.compile(r"\s ")

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pairs = pair_ranks(self.ranks)
        self.comma = {i: f",{i}" for i in self.ranks.values()}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        self.matches = Generations(cache)
        self.chunks = Generations(cache)

    def _encode_matches(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.matches.young
        for m in self.find(text):
            ids = known.get(m) or self.matches.old_get(m)
            if ids is None:
                ids = tuple(merge_ranks(m.encode("utf-8"), self.ranks, self.pairs))
                if len(m) < LONGEST:
                    self.matches.put(m, ids)
            out += ids
        return out

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        ids = self._encode_matches(chunk)
        return array("I", ids).tobytes(), "".join([self.comma[i] for i in ids])

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids, and the same ids in decimal joined by commas.

        No match spans a space that follows a character other than white space, so the
        text is cut there and equal chunks are encoded once.
        """
        if self._run.search(text):
            ids = self._encode_matches(text)
            return ids, ",".join(map(str, ids))
        known = self.chunks.young
        head, *rest = text.split(" ")
        got = list(map(known.get, rest))
        if None in got:
            for i, hit in enumerate(got):
                if hit is None:
                    word = rest[i]
                    hit = known.get(word) or self.chunks.old_get(word)
                    if hit is None:
                        hit = self._chunk(" " + word)
                        if len(word) < LONGEST:
                            self.chunks.put(word, hit)
                    got[i] = hit
        got.insert(0, self._chunk(head))
        ids = array("I")
        ids.frombytes(b"".join([x[0] for x in got]))
        return ids.tolist(), "".join([x[1] for x in got])[1:]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_LOADED: dict[tuple[str, str, int], ByteBpe] = {}


def loaded(path: str, pattern: str, cache: int = CACHE) -> ByteBpe:
    """The vocabulary, loaded once in a worker."""
    key = (path, pattern, cache)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(path, pattern, cache)
    return _LOADED[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256: the texts' token ids and the digests of round_trip_digests()."""

    @tidy
    def run(batches):
        bpe = loaded(path, pattern, cache)
        sha = hashlib.sha256
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                coded = [bpe.encode(t or "") for t in _texts(part)]
                ids = [x for x, _ in coded]
                yield pa.record_batch(
                    [part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([sha(s.encode()).hexdigest() for _, s in coded]), pa.array([sha(bpe.decode(x)).hexdigest() for x in ids])],
                    names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    return require(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def _texts(batch):
    column = batch.column(1)
    return (x.as_py() for x in column)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes that the ids decode to)."""

    @tidy
    def run(batches):
        bpe = loaded(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in _texts(batch):
                ids, joined = bpe.encode(text or "")
                counts.append(len(ids))
                coded.append(sha(joined.encode()).hexdigest())
                decoded.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return require(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
