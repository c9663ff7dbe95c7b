"""Column-wise construction of a collection's Burrows-Wheeler transform with common prefixes.

Each round inserts one more symbol of every document, read from its end: round r adds the
suffixes of length r.  The transform and the lengths of common prefixes of neighbouring
suffixes lie in external files that each round reads and writes from start to end.  A symbol
is a byte, or several at once (wider()), which takes as many times fewer rounds.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tesserae.llm.common import task_folder


class _Files:
    """Transform (a symbol a suffix) and prefix lengths (a byte); a round reads one pair of files and writes the other.

    Files stay open and are written over from the start: each is longer than what it held
    before, so nothing is cut off, which would make the file system write it out at once.
    """

    def __init__(self, folder: str):
        self.pairs = [[open(os.path.join(folder, f"{n}{i}"), "w+b", buffering=0) for n in ("bwt", "lcp")] for i in (0, 1)]
        self.rows, self.types = 0, []

    def write(self, *columns: np.ndarray) -> None:
        self.pairs.reverse()
        self.rows, self.types = len(columns[0]), [c.dtype for c in columns]
        for out, column in zip(self.pairs[0], columns, strict=True):
            out.seek(0)
            out.write(column.data)

    def read(self) -> list[np.ndarray]:
        columns = [np.empty(self.rows, t) for t in self.types]
        for source, column in zip(self.pairs[0], columns, strict=True):
            source.seek(0)
            if source.readinto(column.data) != column.nbytes:
                raise OSError("a file of the transform is short")
        return columns

    def close(self) -> None:
        for f in (*self.pairs[0], *self.pairs[1]):
            f.close()


def _by_symbol(bwt: np.ndarray) -> np.ndarray:
    """Rows in stable order of their symbol: Arrow counts bytes, in a third of numpy's time; numpy sorts two bytes by digits."""
    if bwt.dtype == np.uint8:
        return pc.array_sort_indices(pa.array(bwt)).to_numpy().view(np.int64)
    low = np.argsort(bwt.astype(np.uint16), kind="stable")
    return low if bwt.dtype == np.uint16 else low[np.argsort((bwt >> 16).astype(np.uint16)[low], kind="stable")]


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for each pair, lo < hi, by a table of doubling spans."""
    spans = hi - lo
    level = np.zeros(len(spans), np.int64)
    top = int(spans.max(initial=1)).bit_length()
    out = np.empty(len(spans), values.dtype)
    level = np.frexp(spans.astype(np.float64))[1] - 1
    table = values
    for k in range(top):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        if k + 1 < top:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def wider(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of all documents with `step` bytes a symbol, as documents for transform(): symbols, starts, sizes.

    A document becomes `step` documents, the one numbered k without its last k bytes, each cut
    into symbols from its end: its suffix of n symbols is the document's last n * step + k bytes
    without the last k.  So every place begins one suffix, and suffixes share n symbols where
    they share n * step bytes.  Symbols are numbers of the different byte strings, so their order
    isn't that of bytes; any order puts suffixes that share symbols together.
    """
    if step == 1:
        return data, starts, sizes
    less = np.tile(np.arange(step), len(sizes))
    ends = np.repeat(starts + sizes, step) - less
    counts = (np.repeat(sizes, step) - less) // step
    begins = np.cumsum(counts) - counts
    at = np.repeat(ends - step * (counts + begins), counts) + step * np.arange(int(counts.sum()))
    packed = np.zeros(len(at), np.uint64)
    for i in range(step):
        packed = packed << np.uint64(8) | data[at + i]
    coded = pa.array(packed).dictionary_encode()
    n = len(coded.dictionary)
    return coded.indices.to_numpy().astype(np.uint8 if n < 0xFF else np.uint16 if n < 0xFFFF else np.uint32), begins, counts


def transform(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Transform and prefix lengths (at most `cap`) of all suffixes in order.

    data: symbols of all documents, none of them the greatest of its unsigned type; a document
    is data[start : start + size].  The transform has them plus one, and 0 where a suffix is its whole document.  The first rows
    are the empty suffixes, by document.  `cap` is at most 255.
    """
    m = len(sizes)
    ends = starts + sizes
    with tempfile.TemporaryDirectory(dir=task_folder()) as folder, contextlib.closing(_Files(folder)) as held:
        first = np.where(sizes > 0, data[np.maximum(ends - 1, 0)].astype(np.int64) + 1, 0).astype(data.dtype)
        held.write(first, np.zeros(m, np.uint8))
        docs, rows = np.arange(m), np.arange(m)  # documents that go on, and where their last suffix is
        done = 0
        while True:
            going = sizes[docs] > done
            docs, rows = docs[going], rows[going]
            if not len(docs):
                break
            done += 1
            bwt, lcp = held.read()
            # rows by symbol, stably: what extends them is in this order after the empty suffixes
            order = _by_symbol(bwt)
            whole = int(np.count_nonzero(bwt == 0))
            # the last suffixes are in ascending rows, so the same sort puts them in their order among all
            by = _by_symbol(bwt[rows])
            last = np.zeros(len(bwt), bool)
            last[rows] = True
            docs, rows, near = docs[by], rows[by], np.flatnonzero(last[order])
            at = near + m - whole
            # the old row before this one, and the one after, with the same symbol
            symbol = bwt[rows]
            before = order[near - 1]
            ok = (near > whole) & (bwt[before] == symbol)
            after = order[np.minimum(near + 1, len(order) - 1)]
            more = (near + 1 < len(order)) & (bwt[after] == symbol)
            shared = np.minimum(_least(lcp, np.concatenate([before[ok], rows[more]]) + 1, np.concatenate([rows[ok], after[more]]) + 1), cap - 1) + 1
            prefix, follows = np.zeros(len(at), np.uint8), np.zeros(len(at), np.uint8)
            prefix[ok], follows[more] = np.split(shared, [np.count_nonzero(ok)])
            fresh = np.ones(len(bwt) + len(at), bool)
            fresh[at] = False
            new_bwt, new_lcp = np.empty(len(fresh), bwt.dtype), np.empty(len(fresh), np.uint8)
            new_bwt[fresh], new_lcp[fresh] = bwt, lcp
            left = ends[docs] - done - 1
            new_bwt[at] = np.where(sizes[docs] > done, data[np.maximum(left, 0)].astype(np.int64) + 1, 0)
            new_lcp[at] = prefix
            # a new row changes what the row after it shares, if that isn't new too
            then = np.minimum(at + 1, len(fresh) - 1)
            old = (at + 1 < len(fresh)) & fresh[then]
            new_lcp[then[old]] = follows[old]
            held.write(new_bwt, new_lcp)
            rows = at
        return tuple(held.read())


def places(bwt: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and length of each row's suffix, by following the transform from the empty suffixes."""
    m = len(sizes)
    order = _by_symbol(bwt)
    whole = int(np.count_nonzero(bwt == 0))
    follow = np.empty(len(bwt), np.int64)
    follow[order] = np.arange(len(bwt)) - whole + m
    owner, length = np.empty(len(bwt), np.int64), np.empty(len(bwt), np.int64)
    docs, rows, done = np.arange(m), np.arange(m), 0
    while len(docs):
        owner[rows], length[rows] = docs, done
        going = sizes[docs] > done
        docs, rows = docs[going], follow[rows[going]]
        done += 1
    return owner, length
