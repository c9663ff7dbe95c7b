"""Hashed character n-grams of batches of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers of a character by its place in the n-gram, and of the final mixing.
PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
MIX = np.uint32(0x2C1B3C6D)


class TextBatch:
    """Lower-cased texts laid end to end as code points with padding between them.

    The padding is longer than any n-gram, so no n-gram holds characters of two texts.
    """

    PAD = "\x00" * len(PLACES)

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        joined = self.PAD.join(lowered) + self.PAD
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        self.starts = np.concatenate([[0], np.cumsum(sizes + len(self.PAD))[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        self.ends = self.starts + sizes
        self.sizes = sizes

    def grams(self, order: int, bits: int) -> np.ndarray:
        """Bucket of the n-gram that starts at each code point; those at a text's end reach into its padding."""
        n = len(self.points) - len(self.PAD)
        h = self.points[:n] * PLACES[0]
        for j in range(1, order):
            h += self.points[j : n + j] * PLACES[j]
        h ^= np.uint32(order)
        h ^= h >> np.uint32(15)
        h *= MIX
        h ^= h >> np.uint32(13)
        h *= PLACES[1]
        return h >> np.uint32(32 - bits)

    def owner(self) -> np.ndarray:
        """Index of the text that a code point belongs to, -1 for padding."""
        out = np.full(len(self.points) - len(self.PAD), -1, np.int32)
        for i, (a, b) in enumerate(zip(self.starts, self.ends, strict=True)):
            out[a:b] = i
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum by text of a value by code point; 0 for empty texts."""
        if not len(self.starts):
            return np.zeros((0, *values.shape[1:]), values.dtype)
        edges = np.empty(2 * len(self.starts), np.int64)
        edges[::2], edges[1::2] = self.starts, self.ends
        held = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
        edges = np.minimum(edges, len(values))
        out = np.add.reduceat(held, edges, axis=0)[::2]
        out[self.sizes == 0] = 0
        return out


def portions(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of whole texts of about `most` characters, with the place of the first."""
    at, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t or "")
        if size >= most:
            yield at, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, held


class Grouped:
    """Entries (row, column) of a sparse matrix for sums by row and by column; entries come sorted by row."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray):
        self.cols = cols.astype(np.int32)
        self.row_starts = np.flatnonzero(np.diff(rows, prepend=-1))
        self.row_names = rows[self.row_starts]
        self.order = np.argsort(self.cols, kind="stable").astype(np.int32)
        by_col = self.cols[self.order]
        self.rows_by_col = rows[self.order].astype(np.int32)
        self.col_starts = np.flatnonzero(np.diff(by_col, prepend=-1))
        self.col_names = by_col[self.col_starts]

    def by_row(self, values: np.ndarray, n: int) -> np.ndarray:
        """Sums of a value by entry over rows 0 .. n - 1."""
        out = np.zeros(n)
        if len(values):
            out[self.row_names] = np.add.reduceat(values, self.row_starts)
        return out

    def by_col(self, values: np.ndarray, n: int) -> np.ndarray:
        """Sums over columns 0 .. n - 1 of a value by entry, the entries in `order`."""
        out = np.zeros(n)
        if len(values):
            out[self.col_names] = np.add.reduceat(values, self.col_starts)
        return out
