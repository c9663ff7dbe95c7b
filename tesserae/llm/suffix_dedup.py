"""Removal of byte strings that also start in an earlier document, by suffix order.

A byte goes if a string of `length` bytes that covers it also starts in a document with a
smaller doc_id.  Equal documents are put together first: the one of least doc_id stands for
all of them, and of the others every string starts in it, so they go as a whole.  Then:

1. Winnowing: of every window of `length` bytes the least-hashed `ANCHOR`-byte string is its
   anchor, so equal windows have equal anchors, and the windows of one anchor are a piece of
   the text.  Every window is in exactly one piece.
2. Anchors meet by hash, packed in arrays; those of one document only are done with.
3. The pieces of shared anchors meet by anchor, in as many tasks as their number asks for.
   Whole anchors make a collection: its different pieces are the documents whose
   Burrows-Wheeler transform and common prefixes are built column by column (bwt.py);
   neighbours in suffix order that share `length` symbols are one string, whose earliest
   document is the least of its pieces'.
4. Spans whose string has an earlier document are gathered by document and cut out.

An anchor of over 1/HEAVY of all pieces, or of over HOT_MOST, is hot, so none fills a task.
Equal pieces of hot anchors are combined where they are read, with the list of their places.
Only the different ones meet by anchor, and what the transform finds is looked up for each list.

Strings are judged on the input, matches never cross documents, and overlaps count.  Null text
counts as empty; texts under `length` bytes stay whole, and texts of any length are used
whole.  A row with a null doc_id is neither earlier nor later than any other: it stays whole.
Rows repeated with one doc_id must have one text; they are alike.  An empty table gives an
empty result.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bwt
from tesserae.llm.common import Workspace, lookup, possible, require, small_batches, task_folder, tidy, without
from tesserae.llm.shingles import BASE, BYTE, mix, powers

LENGTH, ANCHOR = 50, 16
PORTION = 4 << 20  # bytes of text at once; below 1 << 22 and a text more
#: Bytes of text whose hashes are worked on at once, or one text.
CACHED_BYTES = 1 << 17
#: Bytes of text whose pieces are cut at once, or one text; and rows of shared anchors that go out together.
CUT_BYTES, OUT_ROWS = 1 << 19, 1 << 16
#: Anchors that a task holds to pack them by bucket.
PACK_ROWS = 1 << 20
#: Pieces of a collection: its arrays then stay in a core's cache.
COLLECTION = 12_000
#: Bytes of a symbol of the transform at most; the most that divide `length` are taken.
SYMBOL = 5
#: Bytes of text whose anchors a task of step 2 gathers, and pieces that a task of step 3 gets.
BUCKET_BYTES, TASK_PIECES = 32 << 20, 250_000
#: Share of all pieces, and pieces at least, from which an anchor is hot, and pieces from which it always is.
HEAVY, HOT_LEAST, HOT_MOST = 1024, 64, 100_000
#: Hot anchors that are broadcast; more are met in a shuffle.
HOT_KEYS = 1 << 20
#: Spans of hot pieces that a task holds to combine them by document.
SPAN_ROWS = 1 << 20


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of every piece of the texts data[starts:ends]."""
    n = len(data)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = length - anchor + 1
    if n < length:
        return none
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(BASE, n))])
    h = mix((sums[anchor:] - sums[:-anchor]) * powers(pow(BASE, -1, 2**64), n)[: n - anchor + 1])
    # half of the hash decides, however much is read at once, and of equal ones the first
    low = np.uint64((1 << 32) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    edge = np.zeros(n + 1, np.int64)
    long = ends - starts >= length
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge)[: len(least)] > 0)
    if not len(windows):
        return none
    at = (least[windows] & low).astype(np.int64)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)])
    first = np.flatnonzero(new)
    return h[at[first]], windows[first], np.diff(np.append(first, len(at)))


def anchors_of_all(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchors() of texts that lie end to end, some at a time, so that its arrays stay in a core's cache."""
    found, lo = [], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CACHED_BYTES, "right")))
        base = starts[lo]
        h, first, count = anchors(data[base : ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base, length, anchor)
        found.append((h, first + base, count))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _portions(batch: pa.RecordBatch):
    """(doc_ids, data, starts, ends) of some whole texts at a time."""
    held, ids, size = [], [], 0

    def out():
        sizes = np.array([len(b) for b in held], np.int64)
        ends = np.cumsum(sizes)
        return np.array(ids, np.int64), np.frombuffer(b"".join(held), np.uint8), ends - sizes, ends

    for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        b = (t.as_py() or "").encode("utf-8", "surrogatepass")
        held.append(b)
        ids.append(i)
        size += len(b)
        if size >= PORTION:
            yield out()
            held, ids, size = [], [], 0
    if held:
        yield out()


PACKED = "bucket int, keys binary, docs binary, locs binary"


def packed_anchors(docs: DataFrame, buckets: int, length: int, anchor: int) -> DataFrame:
    """Anchors of all pieces, a row for each bucket and PACK_ROWS of them or a task's rest: key, doc_id and place << 8 | windows."""

    def packed(held):
        h, docs, locs = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        h, docs, locs, bucket = h[order], docs[order], locs[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        column = lambda x: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())
        return pa.record_batch([pa.array(bucket[cuts[:-1]].astype(np.int32)), column(h), column(docs), column(locs)], names=["bucket", "keys", "docs", "locs"])

    @tidy
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for ids, data, starts, ends in _portions(batch):
                h, first, count = anchors_of_all(data, starts, ends, length, anchor)
                if not len(h):
                    continue
                own = np.searchsorted(starts, first, "right") - 1
                # texts may be empty: the last that starts here holds the window
                held.append((h, ids[own], (first - starts[own]) << 8 | count))
                n += len(h)
                if n >= PACK_ROWS:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return docs.mapInArrow(run, PACKED)


def shared_anchors(packed: DataFrame) -> DataFrame:
    """(key, doc_id, loc) of anchors that two documents have.

    The entries of a task go through an external file: what is held is one line per anchor.
    """

    def reduce(key, lo, hi):
        order = np.argsort(key, kind="stable")
        key, lo, hi = key[order], lo[order], hi[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return (key[at], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)) if len(key) else (key, lo, hi)

    @tidy
    def run(batches):
        parts, rows, sizes = [], 0, []
        with tempfile.TemporaryFile(dir=task_folder()) as spill:
            for batch in batches:
                for keys, docs, locs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    spill.write(keys)
                    spill.write(docs)
                    spill.write(locs)
                    sizes.append(len(keys))
                    doc = np.frombuffer(docs, np.int64)
                    parts.append((np.frombuffer(keys, np.uint64), doc, doc))
                    rows += len(doc)
                    if rows > 2_000_000:
                        parts = [reduce(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                        rows = len(parts[0][0]) // 2
            if not parts:
                return
            key, lo, hi = reduce(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            wanted = key[lo < hi]
            del parts, key, lo, hi
            spill.seek(0)
            # entries shrink as buckets grow in number, batches must not
            found, rows = [], 0

            def out():
                return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["key", "doc_id", "loc"])

            for size in sizes:
                keys, docs, locs = (np.frombuffer(spill.read(size), t) for t in (np.uint64, np.int64, np.int64))
                at = np.minimum(np.searchsorted(wanted, keys), max(len(wanted) - 1, 0))
                ok = wanted[at] == keys if len(wanted) else np.zeros(len(keys), bool)
                if ok.any():
                    found.append((keys[ok].view(np.int64), docs[ok], locs[ok]))
                    rows += len(found[-1][0])
                    if rows >= OUT_ROWS:
                        yield out()
                        found, rows = [], 0
            if found:
                yield out()

    return packed.repartition(F.col("bucket")).mapInArrow(run, "key long, doc_id long, loc long")


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes data[starts : starts + sizes] end to end, and where each begins."""
    begins = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - begins, sizes) + np.arange(int(sizes.sum()))], begins


def strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes data[starts : starts + sizes] end to end, for sizes that differ little: by rows of the greatest."""
    most = int(sizes.max())
    rows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(most, np.uint8)), most)[starts]
    return rows.ravel() if (sizes == most).all() else rows[np.arange(most) < sizes[:, None]]


PIECES = "key long, slot long, doc_id long, start long, more array<long>, piece binary, docs array<long>"
_LISTS = pa.list_(pa.int64())
_PIECES = pa.schema([("key", pa.int64()), ("slot", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("more", _LISTS), ("piece", pa.binary()), ("docs", _LISTS)])


def binary(data: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The strings data[begins[i] : begins[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def places_of(piece: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Different pieces, an order of the rows that puts equal ones together, and where each begins in it, with its count."""
    coded = piece.dictionary_encode()
    which = coded.indices.to_numpy()
    order = np.argsort(which, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(which[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    return coded.dictionary, order, first, np.diff(np.append(first, len(order)))


def pieces(docs: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """The bytes of the shared anchors' windows (`shared`: key, doc_id, loc, hot), by PIECES.

    A piece that a document repeats is one row; `more` has its further starts.  A hot piece
    is one row for all documents of a batch, without doc_id: `docs`, with their starts in `more`.
    """
    wanted = shared.groupBy("doc_id").agg(F.collect_list(F.struct("loc", "key", "hot")).alias("found"))
    texts = possible(docs, "doc_id", shared, "doc_id").join(wanted, "doc_id")

    def cold(doc: np.ndarray, key: np.ndarray, start: np.ndarray, piece: pa.Array) -> pa.RecordBatch:
        coded = piece.dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        order = np.lexsort((which, doc))  # stably
        new = np.concatenate([[True], (np.diff(which[order]) != 0) | (np.diff(doc[order]) != 0)])
        first = order[new]
        more = pa.nulls(len(first), _LISTS)
        if len(first) < len(order):
            counts = np.diff(np.append(np.flatnonzero(new), len(order))) - 1
            more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(start[order[~new]]), mask=pa.array(counts == 0))
        piece, key = coded.dictionary.take(pa.array(which[first])), pa.array(key[first])
        return pa.record_batch([key, key, pa.array(doc[first]), pa.array(start[first]), more, piece, pa.nulls(len(first), _LISTS)], schema=_PIECES)

    def hot(held: list[tuple]) -> pa.RecordBatch:
        docs, key, start, piece = (np.concatenate([h[i] for h in held]) if i < 3 else pa.concat_arrays([h[i] for h in held]) for i in range(4))
        unique, order, first, _ = places_of(piece)
        edges = pa.array(np.append(first, len(order)).astype(np.int32))
        none, key = pa.nulls(len(unique), pa.int64()), key[order[first]]
        # they are looked up later and may go anywhere now
        slot = key ^ (docs[order[first]] * 0x2545F4914F6CDD1D)
        docs, starts = (pa.ListArray.from_arrays(edges, pa.array(x[order])) for x in (docs, start))
        return pa.record_batch([pa.array(key), pa.array(slot), none, none, starts, unique, docs], schema=_PIECES)

    def portions(batch: pa.RecordBatch):
        """Rows of the batch whose texts have CUT_BYTES bytes together, or one, with those texts."""
        lo, held, size = 0, [], 0
        for i, t in enumerate(batch.column(1)):
            held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= CUT_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(lo, i + 1 - lo), held
                lo, held, size = i + 1, [], 0

    @tidy
    def run(batches):
        for batch in batches:
            held = []
            for rows, encoded in portions(batch):
                found = rows.column(2)
                own = np.repeat(np.arange(rows.num_rows), pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64))
                found = found.flatten()
                loc, key = found.field("loc").to_numpy(), found.field("key").to_numpy()
                apart = found.field("hot").to_numpy(zero_copy_only=False)
                ends = np.cumsum([len(t) for t in encoded])
                begins = np.concatenate([[0], ends[:-1]])
                doc, data = rows.column(0).to_numpy()[own], np.frombuffer(b"".join(encoded), np.uint8)
                for at in (~apart, apart):
                    if not at.any():
                        continue
                    start, sizes = loc[at] >> 8, (loc[at] & 255) + length - 1
                    piece = binary(strings(data, begins[own[at]] + start, sizes), np.append(0, np.cumsum(sizes)))
                    if at is apart:
                        held.append((doc[at], key[at], start, piece))
                    else:
                        yield cold(doc[at], key[at], start, piece)
            if held:
                yield hot(held)

    return texts.select("doc_id", "text", "found").mapInArrow(run, PIECES)


def earliest(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest document of every window of the different pieces, end to end, and where each piece's begin."""
    step = max(g for g in range(1, SYMBOL + 1) if length % g == 0)
    wide, at, counts = bwt.wider(data, starts, sizes, step)
    symbols, prefix = bwt.transform(wide, at, counts, length // step)
    owner, suffix = bwt.places(symbols, counts)
    at = np.flatnonzero(suffix >= length // step)
    # a shorter suffix between two of these rows shares less with both, so rows next to each other decide
    new = prefix[at] < length // step
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    owner, less = owner[at] // step, owner[at] % step
    least = np.minimum.reduceat(docs[owner], first) if len(first) else np.zeros(0, np.int64)
    windows = sizes - length + 1
    begins = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    out[begins[owner] + sizes[owner] - less - suffix[at] * step] = least[group]
    return out, begins


def may_repeat(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Whether a window of the piece may also be in another piece: its hash is."""
    n = len(data)
    if not n:
        return np.zeros(0, bool)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(BASE, n))])
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), windows)
    at = starts[owner] + np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]
    h = mix((sums[at + length] - sums[at]) * powers(pow(BASE, -1, 2**64), n)[at])
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    same = h[1:] == h[:-1]
    out = np.zeros(len(sizes), bool)
    out[owner[1:][same]] = True
    out[owner[:-1][same]] = True
    return out


def judged(piece: pa.Array, docs: np.ndarray, latest: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (piece, least and latest doc_id that has it): rows that share a window with another document, the windows of
    their piece, the earliest document of each window of the different pieces, and where each row's begin in that."""
    coded = piece.dictionary_encode()
    which, unique = coded.indices.to_numpy(), coded.dictionary
    offsets = np.frombuffer(unique.buffers()[1], np.int32)[unique.offset : unique.offset + len(unique) + 1].astype(np.int64)
    data = np.frombuffer(unique.buffers()[2], np.uint8)
    sizes = np.diff(offsets)
    least, most = np.full(len(unique), np.iinfo(np.int64).max), np.full(len(unique), np.iinfo(np.int64).min)
    np.minimum.at(least, which, docs)
    np.maximum.at(most, which, latest)
    # pieces of one document that share no window with another have nothing to lose or to give
    part = (least < most) | may_repeat(data, offsets[:-1], sizes, length)
    place = np.cumsum(part) - 1
    rows = np.flatnonzero(part[which])
    which = place[which[rows]]
    early, begins = earliest(data, offsets[:-1][part], sizes[part], least[part], length)
    return rows, (sizes[part] - length + 1)[which], early, begins[which]


def spans_of(docs: np.ndarray, windows: np.ndarray, early: np.ndarray, begins: np.ndarray, start: pa.Array, more: pa.Array, length: int) -> pa.RecordBatch:
    """(doc_id, start, end) of what rows lose: `early[begins]` has the earliest document of a row's windows."""
    n_starts = 1 + pc.fill_null(pc.list_value_length(more), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at_start = np.cumsum(n_starts) - n_starts
    starts = np.empty(int(n_starts.sum()), np.int64)
    further = np.ones(len(starts), bool)
    further[at_start] = False
    starts[at_start], starts[further] = start.to_numpy(), more.flatten().to_numpy()
    held, own = gathered(early, begins, windows)
    member = np.repeat(np.arange(len(docs)), windows)
    gone = held < docs[member]
    offset = np.arange(len(held)) - own[member]
    alike = member[1:] == member[:-1]
    first = np.flatnonzero(gone & ~np.concatenate([[False], alike & gone[:-1]]))
    last = np.flatnonzero(gone & ~np.concatenate([alike & gone[1:], [False]]))
    who = member[first]
    each = n_starts[who]
    begin, _ = gathered(starts, at_start[who], each)
    return pa.record_batch([pa.array(np.repeat(docs[who], each)), pa.array(begin + np.repeat(offset[first], each)), pa.array(begin + np.repeat(offset[last], each) + length)], names=["doc_id", "start", "end"])


def by_document(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Spans (doc_id, start, end) as a row a document (doc_id, spans), those that meet as one."""
    doc, start, end = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    changes = np.concatenate([[True], doc[1:] != doc[:-1]])
    base = (np.cumsum(changes) - 1) * (int(end.max()) + 1)  # so that a document's places are beyond those of the one before
    upto = np.maximum.accumulate(end + base)
    first = np.flatnonzero(changes | np.concatenate([[True], (start + base)[1:] > upto[:-1]]))
    last = np.append(first[1:], len(doc)) - 1
    edges = np.append(np.flatnonzero(changes[first]), len(first)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(start[first]), pa.array((upto - base)[last])], names=["start", "end"])
    return pa.record_batch([pa.array(doc[changes]), pa.ListArray.from_arrays(pa.array(edges), spans)], names=["doc_id", "spans"])


def collections(batches):
    """Tables of whole anchors, of about COLLECTION rows, from a task's batches."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]]))
    lo = 0
    while lo < len(edges) - 1:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + COLLECTION, "right")) - 1)
        yield table.take(pa.array(order[edges[lo] : edges[hi]]))
        lo = hi


def dealt(found: DataFrame, by: str, n_pieces: int) -> DataFrame:
    """Pieces met by anchor, in partitions whose number follows the pieces'; no anchor has more than HOT_MOST."""
    n = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_pieces // TASK_PIECES))
    return found.repartition(n, F.col(by))


SPANS = "doc_id long, start long, end long, piece binary, key long, docs array<long>, starts array<long>"


def repeated_spans(found: DataFrame, n_pieces: int, length: int) -> DataFrame:
    """Spans (doc_id, start, end) of bytes that a string with an earlier document covers; rows of hot pieces pass as they are."""

    @tidy
    def run(batches):
        held = []
        for batch in batches:
            hot = batch.column("doc_id").is_null()
            if pc.any(hot).as_py():
                rows = batch.filter(hot)
                none = pa.nulls(rows.num_rows, pa.int64())
                yield pa.record_batch([none, none, none, *(rows.column(n) for n in ("piece", "key", "docs", "more"))], names=["doc_id", "start", "end", "piece", "key", "docs", "starts"])
                batch = batch.filter(pc.invert(hot))
            held.append(batch)
        for table in collections(held):
            docs = table.column("doc_id").to_numpy()
            rows, windows, early, begins = judged(table.column("piece").combine_chunks(), docs, docs, length)
            at = pa.array(rows)
            out = spans_of(docs[rows], windows, early, begins, table.column("start").combine_chunks().take(at), table.column("more").combine_chunks().take(at), length)
            none = [pa.nulls(out.num_rows, t) for t in (pa.binary(), pa.int64(), _LISTS, _LISTS)]
            yield pa.record_batch([*out.columns, *none], names=["doc_id", "start", "end", "piece", "key", "docs", "starts"])

    return dealt(found, "slot", n_pieces).drop("slot").mapInArrow(run, SPANS)


def hot_spans(ws: Workspace, held: DataFrame, length: int) -> DataFrame:
    """(doc_id, spans) of the hot pieces' rows (key, piece, docs, starts), a row a document and task, or SPAN_ROWS spans of it."""
    alike = held.groupBy("key", "piece").agg(F.min(F.array_min("docs")).alias("least"), F.max(F.array_max("docs")).alias("latest"), F.count(F.lit(1)).alias("n"))

    @tidy
    def judge(batches):
        for table in collections(batches):
            piece = table.column("piece").combine_chunks()
            rows, windows, early, begins = judged(piece, table.column("least").to_numpy(), table.column("latest").to_numpy(), length)
            values, own = gathered(early, begins, windows)
            at = pa.array(rows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(own, len(values)).astype(np.int32)), pa.array(values))
            yield pa.record_batch([piece.take(at), lists, table.column("n").combine_chunks().take(at)], names=["piece", "early", "n"])

    @tidy
    def spans(batches):
        kept, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                early, counts = rows.column("early"), pc.list_value_length(rows.column("docs")).to_numpy(zero_copy_only=False)
                windows = pc.list_value_length(early).to_numpy(zero_copy_only=False).astype(np.int64)
                docs, start = rows.column("docs").flatten(), rows.column("starts").flatten()
                own = np.repeat(np.arange(rows.num_rows), counts)
                kept.append(spans_of(docs.to_numpy(), windows[own], early.flatten().to_numpy(), (np.cumsum(windows) - windows)[own], start, pa.nulls(len(docs), _LISTS), length))
                n += kept[-1].num_rows
                if n >= SPAN_ROWS:
                    yield by_document(kept)
                    kept, n = [], 0
        if n:
            yield by_document(kept)

    n_rows = held.count()
    known = ws.save(dealt(alike, "key", n_rows).mapInArrow(judge, "piece binary, early array<long>, n long"), "hot_judged")
    met = lookup(held.select("piece", "docs", "starts"), known, "piece", "n", n_rows).where("early is not null")
    return met.select("docs", "starts", "early").mapInArrow(spans, "doc_id long, spans array<struct<start: long, end: long>>")


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_removed, n_spans, kept) of the documents that lose bytes; `kept` is the bytes that stay.

    spans: doc_id with start and end, or with a list of them in `spans`.
    """
    alone = F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end")))
    lost = spans.groupBy("doc_id").agg((F.concat(alone, F.flatten(F.collect_list("spans"))) if "spans" in spans.columns else alone).alias("spans"))
    texts = possible(docs, "doc_id", spans, "doc_id").join(lost, "doc_id")

    @tidy
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                removed, runs, kept = [], [], []
                for i in range(rows.num_rows):
                    data = np.frombuffer((rows.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                    found = rows.column(2)[i].values
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, found.field("start").to_numpy(), 1)
                    np.add.at(edge, found.field("end").to_numpy(), -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed.append(int(gone.sum()))
                    runs.append(int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))))
                    kept.append(data[~gone].tobytes())
                yield pa.record_batch([rows.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_removed", "n_spans", "kept"])

    return texts.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_removed long, n_spans long, kept binary")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    if not anchor <= length <= 255:
        raise ValueError("anchor <= length <= 255")
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix")
    rows = require(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    known = ws.save(rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest")), "known")
    groups = known.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = lookup(known, groups, "digest", "n", known.count())
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)) & (F.col("n_bytes") >= length)
    whole = ws.save(met.select("doc_id", "n_bytes", "digest", copy.alias("copy")), "whole")
    n_bytes = whole.where("not copy").agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    texts = without(rows.where("doc_id is not null"), whole.where("copy").select("doc_id"), "doc_id")
    packed = packed_anchors(texts.where(F.octet_length("text") >= length), buckets, length, anchor)
    shared = ws.save(shared_anchors(packed), "shared")
    n_pieces = shared.count()
    least = min(max(HOT_LEAST, -(-n_pieces // HEAVY)), HOT_MOST)
    hot = ws.save(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("key", F.lit(True).alias("is_hot")), "hot_keys")
    n_hot = hot.count()
    flagged = shared.join(F.broadcast(hot) if n_hot <= HOT_KEYS else hot, "key", "left").select("key", "doc_id", "loc", F.col("is_hot").isNotNull().alias("hot"))
    found = ws.save(repeated_spans(pieces(rows, flagged, length), n_pieces, length), "found")
    spans = found.where("doc_id is not null").select("doc_id", "start", "end")
    if n_hot:
        spans = ws.save(spans.unionByName(hot_spans(ws, found.where("doc_id is null").select("key", "piece", "docs", "starts"), length), allowMissingColumns=True), "spans")
    ws.drop("shared")
    left = cut(rows, spans).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("left_sha256")).dropDuplicates(["doc_id"])
    empty = hashlib.sha256(b"").hexdigest()
    out = whole.join(left, "doc_id", "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("left_sha256", "digest")).alias("kept_sha256"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
