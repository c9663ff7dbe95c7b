"""WARC archives of web pages in Zstandard frames, written and read back.

An archive `.warc.zst` starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, then has one frame per record.  The reader loads the dictionary from the leading
frame, decodes frame by frame from a stream, and validates each record: version, needed
headers, Content-Length against the block, the closing line ends, and block and payload
digests.  Anything else raises ValueError.

Of pages with equal payloads of at least `min_bytes` bytes, that of the least page_id is a
response and the others are revisits that name it; smaller payloads are always responses.
Equality is that of SHA-1 and length.  Null html counts as an empty payload, a null url as an
empty target.  Rows repeated with one page_id are alike: all responses or all revisits.  A
null page_id is never the one referred to while another is there; a group of nulls only is
all responses.  An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import files
from tesserae.llm.common import Workspace, lookup, require, small_batches, spread, tidy

SKIPPABLE, ZSTD = 0x184D2A5D, 0xFD2FB528
DICTIONARY_BYTES = 16 << 10
SAMPLE_PAGES, SAMPLE_BYTES = 256, 16 << 10
ARCHIVE_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest", "WARC-Block-Digest")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    if not (identifier.startswith("<urn:page:") and identifier.endswith(">")):
        raise ValueError(f"bad record identifier {identifier!r}")
    inner = identifier[10:-1]
    return int(inner) if inner else None


def record(page_id: int | None, url: str | None, payload: bytes, revisits: int | None, is_revisit: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    target = "".join(c for c in (url or "") if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if is_revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(revisits)}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields, after validation."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of headers")
    version, *lines = head.decode("utf-8").split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"bad version {version!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header {line!r}")
        fields[name.strip().lower()] = value.strip()
    missing = [n for n in NEEDED if n.lower() not in fields]
    if missing:
        raise ValueError(f"missing headers {missing}")
    if not fields["content-length"].isdigit():
        raise ValueError("bad Content-Length")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    block = rest[:length]
    if fields["warc-block-digest"] != "sha1:" + sha1_base32(block):
        raise ValueError("bad block digest")
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP headers in the block")
    sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if len(sizes) != 1 or not sizes[0].isdigit():
        raise ValueError("bad HTTP Content-Length")
    kind, digest, refers = fields["warc-type"], fields["warc-payload-digest"], None
    if not digest.startswith("sha1:"):
        raise ValueError("bad payload digest")
    if kind == "response":
        if len(payload) != int(sizes[0]) or digest != "sha1:" + sha1_base32(payload):
            raise ValueError("payload differs from its length or digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise ValueError("bad revisit")
        refers = page_of(fields["warc-refers-to"])
    else:
        raise ValueError(f"bad type {kind!r}")
    return {"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "payload": payload if kind == "response" else None, "payload_bytes": int(sizes[0]), "payload_digest": digest[5:], "record_type": kind, "refers_to": refers}


class ArchiveWriter:
    def __init__(self, out, dictionary: bytes):
        import zstandard

        self.out, self.at = out, 0
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.squeeze = zstandard.ZstdCompressor(level=3, dict_data=held, write_checksum=True, write_content_size=True).compress
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self._write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, data: bytes) -> None:
        self._write(self.squeeze(data))

    def close(self) -> None:
        self.out.close()


def read_frames(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, one by one, from a stream that is read once."""
    import zstandard

    data = source.read(8)
    if not data:
        return
    if len(data) < 8:
        raise ValueError("truncated archive")
    magic, size = struct.unpack("<II", data)
    held = None
    if magic == SKIPPABLE:
        packed = source.read(size)
        if len(packed) != size:
            raise ValueError("truncated dictionary")
        if packed[:4] == struct.pack("<I", ZSTD):
            packed = zstandard.ZstdDecompressor().decompress(packed)
        held = zstandard.ZstdCompressionDict(packed)
        data = b""
    decoder = zstandard.ZstdDecompressor(dict_data=held)
    frame, parts = None, []
    while True:
        if not data:
            data = source.read(chunk)
            if not data:
                break
        if frame is None:
            while len(data) < 4:
                more = source.read(chunk)
                if not more:
                    raise ValueError("truncated frame")
                data += more
            if data[:4] != struct.pack("<I", ZSTD):
                raise ValueError("not a Zstandard frame")
            frame, parts = decoder.decompressobj(), []
        try:
            parts.append(frame.decompress(data))
        except zstandard.ZstdError as e:
            raise ValueError(f"bad frame: {e}") from e
        data = b""
        if frame.eof:
            data = frame.unused_data
            yield b"".join(parts)
            frame = None
    if frame is not None:
        raise ValueError("truncated frame")


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample: the first SAMPLE_BYTES characters of SAMPLE_PAGES pages of least hash.

    It only makes frames smaller: records, and what is read back, are the same with any other.
    """
    import zstandard

    ids = require(pages, "page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    rows = require(pages, "page_id", "html").join(F.broadcast(ids), "page_id").select("page_id", F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html"))
    sample = [r.html.encode() for r in rows.dropDuplicates(["page_id"]).orderBy("page_id").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in sample if len(s) >= 8]).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, first_id, is_revisit."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = require(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("html"), F.concat_ws(":", F.sha1(payload), F.octet_length(payload)).alias("same"))
    large = F.octet_length("html") >= min_bytes
    groups = rows.where(large).groupBy("same").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = lookup(rows, groups, "same", "n", pages.count())
    revisit = F.coalesce(F.col("n") > 1, F.lit(False)) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return met.select("page_id", "url", "html", "first_id", revisit.alias("is_revisit"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives below `folder` when the frame runs; save the manifest (uri, n_records) once."""
    shared = pages.sparkSession.sparkContext.broadcast(train_dictionary(pages))

    @tidy
    def run(batches):
        names, counts, archive = [], [], None
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, first_id, is_revisit = (c[i].as_py() for c in batch.columns)
                if archive is None or archive.at >= archive_bytes:
                    if archive is not None:
                        archive.close()
                    names.append(files.unique_name(folder, "pages", ".warc.zst"))
                    counts.append(0)
                    archive = ArchiveWriter(files.create(names[-1]), shared.value)
                archive.add(record(page_id, url, html.encode("utf-8"), first_id, is_revisit))
                counts[-1] += 1
        if archive is not None:
            archive.close()
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["uri", "n_records"])

    return with_revisits(pages, min_bytes).mapInArrow(run, "uri string, n_records long")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of a saved manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for."""
    columns = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"} | ({"payload": "binary"} if payloads else {})
    kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in columns.items()])

    @tidy
    def run(batches):
        for batch in batches:
            for uri, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with files.open_stream(uri) as source:
                    for data in read_frames(source):
                        rows.append({n: v for n, v in parse(data).items() if n in columns})
                        size += len(data)
                        seen += 1
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, size = [], 0
                if seen != count:
                    raise ValueError(f"{uri} has {seen} records of {count}")
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    # an archive a task
    each = spread(manifest.select("uri", "n_records"), manifest.count())
    return each.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in columns.items()))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ws = Workspace(spark, "warc")
    manifest = ws.save(write_archives(pages, ws.table("archives"), min_bytes=0), "manifest")
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
