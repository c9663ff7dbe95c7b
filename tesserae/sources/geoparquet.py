"""Feature files: Parquet with geometries as well-known binary and their description in the files' metadata.

Tasks write the files with names of their own and return them; the manifest of names says which
files count, so those of lost or repeated attempts are never read.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format.
VERSION, ENCODING, CRS = "1.1.0", "WKB", "OGC:CRS84"
MANIFEST = "uri string, n long"


def described(kinds: list[str]) -> bytes:
    return json.dumps({"version": VERSION, "primary_column": "geometry", "columns": {"geometry": {"encoding": ENCODING, "geometry_types": kinds, "crs": CRS}}}).encode()


def box_rings(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> pa.Array:
    """Each box as a polygon of one closed ring: order mark, type 3, one ring, five points."""
    ring = np.stack([x0, y0, x1, y0, x1, y1, x0, y1, x0, y0], axis=1).astype("<f8")
    head = np.frombuffer(b"\x01" + np.array([3, 1, 5], "<u4").tobytes(), np.uint8)
    rows = np.concatenate([np.broadcast_to(head, (len(ring), len(head))), ring.view(np.uint8).reshape(len(ring), -1)], axis=1)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def write_boxes(boxes: DataFrame, folder: str) -> DataFrame:
    """Write boxes (id, x0, y0, x1, y1) below `folder` when the frame runs, which must be once; returns the manifest."""

    def run(batches):
        names, counts, out = [], [], None
        schema = pa.schema([("id", pa.string()), ("geometry", pa.binary())]).with_metadata({"geo": described(["Polygon"])})
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                uri = f"{folder}/features-{uuid.uuid4().hex}.parquet"
                fs, path = pafs.FileSystem.from_uri(uri)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = pq.ParquetWriter(fs.open_output_stream(path), schema, compression="zstd")
                names.append(uri)
                counts.append(0)
            out.write_table(pa.table([batch.column(0), box_rings(*(batch.column(i).to_numpy() for i in range(1, 5)))], schema=schema))
            counts[-1] += batch.num_rows
        if out is not None:
            out.close()
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["uri", "n"])

    return boxes.select("id", "x0", "y0", "x1", "y1").where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").mapInArrow(run, MANIFEST)


def check(manifest: DataFrame) -> None:
    """Raises unless every file of a saved manifest describes its geometry and has its rows."""

    def run(batches):
        for batch in batches:
            for uri, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(uri)
                held = pq.read_metadata(path, filesystem=fs)
                geo = json.loads((held.metadata or {}).get(b"geo", b"{}"))
                if held.num_rows != n or geo.get("columns", {}).get("geometry", {}).get("encoding") != ENCODING:
                    raise ValueError(f"{uri} isn't what its manifest says")
            yield batch

    manifest.mapInArrow(run, MANIFEST).write.format("noop").mode("overwrite").save()


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("id string, geometry binary").parquet(folder)
