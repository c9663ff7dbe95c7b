"""Sources and sinks: registries, raster products by tile, metrics, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CITY_SCHEMA = "`City` string, `Country` string, `Lat/lon center` string, `OSM coverage (1-5)` int"


def city_registry(spark: SparkSession, path: str) -> DataFrame:
    """City CSV with an explicit schema: slug id, parsed centre, source row number from 2."""
    from tesserae.functions.text import lat_lon, slug

    raw = spark.read.schema(CITY_SCHEMA).csv(path, header=True)
    return registry(raw.select(F.col("City").alias("city"), F.col("Country").alias("country"), F.col("Lat/lon center").alias("center"), F.col("OSM coverage (1-5)").alias("osm_coverage")), slug, lat_lon)


def registry(raw: DataFrame, slug, lat_lon) -> DataFrame:
    lat, lon = lat_lon(F.col("center"))
    return raw.select(F.concat_ws("_", slug(F.col("country")), slug(F.col("city"))).alias("city_id"), "city", "country", lat.alias("lat"), lon.alias("lon"), "osm_coverage")


def write_product(pixels: DataFrame, path: str, tile: int = 512) -> None:
    """Wide pixels partitioned by city, configuration and tile; only written partitions are replaced."""
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    out = pixels.withColumn("tile_row", at("r")).withColumn("tile_col", at("c"))
    keys = ["city", "config", "tile_row", "tile_col"]
    out.repartition(*keys).sortWithinPartitions(*keys, "r", "c").write.option("partitionOverwriteMode", "dynamic").partitionBy(*keys).mode("overwrite").parquet(path)


def write_bundle(made: DataFrame, path: str, tile: int, tags: dict[str, str]) -> DataFrame:
    """All layers of `made` (city, config, r, c, layers) as one product below `path`, with a manifest of its layers and tags.

    The manifest (kind, name, rows, filled, value) is written last, so a product without one isn't complete.
    """
    spark = made.sparkSession
    write_product(made, f"{path}/pixels", tile)
    layers = [c for c in made.columns if c not in ("city", "config", "r", "c")]
    held = spark.read.parquet(f"{path}/pixels").agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in layers]).first()
    rows = [("layer", c, held["rows"], held[c], None) for c in layers] + [("tag", k, None, None, v) for k, v in sorted(tags.items())]
    kinds = "kind string, name string, rows long, filled long, value string"
    spark.createDataFrame(rows, kinds).write.json(f"{path}/manifest")
    return spark.read.schema(kinds).json(f"{path}/manifest")


def write_metrics(rows: list[DataFrame], path: str) -> None:
    """Metric tables of different columns as one folder of CSV files, nested values as JSON."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    nested = {c: F.to_json(c) for c, t in out.dtypes if t.startswith(("array", "struct", "map"))}
    out.withColumns(nested).write.csv(path, header=True, mode="overwrite")


def tile_checksums(pixels: DataFrame, tile: int) -> DataFrame:
    """(tile_row, tile_col, checksum, n): SHA-256 of each tile's rows as text in row-major order, nulls as null.

    pixels: r, c and columns of integers or text; a tile has at most tile * tile rows.
    """
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in pixels.columns])
    rows = F.array_sort(F.collect_list(F.struct("r", "c", line.alias("line"))))
    held = pixels.groupBy(at("r").alias("tile_row"), at("c").alias("tile_col")).agg(rows.alias("rows"), F.count(F.lit(1)).alias("n"))
    return held.select("tile_row", "tile_col", F.sha2(F.concat_ws(";", F.col("rows.line")), 256).alias("checksum"), "n")
