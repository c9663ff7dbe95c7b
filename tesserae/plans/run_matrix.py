"""Run matrices, tilings, resume and readiness as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import order
from tesserae.operators.pixels import WATER_VARIANTS

#: Fixed names and values of the configurations.
PROXIES = ("built_form_primary", "s2_only")
PRIMARY = "combined_soft"
FWHM = (750.0, 1000.0, 1500.0)
DISK = "circular_mean_reference"


def configurations(spark: SparkSession) -> DataFrame:
    """position, name, kind, proxy, water, kernel, fwhm, contract, cities: every configuration in its order."""
    proxies = spark.createDataFrame(list(enumerate(PROXIES)), "p int, proxy string")
    waters = spark.createDataFrame(list(enumerate(WATER_VARIANTS)), "w int, water string")
    widths = spark.createDataFrame(list(enumerate(FWHM)), "g int, fwhm double")
    fixed = spark.createDataFrame([(0, "direct_upsample", "direct", None), (1, "uniform_normalized_convolution", "uniform", DISK)], "position int, name string, kind string, kernel string")
    fixed = fixed.select("position", "name", "kind", F.lit(None).cast("string").alias("proxy"), F.lit(None).cast("string").alias("water"), "kernel", F.lit(None).cast("double").alias("fwhm"))
    # products of dimension tables of a few rows each: the matrix itself
    disks = proxies.crossJoin(waters).select((2 + F.col("p") * len(WATER_VARIANTS) + F.col("w")).alias("position"), F.concat_ws("__", "proxy", "water", F.lit(DISK)).alias("name"), F.lit("stationary").alias("kind"), "proxy", "water", F.lit(DISK).alias("kernel"), F.lit(None).cast("double").alias("fwhm"))
    at = 2 + len(PROXIES) * len(WATER_VARIANTS)
    wide = proxies.crossJoin(widths).select((at + F.col("p") * len(FWHM) + F.col("g")).alias("position"), F.format_string(f"%s__{PRIMARY}__gaussian_fwhm_%dm", F.col("proxy"), F.col("fwhm").cast("int")).alias("name"), F.lit("stationary").alias("kind"), "proxy", F.lit(PRIMARY).alias("water"), F.lit("gaussian").alias("kernel"), "fwhm")
    at += len(PROXIES) * len(FWHM)
    native = proxies.select((at + F.col("p")).alias("position"), F.concat_ws("__", "proxy", F.lit(PRIMARY), F.lit("native_vnp_footprint")).alias("name"), F.lit("native").alias("kind"), "proxy", F.lit(PRIMARY).alias("water"), F.lit("native_vnp_footprint").alias("kernel"), F.lit(None).cast("double").alias("fwhm"))
    strict = fixed.unionByName(disks).unionByName(wide).unionByName(native).withColumn("contract", F.lit("strict")).withColumn("all_cities", F.lit(True))
    broad = disks.where((F.col("proxy") == PROXIES[0]) & (F.col("water") == PRIMARY)).withColumns({"position": F.lit(at + len(PROXIES)), "name": F.concat("name", F.lit("__broad_qa")), "contract": F.lit("broad"), "all_cities": F.lit(False)})
    return strict.unionByName(broad)


def matrix(spark: SparkSession, cities: DataFrame) -> DataFrame:
    """Configurations by city (city_id, has_broad)."""
    return cities.join(F.broadcast(configurations(spark))).where(F.col("all_cities") | F.col("has_broad")).drop("all_cities", "has_broad")


def core_windows(spark: SparkSession, height: int, width: int, tile: int) -> DataFrame:
    """Row-major windows that cover height x width once, the last ones ragged."""
    rows = spark.range(-(-height // tile)).select((F.col("id") * tile).cast("int").alias("top"))
    cols = spark.range(-(-width // tile)).select((F.col("id") * tile).cast("int").alias("left"))
    return rows.crossJoin(cols).select("top", "left", F.least(F.lit(tile), height - F.col("top")).alias("h"), F.least(F.lit(tile), width - F.col("left")).alias("w"))


def regular_tiles(west: float, south: float, east: float, north: float, step: float, spark: SparkSession) -> DataFrame:
    """Tiles of a box in degrees, cut at its edge."""
    nx, ny = (max(1, int(-(-(b - a) // step)) if abs((b - a) / step - round((b - a) / step)) > 1e-9 else round((b - a) / step)) for a, b in ((west, east), (south, north)))
    xs = spark.range(nx).select((F.lit(west) + F.col("id") * step).alias("west"))
    ys = spark.range(ny).select((F.lit(south) + F.col("id") * step).alias("south"))
    return ys.crossJoin(xs).select("west", "south", F.least(F.lit(east), F.col("west") + step).alias("east"), F.least(F.lit(north), F.col("south") + step).alias("north"))


def quadrants(boxes: DataFrame) -> DataFrame:
    """Four quarters of each box."""
    mx, my = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    part = lambda n, w, s, e, t: F.struct(F.lit(n).alias("quadrant"), w.alias("west"), s.alias("south"), e.alias("east"), t.alias("north"))
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    return boxes.select(F.explode(F.array(part(0, w, s, mx, my), part(1, mx, s, e, my), part(2, w, my, mx, n), part(3, mx, my, e, n))).alias("q")).select("q.*")


def to_do(requested: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """Requested tiles (keys, checksum) without a completed record of the same keys, checksum and status."""
    done = completed.where("status = 'complete'").select(*keys, "checksum")
    return requested.join(done, [*keys, "checksum"], "left_anti")


def city_holdout(cities: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """The cities held out: a share of them, one at least, drawn by a seeded digest of their names."""
    if not 0 <= fraction < 1:
        raise ValueError("fraction must be in [0, 1)")
    drawn = cities.withColumn("_draw", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256))
    n = cities.count() if fraction else 0
    return order.numbered(drawn, [F.col("_draw"), F.col(key)], "_place").where(F.col("_place") <= (max(1, round(n * fraction)) if n else 0)).drop("_draw", "_place")


def readiness(catalog: DataFrame, rules: dict[str, str]) -> DataFrame:
    """`errors` (names of failed rules; a null condition fails) and `ready` of each record."""
    failed = [F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(name)) for name, c in rules.items()]
    return catalog.withColumn("errors", F.array_compact(F.array(*failed))).withColumn("ready", F.size("errors") == 0)
