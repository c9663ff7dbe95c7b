"""Joins on pixels, cells and features, and what is summed over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import order

#: Fixed class weights of roads.
ROAD_WEIGHTS = {
    "motorway": 1.00,
    "trunk": 1.00,
    "primary": 1.00,
    "secondary": 0.85,
    "tertiary": 0.70,
    "residential": 0.55,
    "living_street": 0.50,
    "service": 0.35,
    "pedestrian": 0.25,
    "unclassified": 0.40,
    "unknown": 0.25,
    "footway": 0.20,
    "path": 0.15,
    "track": 0.15,
    "steps": 0.15,
    "cycleway": 0.20,
    "bridleway": 0.10,
}

#: Fixed classes of areal water.
AREAL_WATER = ("bay", "canal", "fishpond", "lake", "pond", "reservoir", "river", "strait", "tidal_channel", "water")


def reference_water(features: DataFrame) -> DataFrame:
    """Areal water (class, kind, is_empty): of a listed class, a polygon or several, and not empty."""
    return features.where(F.col("class").isin(*AREAL_WATER) & F.col("kind").isin("Polygon", "MultiPolygon") & ~F.col("is_empty"))


def aligned(a: DataFrame, b: DataFrame, keys=("r", "c")) -> DataFrame:
    """Pixels of both rasters."""
    return a.join(b, list(keys))


def scatter_add(rows: DataFrame, domain: DataFrame, key: str, weight: str) -> DataFrame:
    """Sum of a weight by key over the whole key domain, zero where there is nothing."""
    sums = rows.groupBy(key).agg(F.sum(weight).alias("total"))
    return domain.select(key).distinct().join(sums, key, "left").select(key, F.coalesce("total", F.lit(0.0)).alias("total"))


def weighted_measure(features: DataFrame, weights: DataFrame, key: str = "cell") -> DataFrame:
    """Sum by cell of measure times class weight."""
    held = features.join(order.small(weights), "class", "left")
    return held.groupBy(key).agg(F.sum(F.col("measure") * F.col("weight")).alias("weighted"), F.sum("measure").alias("measure"))


def unlisted(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Classes that have no weight: must be empty before weighting."""
    return features.select("class").distinct().join(order.small(weights), "class", "left_anti")


def sample_points(points: DataFrame, px: DataFrame, west: float, north: float | Column, res: float) -> DataFrame:
    """Value of the pixel that holds each point (x, y): an equi-join on computed row and column.

    north may be a column of the points.
    """
    at = points.withColumn("r", F.floor((F.lit(north) - F.col("y")) / res).cast("int")).withColumn("c", F.floor((F.col("x") - west) / res).cast("int"))
    return at.join(px, ["r", "c"])


def tile_of(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Owning tile of a centroid: left and bottom edges belong to the tile."""
    return F.floor(x / size).cast("int"), F.floor(y / size).cast("int")


def overlap_pairs(boxes: DataFrame, res: float, least: float = 1e-8) -> DataFrame:
    """(cell, r, c, area) of boxes (cell, x0, y0, x1, y1) with the grid's pixels.

    The pixel rectangle is exploded from the box's own corners, so each box meets only its pixels.
    """
    lo = lambda c: F.floor(F.col(c) / res).cast("int")
    hi = lambda c: (F.ceil(F.col(c) / res) - 1).cast("int")
    held = boxes.where("x1 > x0 and y1 > y0")
    spread = held.withColumn("r", F.explode(F.sequence(lo("y0"), F.greatest(lo("y0"), hi("y1"))))).withColumn("c", F.explode(F.sequence(lo("x0"), F.greatest(lo("x0"), hi("x1")))))
    side = lambda a, b, k: F.greatest(F.lit(0.0), F.least(F.col(b), (F.col(k) + 1) * res) - F.greatest(F.col(a), F.col(k) * res))
    area = side("x0", "x1", "c") * side("y0", "y1", "r")
    return spread.withColumn("area", area).where(F.col("area") > least).select("cell", "r", "c", "area")


def box_overlaps(a: DataFrame, b: DataFrame, bucket: float) -> DataFrame:
    """(a_id, b_id, area) of intersecting boxes, met in shared buckets and once for each pair."""

    def spread(df: DataFrame, p: str) -> DataFrame:
        out = df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
        for k, lo, hi in (("bx", "x0", "x1"), ("by", "y0", "y1")):
            out = out.withColumn(k, F.explode(F.sequence(F.floor(F.col(f"{p}_{lo}") / bucket).cast("int"), F.floor(F.col(f"{p}_{hi}") / bucket).cast("int"))))
        return out

    w = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    h = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    met = spread(a, "a").join(spread(b, "b"), ["bx", "by"])
    # of the buckets that a pair shares, the one with its lower corner counts
    owner = (F.col("bx") == F.floor(F.greatest("a_x0", "b_x0") / bucket)) & (F.col("by") == F.floor(F.greatest("a_y0", "b_y0") / bucket))
    return met.where(owner & (w > 0) & (h > 0)).select("a_id", "b_id", (w * h).alias("area"))


def native_allocation(overlap: DataFrame, proxy: DataFrame, divisor: float | None = None, pixel_area: float | None = None, min_support: float = 1.0, tol: float = 1e-6, eps_rel: float = 1e-6, unstable_rel: float = 0.05) -> dict[str, DataFrame]:
    """Allocation by native footprints.

    overlap: cell, r, c, area, cell_radiance; proxy: r, c, h (normalised; null where missing).
    Returns `cells` (cell, kh, support, reaggregated, err, is_floor, eligible) and `pixels`
    (r, c, allocation; covered but ineligible pixels get 0).
    """
    held = overlap.join(proxy.select("r", "c", "h"), ["r", "c"], "left")
    area_h = F.when(F.col("h").isNotNull(), F.col("area"))
    cells = held.groupBy("cell").agg(F.max("cell_radiance").alias("radiance"), F.sum("area").alias("area"), F.sum(area_h).alias("area_h"), F.sum(F.col("area") * F.col("h")).alias("ah"))
    cells = cells.withColumn("kh", F.try_divide(F.col("ah"), F.col("area_h"))).withColumn("support", F.coalesce(F.try_divide(F.col("area_h"), F.col("area")), F.lit(0.0)))
    cells = cells.withColumn("is_floor", F.coalesce(F.col("kh") < eps_rel, F.lit(False))).withColumn("is_unstable", F.coalesce(F.col("kh") < unstable_rel, F.lit(False)))
    cells = cells.withColumn("eligible", F.col("radiance").isNotNull() & F.col("kh").isNotNull() & (F.col("support") >= min_support - tol))
    each = held.join(cells.select("cell", "kh", "eligible"), "cell").withColumn("value", F.when(F.col("eligible") & F.col("h").isNotNull(), F.greatest(F.lit(0.0), F.col("h") * F.col("cell_radiance") / F.greatest(F.col("kh"), F.lit(eps_rel)))))
    share = F.col("area") if pixel_area is None else F.col("area") / pixel_area
    total = F.sum(F.coalesce(F.col("value"), F.lit(0.0)) * share)
    px = each.groupBy("r", "c").agg((total / (F.sum("area") if pixel_area is None else F.lit(1.0))).alias("allocation"))
    back = overlap.select("cell", "r", "c", "area").join(px, ["r", "c"]).groupBy("cell").agg((F.sum(F.col("area") * F.col("allocation")) / F.sum("area")).alias("reaggregated"))
    cells = cells.join(back, "cell").withColumn("err", F.when(F.col("eligible"), F.col("radiance") - F.col("reaggregated")))
    return {"cells": cells.drop("area_h", "ah"), "pixels": px}


def _within(targets: DataFrame, training: DataFrame, k: int, buffer_m: float, radius: float) -> DataFrame:
    """(cell_id, near_id, distance, rank) of the k nearest training cells between buffer and radius, met in buckets of side `radius`."""
    bucket = lambda c: F.floor(F.col(c) / radius).cast("int")
    near = training.withColumn("bx", bucket("nx")).withColumn("by", bucket("ny"))
    own = targets.withColumn("bx", bucket("x_m")).withColumn("by", bucket("y_m"))
    for b in ("bx", "by"):  # the targets are spread: there are fewer of them from radius to radius
        own = own.withColumn(b, F.explode(F.sequence(F.col(b) - 1, F.col(b) + 1)))
    distance = F.sqrt((F.col("x_m") - F.col("nx")) ** 2 + (F.col("y_m") - F.col("ny")) ** 2)
    met = own.join(near, ["bx", "by"]).where(F.col("fold") != F.col("near_fold")).withColumn("distance", distance)
    met = met.where((F.col("distance") > buffer_m) & (F.col("distance") <= radius))
    first = Window.partitionBy("cell_id").orderBy("distance", "near_id")
    return met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("cell_id", "near_id", "distance", "rank")


def nearest_training(cells: DataFrame, k: int, buffer_m: float, reach_m: float) -> DataFrame:
    """(cell_id, near_id, distance, rank) of the k nearest cells of other folds beyond the buffer.

    Cells need cell_id, x_m, y_m, fold, radiance and proxy_mean; training cells have a radiance
    and a proxy of 0 or more.  Ties go to the smaller id.  The search starts with a radius a
    little beyond the buffer and doubles it, up to the reach, only for cells that are still
    short of k: cells meet those of nearby buckets, not all within reach.
    """
    training = cells.where("radiance is not null and proxy_mean >= 0").select(F.col("cell_id").alias("near_id"), F.col("x_m").alias("nx"), F.col("y_m").alias("ny"), F.col("fold").alias("near_fold"))
    short, out = cells.select("cell_id", "x_m", "y_m", "fold"), None
    radius = min(1.5 * max(buffer_m, reach_m / 64), reach_m)
    while True:
        found = _within(short, training, k, buffer_m, radius)
        if radius >= reach_m:
            return found if out is None else out.unionByName(found)
        found = order.settled(found)
        full = found.where(F.col("rank") == k).select("cell_id")
        out = (lambda x: x if out is None else out.unionByName(x))(found.join(full, "cell_id", "left_semi"))
        short = order.settled(short.join(full, "cell_id", "left_anti"))
        if short.isEmpty():
            return out
        radius = min(2 * radius, reach_m)
