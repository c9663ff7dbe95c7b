"""Small fixtures with known answers."""

import math

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tesserae.functions import geo, text
from tesserae.operators import pixels, quality, relational, statistics, stencil
from tesserae.plans import run_matrix
from tesserae.streaming import events

DISK = stencil.circular_kernel(20.0, 10.0)


def grid(spark, n, radiance, proxy, m=None):
    rows = [(i, j, radiance(i, j), proxy(i, j)) for i in range(n) for j in range(m or n)]
    return spark.createDataFrame(rows, "r int, c int, l double, h double")


def test_kernels():
    assert len(DISK) == 13 and math.isclose(sum(w for *_, w in DISK), 1)
    g = {(a, b): w for a, b, w in stencil.gaussian_kernel(40.0, 10.0)}
    assert math.isclose(g[0, 2] / g[0, 0], 0.5)
    box = stencil.box_kernel(34.0, 22.0, 10.0)
    assert math.isclose(sum(w for *_, w in box), 1) and len(box) == 15
    with pytest.raises(ValueError):
        stencil.normalised([])
    with pytest.raises(ValueError):
        stencil.gaussian_kernel(0, 10.0)


def test_constant_grid_is_kept(spark):
    px = pixels.normalize_mean_one(grid(spark, 15, lambda i, j: 7.0, lambda i, j: 3.0).withColumnRenamed("h", "p"), "p")
    out = {(x.r, x.c): x for x in stencil.allocate(px, DISK, "l", "h").collect()}
    assert math.isclose(out[7, 7].allocation, 7) and abs(out[7, 7].err) < 1e-9
    assert out[0, 0].is_boundary and out[0, 0].allocation is None


def test_one_missing_value_spoils_its_neighbourhood(spark):
    px = grid(spark, 15, lambda i, j: None if (i, j) == (7, 7) else 1.0, lambda i, j: 1.0)
    out = {(x.r, x.c): x for x in stencil.allocate(px, DISK, "l", "h").collect()}
    assert out[7, 7].allocation is None and out[7, 9].s_l < 1 and out[7, 9].is_invalid_l
    assert out[3, 3].is_valid


def test_negative_input_is_cut_and_recorded(spark):
    out = stencil.allocate(grid(spark, 9, lambda i, j: -2.0, lambda i, j: 1.0), DISK, "l", "h").where("r = 4 and c = 4").first()
    assert out.is_negative_input and out.is_negative_pre and out.allocation == 0


def test_zero_proxy_hole(spark):
    px = grid(spark, 15, lambda i, j: 1.0, lambda i, j: 0.0 if 4 <= i <= 10 and 4 <= j <= 10 else 1.0)
    out = stencil.allocate(px, DISK, "l", "h").where("r = 7 and c = 7").first()
    assert out.is_floor and out.is_unstable and out.is_valid and out.allocation == 0


def test_tiles_equal_the_whole(spark):
    px = grid(spark, 31, lambda i, j: math.sin(i * 3 + j) + 2, lambda i, j: 1.0, 33)
    whole = {(x.r, x.c): (x.k_l, x.s_l) for x in stencil.kernel_mean(px, DISK, ["l"]).collect()}
    tiled = {(x.r, x.c): (x.k_l, x.s_l) for x in stencil.kernel_mean_tiled(px, DISK, "l", 8).collect()}
    assert whole.keys() == tiled.keys()
    assert all(math.isclose(a, b, rel_tol=1e-9) for k in whole for a, b in zip(whole[k], tiled[k], strict=True))


def test_gain(spark):
    rows = [(0.4, 0.5), (1.0, 1.0), (2.0, None), (3.0, 0.0)]
    df = spark.createDataFrame(rows, "h double, kh double").select(pixels.gain(F.col("h"), F.col("kh"), F.lit(True), 0.25).alias("g"))
    assert [x.g for x in df.collect()] == [0.8, 1.0, None, 12.0]


@pytest.mark.parametrize(("divisor", "want"), [(None, {0: 10.0, 1: 20.0}), (4.0, {0: 10.0, 1: 20.0})])
def test_native_footprints(spark, divisor, want):
    overlap = spark.createDataFrame([(0, 0, 0, 100.0, 10.0), (0, 1, 0, 100.0, 10.0), (1, 0, 1, 100.0, 20.0), (1, 1, 1, 100.0, 20.0)], "cell int, r int, c int, area double, cell_radiance double")
    proxy = pixels.normalize_mean_one(spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 1.0), (1, 1, 3.0)], "r int, c int, p double"), "p", "h", divisor)
    out = relational.native_allocation(overlap, proxy, pixel_area=100.0)
    assert {x.c: x.allocation for x in out["pixels"].collect()} == want
    assert all(abs(x.err) < 1e-9 for x in out["cells"].collect())


def test_quality_bits_and_contracts(spark):
    bits = 1 | 5 << 1 | 3 << 4 | 2 << 6 | 1 << 8 | 1 << 9 | 1 << 10
    df = spark.createDataFrame([(str(bits),), (None,), ("x",)], "qf string")
    got = [tuple(x)[1:] for x in quality.decode_qa(df).collect()]
    assert got == [(1, 5, 3, 2, 1, 1, 1), (None,) * 7, (None,) * 7]
    good = 2 << 4
    rows = [(0, good, 0), (0, good, None), (1, good, 0), (0, good | 1, 0), (0, good, 1), (0, 1 << 4, 0)]
    obs = spark.createDataFrame(rows, "mqf int, qf int, snow int")
    verdict = lambda v: [x.ok for x in obs.select(quality.accepted(F.col("mqf"), F.col("qf"), F.col("snow"), v).alias("ok")).collect()]
    assert verdict("strict") == [True, False, False, False, False, False]
    assert verdict("broad") == [True, False, True, False, False, True]
    with pytest.raises(ValueError):
        quality.accepted(F.lit(0), F.lit(0), F.lit(0), "other")


def test_water_variants(spark):
    row = Row(base=0.6, persistent_w=0.2, spectral_w=0.5, persistent_mask=True, infra=True)
    out = pixels.water_proxy(spark.createDataFrame([row]), "base", 0.0).first()
    got = [round(out[f"proxy_{v}"], 6) for v in pixels.WATER_VARIANTS]
    assert got == [0.6, 0.12, 0.3, 0.06, 0.0, 0.6]
    with pytest.raises(Exception, match="negative"):
        pixels.water_proxy(spark.createDataFrame([row]).withColumn("base", F.lit(-1.0)), "base").collect()
    with pytest.raises(ValueError):
        pixels.water_modifier("other", *[F.lit(1.0)] * 4)


def test_region_ratio_and_bands(spark):
    df = spark.createDataFrame([(2.0, 1.0), (4.0, 1.0), (-3.0, 5.0), (None, 9.0)], "d double, a double")
    out = statistics.region_ratio(df, "d", "a").first()
    assert (out.n, out.direct_sum, out.allocated_sum) == (3, 6, 7) and math.isclose(out.reduction, -1 / 6)
    px = grid(spark, 7, lambda i, j: 1.0, lambda i, j: 0.5 if j < 2 else 1.5, 9)
    far = stencil.nearest_distance(px, F.col("c") < 2, 12, 10.0)
    bands = [(x.n, x.mean_diff) for x in statistics.distance_bands(far, "distance", "l", "h", (0.0, 10.0, 30.0)).orderBy("band").collect()]
    assert bands == [(14, -0.5), (7, 0.5), (14, 0.5), (28, 0.5)]
    with pytest.raises(ValueError):
        statistics.band_of(F.lit(1.0), (5.0, 1.0))


def test_block_means(spark):
    px = grid(spark, 4, lambda i, j: float(4 * i + j), lambda i, j: 1.0)
    got = {(x.br, x.bc): x.mean for x in stencil.block_mean(px, "l", 2, True).collect()}
    assert got == {(0, 0): 2.5, (0, 1): 4.5, (1, 0): 10.5, (1, 1): 12.5}
    holes = px.withColumn("l", F.when((F.col("r") > 1) & (F.col("c") > 1), None).otherwise(F.col("l")))
    assert {x.mean for x in stencil.block_mean(holes, "l", 2, False).collect()} == {2.5, 4.5, 10.5, None}


def test_deciles_with_ties(spark):
    values = [1.0] * 30 + [2.0] * 30 + [float(i) for i in range(3, 43)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    got = {x.x: x.d for x in statistics.decile(df, "x", "d").collect()}
    want = pd.qcut(pd.Series(values), 10, labels=False, duplicates="drop")
    assert got == dict(zip(values, want, strict=True)) | {None: None}


def test_spearman_of_ties_and_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (2.0, 4.0), (3.0, None)], "a double, b double")
    assert math.isclose(statistics.spearman(df, "a", "b").first().spearman, 1)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert statistics.spearman(flat, "a", "b").first().spearman is None


def test_quadratic_trend_is_taken_out(spark):
    df = spark.range(50).select((F.col("id") * 100.0).alias("radius")).withColumn("v", 3 + 0.01 * F.col("radius") - 0.000002 * F.col("radius") ** 2)
    assert df.transform(lambda d: statistics.quadratic_residual(d, "v", "radius", "e")).agg(F.max(F.abs("e"))).first()[0] < 1e-9


def test_heldout_line(spark):
    rows = [(i, i * 600.0, 0.0, 0.5 + i / 80, 10 + i / 4, f"{int(i * 600 // 5000)}_0") for i in range(80)]
    cells = statistics.folds(spark.createDataFrame(rows, "cell_id int, x_m double, y_m double, proxy_mean double, radiance double, block_id string"))
    near = relational.nearest_training(cells, 3, 500.0, 20000.0)
    assert near.agg(F.min("distance")).first()[0] > 500
    assert statistics.heldout_predictions(cells, near, 3).where("neighbors_only is null").count() == 0


def test_utm_of_known_points(spark):
    df = spark.createDataFrame([(0.0, 3.0), (45.0, 9.0)], "lat double, lon double")
    x, y = geo.to_utm(F.col("lat"), F.col("lon"), geo.utm_zone(F.col("lon")))
    got = [tuple(r) for r in df.select(x, y, geo.utm_epsg(F.col("lat"), F.col("lon"))).collect()]
    assert got[0][:2] == pytest.approx((500000.0, 0.0)) and got[1][:2] == pytest.approx((500000.0, 4982950.40), abs=0.01)
    assert [g[2] for g in got] == [32631, 32632]


def test_names_and_dates(spark):
    df = spark.createDataFrame([(" São Paulo -- Centre! ", "40.7, -74.0"), ("x", "no")], "a string, b string")
    lat, lon = text.lat_lon(F.col("b"))
    got = [tuple(r) for r in df.select(text.slug(F.col("a")), lat, lon).collect()]
    assert got == [("s_o_paulo_centre", 40.7, -74.0), ("x", None, None)]
    n = spark.range(1).select(F.size(text.days(F.to_date(F.lit("2024-01-11")), F.to_date(F.lit("2024-04-20"))))).first()[0]
    assert n == 100


def test_matrices_and_tiles(spark):
    assert run_matrix.matrix(spark, spark.createDataFrame([("a", True), ("b", False)], "city string, has_broad boolean")).groupBy("city").count().orderBy("city").collect() == [("a", 23), ("b", 22)]
    tiles = run_matrix.core_windows(spark, 13, 15, 6).collect()
    assert len(tiles) == 9 and sum(t.h * t.w for t in tiles) == 13 * 15
    assert run_matrix.regular_tiles(0.0, 0.0, 0.2, 0.1, 0.1, spark).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"k{i % 3}", float(i % 7) - 3) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id int, event_type string, value double")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = events.read_stream(spark, f"{tmp_path}/in", df.schema)
    events.stream_metrics(stream, f"{tmp_path}/sums", f"{tmp_path}/check")
    got = {tuple(r) for r in events.finish(spark.read.parquet(f"{tmp_path}/sums")).collect()}
    assert got == {tuple(r) for r in events.finish(events.mergeable(df)).collect()}
