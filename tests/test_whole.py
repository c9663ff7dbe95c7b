"""Whole jobs: no row of the input is left out, against brute force that has no cut."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import relational, stencil
from tesserae.plans import catalogue
from tesserae.sources.views import view

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUERIES = catalogue.queries()


def brute_overlaps(a, b):
    out = {}
    for i, ax0, ay0, ax1, ay1 in a:
        for j, bx0, by0, bx1, by1 in b:
            w, h = min(ax1, bx1) - max(ax0, bx0), min(ay1, by1) - max(ay0, by0)
            if w > 0 and h > 0:
                out[i, j] = w * h
    return out


def same(got, want):
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=2e-5) for k in want)


def test_box_overlaps_against_brute_force(spark):
    draw = random.Random(7)
    sides = [[(i, x := draw.uniform(-60, 60), y := draw.uniform(-60, 60), x + draw.uniform(1, 40), y + draw.uniform(1, 40)) for i in range(80)] for _ in range(2)]
    # boxes that end, or meet, on the lines of the buckets
    sides[0] += [(100, 0.0, 0.0, 10.0, 10.0), (101, -10.0, -10.0, 0.0, 0.0)]
    sides[1] += [(100, 10.0, 0.0, 20.0, 10.0), (101, 5.0, 5.0, 25.0, 25.0)]
    a, b = [spark.createDataFrame(x, "id int, x0 double, y0 double, x1 double, y1 double") for x in sides]
    rows = relational.box_overlaps(a, b, 10.0).collect()
    want = brute_overlaps(*sides)
    assert len(rows) == len(want) > 500
    same({(x.a_id, x.b_id): x.area for x in rows}, want)


@tables
def test_spatial_overlap_join_has_all_pairs(spark):
    cells = [(x.cell_id, x.x_m, x.y_m) for x in view(spark, SF, "cells").where("cell_id < 300").collect()]
    want = brute_overlaps([(i, x / 40, y / 40, x / 40 + 7.5, y / 40 + 12.25) for i, x, y in cells], [(i, x / 40, y / 40, (x + 750) / 40, (y + 750) / 40) for i, x, y in cells])
    out = QUERIES["spatial_overlap_join"](spark, SF)
    got = {(x.a_id, x.b_id): x.area for x in out.where("a_id < 300 and b_id < 300").collect()}
    same(got, want)
    assert {(a + b) % 2 for a, b in got} == {0, 1}
    assert out.select("b_id").distinct().count() == 1500


@tables
def test_road_segmentize_cuts_every_line_at_one_metre(spark):
    cells = [(x.x_m, x.y_m) for x in view(spark, SF, "cells").collect()]
    length = math.hypot(137, 91)
    n, want = math.ceil(length), {}
    for x, y in cells:
        for i in range(n):
            at = math.floor((y + 91 * ((i + 0.5) / n)) / 50), math.floor((x + 137 * ((i + 0.5) / n)) / 50)
            want[at] = want.get(at, 0) + length / n
    got = {(x.r, x.c): x.length for x in QUERIES["road_segmentize"](spark, SF).collect()}
    same(got, want)
    assert math.isclose(sum(got.values()), len(cells) * length, rel_tol=1e-6)


@tables
def test_building_fraction_covers_every_box(spark):
    covered = set()
    for cell in view(spark, SF, "cells").collect():
        x0, y0 = cell.x_m / 40, cell.y_m / 40
        covered |= {(r, c) for r in range(math.floor(y0 / 2), math.ceil((y0 + 12.25) / 2)) for c in range(math.floor(x0 / 2), math.ceil((x0 + 7.5) / 2))}
    want = {}
    for r, c in covered:
        want[r // 5, c // 5] = want.get((r // 5, c // 5), 0) + 1 / 25
    same({(x.r, x.c): x.fraction for x in QUERIES["building_fraction"](spark, SF).collect()}, want)


@tables
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", SF])
def test_pt_sample_join_samples_every_cell(spark, sf):
    px = {(x.r, x.c): x.base_proxy for x in view(spark, sf, "grid_px").select("r", "c", "base_proxy").collect()}
    north = (max(r for r, _ in px) + 0.5) * 10
    cells = view(spark, sf, "cells").collect()
    want = {x.cell_id: px[at] for x in cells if (at := (math.floor((north - x.y_m / 50) / 10), math.floor(x.x_m / 200 / 10))) in px}
    got = {x.cell_id: x.base_proxy for x in QUERIES["pt_sample_join"](spark, sf).collect()}
    assert len(got) == len(cells) and got.keys() == want.keys()
    assert all(got[k] is want[k] is None or math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=2e-5) for k in want)


@tables
def test_osm_geometry_builds_every_ring(spark):
    got = {x.cell_id: (x.closed, x.area) for x in QUERIES["osm_geometry"](spark, SF).collect()}
    assert got == {x.cell_id: (True, 600.0) for x in view(spark, SF, "cells").select("cell_id").collect()}
    assert len(got) == 1500


@tables
def test_band_summary_has_every_image(spark):
    takes = {}
    for x in view(spark, SF, "daily_obs").select("datatake", "source_index", "radiance", "d").collect():
        takes.setdefault(x.datatake, []).append(x)
    out = QUERIES["band_summary"](spark, SF).collect()
    assert sorted((x.datatake, x.source_index) for x in out) == sorted((k, x.source_index) for k, rows in takes.items() for x in rows)
    summaries = {(x.datatake, x.least, x.most, x.mean, x.n, x.days) for x in out}
    assert len(summaries) == len(takes)
    for k, least, most, mean, n, days in summaries:
        v = [x.radiance for x in takes[k] if x.radiance is not None]
        assert (n, days) == (len(v), len({x.d for x in takes[k]}))
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5) for a, b in zip((least, most, mean), (min(v), max(v), math.fsum(v) / n), strict=True))


def pixels_of(spark, sf, value):
    return {(x.r, x.c): x[value] for x in view(spark, sf, "grid_px").select("r", "c", value).collect()}


def indices(step, start, size, last):
    """k whose place k * step + start lies in pixels 0 to last."""
    return [k for k in range(-5, int((last + 1) * size / step) + 5) if 0 <= math.floor((k * step + start) / size) <= last]


def same_or_null(got, want):
    assert got.keys() == want.keys()
    assert all((got[k] is None and want[k] is None) or math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=2e-5) for k in want)


@tables
def test_resample_nearest_covers_the_raster(spark):
    px = pixels_of(spark, SF, "radiance")
    r1, c1 = max(r for r, _ in px), max(c for _, c in px)
    want = {(i, j): px.get((math.floor(i * 4.1 / 20), math.floor(j * 3.7 / 10))) for i in indices(4.1, 0.0, 20, r1) for j in indices(3.7, 0.0, 10, c1)}
    rows = QUERIES["resample_nearest"](spark, SF).collect()
    assert len(rows) == len(want)
    same_or_null({(x.i, x.j): x.radiance for x in rows}, want)


@tables
def test_resample_bilinear_covers_the_raster(spark):
    px = pixels_of(spark, SF, "base_proxy")
    r1, c1 = max(r for r, _ in px), max(c for _, c in px)
    want = {}
    for i in indices(0.13, 0.25, 1, r1):
        for j in indices(0.29, 0.25, 1, c1):
            y, x = i * 0.13 + 0.25, j * 0.29 + 0.25
            r, c, fy, fx = math.floor(y), math.floor(x), y - math.floor(y), x - math.floor(x)
            v = [px.get((r + a, c + b)) for a in (0, 1) for b in (0, 1)]
            w = [(1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx]
            want[i, j] = None if None in v else sum(p * q for p, q in zip(v, w, strict=True))
    rows = QUERIES["resample_bilinear"](spark, SF).collect()
    assert len(rows) == len(want)
    same_or_null({(x.i, x.j): x.value for x in rows}, want)


def test_distance_is_exact_however_far(spark):
    draw = random.Random(5)
    places = [(r, c) for r in range(3, 60) for c in range(2, 45) if draw.random() > 0.1]
    water = set(draw.sample([p for p in places if p[0] < 15 and p[1] < 12], 9))
    px = spark.createDataFrame([(r, c, (r, c) in water) for r, c in places], "r int, c int, water boolean")
    got = {(x.r, x.c): x.distance for x in stencil.exact_distance(px, F.col("water"), 10.0).collect()}
    want = {(r, c): min(math.hypot(r - a, c - b) for a, b in water) * 10 for r, c in places}
    assert max(want.values()) > 400
    same(got, want)
    assert {x.distance for x in stencil.exact_distance(px, F.lit(False), 10.0).collect()} == {None}


def test_edt_distance_has_no_radius(spark, tmp_path):
    # 100 rows of 20 pixels, with water in the first only
    spark.range(2000).selectExpr("id AS p_partkey", "CAST(IF(id = 3, 50, 1) AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2000).selectExpr("id AS l_partkey", "1.0D AS l_extendedprice", "1.0D AS l_quantity", "0.0D AS l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(x.r, x.c): x.distance for x in QUERIES["edt_distance"](spark, str(tmp_path)).collect()}
    same(got, {(r, c): math.hypot(r, c - 3) * 10 for r in range(100) for c in range(20)})
