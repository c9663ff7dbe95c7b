"""Rounding and turns as the independent engine has them, on values where another way differs."""

import hashlib
import math
import random
from fractions import Fraction
from itertools import accumulate

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae.functions import geo
from tesserae.plans import catalogue, registry

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def engine(path, *names):
    held = duckdb.connect()
    for n in names:
        held.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{path}/{n}.parquet/*.parquet')")
    return held


@pytest.mark.parametrize("digits", [3, 6])
def test_doubles_are_rounded_as_in_the_other_engine(spark, digits):
    rows = [(k * 10.0 ** -(digits + 1) * sign,) for k in range(5, 60000, 10) for sign in (1, -1)] + [(x,) for x in (None, 0.5198375, 1e305, -1e22, float("nan"), float("inf"), -0.0)]
    df = spark.createDataFrame(rows, "v double")
    got = [r[0] for r in df.select(registry.rounded_to(F.col("v"), digits)).collect()]
    held = duckdb.connect()
    held.register("t", df.toArrow())
    want = [r[0] for r in held.execute(f"SELECT round(v, {digits}) + 0.0 FROM t").fetchall()]
    assert list(map(repr, got)) == list(map(repr, want))


def pixel_tables(spark, path, prices):
    """part and lineitem: one pixel for each list of prices."""
    rows = [(k, i, float(p)) for k, each in enumerate(prices) for i, p in enumerate(each)]
    spark.createDataFrame([(k, 1) for k in range(len(prices))], "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    lines = spark.createDataFrame(rows, "l_partkey long, l_linenumber int, l_extendedprice double")
    lines.coalesce(1).selectExpr("*", "1.0D AS l_quantity", "0.0D AS l_discount").write.parquet(f"{path}/lineitem.parquet")


def test_tile_checksums_round_halves_as_the_sql(spark, tmp_path):
    pixel_tables(spark, tmp_path, [[k + 0.5] for k in range(640)])
    held = engine(tmp_path, "part", "lineitem")
    want = {r[:2]: r[2:] for r in held.execute(f"SELECT tile_row, tile_col, checksum, n FROM ({SQL['tile_checksum']})").fetchall()}
    got = QUERIES["tile_checksum"](spark, str(tmp_path)).collect()
    assert {(x.tile_row, x.tile_col): (x.checksum, x.n) for x in got} == want


def test_tile_checksums_do_not_depend_on_the_order_of_a_sum(spark, tmp_path):
    draw = random.Random(0)
    prices = [draw.randrange(1, 9999999) / 100 for _ in range(19)]
    prices.append((1000 - sum(round(x * 100) for x in prices)) % 2000 / 100)  # the exact mean ends in a half
    orders = [prices, sorted(prices), sorted(prices, reverse=True)]
    assert len({list(accumulate(x))[-1] / 20 / 1e3 * 1e3 % 1 < 0.5 for x in orders}) == 2
    found = []
    for name, each in zip("abc", orders, strict=True):
        pixel_tables(spark, tmp_path / name, [each])
        found.append([tuple(r) for r in QUERIES["tile_checksum"](spark, str(tmp_path / name)).collect()])
    assert found[0] == found[1] == found[2]


def test_tile_checksums_are_those_of_exact_means(spark, tmp_path):
    """Whatever a sum of doubles makes of means that are exact halves."""
    draw = random.Random(1)
    cents = [[draw.randrange(1, 9999999) for _ in range(19)] for _ in range(8)]
    for each in cents:
        each.append((1000 - sum(each)) % 2000)  # of 20 prices, so the mean ends in a half
    pixel_tables(spark, tmp_path, [[x / 100 for x in each] for each in cents])
    halves = [Fraction(sum(each), 2000) for each in cents]
    assert all(x.denominator == 2 for x in halves)
    text = ";".join(f"0,{k},{'null' if k == 5 else (x.numerator + 1) // 2}" for k, x in enumerate(halves))
    got = [tuple(r) for r in QUERIES["tile_checksum"](spark, str(tmp_path)).select("checksum", "n").collect()]
    assert got == [(hashlib.sha256(text.encode()).hexdigest(), 8)]


def test_utm_keeps_the_turn_of_its_longitudes(spark, tmp_path):
    # cells of 60 times the customers reach several turns
    spark.range(0, 900000, 8111).selectExpr("id AS c_custkey", "0.0D AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(5).selectExpr("id AS o_custkey", "1.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    want = {r[0]: r[1:] for r in engine(tmp_path, "customer", "orders").execute(f"SELECT cell_id, x, y, lat, lon FROM ({SQL['geo_utm']})").fetchall()}
    got = {r[0]: tuple(r[1:]) for r in QUERIES["geo_utm"](spark, str(tmp_path)).select("cell_id", "x", "y", "lat", "lon").collect()}
    assert got.keys() == want.keys() and max(x[3] for x in want.values()) > 720
    sure = 0
    for k, x in got.items():
        lat, lon = math.radians(want[k][2]), want[k][3]
        if math.atanh(abs(math.cos(lat) * math.sin(math.radians(lon - 177)))) < 3.3 or lon < 177:  # nearer to the pole of the projection, its series has several inverses
            assert x == pytest.approx(want[k], rel=1e-9, abs=0.0011), k
            sure += 1
    assert sure > 100


def test_tile_names_are_never_cut(spark, tmp_path):
    pixel_tables(spark, tmp_path, [[1.0]] * 5000)
    assert QUERIES["tile_id"](spark, str(tmp_path)).count() == 5000


def test_utm_by_the_pole_of_a_projection(spark, tmp_path):
    """Where the series takes several places to one, the place that it came from; elsewhere the inverse stands alone."""
    # around the equator, 90 degrees from the meridian 177 of the last zone
    places = [(lat / 10, 267 + lon / 10) for lat in range(-60, 61, 3) for lon in range(-60, 61, 3)]
    df = spark.createDataFrame(places, "lat double, lon double").withColumn("zone", geo.utm_zone(F.col("lon")))
    lat, lon, zone = (F.col(x) for x in ("lat", "lon", "zone"))
    x, y = geo.to_utm(lat, lon, zone)
    back = geo.from_utm(x, y, zone, lat < 0, (lat, lon))
    plain = geo.from_utm(x, y, zone, lat < 0)
    got = df.select(lat, lon, back[0], geo.same_turn(back[1], lon), plain[0], geo.same_turn(plain[1], lon), geo.one_to_one(lat, lon, zone)).collect()
    for r in got:
        assert r[2:4] == pytest.approx(r[:2], abs=1e-6)
        assert not r[6] or r[4:6] == pytest.approx(r[:2], abs=1e-6)
    assert (0.0, 267.0) in {tuple(r[:2]) for r in got} and {r[6] for r in got} == {True, False}
