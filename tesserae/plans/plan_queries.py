"""Queries of run matrices, tilings, registries, sinks, manifests and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import order, pixels, statistics, stencil
from tesserae.plans import contract, raster_queries, run_matrix
from tesserae.plans.registry import Registry
from tesserae.sources import artifacts, geoparquet
from tesserae.streaming import events as streaming

R = Registry()


def t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


# --- registries, scans and selections
CITIES = "SELECT n_nationkey, n_name AS city, r_name AS country, CAST(n_nationkey * 2 AS VARCHAR) || '.5, ' || CAST(n_nationkey * 3 - 30 AS VARCHAR) || '.25' AS center, n_nationkey % 5 + 1 AS osm_coverage FROM nation JOIN region ON r_regionkey = n_regionkey"


def cities(s, d):
    held = t(s, d, "nation").join(F.broadcast(t(s, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return held.selectExpr("n_nationkey", "n_name AS city", "r_name AS country", "concat(n_nationkey * 2, '.5, ', n_nationkey * 3 - 30, '.25') AS center", "n_nationkey % 5 + 1 AS osm_coverage")


SLUG = "trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g'), '_')"
R.add("src_city_registry", lambda s, d: artifacts.registry(cities(s, d), text.slug, text.lat_lon), f"SELECT {SLUG.format('country')} || '_' || {SLUG.format('city')} AS city_id, city, country, CAST(split_part(center, ',', 1) AS DOUBLE) AS lat, CAST(trim(split_part(center, ',', 2)) AS DOUBLE) AS lon, osm_coverage FROM ({CITIES})", (), "lat lon")
R.add("src_projected_scan", lambda s, d: t(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "SELECT c_custkey, c_nationkey, c_acctbal FROM customer", (), "c_acctbal")
R.add("src_native_cells", lambda s, d, c: c.select("cell_id", (F.col("x_m") - 231.5).alias("west"), (F.col("y_m") - 231.5).alias("south"), (F.col("x_m") + 231.5).alias("east"), (F.col("y_m") + 231.5).alias("north"), "radiance").withColumn("area", (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))), "SELECT cell_id, x_m - 231.5 AS west, y_m - 231.5 AS south, x_m + 231.5 AS east, y_m + 231.5 AS north, radiance, 463.0 * 463.0 AS area FROM cells", ("cells",), "west south east north radiance area")
R.add("city_select", lambda s, d: s.createDataFrame([(0, "NATION_17"), (1, "NATION_3"), (2, "NATION_8")], "ordinal int, city string").transform(lambda o: cities(s, d).join(F.broadcast(o), "city").select("ordinal", "city", "country").orderBy("ordinal")), f"SELECT ordinal, city, country FROM ({CITIES}) JOIN (VALUES (0, 'NATION_17'), (1, 'NATION_3'), (2, 'NATION_8')) AS o(ordinal, city) USING (city)")
NOTE = "coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END), ''), nullif(trim(CASE WHEN o_orderkey % 2 = 0 THEN '  ' END), ''), o_orderstatus) AS note"
R.add("city_notes", lambda s, d: t(s, d, "orders").selectExpr("o_orderkey", NOTE), f"SELECT o_orderkey, {NOTE} FROM orders")
R.add("city_holdout", lambda s, d: run_matrix.city_holdout(t(s, d, "nation").select("n_name"), "n_name", 0.2, 20260728), "SELECT n_name FROM nation QUALIFY row_number() OVER (ORDER BY sha256('20260728|' || n_name), n_name) <= greatest(1, round_even(count(*) OVER () * 0.2, 0))")
R.add("s2_link_join", lambda s, d: t(s, d, "orders").select("o_orderkey", "o_orderstatus").join(t(s, d, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_discount").alias("score")), "o_orderkey", "left"), "SELECT o_orderkey, o_orderstatus, l_discount AS score FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 2", (), "score")

# --- dates
R.add("date_seq", lambda s, d: s.range(1).select(F.explode(text.days(F.to_date(F.lit("2024-01-11")), F.to_date(F.lit("2024-04-20")))).alias("day")), "SELECT CAST(unnest(generate_series(DATE '2024-01-11', DATE '2024-04-19', INTERVAL 1 DAY)) AS DATE) AS day")
R.add("date_months", lambda s, d: s.sql("SELECT greatest(m, date'2024-01-11') AS start, least(last_day(m), date'2024-04-19') AS stop FROM (SELECT explode(sequence(date'2024-01-01', date'2024-04-19', interval 1 month)) AS m)"), "SELECT CAST(greatest(m, DATE '2024-01-11') AS DATE) AS start, CAST(least(last_day(m), DATE '2024-04-19') AS DATE) AS stop FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-04-19', INTERVAL 1 MONTH)) AS DATE) AS m)")
R.add("date_sample", lambda s, d: s.range(7).select(F.date_add(F.to_date(F.lit("2024-01-11")), F.rint(F.col("id") * (99 / 6)).cast("int")).alias("day")), "SELECT DATE '2024-01-11' + CAST(round_even(i * (99.0 / 6), 0) AS INT) AS day FROM (SELECT unnest(range(7)) AS i)")

# --- matrices and tilings
TWO = "city string, has_broad boolean"
R.add("cfg_matrix", lambda s, d: run_matrix.matrix(s, s.createDataFrame([("usa_new_york", True), ("india_delhi", False)], TWO)).groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"), F.count_if(F.col("kernel") == "gaussian").alias("gaussian"), F.count_if(F.col("kind") == "native").alias("native"), F.max("position").alias("last")), "SELECT * FROM (VALUES ('usa_new_york', CAST(23 AS BIGINT), CAST(23 AS BIGINT), CAST(6 AS BIGINT), CAST(2 AS BIGINT), 22), ('india_delhi', 22, 22, 6, 2, 21)) AS v(city, n, names, gaussian, native, last)")
R.add("cfg_broad", lambda s, d: run_matrix.configurations(s).where("contract = 'broad'").select("name", "proxy", "water"), "SELECT 'built_form_primary__combined_soft__circular_mean_reference__broad_qa' AS name, 'built_form_primary' AS proxy, 'combined_soft' AS water")
R.add("cfg_eligible", lambda s, d: run_matrix.configurations(s).where("contract = 'strict' AND (kind IN ('direct', 'uniform') OR kernel = 'circular_mean_reference')").groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT * FROM (VALUES ('direct', CAST(1 AS BIGINT)), ('uniform', 1), ('stationary', 12)) AS v(kind, n)")
R.add("tile_windows", lambda s, d: run_matrix.core_windows(s, 13, 15, 6), "SELECT CAST(a AS INT) AS top, CAST(b AS INT) AS \"left\", CAST(least(6, 13 - a) AS INT) AS h, CAST(least(6, 15 - b) AS INT) AS w FROM (VALUES (0), (6), (12)) x(a), (VALUES (0), (6), (12)) y(b)")
R.add("tile_regular", lambda s, d: run_matrix.regular_tiles(0.0, 0.0, 0.2, 0.1, 0.1, s), "SELECT * FROM (VALUES (0.0, 0.0, 0.1, 0.1), (0.1, 0.0, 0.2, 0.1)) AS v(west, south, east, north)", (), "west south east north")
R.add("tile_quad", lambda s, d: run_matrix.quadrants(run_matrix.regular_tiles(0.0, 0.0, 0.2, 0.1, 0.1, s)), "SELECT q AS quadrant, west + (q % 2) * 0.05 AS west, south + (q // 2) * 0.05 AS south, west + 0.05 + (q % 2) * 0.05 AS east, south + 0.05 + (q // 2) * 0.05 AS north FROM (VALUES (0.0, 0.0), (0.1, 0.0)) AS v(west, south), (VALUES (0), (1), (2), (3)) AS k(q)", (), "west south east north")
TILES = "SELECT DISTINCT CAST(floor(r / 8.0) AS INT) AS tile_r, CAST(floor(c / 8.0) AS INT) AS tile_c FROM grid_px"


def resume(s, d, px):
    """Two thirds of the tiles have a record, half of these of another content or not complete."""
    tiles = artifacts.tile_checksums(px.select("r", "c", "infra"), 8).select(F.col("tile_row").alias("tile_r"), F.col("tile_col").alias("tile_c"), "checksum")
    turn = F.col("tile_r") + F.col("tile_c")
    records = tiles.where(turn % 3 < 2).withColumn("status", F.when(turn % 6 == 1, "running").otherwise("complete")).withColumn("checksum", F.when(turn % 6 == 4, F.lit("stale")).otherwise(F.col("checksum")))
    return run_matrix.to_do(tiles, records, ["tile_r", "tile_c"]).select("tile_r", "tile_c")


R.add("resume_anti", resume, f"SELECT * FROM ({TILES}) WHERE (tile_r + tile_c) % 3 = 2 OR (tile_r + tile_c) % 6 IN (1, 4)", ("grid_px",))
R.add("kernel_circular", lambda s, d: s.createDataFrame(stencil.circular_kernel(500.0, 100.0), "dr int, dc int, w double"), "WITH a AS (SELECT CAST(i AS INT) AS dr, CAST(j AS INT) AS dc FROM (SELECT unnest(range(-5, 6)) AS i), (SELECT unnest(range(-5, 6)) AS j) WHERE i * i + j * j <= 25) SELECT dr, dc, 1.0 / (SELECT count(*) FROM a) AS w FROM a", (), "w")
R.add("kernel_gaussian", lambda s, d: s.createDataFrame(stencil.gaussian_kernel(750.0, 100.0), "dr int, dc int, w double"), "WITH z AS (SELECT 750.0 / (2 * sqrt(2 * ln(2.0))) / 100 AS sg), a AS (SELECT CAST(i AS INT) AS dr, CAST(j AS INT) AS dc, exp(-(i * i + j * j) / (2 * sg * sg)) AS w FROM z, (SELECT unnest(range(-13, 14)) AS i), (SELECT unnest(range(-13, 14)) AS j)) SELECT dr, dc, w / (SELECT sum(w) FROM a) AS w FROM a", (), "w")
R.add("kernel_native", lambda s, d: s.createDataFrame(stencil.box_kernel(34.0, 22.0, 10.0), "dr int, dc int, w double"), "WITH a AS (SELECT CAST(i AS INT) AS dr, CAST(j AS INT) AS dc, greatest(0.0, least(11.0, (i + 0.5) * 10) - greatest(-11.0, (i - 0.5) * 10)) * greatest(0.0, least(17.0, (j + 0.5) * 10) - greatest(-17.0, (j - 0.5) * 10)) AS w FROM (SELECT unnest(range(-3, 4)) AS i), (SELECT unnest(range(-3, 4)) AS j)) SELECT dr, dc, w / (SELECT sum(w) FROM a) AS w FROM a WHERE w > 0", (), "w")
R.add("kernel_halo", lambda s, d: s.createDataFrame([("disk", max(abs(a) for a, _, _ in stencil.circular_kernel(500.0, 100.0)), 10), ("gaussian", max(abs(a) for a, _, _ in stencil.gaussian_kernel(1500.0, 100.0)), 20)], "kernel string, required int, available int").withColumn("missing", F.greatest(F.lit(0), F.col("required") - F.col("available"))), "SELECT * FROM (VALUES ('disk', 5, 10, 0), ('gaussian', 26, 20, 6)) AS v(kernel, required, available, missing)")
RULES = {"rows": "n > 0", "finite": "mean IS NOT NULL", "range": "most <= 60"}
R.add("audit_ready", lambda s, d, px: run_matrix.readiness(px.groupBy(F.floor(F.col("r") / 8).cast("int").alias("tile")).agg(F.count("radiance").alias("n"), F.avg("radiance").alias("mean"), F.max("radiance").alias("most")), RULES).select("tile", "errors", "ready"), "SELECT CAST(floor(r / 8.0) AS INT) AS tile, CASE WHEN max(radiance) <= 60 THEN CAST([] AS VARCHAR[]) ELSE ['range'] END AS errors, max(radiance) <= 60 AS ready FROM grid_px GROUP BY 1", ("grid_px",))
R.add("audit_bbox", lambda s, d, c: c.select("cell_id", F.coalesce(F.col("x_m").between(500, 20000) & F.col("y_m").between(500, 20000) & F.col("radiance").isNotNull(), F.lit(False)).alias("inside")), "SELECT cell_id, coalesce(x_m BETWEEN 500 AND 20000 AND y_m BETWEEN 500 AND 20000 AND radiance IS NOT NULL, false) AS inside FROM cells", ("cells",))
R.add("audit_contract", lambda s, d, px: px.agg(F.count_if(F.col("persistent_w").isNull() | ~F.col("persistent_w").between(0, 1)).alias("bad_persistent"), F.count_if(F.col("spectral_w").isNull() | ~F.col("spectral_w").between(0, 1)).alias("bad_spectral"), F.count_if(F.col("base_proxy") < 0).alias("negative_proxy")), "SELECT count(*) FILTER (persistent_w IS NULL OR persistent_w NOT BETWEEN 0 AND 1) AS bad_persistent, count(*) FILTER (spectral_w IS NULL OR spectral_w NOT BETWEEN 0 AND 1) AS bad_spectral, count(*) FILTER (base_proxy < 0) AS negative_proxy FROM grid_px", ("grid_px",))



def contracts(s, d):
    """Settings, sound and with one change each, with what the contract says of them."""
    rows = [(name, *contract.verdict(config)) for name, config in contract.variants(contract.EXAMPLE)]
    return s.createDataFrame(rows, "variant string, valid boolean, problem string")


R.add("config_contract", contracts, contract.VERDICTS_SQL)

# --- manifests and closeouts
MANIFEST = '[{"city":"ny","pixels":100,"configs":[{"name":"direct","valid":90,"mae":1.5},{"name":"s2","valid":80,"mae":1.25}]},{"city":"delhi","pixels":50,"configs":[{"name":"direct","valid":45,"mae":2.5}]}]'
SHAPE = "array<struct<city:string,pixels:bigint,configs:array<struct<name:string,valid:bigint,mae:double>>>>"


def flat(s):
    held = s.createDataFrame([(MANIFEST,)], "manifest string").select(F.explode(F.from_json("manifest", SHAPE)).alias("m"))
    return held.select("m.city", "m.pixels", F.explode("m.configs").alias("k")).select("city", "k.name", (F.col("k.valid") / F.col("pixels")).alias("valid_fraction"), "k.mae")


FLAT = "VALUES ('ny', 'direct', 0.9, 1.5), ('ny', 's2', 0.8, 1.25), ('delhi', 'direct', 0.9, 2.5)"
R.add("cfg_flatten", lambda s, d: flat(s), f"SELECT * FROM ({FLAT}) AS v(city, name, valid_fraction, mae)", (), "valid_fraction mae")
R.add("cfg_water", lambda s, d: flat(s).alias("a").join(flat(s).where("name = 'direct'").select("city", F.col("mae").alias("ref")), "city").select("city", "name", (F.col("mae") - F.col("ref")).alias("change")), f"SELECT a.city, a.name, a.mae - b.mae AS change FROM ({FLAT}) AS a(city, name, v, mae) JOIN ({FLAT}) AS b(city, name, v, mae) ON a.city = b.city AND b.name = 'direct'", (), "change")


def kernel_pairs(s):
    k = run_matrix.configurations(s).where("kind = 'stationary' AND water = 'combined_soft' AND contract = 'strict'")
    a, b = (k.where(F.col("proxy") == p).select("kernel", F.col("fwhm"), F.col("name").alias(n)) for p, n in zip(run_matrix.PROXIES, ("built", "s2"), strict=True))
    return a.join(b.select(F.col("kernel").alias("k2"), F.col("fwhm").alias("f2"), "s2"), (F.col("kernel") == F.col("k2")) & F.col("fwhm").eqNullSafe(F.col("f2"))).select("kernel", "fwhm", "built", "s2")


R.add("proxy_pairs", lambda s, d: kernel_pairs(s), "SELECT kernel, fwhm, 'built_form_primary__combined_soft__' || k AS built, 's2_only__combined_soft__' || k AS s2 FROM (VALUES ('circular_mean_reference', CAST(NULL AS DOUBLE), 'circular_mean_reference'), ('gaussian', 750, 'gaussian_fwhm_750m'), ('gaussian', 1000, 'gaussian_fwhm_1000m'), ('gaussian', 1500, 'gaussian_fwhm_1500m')) AS v(kernel, fwhm, k)", (), "fwhm")
R.add("json_tags", lambda s, d: t(s, d, "region").select("r_regionkey", F.to_json(F.map_from_arrays(F.array(F.lit("key"), F.lit("name")), F.array(F.col("r_regionkey").cast("string"), F.lower("r_name")))).alias("tags")), "SELECT r_regionkey, '{\"key\":\"' || r_regionkey || '\",\"name\":\"' || lower(r_name) || '\"}' AS tags FROM region")


def headlines(px, c, names):
    parts = {
        "raster": px.agg(F.lit("mean_radiance").alias("metric"), F.avg("radiance").alias("value")),
        "cells": c.agg(F.lit("mean_cell_radiance").alias("metric"), F.avg("radiance").alias("value")),
        "support": px.agg(F.lit("supported").alias("metric"), F.avg(F.col("base_proxy").isNotNull().cast("double")).alias("value")),
    }
    out = None
    for n in names:
        row = parts[n].select(F.lit(n).alias("evidence"), "*")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


HEAD = {"raster": "SELECT 'raster' AS evidence, 'mean_radiance' AS metric, avg(radiance) AS value FROM grid_px", "cells": "SELECT 'cells' AS evidence, 'mean_cell_radiance' AS metric, avg(radiance) AS value FROM cells", "support": "SELECT 'support' AS evidence, 'supported' AS metric, avg(CASE WHEN base_proxy IS NOT NULL THEN 1.0 ELSE 0.0 END) AS value FROM grid_px"}
for key, names in (("headline_v1", ("raster", "cells")), ("headline_v2", ("raster", "cells", "support"))):
    R.add(key, lambda s, d, px, c, names=names: headlines(px, c, names), " UNION ALL ".join(HEAD[n] for n in names), ("grid_px", "cells"), "value")
R.add("nb_water_delta", lambda s, d, px: px.agg(F.avg("radiance").alias("direct"), F.avg(F.when(F.col("occ") < 90, F.col("radiance"))).alias("land")).select(((F.col("land") - F.col("direct")) / F.col("direct") * 100).alias("percent")), "SELECT (avg(CASE WHEN occ < 90 THEN radiance END) - avg(radiance)) / avg(radiance) * 100 AS percent FROM grid_px", ("grid_px",), "percent")
R.add("cutout_metrics", lambda s, d, px: px.where("radiance is not null").withColumn("key", F.concat_ws("__", F.lit("dense"), F.when(F.col("infra"), "built").otherwise("open"))).groupBy("key").agg(*statistics.error_metrics(F.col("radiance") - F.col("base_proxy") * 60), F.avg("radiance").alias("m")).select(F.split("key", "__")[0].alias("role"), F.split("key", "__")[1].alias("layer"), "n", "mae", (F.col("mae") / F.col("m")).alias("nmae")), "SELECT 'dense' AS role, CASE WHEN infra THEN 'built' ELSE 'open' END AS layer, count(radiance - base_proxy * 60) AS n, avg(abs(radiance - base_proxy * 60)) AS mae, avg(abs(radiance - base_proxy * 60)) / avg(radiance) AS nmae FROM grid_px WHERE radiance IS NOT NULL GROUP BY 1, 2", ("grid_px",), "mae nmae")
BUNDLE = ["radiance", "base_proxy", "occ", "persistent_w", "spectral_w"]
R.add("ee_bundle_select", lambda s, d, px: px.select("r", "c", *[F.coalesce(F.col(b), F.lit(-9999.0)).alias(b) for b in BUNDLE]), f"SELECT r, c, {', '.join(f'coalesce({b}, -9999.0) AS {b}' for b in BUNDLE)} FROM grid_px", ("grid_px",), " ".join(BUNDLE))
COAST = "SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c, j - 100 - 20 * sin(i / 25.0) AS offshore, CASE WHEN j - 100 - 20 * sin(i / 25.0) > 0 THEN 0.0 ELSE exp(-abs(j - 100 - 20 * sin(i / 25.0)) / 40) END AS proxy FROM (SELECT unnest(range(201)) AS i), (SELECT unnest(range(201)) AS j)"


def coast(s, d):
    grid = s.range(201 * 201).select(F.floor(F.col("id") / 201).cast("int").alias("r"), (F.col("id") % 201).cast("int").alias("c"))
    held = grid.withColumn("offshore", F.col("c") - 100 - 20 * F.sin(F.col("r") / 25.0))
    return held.withColumn("proxy", F.when(F.col("offshore") > 0, 0.0).otherwise(F.exp(-F.abs("offshore") / 40)))


R.add("fixture_coastline", coast, COAST, (), "offshore proxy")


# --- sinks
def shared(s, name):
    return f"{order.shared_dir(s)}/{name}-{uuid.uuid4().hex}"


LAYERS = ["allocation", "err", "kl", "kh", "s_l", "s_h", "g"]


def bundle(s, d, px):
    """All layers of an allocation as one product with a manifest, read back by the manifest's names."""
    path = shared(s, "product")
    h = pixels.normalize_mean_one(px, "base_proxy", "h")
    made = stencil.allocate(h, stencil.plus_kernel(), "radiance", "h").select(F.lit("ny").alias("city"), F.lit("structural").alias("config"), "r", "c", *LAYERS)
    manifest = artifacts.write_bundle(made, path, 32, {"kernel": "plus", "claim": "analysis only"})
    names = [r["name"] for r in manifest.where("kind = 'layer'").collect()]
    return s.read.parquet(f"{path}/pixels").select("r", "c", *names, "tile_row")


ALLOC = raster_queries.alloc_sql(raster_queries.K5, "h")
R.add("sink_bundle", bundle, f"WITH {ALLOC} SELECT r, c, {', '.join(LAYERS)}, CAST(floor(r / 32.0) AS INT) AS tile_row FROM z", ("grid_px",), " ".join(LAYERS))


def features(s, d, c):
    """Boxes of cells as a feature file with its geometry's metadata, read back."""
    path = shared(s, "features")
    boxes = c.select(F.col("cell_id").cast("string").alias("id"), F.col("x_m").alias("x0"), F.col("y_m").alias("y0"), (F.col("x_m") + 30).alias("x1"), (F.col("y_m") + 20).alias("y1"))
    manifest = s.createDataFrame(geoparquet.write_boxes(boxes, path).collect(), geoparquet.MANIFEST)  # a row a file
    geoparquet.check(manifest)
    return geoparquet.read(s, path).select("id", F.hex("geometry").alias("wkb"))


R.add("sink_geoparquet", features, None, ("cells",))


def metrics(s, d, px):
    path = shared(s, "metrics")
    a = px.agg(F.lit("pixels").alias("name"), F.count(F.lit(1)).alias("n"))
    b = px.agg(F.lit("valid").alias("name"), F.count("radiance").alias("n"), F.sort_array(F.collect_set((F.col("c") % 2).cast("int"))).alias("kinds"))
    artifacts.write_metrics([a, b], path)
    return s.read.csv(path, header=True, schema="name string, n long, kinds string")


R.add("sink_metrics", metrics, "SELECT 'pixels' AS name, count(*) AS n, NULL AS kinds FROM grid_px UNION ALL SELECT 'valid', count(radiance), '[0,1]' FROM grid_px", ("grid_px",))


def geometry(s, d, c):
    """Closed rings from ordered corners, with area and whether they close."""
    corners = c.select("cell_id", F.array(*[F.struct((F.col("x_m") + a).alias("x"), (F.col("y_m") + b).alias("y")) for a, b in ((0.0, 0.0), (30.0, 0.0), (30.0, 20.0), (0.0, 20.0), (0.0, 0.0))]).alias("ring"))
    pair = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda p, q: p.x * q.y - q.x * p.y)
    return corners.select("cell_id", (F.element_at("ring", 1) == F.element_at("ring", -1)).alias("closed"), F.abs(F.aggregate(pair, F.lit(0.0), lambda a, v: a + v) / 2).alias("area"))


RING = "[(x_m, y_m), (x_m + 30, y_m), (x_m + 30, y_m + 20), (x_m, y_m + 20), (x_m, y_m)]"
R.add("osm_geometry", geometry, f"WITH g AS (SELECT cell_id, {RING} AS ring FROM cells), p AS (SELECT cell_id, ring[1] = ring[5] AS closed, unnest(range(1, 5)) AS i, ring FROM g) SELECT cell_id, bool_and(closed) AS closed, abs(sum(ring[i][1] * ring[i + 1][2] - ring[i + 1][1] * ring[i][2])) / 2 AS area FROM p GROUP BY cell_id", ("cells",), "area", digits=3)

# --- streams
R.add("events_daily_window", lambda s, d: streaming.daily_window(t(s, d, "events")), "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(value) AS total, max(value) AS most FROM events GROUP BY 1, 2", (), "total most")


def stream(s, d):
    schema = t(s, d, "events").schema
    sums, check = shared(s, "sums"), shared(s, "stream")
    # a pattern, as a stream's source is a set of files and this table is one
    streaming.stream_metrics(streaming.read_stream(s, f"{d}/events.parque[t]", schema), sums, check)
    return streaming.finish(s.read.parquet(sums))


R.add("stream_metrics", stream, "SELECT event_type, count(value) AS n, avg(value) AS bias, avg(abs(value)) AS mae, sqrt(avg(value * value)) AS rmse FROM events GROUP BY event_type", (), "bias mae rmse")
