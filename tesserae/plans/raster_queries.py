"""Queries of pixels, observations, stencils and allocations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import order, pixels, quality, relational, statistics, stencil
from tesserae.plans.registry import Registry
from tesserae.sources import artifacts

R = Registry()
KEYS = ["r", "c"]
PLUS = stencil.plus_kernel()
DISK = stencil.circular_kernel(20.0, 10.0)
EDGES = (0.0, 20.0, 50.0, 100.0)


def values(kernel) -> str:
    return ", ".join(f"({dr}, {dc}, CAST({w!r} AS DOUBLE))" for dr, dc, w in kernel)


K5 = f"k AS (SELECT * FROM (VALUES {values(PLUS)}) AS t(dr, dc, w))"
K13 = f"k AS (SELECT * FROM (VALUES {values(DISK)}) AS t(dr, dc, w))"


def normal(px):
    return pixels.normalize_mean_one(px, "base_proxy", "h")


NORMAL = "px AS (SELECT *, base_proxy / (SELECT avg(base_proxy) FROM grid_px) AS h FROM grid_px)"

# --- scans and per-pixel expressions
R.add("px_join", lambda s, d, px: relational.aligned(px.select(*KEYS, "radiance"), px.where("persistent_mask").select(*KEYS, "base_proxy")), "SELECT a.r, a.c, a.radiance, b.base_proxy FROM grid_px a JOIN grid_px b ON a.r = b.r AND a.c = b.c WHERE b.persistent_mask", ("grid_px",), "radiance base_proxy")
R.add(
    "px_inputs",
    lambda s, d, px: px.select(*KEYS, F.nullif(F.coalesce("radiance", F.lit(-9999.0)), F.lit(-9999.0)).alias("radiance"), pixels.clamp(F.coalesce("persistent_w", F.lit(1.0))).alias("persistent_w"), pixels.clamp(F.coalesce("spectral_w", F.lit(1.0))).alias("spectral_w"), (F.col("radiance").isNotNull() & (F.col("occ") >= 10)).alias("valid")),
    "SELECT r, c, radiance, least(1.0, greatest(0.0, coalesce(persistent_w, 1.0))) AS persistent_w, least(1.0, greatest(0.0, coalesce(spectral_w, 1.0))) AS spectral_w, radiance IS NOT NULL AND occ >= 10 AS valid FROM grid_px",
    ("grid_px",),
    "radiance persistent_w spectral_w",
)
BANDS = "base_proxy * 0.4 AS b3, radiance / 60.0 AS b4, base_proxy AS b8, radiance / 40.0 AS b11"


def bands(px):
    return px.selectExpr("r", "c", *BANDS.split(", "))


INDEX_SQL = f"b AS (SELECT r, c, {BANDS} FROM grid_px), i AS (SELECT *, (b8 - b4) / (b8 + b4 + 1e-6) AS ndvi, (b11 - b8) / (b11 + b8 + 1e-6) AS ndbi, (b3 - b11) / (b3 + b11 + 1e-6) AS mndwi FROM b)"
R.add("s2_indices", lambda s, d, px: pixels.indices(bands(px)).select(*KEYS, "ndvi", "ndbi", "mndwi"), f"WITH {INDEX_SQL} SELECT r, c, ndvi, ndbi, mndwi FROM i", ("grid_px",), "ndvi ndbi mndwi")


def unit(x, a, b):
    return f"CASE WHEN {x} IS NOT NULL THEN least(1.0, greatest(0.0, ({x} - ({a})) / ({b} - ({a})))) END"


COMP_SQL = f"{INDEX_SQL}, q AS (SELECT r, c, {unit('ndbi', -0.25, 0.35)} AS built, 1 - {unit('ndvi', 0.2, 0.8)} AS lowveg, 1 - {unit('mndwi', 0.0, 0.5)} AS specwater FROM i)"
R.add("s2_components", lambda s, d, px: pixels.components(pixels.indices(bands(px))).select(*KEYS, "built", "lowveg", "specwater", "base"), f"WITH {COMP_SQL} SELECT *, built * lowveg AS base FROM q", ("grid_px",), "built lowveg specwater base")
R.add(
    "s2_proxy",
    lambda s, d, px: pixels.normalize_mean_one(pixels.components(pixels.indices(bands(px))).withColumn("raw", pixels.affine_floor(F.col("base") * F.col("specwater"), 0.05)), "raw", "proxy").select(*KEYS, "raw", "proxy"),
    f"WITH {COMP_SQL}, w AS (SELECT r, c, 0.05 + 0.95 * (built * lowveg * specwater) AS raw FROM q) SELECT r, c, raw, raw / (SELECT avg(raw) FROM w) AS proxy FROM w",
    ("grid_px",),
    "raw proxy",
)
R.add(
    "s2_clear_filter",
    lambda s, d: quality.clear_sky(s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "1 - l_discount * 6 AS cs_cdf", "CAST(l_quantity % 12 AS INT) AS scl", "l_tax AS b2", "l_tax AS b3", "nullif(l_tax, 0.04) AS b4", "l_tax AS b8", "l_tax AS b11", "l_tax AS b12")).select("l_orderkey", "l_linenumber", "cs_cdf"),
    "SELECT l_orderkey, l_linenumber, 1 - l_discount * 6 AS cs_cdf FROM lineitem WHERE 1 - l_discount * 6 >= 0.60 AND CAST(l_quantity % 12 AS INT) NOT IN (1, 3, 8, 9, 10, 11) AND l_tax <> 0.04",
    (),
    "cs_cdf",
)
R.add(
    "water_layers",
    lambda s, d, px: px.select(*KEYS, *[pixels.persistent_water(F.col("occ"), F.col("radiance").isNotNull(), m).alias(f"w_{m}") for m in ("soft", "hard", "none")], ((F.col("occ") >= 90) & F.col("radiance").isNotNull()).alias("mask")),
    "SELECT r, c, CASE WHEN radiance IS NULL THEN 1.0 ELSE 1 - least(1.0, greatest(0.0, occ / 90.0)) END AS w_soft, CASE WHEN radiance IS NULL THEN 1.0 WHEN occ < 90 THEN 1.0 ELSE 0.0 END AS w_hard, 1.0 AS w_none, occ >= 90 AND radiance IS NOT NULL AS mask FROM grid_px",
    ("grid_px",),
    "w_soft w_hard w_none",
)
MODS = {"no_water_prior": "1.0", "persistent_only_soft": "persistent_w", "spectral_only_soft": "spectral_w", "combined_soft": "persistent_w * spectral_w", "combined_hard_persistent_sensitivity_only": "spectral_w * CASE WHEN persistent_mask THEN 0.0 ELSE 1.0 END", "soft_with_mapped_infrastructure_override": "CASE WHEN infra THEN 1.0 ELSE persistent_w * spectral_w END"}
WATER = ", ".join(f"0.05 + 0.95 * (base_proxy * ({m})) AS proxy_{v}" for v, m in MODS.items())
WCOLS = " ".join(f"proxy_{v}" for v in MODS)
R.add("water_variants", lambda s, d, px: pixels.water_proxy(px, "base_proxy").select(*KEYS, *WCOLS.split()), f"SELECT r, c, {WATER} FROM grid_px", ("grid_px",), WCOLS, digits=9)
R.add("built_proxy", lambda s, d, px: px.select(*KEYS, pixels.built_proxy(F.col("radiance"), F.lit(60.0), F.col("occ") * 300).alias("proxy")), "SELECT r, c, 0.7 * sqrt(least(1.0, greatest(0.0, CASE WHEN radiance IS NOT NULL THEN radiance / 60.0 END))) + CASE WHEN radiance IS NULL THEN NULL ELSE 0.3 * least(1.0, greatest(0.0, occ * 300 / 20000.0)) END AS proxy FROM grid_px", ("grid_px",), "proxy")
R.add("alloc_direct", lambda s, d, px: pixels.direct(px).select(*KEYS, "allocation"), "SELECT r, c, radiance AS allocation FROM grid_px", ("grid_px",), "allocation")
R.add("proxy_normalize", lambda s, d, px: normal(px).agg(F.count("h").alias("n"), F.avg("base_proxy").alias("mean_before"), F.avg("h").alias("mean_after")), f"WITH {NORMAL} SELECT count(h) AS n, avg(base_proxy) AS mean_before, avg(h) AS mean_after FROM px", ("grid_px",), "mean_before mean_after")
R.add(
    "citywide_norm",
    lambda s, d, px: pixels.water_proxy(px, "base_proxy").selectExpr(f"stack({len(MODS)}, {', '.join(f'{v!r}, proxy_{v}' for v in MODS)}) AS (variant, proxy)").groupBy("variant").agg(F.sum("proxy").alias("total"), F.count("proxy").alias("n"), F.avg("proxy").alias("mean")),
    f"WITH w AS (SELECT {WATER} FROM grid_px), u AS ({' UNION ALL '.join(f'SELECT {v!r} AS variant, proxy_{v} AS proxy FROM w' for v in MODS)}) SELECT variant, sum(proxy) AS total, count(proxy) AS n, avg(proxy) AS mean FROM u GROUP BY variant",
    ("grid_px",),
    "total mean",
)

# --- stencils and allocation
MEAN_SQL = "m AS (SELECT s.r - k.dr AS r, s.c - k.dc AS c, sum(k.w) AS g, sum(k.w * s.l) AS nl, sum(CASE WHEN s.l IS NOT NULL THEN k.w END) AS sl, sum(k.w * s.h) AS nh, sum(CASE WHEN s.h IS NOT NULL THEN k.w END) AS sh FROM src s CROSS JOIN k GROUP BY 1, 2)"
ONE = "least(1.0, greatest(0.0, coalesce({}, 0.0)))"
R.add("kernel_mean", lambda s, d, px: stencil.kernel_mean(px, DISK, ["radiance"]).select(*KEYS, "k_radiance", "s_radiance", "g"), f"WITH {K13}, src AS (SELECT r, c, radiance AS l, base_proxy AS h FROM grid_px), {MEAN_SQL} SELECT r, c, CASE WHEN coalesce(sl, 0) > 1.1920929e-07 THEN nl / sl END AS k_radiance, {ONE.format('sl')} AS s_radiance, {ONE.format('g')} AS g FROM src JOIN m USING (r, c)", ("grid_px",), "k_radiance s_radiance g")
R.add("kernel_mean_tiled", lambda s, d, px: stencil.kernel_mean_tiled(px, DISK, "radiance", 8), f"WITH {K13}, src AS (SELECT r, c, radiance AS l, base_proxy AS h FROM grid_px), {MEAN_SQL} SELECT r, c, CASE WHEN coalesce(sl, 0) > 1.1920929e-07 THEN nl / sl END AS k_radiance, {ONE.format('sl')} AS s_radiance FROM src JOIN m USING (r, c)", ("grid_px",), "k_radiance s_radiance")


def alloc_sql(kernel: str, h: str, support: str = "1") -> str:
    return f"""{kernel}, {NORMAL}, src AS (SELECT r, c, radiance AS l, {h} AS h FROM px), {MEAN_SQL},
    a AS (SELECT r, c, l, h, CASE WHEN coalesce(sl, 0) > 1.1920929e-07 THEN nl / sl END AS kl, CASE WHEN coalesce(sh, 0) > 1.1920929e-07 THEN nh / sh END AS kh, {ONE.format('sl')} AS s_l, {ONE.format('sh')} AS s_h, {ONE.format('g')} AS g FROM src JOIN m USING (r, c)),
    v AS (SELECT *, coalesce(kh < 1e-6, false) AS is_floor, coalesce(kh < 0.05, false) AS is_unstable, g < 1 - 1e-6 AS is_boundary, s_l < g - 1e-6 AS is_invalid_l, s_h < g - 1e-6 AS is_invalid_h, coalesce(l < 0, false) AS is_negative_input,
        h IS NOT NULL AND kl IS NOT NULL AND kh IS NOT NULL AND least(s_l, s_h, g) >= {support} - 1e-6 AS is_valid FROM a),
    p AS (SELECT *, CASE WHEN is_valid THEN h * kl / greatest(kh, 1e-6) END AS pre_clip FROM v),
    f AS (SELECT *, coalesce(pre_clip < 0, false) AS is_negative_pre, CASE WHEN pre_clip IS NOT NULL THEN greatest(pre_clip, 0.0) END AS allocation FROM p),
    b AS (SELECT s.r - k.dr AS r, s.c - k.dc AS c, sum(k.w * s.allocation) AS na, sum(CASE WHEN s.allocation IS NOT NULL THEN k.w END) AS sa FROM f s CROSS JOIN k GROUP BY 1, 2),
    z AS (SELECT f.*, CASE WHEN coalesce(sa, 0) > 1.1920929e-07 THEN na / sa END AS reaggregated, CASE WHEN l IS NOT NULL AND least({ONE.format('sa')}, g) >= {support} - 1e-6 THEN l - na / sa END AS err FROM f JOIN b USING (r, c))"""


def structural(px, kernel=PLUS, **how):
    return stencil.allocate(normal(px), kernel, "radiance", "h", **how)


MASKS = "is_floor is_unstable is_boundary is_invalid_l is_invalid_h is_negative_input is_negative_pre is_valid".split()
R.add("alloc_structural", lambda s, d, px: structural(px).select(*KEYS, "allocation", "err"), f"WITH {alloc_sql(K5, 'h')} SELECT r, c, allocation, err FROM z", ("grid_px",), "allocation err")
R.add("alloc_structural_disk", lambda s, d, px: structural(px, DISK).select(*KEYS, "allocation", "err"), f"WITH {alloc_sql(K13, 'h')} SELECT r, c, allocation, err FROM z", ("grid_px",), "allocation err")
#: 1257 taps, more than the raster is wide, so the support asked for is less.
WIDE = stencil.circular_kernel(200.0, 10.0)
KWIDE = "ki AS (SELECT CAST(i AS INT) AS dr, CAST(j AS INT) AS dc FROM (SELECT unnest(range(-20, 21)) AS i), (SELECT unnest(range(-20, 21)) AS j) WHERE i * i + j * j <= 400), k AS (SELECT dr, dc, 1.0 / (SELECT count(*) FROM ki) AS w FROM ki)"
R.add("alloc_structural_wide", lambda s, d, px: structural(px, WIDE, min_support=0.3).select(*KEYS, "allocation", "err", *MASKS), f"WITH {alloc_sql(KWIDE, 'h', '0.3')} SELECT r, c, allocation, err, {', '.join(MASKS)} FROM z", ("grid_px",), "allocation err")
R.add("alloc_uniform", lambda s, d, px: stencil.uniform(px, PLUS, "radiance").select(*KEYS, "allocation", "err"), f"WITH {alloc_sql(K5, '1.0')} SELECT r, c, allocation, err FROM z", ("grid_px",), "allocation err")
R.add("alloc_consistency", lambda s, d, px: structural(px).select(*KEYS, "reaggregated", "err"), f"WITH {alloc_sql(K5, 'h')} SELECT r, c, reaggregated, err FROM z", ("grid_px",), "reaggregated err")
R.add("alloc_masks", lambda s, d, px: structural(px).select(*KEYS, *MASKS), f"WITH {alloc_sql(K5, 'h')} SELECT r, c, {', '.join(MASKS)} FROM z", ("grid_px",))
LAYERS = "l h kl kh s_l s_h g pre_clip allocation reaggregated err"
R.add("alloc_layers", lambda s, d, px: structural(px).where("r >= 2 and c between 2 and 17").select(*KEYS, *LAYERS.split(), *MASKS), f"WITH {alloc_sql(K5, 'h')} SELECT r, c, {', '.join(LAYERS.split() + MASKS)} FROM z WHERE r >= 2 AND c BETWEEN 2 AND 17", ("grid_px",), LAYERS)
R.add("alloc_gain", lambda s, d, px: structural(px).select(*KEYS, pixels.gain(F.col("h"), F.col("kh"), F.col("is_valid"), 1e-6).alias("gain")), f"WITH {alloc_sql(K5, 'h')} SELECT r, c, CASE WHEN is_valid THEN h / greatest(kh, 1e-6) END AS gain FROM z", ("grid_px",), "gain")
R.add("gain_strata", lambda s, d, px: structural(px).withColumn("stratum", pixels.gain_stratum(pixels.gain(F.col("h"), F.col("kh"), F.col("is_valid"), 1e-6))).groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), f"WITH {alloc_sql(K5, 'h')}, q AS (SELECT CASE WHEN is_valid THEN h / greatest(kh, 1e-6) END AS gain FROM z) SELECT CASE WHEN gain < 0.8 THEN 1 WHEN gain < 1.25 THEN 2 WHEN gain IS NOT NULL THEN 3 END AS stratum, count(*) AS n FROM q GROUP BY 1", ("grid_px",))
R.add(
    "alloc_summary",
    lambda s, d, px: structural(px).agg(*statistics.error_metrics(F.col("err")), *[F.count_if(F.col(m)).alias(m) for m in MASKS], F.avg(F.col("is_valid").cast("double")).alias("valid_fraction"), F.sum(F.when(F.col("l") > 0, F.col("l"))).alias("authority"), F.sum(F.when((F.col("l") > 0) & (F.col("kh") < 0.9), F.col("l"))).alias("authority_low")).withColumn("low_share", F.try_divide("authority_low", "authority")),
    f"WITH {alloc_sql(K5, 'h')}, q AS (SELECT count(err) AS n, avg(err) AS bias, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse, {', '.join(f'count(*) FILTER ({m}) AS {m}' for m in MASKS)}, avg(CASE WHEN is_valid THEN 1.0 ELSE 0.0 END) AS valid_fraction, sum(CASE WHEN l > 0 THEN l END) AS authority, sum(CASE WHEN l > 0 AND kh < 0.9 THEN l END) AS authority_low FROM z) SELECT *, authority_low / authority AS low_share FROM q",
    ("grid_px",),
    "bias mae rmse valid_fraction authority authority_low low_share",
)
R.add("metric_accumulator", lambda s, d, px: structural(px).groupBy(F.floor(F.col("r") / 8).cast("int").alias("tile_r"), F.floor(F.col("c") / 8).cast("int").alias("tile_c")).agg(*statistics.error_metrics(F.col("err"))), f"WITH {alloc_sql(K5, 'h')} SELECT CAST(floor(r / 8.0) AS INT) AS tile_r, CAST(floor(c / 8.0) AS INT) AS tile_c, count(err) AS n, avg(err) AS bias, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse FROM z GROUP BY 1, 2", ("grid_px",), "bias mae rmse")

# --- native footprints
NATIVE_SQL = f"""{NORMAL}, o AS (SELECT cell, r, c, area, CASE WHEN cell_radiance >= 0 THEN cell_radiance END AS cell_radiance FROM cell_overlap),
    j AS (SELECT o.*, px.h FROM o LEFT JOIN px USING (r, c)),
    q AS (SELECT cell, max(cell_radiance) AS radiance, sum(area) AS area, sum(area * h) / nullif(sum(CASE WHEN h IS NOT NULL THEN area END), 0) AS kh, coalesce(sum(CASE WHEN h IS NOT NULL THEN area END) / sum(area), 0) AS support FROM j GROUP BY cell),
    e AS (SELECT *, radiance IS NOT NULL AND kh IS NOT NULL AND support >= 0.9 - 1e-6 AS eligible FROM q),
    x AS (SELECT j.r, j.c, sum(coalesce(CASE WHEN e.eligible AND j.h IS NOT NULL THEN greatest(0.0, j.h * j.cell_radiance / greatest(e.kh, 1e-6)) END, 0.0) * j.area) / sum(j.area) AS allocation FROM j JOIN e USING (cell) GROUP BY 1, 2),
    b AS (SELECT o.cell, sum(o.area * x.allocation) / sum(o.area) AS reaggregated FROM o JOIN x USING (r, c) GROUP BY 1),
    y AS (SELECT e.cell, e.radiance, e.kh, e.support, e.eligible, b.reaggregated, CASE WHEN e.eligible THEN e.radiance - b.reaggregated END AS err FROM e JOIN b USING (cell))"""


def native(px, overlap):
    held = overlap.withColumn("cell_radiance", F.when(F.col("cell_radiance") >= 0, F.col("cell_radiance")))
    return relational.native_allocation(held, normal(px), min_support=0.9)


NATIVE = ("grid_px", "cell_overlap")
R.add("alloc_native", lambda s, d, px, o: native(px, o)["pixels"], f"WITH {NATIVE_SQL} SELECT r, c, allocation FROM x", NATIVE, "allocation")
R.add("alloc_native_layers", lambda s, d, px, o: native(px, o)["cells"].select("cell", "radiance", "kh", "support", "eligible", "reaggregated", "err"), f"WITH {NATIVE_SQL} SELECT * FROM y", NATIVE, "radiance kh support reaggregated err")
R.add("native_cell_summary", lambda s, d, px, o: native(px, o)["cells"].agg(F.count(F.lit(1)).alias("cells"), F.count_if("eligible").alias("eligible_cells"), *statistics.error_metrics(F.col("err"))), f"WITH {NATIVE_SQL} SELECT count(*) AS cells, count(*) FILTER (eligible) AS eligible_cells, count(err) AS n, avg(err) AS bias, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse FROM y", NATIVE, "bias mae rmse")
R.add(
    "downsample_native",
    lambda s, d, px, o: o.join(px.select(*KEYS, "base_proxy", "persistent_w"), KEYS).groupBy("cell").agg((F.sum(F.col("area") * F.col("base_proxy")) / F.sum(F.when(F.col("base_proxy").isNotNull(), F.col("area")))).alias("proxy_mean"), (F.sum(F.when(F.col("base_proxy").isNotNull(), F.col("area"))) / F.sum("area")).alias("support"), (F.sum(F.col("area") * F.col("persistent_w")) / F.sum("area")).alias("water_weight")).na.drop(),
    "WITH q AS (SELECT cell, sum(area * base_proxy) / sum(CASE WHEN base_proxy IS NOT NULL THEN area END) AS proxy_mean, sum(CASE WHEN base_proxy IS NOT NULL THEN area END) / sum(area) AS support, sum(area * persistent_w) / sum(area) AS water_weight FROM cell_overlap JOIN grid_px USING (r, c) GROUP BY cell) SELECT * FROM q WHERE proxy_mean IS NOT NULL AND support IS NOT NULL AND water_weight IS NOT NULL",
    NATIVE,
    "proxy_mean support water_weight",
)
R.add("scatter_add", lambda s, d, o: relational.scatter_add(o.where("area > 30"), o, "cell", "area"), "SELECT cell, coalesce(sum(CASE WHEN area > 30 THEN area END), 0.0) AS total FROM cell_overlap GROUP BY cell", ("cell_overlap",), "total")

# --- observations
R.add("qa_decode", lambda s, d, o: quality.decode_qa(o.select("source_index", "qf")), "SELECT source_index, qf, qf & 1 AS day_night, (qf >> 1) & 7 AS background, (qf >> 4) & 3 AS mask_quality, (qf >> 6) & 3 AS cloud, (qf >> 8) & 1 AS shadow, (qf >> 9) & 1 AS cirrus, (qf >> 10) & 1 AS snow_ice FROM daily_obs", ("daily_obs",))


def accepts(variant: str) -> str:
    mqf, quality_least = ("(0)", 2) if variant == "strict" else ("(0, 1)", 1)
    return f"coalesce(mqf IN {mqf} AND ((qf >> 6) & 3) IN (0, 1) AND ((qf >> 4) & 3) >= {quality_least} AND (qf & 1) = 0 AND ((qf >> 8) & 1) = 0 AND ((qf >> 9) & 1) = 0 AND ((qf >> 10) & 1) = 0 AND snow = 0, false)"


for v in ("strict", "broad"):
    kept_sql = f"o AS (SELECT *, {accepts(v)} AS accepted, CASE WHEN {accepts(v)} THEN radiance END AS kept FROM daily_obs)"
    least = 15 if v == "strict" else 5
    R.add(f"qa_{v}", lambda s, d, o, v=v: quality.mask_observations(o, v).select("source_index", "accepted", "kept"), f"WITH {kept_sql} SELECT source_index, accepted, kept FROM o", ("daily_obs",), "kept")
    R.add(f"vnp_median_{v}", lambda s, d, o, v=v, n=least: statistics.median_composite(quality.mask_observations(o, v), KEYS, n), f"WITH {kept_sql} SELECT r, c, CASE WHEN count(kept) >= {least} THEN median(kept) END AS median, count(kept) AS n_valid, count(radiance) AS n_source, count(radiance) - count(kept) AS n_rejected, count(kept) / greatest(count(radiance), 1) AS retained, count(kept) >= {least} AS supported FROM o GROUP BY r, c", ("daily_obs",), "median retained")
STRICT_SQL = f"o AS (SELECT *, CASE WHEN {accepts('strict')} THEN radiance END AS kept FROM daily_obs)"
R.add("s2_mosaic_last", lambda s, d, o: quality.mask_observations(o, "strict").where("kept is not null").groupBy(*KEYS, "datatake").agg(F.max_by("kept", "source_index").alias("value")), f"WITH {STRICT_SQL} SELECT r, c, datatake, arg_max(kept, source_index) AS value FROM o WHERE kept IS NOT NULL GROUP BY r, c, datatake", ("daily_obs",), "value")
R.add("s2_composite", lambda s, d, o: statistics.datatake_composite(quality.mask_observations(o, "strict"), KEYS, 4), f"WITH {STRICT_SQL}, m AS (SELECT r, c, datatake, arg_max(kept, source_index) AS value FROM o WHERE kept IS NOT NULL GROUP BY r, c, datatake) SELECT r, c, CASE WHEN count(value) >= 4 THEN median(value) END AS median, count(value) AS n FROM m GROUP BY r, c", ("daily_obs",), "median")
GAP = "SELECT {a} AS max_age, r, c, CASE WHEN count(CASE WHEN age_days <= {a} THEN radiance END) >= 10 THEN median(CASE WHEN age_days <= {a} THEN radiance END) END AS median, count(CASE WHEN age_days <= {a} THEN radiance END) AS n_days, count(radiance) AS n_source, count(*) FILTER (age_days = 0) AS n_fresh, median(CASE WHEN age_days <= {a} THEN age_days END) AS median_age, quantile_cont(CASE WHEN age_days <= {a} THEN age_days END, 0.9) AS p90_age FROM daily_obs GROUP BY r, c"


def gaps(s, d, o):
    parts = [statistics.gap_filled(o, KEYS, a).select(F.lit(a).alias("max_age"), "*") for a in (7, 30, 90)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


R.add("gapfill_7_30_90", gaps, " UNION ALL ".join(GAP.format(a=a) for a in (7, 30, 90)), ("daily_obs",), "median median_age p90_age")
R.add("dominant_background", lambda s, d, o: statistics.dominant_class(quality.decode_qa(o), KEYS, "background"), "WITH n AS (SELECT r, c, (qf >> 1) & 7 AS b, count(*) AS n FROM daily_obs GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, b) AS i FROM n) SELECT r, c, b AS dominant, n FROM k WHERE i = 1", ("daily_obs",))
R.add("obs_scan", lambda s, d, o: o.where("d >= date'2024-01-11' and d < date'2024-04-20' and r between 2 and 8").select("source_index", "d", *KEYS, "radiance"), "SELECT source_index, d, r, c, radiance FROM daily_obs WHERE d >= DATE '2024-01-11' AND d < DATE '2024-04-20' AND r BETWEEN 2 AND 8", ("daily_obs",), "radiance")
R.add("daily_layers", lambda s, d, o: quality.decode_qa(quality.mask_observations(o, "strict")).groupBy("d", *KEYS).agg(F.max("kept").alias("radiance"), F.min(F.when(F.col("accepted"), F.col("age_days"))).alias("age"), F.max(F.when(F.col("accepted"), F.col("cloud"))).alias("cloud")), f"WITH {STRICT_SQL} SELECT d, r, c, max(kept) AS radiance, min(CASE WHEN {accepts('strict')} THEN age_days END) AS age, max(CASE WHEN {accepts('strict')} THEN (qf >> 6) & 3 END) AS cloud FROM o GROUP BY d, r, c", ("daily_obs",), "radiance")
DAY_SQL = "dy AS (SELECT d, r, c, avg(radiance) AS v FROM daily_obs GROUP BY d, r, c)"


def by_day(o):
    return o.groupBy("d", *KEYS).agg(F.avg("radiance").alias("v"))


STENCIL_SQL = f"""{K5}, {DAY_SQL}, pr AS (SELECT r, c, greatest(base_proxy, 0.05) AS h FROM grid_px WHERE base_proxy IS NOT NULL),
    e AS (SELECT dy.*, pr.h FROM dy LEFT JOIN pr USING (r, c)),
    m AS (SELECT e.d, e.r - k.dr AS r, e.c - k.dc AS c, sum(k.w * v) AS nv, count(v) AS cv, sum(k.w * h) AS nh, count(h) AS ch FROM e CROSS JOIN k GROUP BY 1, 2, 3)"""
R.add("daily_stencil", lambda s, d, o, px: stencil.daily_stencil(by_day(o), px.where("base_proxy is not null").select(*KEYS, F.col("base_proxy").alias("h")), PLUS), f"WITH {STENCIL_SQL} SELECT d, r, c, v, h, CASE WHEN cv = 5 THEN nv END AS uniform, CASE WHEN cv = 5 AND ch = 5 AND nh > 1e-6 THEN h * nv / nh END AS structural FROM e JOIN m USING (d, r, c)", ("daily_obs", "grid_px"), "v h uniform structural")
R.add("obs_daily_support", lambda s, d, o, px: stencil.daily_stencil(by_day(o), px.where("base_proxy is not null").select(*KEYS, F.col("base_proxy").alias("h")), PLUS).groupBy("d").agg(F.avg(F.col("v").isNotNull().cast("double")).alias("finite"), F.avg(F.col("uniform").isNotNull().cast("double")).alias("complete")), f"WITH {STENCIL_SQL} SELECT d, avg(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0.0 END) AS finite, avg(CASE WHEN cv = 5 THEN 1.0 ELSE 0.0 END) AS complete FROM e JOIN m USING (d, r, c) GROUP BY d", ("daily_obs", "grid_px"), "finite complete")
RES_SQL = "x AS (SELECT d, r, c, ln(1 + greatest(radiance, 0.0)) AS x, age_days FROM daily_obs), q AS (SELECT r, c, median(x) AS m FROM x GROUP BY r, c), w AS (SELECT x.*, x.x - q.m AS residual FROM x JOIN q USING (r, c))"
R.add("within_cell_residual", lambda s, d, o: statistics.within_cell_residual(o, KEYS, "radiance", True).select("source_index", "residual"), "WITH x AS (SELECT source_index, r, c, ln(1 + greatest(radiance, 0.0)) AS x FROM daily_obs), q AS (SELECT r, c, median(x) AS m FROM x GROUP BY r, c) SELECT source_index, x.x - q.m AS residual FROM x JOIN q USING (r, c)", ("daily_obs",), "residual")
R.add("obs_conditions", lambda s, d, o: statistics.within_cell_residual(o, KEYS, "radiance", True).withColumn("age", F.col("age_days").cast("double")).agg(F.count("residual").alias("n"), statistics.pearson("residual", "age").alias("pearson"), F.avg(F.abs("residual")).alias("mean_abs")).withColumn("r2", F.col("pearson") * F.col("pearson")), f"WITH {RES_SQL}, t AS (SELECT count(residual) AS n, covar_pop(residual, age_days) / nullif(stddev_pop(residual) * stddev_pop(age_days), 0) AS pearson, avg(abs(residual)) AS mean_abs FROM w) SELECT *, pearson * pearson AS r2 FROM t", ("daily_obs",), "pearson mean_abs r2")
R.add("obs_invariants", lambda s, d, o: o.groupBy("datatake").agg(F.min("mqf").alias("least"), F.max("mqf").alias("most"), F.to_json(F.sort_array(F.collect_set("mqf"))).alias("kinds"), (F.count_distinct("mqf") > 1).alias("varies")), "SELECT datatake, min(mqf) AS least, max(mqf) AS most, CAST(to_json(list_sort(list(DISTINCT mqf))) AS VARCHAR) AS kinds, count(DISTINCT mqf) > 1 AS varies FROM daily_obs GROUP BY datatake", ("daily_obs",))


def band_images(s, d, o):
    """Every source image of a datatake as a row, with the datatake's summary beside it."""
    summary = o.groupBy("datatake").agg(F.min("radiance").alias("least"), F.max("radiance").alias("most"), F.avg("radiance").alias("mean"), F.count("radiance").alias("n"), F.count_distinct("d").alias("days"))
    # there are four datatakes, so the images stay where they are
    return o.select("datatake", "source_index").join(F.broadcast(summary), "datatake").select("datatake", "least", "most", "mean", "n", "days", "source_index")


R.add("band_summary", band_images, "SELECT o.datatake, least, most, mean, n, days, source_index FROM daily_obs o JOIN (SELECT datatake, min(radiance) AS least, max(radiance) AS most, avg(radiance) AS mean, count(radiance) AS n, count(DISTINCT d) AS days FROM daily_obs GROUP BY datatake) s ON s.datatake = o.datatake", ("daily_obs",), "least most mean")

# --- blocks, bands, comparisons
R.add("block_mean", lambda s, d, px: stencil.block_mean(px, "radiance", 2, True), "SELECT CAST(floor(r / 2.0) AS INT) AS br, CAST(floor(c / 2.0) AS INT) AS bc, CASE WHEN count(radiance) = 4 THEN avg(radiance) END AS mean, count(radiance) AS n FROM grid_px GROUP BY 1, 2", ("grid_px",), "mean")
R.add("block_nanmean", lambda s, d, px: stencil.block_mean(px, "radiance", 4, False), "SELECT CAST(floor(r / 4.0) AS INT) AS br, CAST(floor(c / 4.0) AS INT) AS bc, avg(radiance) AS mean, count(radiance) AS n FROM grid_px GROUP BY 1, 2", ("grid_px",), "mean")
DIST_SQL = "dist AS (SELECT a.r, a.c, sqrt(min((a.r - b.r) ** 2 + (a.c - b.c) ** 2)) * 10 AS distance FROM grid_px a JOIN grid_px b ON b.occ >= 90 AND abs(a.r - b.r) <= 12 AND abs(a.c - b.c) <= 12 AND (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 144 GROUP BY a.r, a.c)"


def distances(px):
    return stencil.nearest_distance(px, F.col("occ") >= 90, 12, 10.0)


EXACT_SQL = "SELECT a.r, a.c, sqrt(min((a.r - b.r) ** 2 + (a.c - b.c) ** 2)) * 10 AS distance FROM grid_px a LEFT JOIN (SELECT r, c FROM grid_px WHERE occ >= 90) b ON true GROUP BY a.r, a.c"
R.add("edt_distance", lambda s, d, px: stencil.exact_distance(px, F.col("occ") >= 90, 10.0), EXACT_SQL, ("grid_px",), "distance")


def with_bands(px):
    return structural(px).select(*KEYS, "radiance", "allocation", "occ", "infra").join(distances(px).select(*KEYS, "distance"), KEYS)


BAND_SQL = f"{alloc_sql(K5, 'h')}, {DIST_SQL}, w AS (SELECT z.r, z.c, g.radiance, z.allocation, g.occ, g.infra, dist.distance FROM z JOIN grid_px g USING (r, c) LEFT JOIN dist USING (r, c))"
CASE_SQL = "CASE WHEN distance = 0 THEN 0 WHEN distance <= 20 THEN 1 WHEN distance <= 50 THEN 2 WHEN distance <= 100 THEN 3 ELSE 4 END"
R.add("shoreline_bands", lambda s, d, px: statistics.distance_bands(with_bands(px), "distance", "radiance", "allocation", EDGES), f"WITH {BAND_SQL}, x AS (SELECT {CASE_SQL} AS band, * FROM w WHERE radiance IS NOT NULL AND allocation IS NOT NULL), e AS (SELECT band, count(*) AS n, sum(radiance) AS direct_sum, sum(allocation) AS allocated_sum, avg(allocation - radiance) AS mean_diff, avg(abs(allocation - radiance)) AS mean_abs_diff FROM x GROUP BY band) SELECT CAST(b.band AS INT) AS band, coalesce(n, 0) AS n, direct_sum, allocated_sum, mean_diff, mean_abs_diff FROM (SELECT unnest(range(5)) AS band) b LEFT JOIN e USING (band)", ("grid_px",), "direct_sum allocated_sum mean_diff mean_abs_diff")


def control(px):
    return statistics.lowest_control(px, "base_proxy", (F.col("occ") < 90) & (F.col("r") >= 2), F.col("occ") >= 90, KEYS)


CONTROL_SQL = "t AS (SELECT * FROM grid_px WHERE occ < 90 AND r >= 2 AND base_proxy IS NOT NULL), cn AS (SELECT least((SELECT count(*) FROM grid_px WHERE occ >= 90), greatest(1, count(*) // 10)) AS n FROM t), u AS (SELECT max(base_proxy) AS cut FROM (SELECT base_proxy, row_number() OVER (ORDER BY base_proxy) AS i FROM t), cn WHERE i <= n), ct AS (SELECT * EXCLUDE (i) FROM (SELECT t.*, row_number() OVER (ORDER BY r, c) AS i FROM t, u WHERE base_proxy <= cut), cn WHERE i <= n)"
R.add("low_proxy_control", lambda s, d, px: control(px).select(*KEYS, "base_proxy"), f"WITH {CONTROL_SQL} SELECT r, c, base_proxy FROM ct", ("grid_px",), "base_proxy")


def inland(s, d, px):
    # distances to the control set
    marked = px.join(control(px).select(*KEYS, F.lit(True).alias("control")), KEYS, "left")
    held = stencil.nearest_distance(marked, F.col("control"), 12, 10.0).where("r >= 2")
    return statistics.distance_bands(held.withColumn("scaled", F.col("base_proxy") * 30), "distance", "radiance", "scaled", EDGES)


INLAND_SQL = f"WITH {CONTROL_SQL}, dist AS (SELECT a.r, a.c, sqrt(min((a.r - b.r) ** 2 + (a.c - b.c) ** 2)) * 10 AS distance FROM grid_px a JOIN ct b ON (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 144 GROUP BY a.r, a.c), w AS (SELECT g.radiance, g.base_proxy * 30 AS allocation, distance FROM grid_px g LEFT JOIN dist USING (r, c) WHERE g.r >= 2), x AS (SELECT {CASE_SQL} AS band, * FROM w WHERE radiance IS NOT NULL AND allocation IS NOT NULL), e AS (SELECT band, count(*) AS n, sum(radiance) AS direct_sum, sum(allocation) AS allocated_sum, avg(allocation - radiance) AS mean_diff, avg(abs(allocation - radiance)) AS mean_abs_diff FROM x GROUP BY band) SELECT CAST(b.band AS INT) AS band, coalesce(n, 0) AS n, direct_sum, allocated_sum, mean_diff, mean_abs_diff FROM (SELECT unnest(range(5)) AS band) b LEFT JOIN e USING (band)"
R.add("inland_bands", inland, INLAND_SQL, ("grid_px",), "direct_sum allocated_sum mean_diff mean_abs_diff")
STRATUM = "CASE WHEN infra AND occ >= 96 THEN 'pier' WHEN infra AND occ >= 90 THEN 'bridge' WHEN infra THEN 'building' WHEN base_proxy > 0.5 THEN 'road' ELSE 'ordinary' END"
R.add("waterfront_strata", lambda s, d, px: distances(px).where("distance <= 100").withColumn("side", F.expr("CASE WHEN distance = 0 THEN 'water' ELSE 'land' END")).withColumn("stratum", F.expr(STRATUM)).groupBy("side", "stratum").agg(F.count("radiance").alias("n"), F.sum("radiance").alias("total"), F.avg("radiance").alias("mean")), f"WITH {DIST_SQL} SELECT CASE WHEN distance = 0 THEN 'water' ELSE 'land' END AS side, {STRATUM} AS stratum, count(radiance) AS n, sum(radiance) AS total, avg(radiance) AS mean FROM grid_px JOIN dist USING (r, c) WHERE distance <= 100 GROUP BY 1, 2", ("grid_px",), "total mean")
R.add("region_ratio", lambda s, d, px: statistics.region_ratio(with_bands(px).withColumn("region", F.expr("CASE WHEN occ >= 90 THEN 'water' ELSE 'inland' END")), "radiance", "allocation", ["region"]), f"WITH {BAND_SQL}, x AS (SELECT CASE WHEN occ >= 90 THEN 'water' ELSE 'inland' END AS region, count(*) FILTER (radiance IS NOT NULL AND allocation IS NOT NULL) AS n, sum(CASE WHEN allocation IS NOT NULL THEN greatest(radiance, 0.0) END) AS direct_sum, sum(CASE WHEN radiance IS NOT NULL THEN allocation END) AS allocated_sum FROM w GROUP BY 1) SELECT *, CASE WHEN direct_sum > 0 THEN allocated_sum / direct_sum END AS ratio, 1 - CASE WHEN direct_sum > 0 THEN allocated_sum / direct_sum END AS reduction FROM x", ("grid_px",), "direct_sum allocated_sum ratio reduction")


def inland_ratio(s, d, px):
    ratios = statistics.region_ratio(with_bands(px).withColumn("region", F.expr("CASE WHEN occ >= 90 THEN 'water' ELSE 'inland' END")), "radiance", "allocation", ["region"])
    return ratios.groupBy().pivot("region", ["water", "inland"]).agg(F.first("ratio")).select("water", "inland", F.when(F.col("water") < F.col("inland"), "water_reduced_more").otherwise("inland_reduced_more").alias("direction"))


R.add("inland_ratio", inland_ratio, f"WITH {BAND_SQL}, x AS (SELECT sum(CASE WHEN occ >= 90 AND radiance IS NOT NULL THEN allocation END) / sum(CASE WHEN occ >= 90 AND allocation IS NOT NULL THEN greatest(radiance, 0.0) END) AS water, sum(CASE WHEN occ < 90 AND radiance IS NOT NULL THEN allocation END) / sum(CASE WHEN occ < 90 AND allocation IS NOT NULL THEN greatest(radiance, 0.0) END) AS inland FROM w) SELECT water, inland, CASE WHEN water < inland THEN 'water_reduced_more' ELSE 'inland_reduced_more' END AS direction FROM x", ("grid_px",), "water inland")
R.add("water_metrics", lambda s, d, px: with_bands(px).agg(F.sum("allocation").alias("total"), F.sum(F.when(F.col("occ") >= 90, F.col("allocation"))).alias("over_water"), F.sum(F.when((F.col("distance") > 0) & (F.col("distance") <= 20), F.col("allocation") - F.col("radiance"))).alias("adjacent_transfer"), F.sum(F.when((F.col("distance") > 0) & (F.col("distance") <= 20), F.abs(F.col("allocation") - F.col("radiance")))).alias("adjacent_abs")).withColumn("water_share", F.try_divide("over_water", "total")), f"WITH {BAND_SQL}, x AS (SELECT sum(allocation) AS total, sum(CASE WHEN occ >= 90 THEN allocation END) AS over_water, sum(CASE WHEN distance > 0 AND distance <= 20 THEN allocation - radiance END) AS adjacent_transfer, sum(CASE WHEN distance > 0 AND distance <= 20 THEN abs(allocation - radiance) END) AS adjacent_abs FROM w) SELECT *, over_water / total AS water_share FROM x", ("grid_px",), "total over_water adjacent_transfer adjacent_abs water_share")
CMP = "count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(b - a) AS mean_diff, avg(abs(b - a)) AS mae, sqrt(avg((b - a) * (b - a))) AS rmse, max(abs(b - a)) AS max_abs, avg(CASE WHEN abs(b - a) > 1e-6 THEN 1.0 ELSE 0.0 END) AS changed_share, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS pearson"
CMPD = "mean_a mean_b mean_diff mae rmse max_abs changed_share pearson"
for name, a, b in (("proxy_disagreement", "proxy_no_water_prior", "proxy_combined_soft"), ("water_vs_reference", "proxy_no_water_prior", "proxy_persistent_only_soft"), ("raster_comparison", "proxy_spectral_only_soft", "proxy_combined_hard_persistent_sensitivity_only")):
    R.add(name, lambda s, d, px, a=a, b=b: statistics.comparison(pixels.water_proxy(px, "base_proxy"), a, b), f"WITH p AS (SELECT {WATER} FROM grid_px), q AS (SELECT {a} AS a, {b} AS b FROM p WHERE {a} IS NOT NULL AND {b} IS NOT NULL) SELECT {CMP} FROM q", ("grid_px",), CMPD)
R.add("proxy_vintage", lambda s, d, px: pixels.water_proxy(px, "base_proxy").selectExpr("stack(2, 'spectral', proxy_no_water_prior, proxy_spectral_only_soft, 'persistent', proxy_no_water_prior, proxy_persistent_only_soft) AS (layer, a, b)").transform(lambda x: statistics.comparison(x, "a", "b", by=["layer"])), f"WITH p AS (SELECT {WATER} FROM grid_px), q AS (SELECT 'spectral' AS layer, proxy_no_water_prior AS a, proxy_spectral_only_soft AS b FROM p UNION ALL SELECT 'persistent', proxy_no_water_prior, proxy_persistent_only_soft FROM p) SELECT layer, {CMP} FROM q WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY layer", ("grid_px",), CMPD)


def qa_pairs(o):
    medians = [statistics.median_composite(quality.mask_observations(o, v), KEYS, n).select(*KEYS, F.col("median").alias(v)) for v, n in (("strict", 15), ("broad", 5))]
    return medians[0].join(medians[1], KEYS)


PAIR_SQL = f"u AS (SELECT r, c, CASE WHEN count(CASE WHEN {accepts('strict')} THEN 1 END) >= 15 THEN median(CASE WHEN {accepts('strict')} THEN radiance END) END AS strict, CASE WHEN count(CASE WHEN {accepts('broad')} THEN 1 END) >= 5 THEN median(CASE WHEN {accepts('broad')} THEN radiance END) END AS broad FROM daily_obs GROUP BY r, c)"
R.add("qa_coverage_compare", lambda s, d, o: qa_pairs(o).agg(F.count("strict").alias("n_strict"), F.count("broad").alias("n_broad"), F.count_if(F.col("strict").isNull() & F.col("broad").isNotNull()).alias("n_broad_only"), F.avg(F.when(F.col("strict").isNull(), F.col("broad"))).alias("broad_only_mean"), (F.count("broad") * 0.0001).alias("area_km2"), statistics.pearson("strict", "broad").alias("pearson")), f"WITH {PAIR_SQL} SELECT count(strict) AS n_strict, count(broad) AS n_broad, count(*) FILTER (strict IS NULL AND broad IS NOT NULL) AS n_broad_only, avg(CASE WHEN strict IS NULL THEN broad END) AS broad_only_mean, count(broad) * 0.0001 AS area_km2, (SELECT covar_pop(strict, broad) / nullif(stddev_pop(strict) * stddev_pop(broad), 0) FROM u WHERE strict IS NOT NULL AND broad IS NOT NULL) AS pearson FROM u", ("daily_obs",), "broad_only_mean area_km2 pearson")
R.add("broad_audit", lambda s, d, o: statistics.comparison(qa_pairs(o), "strict", "broad").selectExpr("'common' AS part", "n", "mae AS value").unionByName(qa_pairs(o).where("strict is null and broad is not null").agg(F.lit("newly_filled").alias("part"), F.count(F.lit(1)).alias("n"), F.avg("broad").alias("value"))), f"WITH {PAIR_SQL} SELECT 'common' AS part, count(*) AS n, avg(abs(broad - strict)) AS value FROM u WHERE strict IS NOT NULL AND broad IS NOT NULL UNION ALL SELECT 'newly_filled', count(*), avg(broad) FROM u WHERE strict IS NULL AND broad IS NOT NULL", ("daily_obs",), "value")
def limits(s, d, px):
    low, high, most = order.quantiles(px, "radiance", [0.02, 0.98, 0.995])
    return s.createDataFrame([(low, high, most)], "p02 double, p98 double, p995 double")


R.add("quantile_limits", limits, "SELECT quantile_cont(radiance, 0.02) AS p02, quantile_cont(radiance, 0.98) AS p98, quantile_cont(radiance, 0.995) AS p995 FROM grid_px", ("grid_px",), "p02 p98 p995")


def targets(at, step, start, size):
    """Indices k of target places k * step + start that lie in the source pixel `at` of the given size."""
    first, last = F.floor((F.col(at) * size - start) / step) - 1, F.floor(((F.col(at) + 1) * size - start) / step) + 1
    return F.explode(F.filter(F.sequence(first, last), lambda k: F.floor((k * step + start) / size) == F.col(at)))


def nearest(s, d, px):
    """Every target of the raster's extent takes the value of the source pixel that holds it, null in a hole."""
    held = stencil.lattice(px).join(px.select(*KEYS, "radiance"), KEYS, "left")
    return held.withColumn("i", targets("r", 4.1, 0.0, 20.0)).withColumn("j", targets("c", 3.7, 0.0, 10.0)).select("i", "j", "radiance")


#: Target numbers along an axis, with the source place that holds each; sides as in targets(), in doubles as there.
AXIS = "SELECT k AS {k}, CAST(floor((k * {step}e0 + {start}e0) / {size}e0) AS INT) AS {at} FROM (SELECT unnest(range(-8, (SELECT CAST(ceil((max({at}) + 1) * {size}e0 / {step}e0) AS BIGINT) + 2 FROM grid_px))) AS k)"
EXTENT = "ex AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM grid_px)"
R.add(
    "resample_nearest",
    nearest,
    f"WITH {EXTENT}, ti AS ({AXIS.format(k='i', at='r', step=4.1, start=0.0, size=20.0)}), tj AS ({AXIS.format(k='j', at='c', step=3.7, start=0.0, size=10.0)}) SELECT i, j, radiance FROM ti JOIN ex ON ti.r BETWEEN r0 AND r1 JOIN tj ON tj.c BETWEEN c0 AND c1 LEFT JOIN grid_px g ON g.r = ti.r AND g.c = tj.c",
    ("grid_px",),
    "radiance",
)


def bilinear(s, d, px):
    """Every target of the raster's extent from the four pixels around it, null where one is missing."""
    # a source pixel is a corner of four squares, so the squares meet their corners before targets are made
    corners = [(a, b) for a in (0, 1) for b in (0, 1)]
    taps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in corners]))
    each = px.select(*KEYS, "base_proxy", taps.alias("t")).select((F.col("r") - F.col("t.a")).alias("r"), (F.col("c") - F.col("t.b")).alias("c"), "t", "base_proxy")
    squares = each.groupBy(*KEYS).agg(*[F.max(F.when((F.col("t.a") == a) & (F.col("t.b") == b), F.col("base_proxy"))).alias(f"v{a}{b}") for a, b in corners])
    held = stencil.lattice(px).join(squares, KEYS, "left").withColumn("i", targets("r", 0.13, 0.25, 1.0)).withColumn("j", targets("c", 0.29, 0.25, 1.0))
    y, x = F.col("i") * 0.13 + 0.25, F.col("j") * 0.29 + 0.25
    fy, fx = y - F.floor(y), x - F.floor(x)
    parts = [(fy if a else 1 - fy) * (fx if b else 1 - fx) * F.col(f"v{a}{b}") for a, b in corners]
    return held.select("i", "j", (parts[0] + parts[1] + parts[2] + parts[3]).alias("value"))


PART = {(a, b): f"({'fy' if a else '(1 - fy)'}) * ({'fx' if b else '(1 - fx)'}) * g{a}{b}.base_proxy" for a in (0, 1) for b in (0, 1)}
R.add(
    "resample_bilinear",
    bilinear,
    f"WITH {EXTENT}, ti AS ({AXIS.format(k='i', at='r', step=0.13, start=0.25, size=1.0)}), tj AS ({AXIS.format(k='j', at='c', step=0.29, start=0.25, size=1.0)}), "
    "tg AS (SELECT i, j, ti.r, tj.c, i * 0.13e0 + 0.25e0 - ti.r AS fy, j * 0.29e0 + 0.25e0 - tj.c AS fx FROM ti JOIN ex ON ti.r BETWEEN r0 AND r1 JOIN tj ON tj.c BETWEEN c0 AND c1) "
    f"SELECT i, j, {' + '.join(PART.values())} AS value FROM tg " + " ".join(f"LEFT JOIN grid_px g{a}{b} ON g{a}{b}.r = tg.r + {a} AND g{a}{b}.c = tg.c + {b}" for a, b in PART),
    ("grid_px",),
    "value",
)
R.add("tile_halo", lambda s, d, px: stencil.tile_halo(px.select(*KEYS), 8, 2).groupBy("tile_r", "tile_c").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("n_core")), "WITH t AS (SELECT DISTINCT CAST(floor(r / 8.0) AS INT) AS tr, CAST(floor(c / 8.0) AS INT) AS tc FROM grid_px), u AS (SELECT DISTINCT a.tr + i AS tile_r, a.tc + j AS tile_c FROM t a, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j)) SELECT tile_r, tile_c, count(*) AS n, count(*) FILTER (floor(r / 8.0) = tile_r AND floor(c / 8.0) = tile_c) AS n_core FROM u JOIN grid_px g ON g.r BETWEEN tile_r * 8 - 2 AND tile_r * 8 + 9 AND g.c BETWEEN tile_c * 8 - 2 AND tile_c * 8 + 9 WHERE tile_r >= 0 AND tile_c >= 0 GROUP BY 1, 2", ("grid_px",))
R.add("tile_cores", lambda s, d, px: px.groupBy(F.floor(F.col("r") / 8).cast("int").alias("tile_r"), F.floor(F.col("c") / 8).cast("int").alias("tile_c")).agg(F.min("r").alias("top"), F.min("c").alias("left"), F.max("r").alias("bottom"), F.max("c").alias("right")), "SELECT CAST(floor(r / 8.0) AS INT) AS tile_r, CAST(floor(c / 8.0) AS INT) AS tile_c, min(r) AS top, min(c) AS \"left\", max(r) AS bottom, max(c) AS \"right\" FROM grid_px GROUP BY 1, 2", ("grid_px",))
R.add("tile_id", lambda s, d, px: px.selectExpr("r * 512 AS r", "c * 512 AS c").select(F.format_string("r%05d_c%05d_h%04d_w%04d", "r", "c", F.lit(512), F.lit(512)).alias("tile_id")).distinct(), "SELECT DISTINCT 'r' || lpad(CAST(r * 512 AS VARCHAR), 5, '0') || '_c' || lpad(CAST(c * 512 AS VARCHAR), 5, '0') || '_h0512_w0512' AS tile_id FROM grid_px", ("grid_px",))
R.add("audit_grid", lambda s, d, px: px.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("r", "c").alias("n_places"), F.min("r").alias("top"), F.max("r").alias("bottom"), (F.min("c") >= 0).alias("aligned")), "SELECT count(*) AS n, count(DISTINCT (r, c)) AS n_places, min(r) AS top, max(r) AS bottom, min(c) >= 0 AS aligned FROM grid_px", ("grid_px",))
R.add("nearest_center", lambda s, d, px: px.agg(F.min_by(F.struct("r", "c"), F.struct((F.col("r") - 40) ** 2 + (F.col("c") - 9) ** 2, F.col("r"), F.col("c"))).alias("at")).select("at.r", "at.c"), "SELECT r, c FROM grid_px ORDER BY (r - 40) ** 2 + (c - 9) ** 2, r, c LIMIT 1", ("grid_px",))
BLOCKS_SQL = "b AS (SELECT CAST(floor(r / 4.0) AS INT) AS br, CAST(floor(c / 4.0) AS INT) AS bc, avg(base_proxy) AS p, avg(CASE WHEN infra THEN 1.0 ELSE 0.0 END) AS infra FROM grid_px GROUP BY 1, 2)"


def cutouts(s, d, px):
    b = stencil.block_mean(px, "base_proxy", 4, False).select("br", "bc", F.col("mean").alias("p")).join(stencil.block_mean(px.withColumn("i", F.col("infra").cast("double")), "i", 4, False).select("br", "bc", F.col("mean").alias("infra")), ["br", "bc"])
    at = F.struct("br", "bc")
    dense = b.agg(F.min_by(at, F.struct(-F.col("p"), F.col("br"), F.col("bc"))).alias("at")).select(F.lit("dense").alias("role"), "at.*")
    sparse = b.where("infra >= 0.05 and p is not null").agg(F.min_by(at, F.struct("p", "br", "bc")).alias("at")).select(F.lit("sparse").alias("role"), "at.*")
    return dense.unionByName(sparse)


R.add("cutout_select", cutouts, f"WITH {BLOCKS_SQL} (SELECT 'dense' AS role, br, bc FROM b WHERE p IS NOT NULL ORDER BY p DESC, br, bc LIMIT 1) UNION ALL (SELECT 'sparse', br, bc FROM b WHERE infra >= 0.05 AND p IS NOT NULL ORDER BY p, br, bc LIMIT 1)", ("grid_px",))
ROWS_SQL = "string_agg(r || ',' || c || ',' || coalesce(CAST(CAST(round(radiance * 1e3) AS BIGINT) AS VARCHAR), 'null'), ';' ORDER BY r, c)"


def checksums(s, d, px):
    """Checksums of tiles of whole thousandths, halves away from zero; a mean's last bits, which depend on the order of its sum, are cut off before."""
    return artifacts.tile_checksums(px.select(*KEYS, F.round(F.round("radiance", 11) * 1e3).cast("long").alias("radiance")), 8)


R.add("tile_checksum", checksums, f"SELECT CAST(floor(r / 8.0) AS INT) AS tile_row, CAST(floor(c / 8.0) AS INT) AS tile_col, sha256({ROWS_SQL}) AS checksum, count(*) AS n FROM grid_px GROUP BY 1, 2", ("grid_px",))
R.add("gate1_checks", lambda s, d, px: structural(px).agg(F.every(F.coalesce(F.col("allocation") >= 0, F.lit(True))).alias("nonnegative"), F.every(~F.col("is_valid") | F.col("allocation").isNotNull()).alias("valid_has_value"), F.every(~F.col("is_boundary") | ~F.col("is_valid")).alias("boundary_invalid"), (F.count("allocation") > 0).alias("some_output")), f"WITH {alloc_sql(K5, 'h')} SELECT bool_and(coalesce(allocation >= 0, true)) AS nonnegative, bool_and(NOT is_valid OR allocation IS NOT NULL) AS valid_has_value, bool_and(NOT is_boundary OR NOT is_valid) AS boundary_invalid, count(allocation) > 0 AS some_output FROM z", ("grid_px",))
