"""Grouped statistics: composites, errors, correlations, quantile bins, bands, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import order


def error_metrics(error: Column) -> list[Column]:
    """n, bias, mae, rmse of an error column: mergeable sums, null without rows."""
    return [F.count(error).alias("n"), F.avg(error).alias("bias"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse")]


def pearson(x: str, y: str) -> Column:
    """Correlation of the pairs; null where either is constant."""
    a = F.when(F.col(y).isNotNull(), F.col(x))
    b = F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Average rank of ties.

    Ranks need the whole order; values are first counted, so the ordering window runs over
    different values and not over rows.
    """
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_upto", F.sum("_n").over(upto))
    else:
        counts = order.running(counts, [F.col(value)], F.col("_n"), "_upto")
    ranks = counts.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rank correlation with average ranks over complete pairs."""
    by = by or []
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = average_rank(average_rank(pairs, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson("_rx", "_ry").alias("spearman"))


def median_composite(masked: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Median of the accepted observations by pixel with its counts; null below `least`."""
    kept = F.count("kept")
    return masked.groupBy(*keys).agg(F.when(kept >= least, F.median("kept")).alias("median"), kept.alias("n_valid"), F.count("radiance").alias("n_source"), (F.count("radiance") - kept).alias("n_rejected"), (kept / F.greatest(F.count("radiance"), F.lit(1))).alias("retained"), (kept >= least).alias("supported"))


def gap_filled(daily: DataFrame, keys: list[str], max_age: int, least: int = 10) -> DataFrame:
    """Composite of retrievals of at most `max_age` days."""
    if max_age not in (7, 30, 90):
        raise ValueError("undeclared age bound")
    fresh = F.col("age_days") <= max_age
    v, age = F.when(fresh, F.col("radiance")), F.when(fresh, F.col("age_days"))
    return daily.groupBy(*keys).agg(F.when(F.count(v) >= least, F.median(v)).alias("median"), F.count(v).alias("n_days"), F.count("radiance").alias("n_source"), F.count_if(F.col("age_days") == 0).alias("n_fresh"), F.median(age).alias("median_age"), F.percentile(age, F.lit(0.9)).alias("p90_age"))


def datatake_composite(obs: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Latest non-null image within a datatake, then the median across datatakes."""
    mosaic = obs.where("kept is not null").groupBy(*keys, "datatake").agg(F.max_by("kept", "source_index").alias("value"))
    return mosaic.groupBy(*keys).agg(F.when(F.count("value") >= least, F.median("value")).alias("median"), F.count("value").alias("n"))


def dominant_class(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent class by key; of equal counts the smaller class; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("dominant"), F.max("n").alias("n"))


def decile(df: DataFrame, value: str, out: str, bins: int = 10) -> DataFrame:
    """Quantile bin: linear quantile edges, right-closed, duplicate edges dropped, from 0."""
    edges = sorted({e for e in order.quantiles(df, value, [i / bins for i in range(bins + 1)]) if e is not None})
    below = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e < F.col(value)))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(F.lit(0), below - 1)))


def folds(cells: DataFrame, n: int = 5) -> DataFrame:
    """Fold of each block: its place among the blocks sorted as text, modulo n."""
    blocks = cells.select("block_id").distinct()
    placed = order.numbered(blocks, [F.col("block_id")], "_place").select("block_id", ((F.col("_place") - 1) % n).cast("int").alias("fold"))
    return cells.join(order.small(placed), "block_id")


def quadratic_residual(df: DataFrame, value: str, radius: str, out: str) -> DataFrame:
    """Residual of least squares on 1, u, u^2 with u the standardised radius, by moment sums."""
    scale = df.agg(F.avg(radius).alias("_m"), F.stddev_pop(radius).alias("_s"))
    u = df.join(F.broadcast(scale)).withColumn("_u", (F.col(radius) - F.col("_m")) / F.col("_s"))
    ok = F.col(value).isNotNull() & F.col("_u").isNotNull()
    power = lambda k: F.sum(F.when(ok, F.pow("_u", F.lit(k))))
    sums = u.agg(*[power(k).alias(f"_s{k}") for k in range(5)], *[F.sum(F.when(ok, F.pow("_u", F.lit(k)) * F.col(value))).alias(f"_t{k}") for k in range(3)])
    det = lambda a: f"({a[0]}*({a[4]}*{a[8]}-{a[5]}*{a[7]})-{a[1]}*({a[3]}*{a[8]}-{a[5]}*{a[6]})+{a[2]}*({a[3]}*{a[7]}-{a[4]}*{a[6]}))"
    m = ["_s0", "_s1", "_s2", "_s1", "_s2", "_s3", "_s2", "_s3", "_s4"]
    t = ["_t0", "_t1", "_t2"]
    cols = [det([t[i // 3] if i % 3 == k else m[i] for i in range(9)]) for k in range(3)]
    fit = sums.select(*[F.expr(f"try_divide({c}, {det(m)})").alias(f"_b{k}") for k, c in enumerate(cols)])
    held = u.join(F.broadcast(fit))
    return held.withColumn(out, F.col(value) - (F.col("_b0") + F.col("_b1") * F.col("_u") + F.col("_b2") * F.col("_u") * F.col("_u"))).drop("_m", "_s", "_u", "_b0", "_b1", "_b2")


def region_ratio(df: DataFrame, direct: str, allocated: str, by: list[str] | None = None) -> DataFrame:
    """Ratio of sums on common support, the direct value cut at zero."""
    both = F.col(direct).isNotNull() & F.col(allocated).isNotNull()
    d, a = F.sum(F.when(both, F.greatest(F.col(direct), F.lit(0.0)))), F.sum(F.when(both, F.col(allocated)))
    ratio = F.when(d > 0, a / d)
    return df.groupBy(*(by or [])).agg(F.count_if(both).alias("n"), d.alias("direct_sum"), a.alias("allocated_sum"), ratio.alias("ratio"), (1 - ratio).alias("reduction"))


def band_of(distance: Column, edges: tuple[float, ...]) -> Column:
    """0: inside; i: up to edge i; last: beyond; null distance counts as beyond."""
    if edges[0] != 0 or list(edges) != sorted(set(edges)):
        raise ValueError("edges start at 0 and increase")
    out = F.when(distance == 0, 0)
    for i, e in enumerate(edges[1:], 1):
        out = out.when(distance <= e, i)
    return out.otherwise(len(edges)).cast("int")


def distance_bands(df: DataFrame, distance: str, direct: str, allocated: str, edges: tuple[float, ...]) -> DataFrame:
    """n, sums and differences by distance band; every band is there, empty ones with n = 0."""
    spark = df.sparkSession
    bands = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("band"))
    both = F.col(direct).isNotNull() & F.col(allocated).isNotNull()
    diff = F.col(allocated) - F.col(direct)
    found = df.where(both).withColumn("band", band_of(F.col(distance), edges)).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(direct).alias("direct_sum"), F.sum(allocated).alias("allocated_sum"), F.avg(diff).alias("mean_diff"), F.avg(F.abs(diff)).alias("mean_abs_diff"))
    return F.broadcast(bands).join(found, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def lowest_control(df: DataFrame, value: str, eligible: Column, water: Column, keys: list[str]) -> DataFrame:
    """Control pixels: those up to the n-th smallest value, cut to n in row-major order.

    n is the number of water pixels, but no more than a tenth of the eligible ones (one at least).
    """
    ok = eligible & F.col(value).isNotNull()
    n_water, n_ok = df.agg(F.count_if(water), F.count_if(ok)).first()
    n = min(n_water, max(1, n_ok // 10))
    held = df.where(ok)
    counts = held.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    cut = order.running(counts, [F.col(value)], F.col("_n"), "_upto").where(F.col("_upto") >= n).agg(F.min(value).alias("_cut"))
    kept = held.join(F.broadcast(cut)).where(F.col(value) <= F.col("_cut")).drop("_cut")  # one row
    return order.numbered(kept, [F.col(k) for k in keys], "_place").where(F.col("_place") <= n).drop("_place")


def comparison(df: DataFrame, a: str, b: str, changed: float = 1e-6, by: list[str] | None = None) -> DataFrame:
    """n, means, MAE, largest difference, changed share and correlation on common support."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    diff = F.col(b) - F.col(a)
    return both.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(diff).alias("mean_diff"), F.avg(F.abs(diff)).alias("mae"), F.sqrt(F.avg(diff * diff)).alias("rmse"), F.max(F.abs(diff)).alias("max_abs"), F.avg((F.abs(diff) > changed).cast("double")).alias("changed_share"), pearson(a, b).alias("pearson"))


def within_cell_residual(df: DataFrame, keys: list[str], value: str, log: bool) -> DataFrame:
    """Value (or log1p of it, cut at 0) less its median by key."""
    x = F.log1p(F.greatest(F.col(value), F.lit(0.0))) if log else F.col(value)
    held = df.withColumn("_x", F.when(F.col(value).isNotNull(), x))
    return held.join(held.groupBy(*keys).agg(F.median("_x").alias("_m")), keys).withColumn("residual", F.col("_x") - F.col("_m")).drop("_x", "_m")


def heldout_predictions(cells: DataFrame, neighbours: DataFrame, k: int) -> DataFrame:
    """Inverse-square-distance prediction from the neighbours, and its rescaling by the proxy."""
    near = neighbours.join(cells.select(F.col("cell_id").alias("near_id"), F.col("radiance").alias("near_radiance"), F.col("proxy_mean").alias("near_proxy")), "near_id")
    w = 1 / (F.col("distance") * F.col("distance"))
    sums = near.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_near"), F.sum(w * F.col("near_radiance")).alias("wr"), F.sum(w * F.col("near_proxy")).alias("wp"), F.sum(w).alias("w"), F.min("distance").alias("nearest_m"))
    out = cells.join(sums, "cell_id", "left")
    base = F.when(F.col("n_near") >= k, F.col("wr") / F.col("w"))
    proxy = F.when(F.col("n_near") >= k, F.col("wp") / F.col("w"))
    out = out.withColumn("neighbors_only", base).withColumn("structural", F.when(proxy > 0, base * F.col("proxy_mean") / proxy))
    out = out.withColumn("gain", F.when(F.col("neighbors_only").isNotNull(), F.try_divide(F.col("structural"), F.col("neighbors_only"))))
    stratum = F.when(F.col("gain") < 0.8, "below_0.8").when(F.col("gain") < 1.25, "0.8_to_1.25").when(F.col("gain").isNotNull(), "at_least_1.25")
    return out.withColumn("gain_stratum", stratum).withColumn("observed", F.col("radiance")).drop("wr", "wp", "w")
